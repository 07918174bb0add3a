"""Rendering, the whole run and its report."""

from tessera.operators.render import render_pages
from tessera.operators.tokenize import page_rows
from tessera.options import Options
from tessera.plans import synthetic as syn
from tessera.plans.translation import translate_pages


def _render(spark, htmls):
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return {r.page_id: r.html for r in render_pages(page_rows(df)).collect()}


def test_render_serializer_rules(spark):
    cases = {
        '<p class="x" id="a">a<br>b</p>': '<p class="x" id="a">a<br/>b</p>',
        '<div b="2" a="1">x</div>': '<div a="1" b="2">x</div>',
        "<p>a &amp; b &lt; c &gt; d &copy;</p>": "<p>a &amp; b &lt; c &gt; d ©</p>",
        "<p><b>open": "<p><b>open</b></p>",
        "<style>a>b{}</style>": "<style>a>b{}</style>",
        "<!DOCTYPE html><!-- c --><p>x</p>": "<!DOCTYPE html>\n<!-- c --><p>x</p>",
        "<p>x</b>y</p>": "<p>xy</p>",
        "<img src=x alt>": '<img alt="" src="x"/>',
        "<p title='say \"hi\"'>q</p>": "<p title='say \"hi\"'>q</p>",
    }
    got = _render(spark, list(cases))
    for i, (src, want) in enumerate(cases.items()):
        assert got[i] == want, src


def test_translate_pages_clean_model(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    tr = translate_pages(pages, syn.rot13_translate_backend, Options(), syn.rot13_fit_backend)
    rep = tr.report.collect()
    assert len(rep) == 50
    assert sum(r.s for r in rep) == 950 and sum(r.all for r in rep) == 950
    assert all(r.page_status == "ok" for r in rep)
    out = {r.page_id: r.html for r in tr.out_pages.collect()}
    assert len(out) == 50
    src = {r.page_id: r.html for r in pages.collect()}
    # the letter rotation is undone by a second rotation: structure is kept
    page0 = out[0]
    assert page0.count("<p>") == src[0].count("<p>")
    assert "<!DOCTYPE html>" in page0


def test_translate_markup_faults_and_report(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pages = syn.markup_pages(docs)
    tr = translate_pages(pages, syn.faulty_translate_backend, Options(), syn.faulty_fit_backend)
    rep = {r.page_id: r for r in tr.report.collect()}
    assert len(rep) == 200
    failed = [p for p, r in rep.items() if r.page_status == "failed"]
    assert failed and all(p % 8 == 7 for p in failed)
    tot = {k: sum(getattr(r, k) for r in rep.values()) for k in "scfe"}
    assert tot["c"] > 0 and tot["f"] > 0 and tot["e"] > 0 and tot["s"] > tot["c"]
    assert tr.out_pages.count() == 200 - len(failed)
    # class 6 pages get replies cut at the length limit: still used, and counted
    assert all(r.truncated > 0 for p, r in rep.items() if p % 8 == 6 and r.all > 0)
    assert all(r.truncated == 0 for p, r in rep.items() if p % 8 != 6)
    # every fit round was written; no group got more than 11 attempts
    attempts = [a for a in range(12) if __import__("os").path.exists(tr.work.path(f"fit_round_{a}"))]
    assert attempts and max(attempts) <= 10


def test_keep_mode_isolates_segments(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pages = syn.markup_pages(docs)
    tr = translate_pages(pages, syn.faulty_translate_backend, Options(on_segment_error="keep"), syn.rot13_fit_backend)
    rep = tr.report.collect()
    assert all(r.page_status == "ok" for r in rep)
    assert sum(r.e for r in rep if r.page_id % 8 == 7) > 0
    assert tr.out_pages.count() == 200


def test_report_line_and_skipped(spark):
    from tessera.operators.report import report_line
    from tessera.operators.segments import skipped_groups

    rep = spark.createDataFrame([(1, 3, 1, 0, 0, 4)], "page_id long, s int, c int, f int, e int, all int")
    assert report_line(rep).first().line == "3 fitted, 1 partly, 0 not, of 4 groups"
    g = spark.createDataFrame([(1, 0, 5), (1, 1, 50)], "page_id long, group_no int, n_tokens int")
    assert [(r.group_no, r.reason) for r in skipped_groups(g, 20).collect()] == [(1, "oversize")]


def test_render_shape_matches_example_output(spark):
    """Rendering the example page without edits gives the same tags and the
    same whitespace-only text as the example's translated output page."""
    import os
    import re

    import pytest

    src_p = os.environ.get("TESSERA_EXAMPLE_PAGE", "")
    out_p = os.environ.get("TESSERA_EXAMPLE_OUTPUT", "")
    if not (os.path.exists(src_p) and os.path.exists(out_p)):
        pytest.skip("set TESSERA_EXAMPLE_PAGE and TESSERA_EXAMPLE_OUTPUT to the example pair")
    with open(src_p, encoding="utf-8") as f:
        src = f.read()
    with open(out_p, encoding="utf-8") as f:
        out = f.read()
    mine = _render(spark, [src])[0]
    assert re.findall(r"<[^>]+>", mine) == re.findall(r"<[^>]+>", out)
    assert re.findall(r">(\s+)<", mine) == re.findall(r">(\s+)<", out)


def _fixed_backend(contents):
    def run(requests):
        from pyspark.sql import functions as F

        expr = F.lit(None).cast("string")
        for pid, text in contents.items():
            expr = F.when(F.col("page_id") == pid, F.lit(text)).otherwise(expr)
        return requests.select(
            "*", F.lit(1).alias("calls"), expr.alias("content"), F.lit("stop").alias("finish_reason"),
            F.lit(None).cast("string").alias("error"),
        )

    return run


def test_translate_stage_faults(spark):
    html = "<p>alpha</p><p>beta</p><p>gamma</p>"
    pages = spark.createDataFrame([(p, f"u{p}", html) for p in (1, 2, 3)], "page_id long, url string, html string")
    contents = {1: '{"0":"x","1":2}', 2: '{"0":"x","7":"y"}', 3: "garbage"}
    for mode in ("fail_page", "keep"):
        tr = translate_pages(pages, _fixed_backend(contents), Options(on_segment_error=mode), syn.rot13_fit_backend)
        out = {(r.page_id, r.group_no): r.status for r in tr.outcomes.collect()}
        rep = {r.page_id: r for r in tr.report.collect()}
        assert (out[(1, 0)], out[(1, 1)], out[(1, 2)]) == ("S", "E", "M")
        if mode == "fail_page":
            assert rep[2].page_status == "failed" and rep[3].page_status == "failed"
            assert {r.page_id for r in tr.out_pages.collect()} == {1}
        else:
            assert (out[(2, 0)], out[(2, 1)], out[(2, 2)], out[(2, None)]) == ("S", "M", "M", "U")
            assert all(out[(3, g)] == "E" for g in range(3))
            assert rep[2].u == 1 and rep[3].e == 3
            assert {r.page_id for r in tr.out_pages.collect()} == {1, 2, 3}
        pages_out = {r.page_id: r.html for r in tr.out_pages.collect()}
        assert pages_out[1] == "<p>x</p><p>beta</p><p>gamma</p>"


def test_resume_does_not_call_again(spark):
    from tessera.session import WorkArea

    calls = []

    def counting(requests):
        calls.append(1)
        return syn.rot13_translate_backend(requests)

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    run_id = "resume-test-" + __import__("uuid").uuid4().hex
    first = translate_pages(pages, counting, Options(), syn.rot13_fit_backend, work=WorkArea(spark, run_id, resume=True))
    a = sorted(tuple(r) for r in first.report.collect())
    assert len(calls) == 1
    again = translate_pages(pages, counting, Options(), syn.rot13_fit_backend, work=WorkArea(spark, run_id, resume=True))
    assert sorted(tuple(r) for r in again.report.collect()) == a
    assert len(calls) == 1
