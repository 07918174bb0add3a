"""Directory trees and the file stream."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tessera.options import Options
from tessera.plans import synthetic as syn
from tessera.session import WorkArea
from tessera.sources.tree import file_extension, plan_tree, scan_tree, translate_tree
from tessera.streaming.pages_stream import translate_stream


def _write(root, rel, text):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)


def test_extension_rule(spark):
    names = ["a/b.html", "a/.html", "a/x.HTML", "a/x.htm", "a/b.c.html", "a/noext", "a/x.", "a..html"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = [r.e for r in df.select(file_extension(df.p).alias("e")).collect()]
    assert got == [os.path.splitext(n)[1] for n in names]


def test_plan_prefix_only(spark):
    df = spark.createDataFrame([("/src/a/src/b.html",)], "path string")
    rows = plan_tree(df, "/src", "/dst").collect()
    assert [(r.rel_path, r.action, r.target_path) for r in rows] == [("a/src/b.html", "translate", "/dst/a/src/b.html")]


@pytest.mark.parametrize("root", ["/src", "/src/", "file:///src", "file:/src", "/src/../src", "/x/../src/."])
@pytest.mark.parametrize("path", ["/src/a/b.html", "file:/src/a/b.html", "file:///src/a/b.html", "hdfs://nn:8020/src/a/b.html"])
def test_plan_root_spellings(spark, root, path):
    assert plan_tree(spark.createDataFrame([(path,)], "path string"), root, "/dst").first().rel_path == "a/b.html"


def test_plan_outside_the_root_is_an_error(spark):
    df = spark.createDataFrame([("/src/a.html",), ("/srcs/c.html",)], "path string")
    with pytest.raises(Exception, match="not under /src"):
        plan_tree(df, "/src", "/dst").collect()


TREE = {
    "index.html": "<html><body><p>Hello <b>big</b> world</p></body></html>",
    "docs/a.html": "<p>Install <code>pkg</code> now</p>",
    "docs/style.css": "p{}",
    "_u.html": "<p>one</p>", ".hid.html": "<p>two</p>", "_modules/m.html": "<p>three</p>", "_static/s.css": "q{}", "_static/.x/_y": "z",
    "empty.html": "", "empty.css": "", "sp ace/%41 é.html": "<p>four</p>",
}


def _tree(root):
    for rel, text in TREE.items():
        _write(root, rel, text)


def _read(root):
    out = {}
    for d, _, names in os.walk(root):
        for n in names:
            with open(os.path.join(d, n), "rb") as f:
                out[os.path.relpath(os.path.join(d, n), root)] = f.read()
    return out


def _rot(s):
    return s.translate(str.maketrans("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM"))


def _run(spark, src, dst, backend=syn.rot13_translate_backend, **kw):
    return translate_tree(spark, src, dst, backend, Options(), syn.rot13_fit_backend, **kw)


@pytest.mark.parametrize("form", ["plain", "uri", "relative"])
def test_translate_whole_tree_and_rerun(spark, tmpdir_path, form):
    src, dst = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "dst")
    _tree(src)
    assert scan_tree(spark, src, WorkArea(spark)).count() == len(TREE)
    name = {"plain": lambda p: p, "uri": lambda p: f"file://{p}", "relative": lambda p: os.path.relpath(p)}[form]
    done = _run(spark, name(src), name(dst))
    assert done.tasks == 7 and done.report.count() == 7 and done.report.filter("page_status <> 'ok'").count() == 0
    got = _read(dst)
    assert set(got) == set(TREE)
    assert got["index.html"].decode() == "<html><body><p>Uryyb <b>ovt</b> jbeyq</p></body></html>"
    for rel, text in TREE.items():
        if not rel.endswith(".html"):
            assert got[rel].decode() == text
    assert got["_u.html"].decode() == f"<p>{_rot('one')}</p>" and got[".hid.html"].decode() == f"<p>{_rot('two')}</p>"
    assert got["empty.html"] == b"" and got["sp ace/%41 é.html"].decode() == f"<p>{_rot('four')}</p>"
    # second run: every target exists, nothing to do
    assert _run(spark, name(src), name(dst)).tasks == 0
    # a target that is gone is made again, the others are left alone
    os.remove(os.path.join(dst, "_u.html"))
    _write(dst, "docs/a.html", "mine")
    assert _run(spark, name(src), name(dst)).tasks == 1
    assert _read(dst)["docs/a.html"] == b"mine" and "_u.html" in _read(dst)


def test_odd_files_do_not_stop_the_others(spark, tmpdir_path):
    src, dst = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "dst")
    _write(src, "good.html", "<p>one</p>")
    _write(src, "marked.html", "<p>a<![foo[x]]>b</p>")
    with open(os.path.join(src, "latin.html"), "wb") as f:
        f.write("<p>é</p>".encode("latin-1"))
    done = _run(spark, src, dst)
    status = {r.url: (r.page_status, r.page_error) for r in done.report.collect()}
    assert status["good.html"] == ("ok", None)
    assert status["marked.html"][0] == status["latin.html"][0] == "failed"
    assert "UnicodeDecodeError" in status["latin.html"][1] and "AssertionError" in status["marked.html"][1]
    assert set(_read(dst)) == {"good.html"}
    assert _run(spark, src, dst, encoding="latin-1").tasks == 2  # tried again, now readable
    assert "latin.html" in _read(dst)


def _broken(reqs):
    return syn.rot13_translate_backend(reqs).withColumn("content", F.lit("no"))


def test_stream_passes(spark, tmpdir_path):
    src, dst = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "dst")
    ckpt, rep = os.path.join(tmpdir_path, "ckpt"), os.path.join(tmpdir_path, "rep")

    def stream(backend=syn.rot13_translate_backend):
        q = translate_stream(spark, src, dst, ckpt, backend, Options(), syn.rot13_fit_backend, report_path=rep)
        q.awaitTermination(120)

    _write(src, "one.html", "<p>one</p>")
    _write(src, "_hidden.html", "<p>two</p>")
    stream(_broken)
    assert _read(dst) == {}
    stream()  # the same checkpoint, a model that answers: what failed is done now
    assert set(_read(dst)) == {"one.html", "_hidden.html"}
    _write(dst, "one.html", "mine")
    time.sleep(1.1)
    _write(src, "two.html", "<p>two</p>")
    _write(src, "s.css", "")
    stream()
    assert _read(dst) == {"one.html": b"mine", "_hidden.html": f"<p>{_rot('two')}</p>".encode(), "two.html": f"<p>{_rot('two')}</p>".encode(), "s.css": b""}
    assert spark.read.parquet(rep).filter("url = 'two.html' and page_status = 'ok'").count() == 1


def test_listing_goes_through_tasks_level_by_level(spark, tmpdir_path, monkeypatch):
    """Deep and wide trees, odd names, links and folders that can't be listed; the
    driver lists nothing itself."""
    from tessera.sources import files

    root = os.path.join(tmpdir_path, "src")
    names = {f"d{i % 7}/e{i % 3}/f{i}.html" for i in range(200)} | {"top.txt", ".h/.x", "_u/_v/_w/deep", "sp ace/%41 é"}
    for n in names:
        _write(root, n, n)
    os.makedirs(os.path.join(root, "none/at/all"))
    os.symlink(root, os.path.join(root, "loop"))
    os.symlink(os.path.join(root, "top.txt"), os.path.join(root, "link.txt"))
    os.symlink(os.path.join(root, "nowhere"), os.path.join(root, "dead.txt"))
    monkeypatch.setattr(files, "scan_folder", lambda path: 1 / 0)  # in this process
    got = {r.path[len("file:" + root) + 1 :]: r for r in scan_tree(spark, root, WorkArea(spark)).collect()}
    assert set(got) == names | {"link.txt", "dead.txt"}
    assert all(got[n].length == len(n.encode()) and got[n].modified > 1e9 and got[n].error is None for n in names)
    assert scan_tree(spark, os.path.join(tmpdir_path, "missing"), WorkArea(spark)).count() == 0
    assert [r.error is None for r in scan_tree(spark, os.path.join(root, "top.txt"), WorkArea(spark)).collect()] == [False]


def test_tree_delta(spark, tmpdir_path):
    from tessera.sources.files import tree_delta

    for n in "abc":
        _write(tmpdir_path, f"{n}.txt", n)
    work = WorkArea(spark)
    before = scan_tree(spark, tmpdir_path, work, "before")
    os.remove(os.path.join(tmpdir_path, "a.txt"))
    _write(tmpdir_path, "b.txt", "longer")
    _write(tmpdir_path, "x/d.txt", "d")
    change = {os.path.basename(r.path): r.change for r in tree_delta(scan_tree(spark, tmpdir_path, work, "now"), before).collect()}
    assert change == {"a.txt": "gone", "b.txt": "changed", "d.txt": "new"}


def test_a_large_file_is_copied_in_bounded_memory(tmpdir_path):
    """2.2 GB (a sparse file), block by block."""
    import resource

    from tessera.sources.files import copy_file

    src, dst = os.path.join(tmpdir_path, "big"), os.path.join(tmpdir_path, "x", "big")
    size = (2 << 30) + (200 << 20)
    with open(src, "wb") as f:
        f.write(b"start")
        f.seek(size - 3)
        f.write(b"end")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    copy_file(src, dst)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10
    assert os.path.getsize(dst) == size and os.listdir(os.path.dirname(dst)) == ["big"]
    with open(dst, "rb") as f:
        assert f.read(5) == b"start"
        f.seek(size - 3)
        assert f.read() == b"end"
    os.truncate(src, 0)
    os.truncate(dst, 0)


def test_copy_errors_are_rows(spark, tmpdir_path):
    src, dst = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "dst")
    _write(src, "a/good.css", "x")
    _write(src, "b/blocked.css", "y")
    _write(dst, "b", "a file where a folder should be")
    done = _run(spark, src, dst)
    assert [(r.rel_path, r.file_error[:11]) for r in done.copy_errors.collect()] == [("b/blocked.css", "not copied:")]
    assert _read(dst)["a/good.css"] == b"x"


def test_an_aborted_write_leaves_no_file(spark, tmpdir_path):
    """Staging fails in one task: no target and no part is left. A run that breaks
    while it renames goes on."""
    from tessera.sources import files

    dst = os.path.join(tmpdir_path, "dst")
    rows = [(f"{dst}/d{i % 3}/f{i}.html", f"page {i}") for i in range(50)]
    good = spark.createDataFrame([*rows, (f"{dst}/null.html", None)], "target string, html string").repartition(5)
    bad = good.unionByName(spark.createDataFrame([(f"{dst}/bad.html", "x")], "target string, html string")).withColumn(
        "html", F.when(F.col("target").endswith("bad.html"), F.raise_error(F.lit("lost"))).otherwise(F.col("html")))
    with pytest.raises(Exception, match="lost"):
        files.publish_files(bad, "target", "html", dst, WorkArea(spark), "pages")
    assert _read(dst) == {} and os.listdir(tmpdir_path) in ([], ["dst"])
    work = WorkArea(spark, "publish-" + os.path.basename(tmpdir_path), resume=True)
    staged = work.write(files.stage_files(good, "target", "html", f"{dst}/{files.STAGING}x"), "pages_staged").collect()
    files.move_file(staged[0].part, staged[0].target)  # some were renamed before the run broke
    out = files.publish_files(good, "target", "html", dst, work, "pages")
    assert out.count() == 50 and _read(dst) == {os.path.relpath(p, dst): t.encode() for p, t in rows} | {k: v for k, v in _read(dst).items() if k.startswith(files.STAGING)}


def test_a_batch_touches_its_own_files_only(spark, tmpdir_path, monkeypatch):
    """After the first pass no tree is listed; failed pages come again when they are
    due, with one try more each time."""
    from tessera.sources import tree
    from tessera.streaming import pages_stream as ps

    src, dst = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "dst")
    ckpt, rep = os.path.join(tmpdir_path, "ckpt"), os.path.join(tmpdir_path, "rep")
    listed, list_tree, now = [], tree.list_tree, [1000.0]
    monkeypatch.setattr(tree, "list_tree", lambda spark, root, work, name: listed.append(root) or list_tree(spark, root, work, name))

    def backend(reqs):
        bad = F.exists("messages", lambda m: m["content"].contains("unlucky"))
        out = syn.rot13_translate_backend(reqs)
        return out.withColumn("content", F.when(bad & F.lit(now[0] < 1010), F.lit("no")).otherwise(F.col("content")))

    def batch(k, *names):
        return run(spark.createDataFrame([(f"file:{src}/{n}",) for n in names], "path string"), k)

    runs = []
    monkeypatch.setattr(ps, "start_query", lambda arrivals, run_batch, *a: runs.append(run_batch))
    _write(src, "old.html", "<p>old</p>")
    ps.translate_stream(spark, src, dst, ckpt, backend, Options(backoff_init_delay=2.0), syn.rot13_fit_backend, report_path=rep, clock=lambda: now[0])
    run = runs[0]
    assert len(listed) == 2 and set(_read(dst)) == {"old.html"}
    _write(src, "one.html", "<p>one</p>")
    _write(src, "bad.html", "<p>unlucky</p>")
    _write(src, "s.css", "s")
    batch(0, "one.html", "bad.html", "s.css", "old.html")
    assert set(_read(dst)) == {"old.html", "one.html", "s.css"}
    state = lambda k: [(r.rel_path, r.tries, r.due) for r in spark.read.parquet(f"{ckpt}/page_state/{k}").collect()]
    assert state(0) == [("bad.html", 1, 1002.0)]
    now[0] = 1001.0
    batch(1, "one.html")  # not due yet; the target is there
    assert state(1) == state(0)
    now[0] = 1003.0
    batch(2)
    assert state(2) == [("bad.html", 2, 1007.0)]
    now[0] = 1010.0
    batch(3)
    assert state(3) == [] and _read(dst)["bad.html"].decode() == f"<p>{_rot('unlucky')}</p>"
    assert len(listed) == 2  # as at the start
    tried = {(r.url, r.batch_id): r.page_status for r in spark.read.parquet(rep).collect()}
    assert tried == {("old.html", -1): "ok", ("one.html", 0): "ok", ("bad.html", 0): "failed", ("bad.html", 2): "failed", ("bad.html", 3): "ok"}
