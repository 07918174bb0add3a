"""The whole page translation as one Spark plan with two call stages.

``translate_pages(pages, backend)`` takes ``pages(page_id, url, html)`` and a
backend (see ``tessera.operators.calls``) and returns every table of the
run: fragments, planned groups, replies, outcomes, rendered pages and the
per-page report.

Materialization points (written to the shared checkpoint folder):
the errors of unreadable pages and the oversize groups, the translation replies, their
segment status, what became of every group of a reply, the validated replies of every fit
round, and the outcomes. Texts are stored with the replies only, and those of groups that
wait for a fit with the round before; shuffle files go when a stage is stored. Model calls are never repeated by a retried stage,
and with a resumable work area not by a restarted driver either.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.json_reply import computed_once
from tessera.operators.calls import Backend, call_model
from tessera.functions.text import token_count
from tessera.operators.fit import KEYS, best_candidate, chosen_edits, fit_rounds, route_groups
from tessera.operators.groups import SHREDS_DDL, groups_by_page, page_groups
from tessera.operators.render import render_pages
from tessera.operators.replies import explode_reply_groups, segment_status, unknown_key_rows
from tessera.operators.report import OUTCOME_COLS, page_report
from tessera.operators.requests import translate_requests
from tessera.operators.segments import page_faults, page_segments, plan_segments, skipped_groups
from tessera.operators.tokenize import fragments, read_errors
from tessera.options import Options
from tessera.session import WorkArea, slim_stages


@dataclass
class Translation:
    fragments: DataFrame
    planned: DataFrame
    replies: DataFrame
    outcomes: DataFrame
    failed: DataFrame
    out_pages: DataFrame
    report: DataFrame
    work: WorkArea


def _outcome(df: DataFrame, status, score=None, error=None) -> DataFrame:
    return df.select(
        "page_id",
        F.col("group_no").cast("int").alias("group_no"),
        (F.lit(status) if isinstance(status, str) else status).alias("status"),
        (F.lit(score) if not hasattr(score, "alias") else score).cast("double").alias("score"),
        (F.lit(error) if not hasattr(error, "alias") else error).cast("string").alias("error"),
    )


#: Up to so many failed pages (8 MB of ids) are broadcast where their segments are left out;
#: beyond, the segments are joined by page.
BROADCAST_PAGES = 1 << 20


REPLY_ROWS_DDL = (
    f"request_id string, page_id long, seg_no int, model string, temperature double, groups array<struct<seg_key:int,group_no:int,n_shreds:int,shreds:{SHREDS_DDL}>>, "
    "calls int, content string, finish_reason string, error string, whole int"
)


def _twofold(backend: Backend) -> Backend:
    """Every reply as two rows: by itself (``whole`` 0) and with its groups, whose texts are
    those of their shreds (1)."""

    def two(replies: DataFrame) -> DataFrame:
        r = replies.withColumn("whole", F.explode(F.array(F.lit(0), F.lit(1))))
        groups = F.transform("groups", lambda g: F.struct(*[g[c].alias(c) for c in ("seg_key", "group_no", "n_shreds", "shreds")]))
        return r.withColumn("groups", F.when(F.col("whole") == 1, groups))

    def run(requests: DataFrame) -> DataFrame:
        return two(backend(requests))

    if hasattr(backend, "stage"):
        run.stage = lambda requests, area, name: two(backend.stage(requests, area, name))
    return run


def _without(rows: DataFrame, failed: DataFrame, n: int) -> DataFrame:
    """Rows of other pages than ``failed(page_id)``, ``n`` different ones."""
    if not n:
        return rows
    return rows.join(F.broadcast(failed) if n <= BROADCAST_PAGES else failed, "page_id", "left_anti")


def translate_pages(
    pages: DataFrame,
    backend: Backend,
    options: Options = Options(),
    fit_backend: Backend | None = None,
    work: WorkArea | None = None,
    token_counter=None,
    clustered: bool = False,
) -> Translation:
    """Translate all pages; see the module doc for the stages.

    ``token_counter`` (optional) maps a text column to its token count
    (default: the built-in rule; ``vocab_token_count`` for a vocabulary). ``clustered``: pages
    with one id are in one partition as they come and need not be dealt out again.
    """
    work = work or WorkArea(pages.sparkSession)
    with slim_stages(pages.sparkSession):
        return _translate(pages, backend, options, fit_backend or backend, work, token_counter, clustered)


def _translate(pages: DataFrame, backend: Backend, options: Options, fit_backend: Backend, work: WorkArea, token_counter, clustered: bool) -> Translation:
    # B1 wherever it is needed: a page's fragments are some tens of times its html, so
    # grouping and rendering tokenize what they read, and no fragment is stored.
    frags = fragments(pages, options.page_partitions)
    # B2-B12, C1-C7; a page's groups stay in its row, so that they need not meet again.
    planned = plan_segments(page_groups(pages, counter=token_counter), options.max_tokens, carry=["text", "n_shreds", "shreds"])
    if token_counter is None:
        by_page = groups_by_page(pages, clustered)
        faults = page_faults(by_page, options.max_tokens, token_count)
        segments = page_segments(by_page, options.max_tokens, token_count)
    else:  # it may be a Python function, which works on rows only
        errors = read_errors(pages, options.page_partitions).withColumn("group_no", F.lit(None).cast("int"))
        over = skipped_groups(page_groups(pages, counter=token_counter), options.max_tokens)
        faults = errors.unionByName(over.select("page_id", F.lit(None).cast("string").alias("error"), "group_no"))
        segments = planned.filter(F.col("seg_no").isNotNull())
    faults = work.write(faults, "page_faults")
    unreadable = faults.filter(F.col("error").isNotNull()).select("page_id", "error")

    # One request per segment; replies stored before use.
    # A reply is stored for good, and with its groups (``whole`` 1) until these are read.
    stored = call_model(translate_requests(segments, options), _twofold(backend), work, "translate_replies", by="whole", schema=REPLY_ROWS_DDL)
    replies = stored.filter(F.col("whole") == 0).drop("whole", "groups")

    # F1-F6, I5
    status = segment_status(stored.filter(F.col("whole") == 1).drop("whole"))
    group_nos = F.when(F.col("seg_error").isNotNull(), F.col("groups.group_no")).alias("group_nos")
    seg = work.write(status.select("page_id", "seg_no", "seg_error", "truncated", "unknown_keys", group_nos), "segments")
    if options.on_segment_error == "fail_page":
        failed = seg.filter(F.col("seg_error").isNotNull()).select("page_id", F.col("seg_error").alias("error")).unionByName(unreadable)
        failed_pages = failed.select("page_id").distinct()
        usable = _without(status, failed_pages, failed_pages.count())
        seg_errors = None
        unknown = None
    else:
        failed = unreadable
        bad = F.col("seg_error").isNotNull() & ~F.col("seg_error").startswith("unknown key")
        fine = ~bad | F.col("seg_error").isNull()
        usable = status.filter(fine)
        seg_errors = seg.filter(bad)
        unknown = unknown_key_rows(seg.filter(fine))

    # G3-G5 routing; a group that takes its translation whole is stored with it
    routed = route_groups(explode_reply_groups(usable))
    usual = F.col("present") & ~F.col("non_string")
    routed = computed_once(routed.withColumn("route", F.when(usual, F.col("route"))), "route", "trans_text")
    whole = F.col("route") == "single"
    rows = work.write(routed.select(
        *KEYS, "present", "non_string", "route", F.when(whole, F.col("shreds")[0]["frag_no"]).alias("frag_no"), F.when(whole, F.col("trans_text")).alias("new_text")
    ), "reply_groups")
    unchanged = rows.filter(F.col("route") == "unchanged")
    single = rows.filter(F.col("route") == "single")

    # G6-G10 fit rounds
    cands = fit_rounds(routed.filter(F.col("route") == "multi"), fit_backend, options, work)
    work.drop("translate_replies/whole=1")
    best = best_candidate(cands.select(*KEYS, "attempt", "score", "status", "error"))
    fitted = rows.filter(F.col("route") == "multi").select(*KEYS).join(best, KEYS, "left")

    parts = [
        _outcome(unchanged, "S", 1.0),
        _outcome(single, "S", 1.0),
        _outcome(fitted, F.coalesce(F.col("status"), F.lit("F")), F.col("score"), F.col("error")),
        _outcome(rows.filter(~F.col("present")), "M", None, "no translation for this key"),
        _outcome(rows.filter(F.col("present") & F.col("non_string")), "E", None, "translation is not a string"),
        _outcome(faults.filter(F.col("group_no").isNotNull()), "X", None, "oversize"),
    ]
    if seg_errors is not None:
        parts.append(
            _outcome(seg_errors.select("page_id", F.explode("group_nos").alias("group_no"), "seg_error"),
                     "E", None, F.col("seg_error"))
        )
        parts.append(
            unknown.select("page_id", F.lit(None).cast("int").alias("group_no"), F.lit("U").alias("status"),
                           F.lit(None).cast("double").alias("score"),
                           F.concat(F.lit("unknown key "), F.col("key")).alias("error"))
        )
    outcomes = parts[0]
    for p in parts[1:]:
        outcomes = outcomes.unionByName(p)
    if options.on_segment_error == "fail_page":  # an unreadable page has no outcomes to leave out
        outcomes = outcomes.join(failed.select("page_id").distinct(), "page_id", "left_anti")
    outcomes = work.write(outcomes.select(*OUTCOME_COLS), "outcomes")

    # H1, H2, I4
    out_pages = render_pages(pages, chosen_edits(cands, single), failed)
    report = page_report(outcomes, pages, failed, seg.select("page_id", "truncated"))
    return Translation(frags, planned, replies, outcomes, failed, out_pages, report, work)
