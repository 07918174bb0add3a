"""Per-page report and error isolation.

Statuses per group: ``S`` success, ``C`` compromise, ``F`` no fit found,
``E`` error in that group, ``M`` no translation came back for it, ``X``
oversize (never sent). ``U`` rows are reply keys with no group. ``all``
counts S, C, F and E, the results of the groups that were worked on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOME_COLS = ["page_id", "group_no", "status", "score", "error"]


def page_report(
    outcomes: DataFrame, pages: DataFrame, failed: DataFrame | None = None, segments: DataFrame | None = None
) -> DataFrame:
    """I1 (+ I4, E8): one row per input page.

    ``failed(page_id, error)`` lists pages lost to a segment error; their
    counts are zero and ``page_status`` is ``failed``. ``segments(page_id,
    truncated)`` (optional) adds ``truncated``, the number of replies that
    stopped at the length limit. Counting is a partial aggregate; only the
    per-page counts meet the page list.
    """

    def n(s):
        return F.count_if(F.col("status") == s).cast("int").alias(s.lower())

    counts = outcomes.groupBy("page_id").agg(n("S"), n("C"), n("F"), n("E"), n("M"), n("U"), n("X"))
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url")
    rep = pages.select("page_id", url).join(counts, "page_id", "left")
    if failed is not None:
        f = failed.groupBy("page_id").agg(F.min("error").alias("page_error"))
        rep = rep.join(f, "page_id", "left")
    else:
        rep = rep.withColumn("page_error", F.lit(None).cast("string"))
    if segments is not None:
        t = segments.groupBy("page_id").agg(F.count_if(F.col("truncated")).cast("int").alias("truncated"))
        rep = rep.join(t, "page_id", "left")
    else:
        rep = rep.withColumn("truncated", F.lit(None).cast("int"))
    zero = F.lit(0)
    for c in ["s", "c", "f", "e", "m", "u", "x"]:
        rep = rep.withColumn(c, F.when(F.col("page_error").isNotNull(), zero).otherwise(F.coalesce(F.col(c), zero)))
    return rep.select(
        "page_id",
        "url",
        "s",
        "c",
        "f",
        "e",
        (F.col("s") + F.col("c") + F.col("f") + F.col("e")).alias("all"),
        "m",
        "u",
        "x",
        F.coalesce(F.col("truncated"), zero).alias("truncated"),
        F.when(F.col("page_error").isNotNull(), F.lit("failed")).otherwise(F.lit("ok")).alias("page_status"),
        "page_error",
    )


def report_line(report: DataFrame) -> DataFrame:
    """A console line for a finished page: its groups by outcome."""
    return report.select(
        "page_id",
        F.format_string("%d fitted, %d partly, %d not, of %d groups", "s", "c", "f", "all").alias("line"),
    )
