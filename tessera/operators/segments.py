"""Token counts, page totals and token-bounded segments.

Packing rule: the page total (oversize groups included) fixes
``n = ceil(total / max)`` and an even target ``ceil(total / n)``. Groups are
taken in order; a group above ``max`` is skipped; a new segment opens when
the running sum of the current one is strictly above the target and the
segment is not empty. Keys restart at 0 in every segment.

The fold is order-dependent with a reset, so it is not a window sum. It runs
as a native ``aggregate`` over the page's kept groups and records only the
segment *breakpoints*; the per-group segment number and key then come from
``posexplode`` plus a count over the (short) breakpoint list. Cost is
O(groups x segments) per page instead of an O(groups^2) array append. The
page-level ``collect_list`` runs on the ``page_id`` partitioning the groups
already have, so no new exchange is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.options import DEFAULT_ENCODING, ENCODING_MAP


def page_tokens(groups: DataFrame, max_tokens: int) -> DataFrame:
    """``(page_id, n_groups, total_tokens, n_seg, seg_target)``; pages with 0 tokens dropped."""
    t = groups.groupBy("page_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_groups"),
        F.sum("n_tokens").cast("long").alias("total_tokens"),
    )
    t = t.filter(F.col("total_tokens") > 0)
    n_seg = F.ceil(F.col("total_tokens") / F.lit(max_tokens)).cast("long")
    return t.withColumn("n_seg", n_seg).withColumn(
        "seg_target", F.ceil(F.col("total_tokens") / F.col("n_seg")).cast("long")
    )


def skipped_groups(groups: DataFrame, max_tokens: int) -> DataFrame:
    """``skipped(page_id, group_no, n_tokens, reason)`` - groups above the maximum."""
    return groups.filter(F.col("n_tokens") > max_tokens).select(
        "page_id", "group_no", "n_tokens", F.lit("oversize").alias("reason")
    )


def _per_page(groups: DataFrame, max_tokens: int, carry: list[str]) -> DataFrame:
    item = F.struct(
        F.col("group_no"), F.col("n_tokens").cast("long").alias("n_tokens"), *[F.col(c) for c in carry]
    )
    return _broken(groups.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("g")), max_tokens)


def _broken(per_page: DataFrame, max_tokens: int) -> DataFrame:
    """Pages with their groups ``g`` in order: those kept, and where segments start."""
    total = F.aggregate("g", F.lit(0).cast("long"), lambda acc, x: acc + x["n_tokens"])
    per_page = per_page.withColumn("total", total).filter(F.col("total") > 0)
    n_seg = F.ceil(F.col("total") / F.lit(max_tokens))
    per_page = per_page.withColumn("target", F.ceil(F.col("total") / n_seg).cast("long"))
    per_page = per_page.withColumn("kept", F.filter("g", lambda x: x["n_tokens"] <= F.lit(max_tokens)))

    def step(acc, x):
        new_seg = (acc["cnt"] > F.col("target")) & (acc["k"] > 0)
        return F.when(
            new_seg,
            F.struct(
                x["n_tokens"].alias("cnt"),
                F.lit(1).alias("k"),
                (acc["i"] + 1).alias("i"),
                F.concat(acc["starts"], F.array(acc["i"])).alias("starts"),
            ),
        ).otherwise(
            F.struct(
                (acc["cnt"] + x["n_tokens"]).alias("cnt"),
                (acc["k"] + 1).alias("k"),
                (acc["i"] + 1).alias("i"),
                acc["starts"].alias("starts"),
            )
        )

    init = F.struct(
        F.lit(0).cast("long").alias("cnt"),
        F.lit(0).alias("k"),
        F.lit(0).alias("i"),
        F.array(F.lit(0)).alias("starts"),
    )
    return per_page.withColumn("starts", F.aggregate("kept", init, step)["starts"])


def _segments(per_page: DataFrame) -> DataFrame:
    """One row per segment: ``(page_id, seg_no, _segment)``."""
    def cut(start, i):
        end = F.coalesce(F.get("starts", i + 1), F.size("kept"))
        return F.slice("kept", start + 1, end - start)

    return per_page.select("page_id", F.posexplode(F.transform("starts", cut)).alias("seg_no", "_segment"))


def page_segments(pages: DataFrame, max_tokens: int, counter) -> DataFrame:
    """C1-C7 on a row per page (``groups_by_page``), where the groups of a page need not meet
    any more: a row per segment, ``(page_id, seg_no, groups)``, as ``translate_requests`` takes it."""
    item = ("group_no", "text", "n_shreds", "shreds")
    counted = F.transform("groups", lambda g: F.struct(g["group_no"].alias("group_no"), counter(g["text"]).cast("long").alias("n_tokens"), *[g[c].alias(c) for c in item[1:]]))
    segments = _segments(_broken(pages.select("page_id", counted.alias("g")), max_tokens)).filter(F.size("_segment") > 0)
    keyed = F.transform("_segment", lambda g, i: F.struct(i.alias("seg_key"), *[g[c].alias(c) for c in item]))
    return segments.select("page_id", F.col("seg_no").cast("int").alias("seg_no"), keyed.alias("groups"))


def page_faults(pages: DataFrame, max_tokens: int, counter) -> DataFrame:
    """I4, C5 on a row per page (``groups_by_page``): ``(page_id, error, group_no)`` of pages that
    can't be read (``group_no`` null) and of groups above the maximum (``error`` null)."""
    over = F.transform(F.filter("groups", lambda g: counter(g["text"]) > F.lit(max_tokens)), lambda g: g["group_no"])
    found = F.when(F.col("error").isNotNull(), F.array(F.lit(None).cast("int"))).otherwise(over)
    return pages.select("page_id", "error", F.explode(found).alias("group_no"))


def _kept_rows(per_page: DataFrame, carry: list[str]) -> DataFrame:
    """One row per kept group. The groups are cut into their segments first, so that
    a row of a segment holds that segment only, and every group is looked at once."""
    segments = _segments(per_page)
    out = segments.select("page_id", F.col("seg_no").cast("int").alias("seg_no"), F.posexplode("_segment").alias("seg_key", "x"))
    return out.select(
        "page_id",
        F.col("x.group_no").alias("group_no"),
        "seg_no",
        F.col("seg_key").cast("int").alias("seg_key"),
        F.col("x.n_tokens").alias("n_tokens"),
        *[F.col("x." + c).alias(c) for c in carry],
    )


def segment_groups(groups: DataFrame, max_tokens: int, carry: list[str] | None = None) -> DataFrame:
    """One row per kept group: ``(page_id, group_no, seg_no, seg_key, n_tokens, *carry)``.

    ``carry`` names extra group columns (e.g. ``text``, ``shreds``) carried
    through the fold so later stages need no join back to ``groups``.
    """
    carry = list(carry or [])
    return _kept_rows(_per_page(groups, max_tokens, carry), carry)


def plan_segments(groups: DataFrame, max_tokens: int, carry: list[str] | None = None) -> DataFrame:
    """C5-C7 in one pass: every group, with ``seg_no``/``seg_key`` null when oversize.

    Both branches read the same per-page aggregate; Spark reuses its exchange.
    Pages whose total is 0 have no segment and are left out.
    """
    carry = list(carry or [])
    per_page = _per_page(groups, max_tokens, carry)
    kept = _kept_rows(per_page, carry)
    over = per_page.select("page_id", F.explode(F.filter("g", lambda x: x["n_tokens"] > F.lit(max_tokens))).alias("x"))
    over = over.select(
        "page_id",
        F.col("x.group_no").alias("group_no"),
        F.lit(None).cast("int").alias("seg_no"),
        F.lit(None).cast("int").alias("seg_key"),
        F.col("x.n_tokens").alias("n_tokens"),
        *[F.col("x." + c).alias(c) for c in carry],
    )
    return kept.unionByName(over)


def encoding_table(spark) -> DataFrame:
    """C2 lookup table (fixed, 7 rows)."""
    return spark.createDataFrame(list(ENCODING_MAP), "model string, encoding string")


def with_encoding(df: DataFrame, model_col: str = "model") -> DataFrame:
    """Model name -> vocabulary name, fallback to the default.

    The lookup side is the fixed 7-row table above, so broadcasting it is
    bounded by construction.
    """
    enc = F.broadcast(encoding_table(df.sparkSession)).withColumnRenamed("model", "_enc_model")
    joined = df.join(enc, df[model_col] == enc["_enc_model"], "left")
    return joined.withColumn("encoding", F.coalesce(F.col("encoding"), F.lit(DEFAULT_ENCODING))).drop("_enc_model")
