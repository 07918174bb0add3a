"""Translation replies matched to the groups of their segment.

The groups of a segment travel inside the request row, so matching a reply
key to its group is a lookup inside the row: no shuffle. ``match_replies``
is the same step as an equi-join, for replies stored apart from requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.json_reply import with_parsed_reply
from tessera.operators.calls import truncated


def segment_status(replies: DataFrame) -> DataFrame:
    """Segment-level reading of a translation reply.

    Adds ``reply`` (parsed map or null), ``_vm`` (the same values as
    variants), ``unknown_keys`` (reply keys with no group in the segment),
    ``truncated`` and ``seg_error``: the reason a segment cannot be used
    (call failed / unreadable reply / unknown key), or null.
    """
    r = with_parsed_reply(replies, "content", "reply", non_string="_any_ns", variants="_vm")
    r = r.withColumn("_keys", F.transform("groups", lambda g: g["seg_key"].cast("string")))
    keys = F.col("_keys")
    r = r.withColumn(
        "unknown_keys",
        F.coalesce(F.filter(F.map_keys("reply"), lambda k: ~F.array_contains(keys, k)), F.array().cast("array<string>")),
    ).drop("_keys")
    r = r.withColumn("truncated", truncated("finish_reason"))
    seg_error = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("call failed: "), F.col("error")))
        .when(F.col("reply").isNull(), F.lit("unreadable reply"))
        .when(F.size("unknown_keys") > 0, F.concat(F.lit("unknown key: "), F.array_join("unknown_keys", ",")))
    )
    return r.withColumn("seg_error", seg_error)


def explode_reply_groups(seg: DataFrame) -> DataFrame:
    """one row per group of each segment with its translation. Groups that are
    stored without their text (it is that of their shreds) get it back.

    Output: ``page_id, seg_no, seg_key, group_no, n_shreds, shreds,
    src_text, trans_text, present, non_string, seg_error, truncated``.
    """
    g = seg.select(
        "page_id", "seg_no", "seg_error", "truncated", "reply", "_vm", "_any_ns", F.explode("groups").alias("g")
    )
    fields = seg.schema["groups"].dataType.elementType.names
    text = F.col("g.text") if "text" in fields else F.array_join(F.col("g.shreds.text"), "")
    key = F.col("g.seg_key").cast("string")
    present = F.coalesce(F.map_contains_key("reply", key), F.lit(False))
    v = F.try_element_at(F.col("_vm"), key)
    non_string = present & F.coalesce(F.col("_any_ns"), F.lit(False)) & (
        v.isNull() | (F.schema_of_variant(v) != F.lit("STRING"))
    )
    return g.select(
        "page_id",
        "seg_no",
        F.col("g.seg_key").alias("seg_key"),
        F.col("g.group_no").alias("group_no"),
        F.col("g.n_shreds").alias("n_shreds"),
        F.col("g.shreds").alias("shreds"),
        text.alias("src_text"),
        F.when(present & ~non_string, F.try_element_at(F.col("reply"), key)).alias("trans_text"),
        present.alias("present"),
        non_string.alias("non_string"),
        "seg_error",
        "truncated",
    )


def unknown_key_rows(seg: DataFrame) -> DataFrame:
    """reply keys with no group in their segment: ``(page_id, seg_no, key)``."""
    return seg.select("page_id", "seg_no", F.explode("unknown_keys").alias("key"))


def match_status(reply_rows: DataFrame, segments: DataFrame) -> DataFrame:
    """F5, F6 as one join: reply entries ``(page_id, seg_no, key, value)`` against
    ``segments(page_id, seg_no, seg_key, group_no)``.

    Every group and every reply key once, with ``status`` ``matched``, ``U`` (a reply key
    with no group) or ``M`` (a group with no reply key). Keys match as text, as dictionary
    keys do ("01" is not "1").
    """
    keys = ["page_id", "seg_no", "key"]
    seg = segments.withColumn("key", F.col("seg_key").cast("string")).withColumn("_group", F.lit(True))
    both = seg.join(reply_rows.withColumn("_reply", F.lit(True)), keys, "full")
    status = F.when(F.col("_group").isNull(), "U").when(F.col("_reply").isNull(), "M").otherwise("matched")
    return both.withColumn("status", status).drop("_group", "_reply")


def match_replies(reply_rows: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(matched, unknown, absent)``: the three kinds of ``match_status``. Each of them is
    the join; where more than one is used, store ``match_status`` instead."""
    both = match_status(reply_rows, segments)
    matched, unknown, absent = (both.filter(F.col("status") == s).drop("status") for s in ("matched", "U", "M"))
    return matched, unknown.select(*reply_rows.columns), absent.drop("value")
