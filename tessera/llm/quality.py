"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

DataFrame operations only. Base counts come from each whole text. The verdict
compares two multinomials over hashed words and word pairs: that of trusted
documents and that of the raw corpus. A document's score is the mean, over all
its words and pairs, of log(p_trusted / p_raw) of their bucket, in millionths
and as whole numbers, so that the sum does not depend on any order and the
threshold decides every document the same way on every run.

The raw counts cover all documents. The trusted ids are a bounded sample of the
labelled rows: the ``trusted`` rows with quality 1 and the smallest hash of
doc_id (8 bytes each, broadcast). Counts are partial sums of ``BUCKETS`` rows a
task; the table of ratios has ``BUCKETS`` numbers and enters the plan as a
constant. No document is shuffled.

Defined cases: a null text has no words and fails the base rules; a document
with one word has a score from that word; a document without words has score
null; repeated rows are judged each on its own; without trusted rows all ratios
are 0 and the method keeps everything that passes the base rules; an empty
table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import read

BUCKETS = 1 << 14
SPACE_CHARS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SCALE = 1_000_000


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``words`` (array of strings) and ``hashes`` (their 64-bit hashes)."""
    spaced = F.translate(F.coalesce(F.col(text), F.lit("")), SPACE_CHARS[:-1], " " * (len(SPACE_CHARS) - 1))
    out = docs.withColumn("words", F.array_remove(F.split(spaced, " "), ""))
    return out.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).drop("words")


def _without(col: Column, chars: str) -> Column:
    return F.translate(col, chars, "")


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    base_failed to a frame that has text and hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    with_word = F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, SPACE_CHARS)) > 0)
    out = (
        docs.withColumn("n_words", F.size("hashes").cast("long"))
        .withColumn("word_chars", F.length(_without(text, SPACE_CHARS)).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"))
        .withColumn("lines", with_word)
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn(
            "grams",
            F.when(F.size("hashes") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))),
        )
    )
    # windows sorted by hash: one that equals a neighbour is repeated in the text
    repeated = F.size(F.array_distinct("grams")) < F.size("grams")
    out = out.withColumn("sorted", F.when(repeated, F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = F.filter("sorted", lambda x, i: (F.get("sorted", i - 1)["g"] == x["g"]) | (F.get("sorted", i + 1)["g"] == x["g"]))
    out = out.withColumn("at", F.sort_array(F.transform(same, lambda x: x["i"])))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum"))
    covered = F.aggregate(
        "at", start,
        lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), p - a["last"]).cast("long")).alias("sum")),
        lambda a: a["sum"],
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)).drop("lines", "grams", "sorted", "at")


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS))


def _pair(a: Column, b: Column) -> Column:
    return _bucket(F.xxhash64(a, b))


def log_ratios(docs: DataFrame, labels: DataFrame, trusted: int = 1 << 16, smooth: float = 1.0) -> Column:
    """The table of log ratios, as a constant array of whole millionths."""
    good = labels.filter("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted)
    marked = with_words(docs.select("doc_id", "text")).join(F.broadcast(good.withColumn("good", F.lit(1))), "doc_id", "left")
    pairs = F.when(F.size("hashes") > 1, F.zip_with(F.slice("hashes", F.lit(1), F.size("hashes") - 1), F.slice("hashes", F.lit(2), F.size("hashes") - 1), _pair))
    buckets = F.concat(F.transform("hashes", _bucket), F.coalesce(pairs, F.array().cast("array<bigint>")))
    counts = (
        marked.select(F.coalesce("good", F.lit(0)).alias("good"), F.explode(buckets).alias("bucket"))
        .groupBy("bucket").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("raw")).collect()
    )
    n_good, n_raw = sum(r["good"] for r in counts), sum(r["raw"] for r in counts)
    table = [0] * BUCKETS
    if n_good:
        for r in counts:
            p, q = (r["good"] + smooth) / (n_good + smooth * BUCKETS), (r["raw"] + smooth) / (n_raw + smooth * BUCKETS)
            table[r["bucket"]] = round(SCALE * math.log(p / q))
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")


def with_score(docs: DataFrame, table: Column) -> DataFrame:
    """Adds ``score``: mean log ratio, in millionths, of a document's words and
    pairs, to a frame that has hashes."""
    zero = F.lit(0).cast("long")
    at = lambda b: F.get(table, b.cast("int"))
    start = F.struct(F.lit(None).cast("long").alias("last"), zero.alias("sum"))
    total = F.aggregate(
        "hashes", start,
        lambda a, h: F.struct(h.alias("last"), (a["sum"] + at(_bucket(h)) + F.when(a["last"].isNotNull(), at(_pair(a["last"], h))).otherwise(zero)).alias("sum")),
        lambda a: a["sum"],
    )
    n = F.size("hashes")
    return docs.withColumn("score", F.when(n > 0, total / (n * 2 - 1)))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = -0.08) -> DataFrame:
    """doc_id, the base counts, score and the verdict of every document."""
    table = log_ratios(docs, labels)
    out = with_score(base_counts(with_words(docs.select("doc_id", "text"))), table)
    keep = ~F.col("base_failed") & (F.coalesce(F.col("score"), F.lit(0.0)) >= threshold * SCALE)
    return out.withColumn("kept", keep).drop("text", "hashes")


def op8_quality_llr(spark, sf_dir: str) -> DataFrame:
    out = judge(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
