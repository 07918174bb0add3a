"""A cleaning pipeline over ``documents``, from raw texts to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. A stage works on all rows that the
stage before it kept.

1. toxicity: a factorization machine learned from ``labels``; documents with a
   score of 0.5 or more go.
2. line_dedup: lines of 40 or more characters found in 5 or more documents stay
   in the largest doc_id that holds them only; n_chars follows the text.
3. jaccard_join: of the documents linked, over any number of links, by 75 % of
   their five-word shingles, the one with the smallest doc_id stays. Rows with
   one doc_id stay or go together, null doc_ids stay.
4. decontamination: documents that hold an item of ``benchmark`` within an edit
   distance of a fifth of its words go.
5. bpe: ids and decoded text of what is left, as digests.

Empty tables, null texts and repeated rows are as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe_tree, decontamination, jaccard_join, line_dedup, toxicity
from tessera.llm.common import read, work_area

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    chosen, machine = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score_texts(docs, chosen, machine).filter("toxic_score < 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(docs, carry=("text", "lang", "source", "n_chars"))
    cut = F.col("n_dropped") > 0
    return out.select(
        "doc_id", F.when(cut, F.col("kept")).otherwise(F.col("carry.text")).alias("text"), "carry.lang", "carry.source",
        F.when(cut, F.length("kept").cast("long")).otherwise(F.col("carry.n_chars")).alias("n_chars"),
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    linked = work_area(spark).write(jaccard_join.link_sets(docs).filter("component_id <> doc_id").select("doc_id").distinct(), "copies")
    return docs.join(linked, "doc_id", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(bpe_tree.TOKENIZER)
    return bpe_tree.encode_digests(docs, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: Learned scores and a tokenizer's ids aren't SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    area = work_area(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = area.write(stage(spark, docs, sf_dir), name)
    return docs
