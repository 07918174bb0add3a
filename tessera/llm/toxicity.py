"""Toxicity scores from a factorization machine over hashed terms.

Terms of a text are its lower-cased words without ASCII punctuation at the ends
and the four-byte grams of "^" + word, hashed into ``BUCKETS`` buckets. The
machine scores a document from the terms present in it:

    w0 + sum of w[f] + sum over pairs f < g of <v[f], v[g]>

through the logistic function. The pairs let it learn what an additive model
misses, such as a word that insults only beside another.

Learning uses a bounded sample of labelled rows: the ``sample`` rows with the
smallest hash of doc_id among those with crc32(doc_id as text) mod 5 not 0. The
sample's ids are the only thing broadcast besides the model (``terms`` rows of
``FACTORS`` + 1 numbers), both of a size fixed by parameters. Buckets are
chosen by their likelihood-ratio statistic against the label (``least_gain`` or
more, the ``terms`` best), counted over the sample by a Spark aggregate; the machine is then fitted on the driver from the
sample's chosen terms (a few per row). Scoring covers every whole text.

Defined cases: null and empty texts have no terms and get the score of the bias
alone; rows with the same doc_id are scored each on its own; labels that
contradict each other for one doc_id count as toxic; without labels of both
kinds every score is the same, below 0.5; an empty table gives an empty result.
Labels, lang, source and doc_id are never inputs of a score; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_strings, mix64, one_row_per, read, split_words, text_slices, tidy, work_area

BUCKETS = 1 << 20
FACTORS = 8
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _distinct_words(texts: pa.Array):
    """Distinct trimmed lower-cased words of the texts, and the distinct pairs
    (text, word) as two arrays."""
    words, counts = split_words(texts)
    if not len(words):
        return words, np.empty(0, np.int64), np.empty(0, np.int64)
    coded = words.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    plain = pc.ascii_trim(pc.utf8_lower(coded.dictionary), characters=PUNCTUATION).dictionary_encode()
    code = plain.indices.to_numpy()[coded.indices.to_numpy()]
    owner, _ = one_row_per(counts)
    pair = np.unique(owner * len(plain.dictionary) + code)
    return plain.dictionary, pair // len(plain.dictionary), pair % len(plain.dictionary)


def _terms(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every term of the words."""
    marked = pc.binary_join_element_wise(pa.scalar("^"), words, "")
    raw = np.frombuffer(marked.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(marked.buffers()[1], np.int32, len(marked) + 1).astype(np.int64)
    word, _ = one_row_per(np.diff(ends))
    n = max(0, len(raw) - 3)
    g = raw[:n].astype(np.uint64)
    for k in (1, 2, 3):
        g = (g << np.uint64(8)) | raw[k : k + n].astype(np.uint64)
    inside = word[:n] == word[3 : 3 + n]
    grams = mix64(g[inside]) % np.uint64(BUCKETS)
    own = hash_strings(words) % np.uint64(BUCKETS)
    return np.concatenate([word[:n][inside], np.arange(len(words))]), np.concatenate([grams, own]).astype(np.int64)


def text_terms(texts: pa.Array, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs; chosen maps buckets to places of the
    terms to keep (-1: not kept), which are then returned in their stead."""
    words, doc, code = _distinct_words(texts)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word, bucket = _terms(words)
    if chosen is not None:
        bucket = chosen[bucket]
        word, bucket = word[bucket >= 0], bucket[bucket >= 0]
    order = np.argsort(word, kind="stable")
    per = np.bincount(word, minlength=len(words))
    first = np.cumsum(per) - per
    n = per[code]
    keep = n > 0
    doc, code, n = doc[keep], code[keep], n[keep]
    row, k = one_row_per(n)
    pair = np.unique(doc[row] * BUCKETS + bucket[order[first[code[row]] + k]])
    return pair // BUCKETS, pair % BUCKETS


class FactorizationMachine:
    def __init__(self, terms: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = np.float64(-4.0), np.zeros(terms), rng.normal(0, 0.05, (terms, FACTORS))

    def margins(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Of n texts given as (row, term) pairs of present terms."""
        add = lambda x: np.bincount(rows, weights=x, minlength=n)
        out = self.w0 + add(self.w[terms])
        for k in range(FACTORS):
            v = self.v[terms, k]
            out += 0.5 * (add(v) ** 2 - add(v * v))
        return out

    def fit(self, rows: np.ndarray, terms: np.ndarray, labels: np.ndarray, epochs: int = 60, rate: float = 0.05, decay: float = 2e-4) -> "FactorizationMachine":
        """Adam over whole passes; the two classes weigh alike."""
        n, pos = len(labels), labels.sum()
        if not 0 < pos < n:
            return self
        weight = np.where(labels == 1, 0.5 / pos, 0.5 / (n - pos))
        params = [np.array([self.w0]), self.w, self.v]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        m = len(self.w)
        for t in range(1, epochs + 1):
            err = weight * (1 / (1 + np.exp(-np.clip(self.margins(rows, terms, n), -30, 30))) - labels)
            e = err[rows]
            grad_v = np.empty_like(self.v)
            for k in range(FACTORS):
                v = self.v[terms, k]
                total = np.bincount(rows, weights=v, minlength=n)
                grad_v[:, k] = np.bincount(terms, weights=e * (total[rows] - v), minlength=m)
            grads = [np.array([err.sum()]), np.bincount(terms, weights=e, minlength=m) + decay * self.w, grad_v + decay * self.v]
            for p, g, (a, b) in zip(params, grads, state, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
            self.w0 = params[0][0]
        return self


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 5 == 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 16_000, terms: int = 2048, min_rows: int = 5, least_gain: float = 4.0):
    """(chosen, machine): places of the chosen buckets and the fitted machine."""
    spark = docs.sparkSession
    picked = (
        labels.filter("toxic is not null").filter(~_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = work_area(spark).write(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "sample")

    def count(batches):
        for b in text_slices(batches, most=2 << 20):
            doc, bucket = text_terms(b.column(b.schema.get_field_index("text")))
            toxic = b.column(b.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False) > 0
            seen, place = np.unique(bucket, return_inverse=True)
            bad = np.bincount(place, weights=toxic[doc], minlength=len(seen)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(bad), pa.array(np.bincount(place, minlength=len(seen)) - bad)], ["bucket", "bad", "good"])

    n = rows.agg(F.count(F.when(F.col("toxic") > 0, 1)).alias("bad"), F.count(F.when(F.col("toxic") <= 0, 1)).alias("good")).first()
    machine = FactorizationMachine(terms)
    chosen = np.full(BUCKETS, -1, np.int32)
    if not n["bad"] or not n["good"]:
        return chosen, machine
    seen = rows.mapInArrow(tidy(count), "bucket long, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    part = lambda x, of: x * F.log(x / of)
    a, b = F.col("bad") + 0.5, F.col("good") + 0.5
    c, d = F.lit(n["bad"] + 1.0), F.lit(n["good"] + 1.0)
    share = (a + b) / (c + d)
    gain = part(a, c * share) + part(b, d * share) + part(c - a, c * (1 - share)) + part(d - b, d * (1 - share))
    best = seen.filter(F.col("bad") + F.col("good") >= min_rows).withColumn("gain", gain).filter(F.col("gain") >= least_gain).orderBy(F.desc("gain"), "bucket").limit(terms).collect()
    chosen[[r["bucket"] for r in best]] = np.arange(len(best), dtype=np.int32)

    def present(batches):
        for b in text_slices(batches, most=2 << 20):
            doc, term = text_terms(b.column(b.schema.get_field_index("text")), chosen)
            lists = np.split(term, np.cumsum(np.bincount(doc, minlength=b.num_rows))[:-1])
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("toxic")).cast(pa.int32()), pa.array([x.tolist() for x in lists], pa.list_(pa.int32()))],
                                             ["doc_id", "toxic", "terms"])

    known = sorted(rows.mapInArrow(tidy(present), "doc_id long, toxic int, terms array<int>").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["terms"]))
    sizes = np.array([len(r["terms"]) for r in known])
    flat = np.array([t for r in known for t in r["terms"]], np.int64)
    return chosen, machine.fit(np.repeat(np.arange(len(known)), sizes), flat, np.array([int(r["toxic"] > 0) for r in known]))


def score_texts(docs: DataFrame, chosen: np.ndarray, machine: FactorizationMachine) -> DataFrame:
    """docs with a column score, computed from the column text."""
    model = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(chosen >= 0), chosen[chosen >= 0], machine))
    cols = docs.columns

    def score(batches):
        at, place, fm = model.value
        table = np.full(BUCKETS, -1, np.int32)
        table[at] = place
        for b in text_slices(batches, most=4 << 20):
            doc, term = text_terms(b.column(cols.index("text")), table)
            p = 1 / (1 + np.exp(-np.clip(fm.margins(doc, term, b.num_rows), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*cols, "toxic_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(tidy(score), f"{fields}, toxic_score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    chosen, machine = fit_toxicity(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score_texts(docs, chosen, machine).select(
        "doc_id", _held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"),
        F.when(F.col("toxic_score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )
