"""Line dedup against a sharded minimal perfect hash.

A document's text is split at \\n; a line's key is the line stripped of ASCII
white space with A-Z lower-cased. Keys of at least ``min_chars`` code points
that are found in at least ``min_docs`` documents keep their lines only in the
largest doc_id that holds them.

Method, in three passes over the documents:

1. *Index.* Every slice of documents gives its distinct keys once, as 128-bit
   hashes with a document count and the largest doc_id, so a line that fills
   the corpus costs one row a slice. The rows are dealt by hash into shards.
   Each shard merges them and builds a minimal perfect hash over its distinct
   line hashes (levels of bit arrays; a hash that is alone on its bit of a
   level ends there, its slot is the rank of the bit). The slot indexes a
   64-bit fingerprint, a count and the largest doc_id. One row per shard is
   written to the shared folder.
2. *Probe.* Documents send the hashes of their long lines, packed into one
   array per slice and shard, to the shard and probe its arrays; a fingerprint
   that differs means "not indexed". What returns is only (doc_id, hash) of
   lines to drop. Keys found in more than one ``hot``-th of all line
   occurrences - there can be no more than ``hot`` of them, whatever the size of
   the corpus - aren't sent: their index entries are broadcast, a table of at
   most ``hot`` rows of 24 bytes, so no shard receives a third of the corpus
   because of one line.
3. *Rewrite.* Documents meet their own list of dropped hashes by doc_id and are
   rewritten.

Lines are never joined with lines. A shard's memory is its share of the
distinct keys; ``shards`` (default: the session's shuffle partitions) sets it.

Defined cases: a null or empty text is one empty line. Rows with the same
doc_id count as separate documents and hold the line together when theirs is
the largest doc_id. A null doc_id counts as a document but is smaller than any
doc_id, and it keeps its lines only if no other document holds them. An empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import int64, mix64, partitions, read, SPACES, text_slices, tidy, work_area

NO_ID = np.iinfo(np.int64).min


def line_keys(texts: pa.Array, min_chars: int):
    """Number of lines of each text; of the long lines: the owner's place, the
    line's number in the text and the two halves of the 128-bit key hash."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    lines = lists.flatten()
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=SPACES))
    at = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False))
    coded = keys.take(pa.array(at)).dictionary_encode()
    digests = b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist()))
    halves = np.frombuffer(digests, np.uint64).reshape(-1, 2)[coded.indices.to_numpy()]
    owner = np.searchsorted(offsets, at, side="right") - 1
    return np.diff(offsets), owner, at - offsets[owner], halves[:, 0], halves[:, 1]


def _doc_ids(b: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(b.column(0), int(NO_ID)).to_numpy(zero_copy_only=False)


def _distinct(cols: list[np.ndarray]) -> np.ndarray:
    """Places of the first of equal rows, rows sorted."""
    order = np.lexsort(cols[::-1])
    if not len(order):
        return order
    change = np.zeros(len(order) - 1, bool)
    for c in cols:
        s = c[order]
        change |= s[1:] != s[:-1]
    return order[np.concatenate([[True], change])]


# ---------------------------------------------------------------- the index


def _level_bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64(((level + 1) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    return (mix64(keys + salt) % np.uint64(size)).astype(np.int64)


def build_mph(keys: np.ndarray, gamma: float = 1.5) -> tuple[list[int], np.ndarray]:
    """Minimal perfect hash of distinct 64-bit keys: sizes of the levels, and
    their bits one after another, in bytes."""
    sizes, bits, left = [], [], keys
    while len(left):
        size = max(64, -(-int(gamma * len(left)) // 64) * 64)
        at = _level_bit(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    return sizes, np.packbits(np.concatenate(bits), bitorder="little") if bits else np.empty(0, np.uint8)


class PerfectHash:
    """Slots of keys; any other key gets some slot or -1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes = sizes
        self.words = np.frombuffer(bits.tobytes(), np.uint64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            bit = base + _level_bit(keys[todo], level, size)
            word, sub = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = ((word >> sub) & np.uint64(1)).astype(bool)
            low = word[hit] & ((np.uint64(1) << sub[hit]) - np.uint64(1))
            out[todo[hit]] = self.rank[bit[hit] >> 6] + np.bitwise_count(low)
            todo = todo[~hit]
            base += size
            if not len(todo):
                break
        return out


class LineIndex:
    """One shard: perfect hash over ``hi``, arrays of fingerprint (``lo``),
    document count and largest doc_id. Keys of one shard that share ``hi`` (they
    differ in ``lo`` only) stay in a short overflow list."""

    FIELDS = "shard int, keys long, sizes array<long>, bits binary, prints binary, counts binary, largest binary, over binary"

    def __init__(self, row: dict):
        self.hash = PerfectHash(row["sizes"], np.frombuffer(row["bits"], np.uint8))
        self.prints = np.frombuffer(row["prints"], np.uint64)
        self.counts = np.frombuffer(row["counts"], np.int64)
        self.largest = np.frombuffer(row["largest"], np.int64)
        over = np.frombuffer(row["over"], np.int64).reshape(-1, 4)
        self.over = {(int(a), int(b)): (int(c), int(d)) for a, b, c, d in over}

    @staticmethod
    def row(shard: int, hi, lo, count, largest) -> dict:
        """From sorted distinct (hi, lo)."""
        first = np.concatenate([[True], hi[1:] != hi[:-1]]) if len(hi) else np.empty(0, bool)
        keys = hi[first]
        sizes, bits = build_mph(keys)
        slot = PerfectHash(sizes, bits).slots(keys)
        put = lambda x: (lambda out: (out.__setitem__(slot, x[first]), out)[1])(np.empty(len(keys), x.dtype)).tobytes()
        rest = np.stack([int64(hi[~first]), int64(lo[~first]), count[~first], largest[~first]], 1) if len(hi) else np.empty((0, 4), np.int64)
        return {"shard": shard, "keys": len(hi), "sizes": sizes, "bits": bits.tobytes(), "prints": put(lo), "counts": put(count),
                "largest": put(largest), "over": rest.tobytes()}

    def find(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document count (0: not indexed) and largest doc_id of every key."""
        slot = self.hash.slots(hi)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == lo[known]
        count, largest = np.zeros(len(hi), np.int64), np.full(len(hi), NO_ID)
        count[known], largest[known] = self.counts[slot[known]], self.largest[slot[known]]
        if self.over:
            for i, pair in enumerate(zip(int64(hi).tolist(), int64(lo).tolist(), strict=True)):
                if pair in self.over:
                    count[i], largest[i] = self.over[pair]
        return count, largest


def _shard_of(hi: np.ndarray, shards: int) -> np.ndarray:
    return ((hi >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


def _packed(shard: np.ndarray, *cols: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    order = np.argsort(shard, kind="stable")
    s = shard[order]
    cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])) if len(s) else []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(s[i]), [c[order[i:j]].tobytes() for c in cols]


def _merge(hi, lo, count, largest):
    """Sums and maxima by (hi, lo), sorted."""
    order = np.lexsort((lo, hi))
    hi, lo, count, largest = hi[order], lo[order], count[order], largest[order]
    if not len(hi):
        return hi, lo, count, largest
    at = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
    return hi[at], lo[at], np.add.reduceat(count, at), np.maximum.reduceat(largest, at)


def index_lines(docs: DataFrame, min_chars: int, shards: int) -> DataFrame:
    """One index row per shard that has keys; see ``LineIndex.FIELDS``."""

    def emit(batches):
        for b in text_slices(batches):
            ids = _doc_ids(b)
            _, owner, _, hi, lo = line_keys(b.column(1), min_chars)
            one = _distinct([hi, lo, owner])  # a key counts once a document
            hi, lo, count, largest = _merge(hi[one], lo[one], np.ones(len(one), np.int64), ids[owner[one]])
            rows = list(_packed(_shard_of(hi, shards), hi, lo, count, largest))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in rows], pa.int32()), *(pa.array([p[k] for _, p in rows], pa.binary()) for k in range(4))],
                    ["shard", "hi", "lo", "count", "largest"])

    def build(batches):
        parts: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                parts.setdefault(r["shard"], []).append(
                    (np.frombuffer(r["hi"], np.uint64), np.frombuffer(r["lo"], np.uint64), np.frombuffer(r["count"], np.int64), np.frombuffer(r["largest"], np.int64)))
        for s in sorted(parts):
            rows = LineIndex.row(s, *_merge(*(np.concatenate(c) for c in zip(*parts.pop(s), strict=True))))
            yield pa.RecordBatch.from_pylist([rows], pa.schema([("shard", pa.int32()), ("keys", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()),
                                                                ("prints", pa.binary()), ("counts", pa.binary()), ("largest", pa.binary()), ("over", pa.binary())]))

    found = docs.select("doc_id", "text").mapInArrow(tidy(emit), "shard int, hi binary, lo binary, count binary, largest binary")
    return found.repartition(shards, "shard").mapInArrow(tidy(build), LineIndex.FIELDS)


def hot_entries(index: DataFrame, min_docs: int, hot: int) -> dict[tuple[int, int], int]:
    """Keys that hold more than one hot-th of all occurrences, with their
    largest doc_id: at most ``hot`` entries by construction."""

    def sums(batches):
        for b in batches:
            for c in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(c, np.int64).sum())])], ["n"])

    total = index.select("counts").mapInArrow(sums, "n long").agg(F.sum("n")).first()[0] or 0
    least = max(min_docs, total // hot + 1)

    def top(batches):
        for b in batches:
            for r in b.to_pylist():
                x = LineIndex(r)
                at = np.flatnonzero(x.counts >= least)
                if len(at):
                    # the perfect hash keeps no keys: hot ones are named by shard, slot and fingerprint
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["shard"])), pa.array(at), pa.array(int64(x.prints[at])), pa.array(x.largest[at])],
                                                     ["shard", "slot", "print", "largest"])

    rows = index.mapInArrow(top, "shard long, slot long, print long, largest long").collect()
    return {(r["shard"], r["print"]): r["largest"] for r in rows}


class _Hot:
    """Which keys are hot, by shard and fingerprint, and what becomes of them."""

    def __init__(self, table: dict[tuple[int, int], int], shards: int):
        self.shards = shards
        rows = sorted((s, p, v) for (s, p), v in table.items())
        self.shard = np.array([r[0] for r in rows], np.int64)
        self.print = np.array([r[1] for r in rows], np.int64)
        self.largest = np.array([r[2] for r in rows], np.int64)
        self.order = np.argsort(self.print, kind="stable")

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The entry of every key, -1 where it isn't hot."""
        out = np.full(len(hi), -1, np.int64)
        if len(self.print) and len(hi):
            at = self.order[np.minimum(np.searchsorted(self.print[self.order], int64(lo)), len(self.order) - 1)]
            same = (self.print[at] == int64(lo)) & (self.shard[at] == _shard_of(hi, self.shards))
            out[same] = at[same]
        return out


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, hot: int = 10_000, shards: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text left) of every row of docs, and
    a struct ``carry`` of the columns named so."""
    spark = docs.sparkSession
    area = work_area(spark)
    carried = F.struct(*carry) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    whole = docs.select("doc_id", "text", carried.alias("carry"))
    docs = docs.select("doc_id", "text")
    shards = shards or partitions(spark)
    index = area.write(index_lines(docs, min_chars, shards), "index")
    heavy = spark.sparkContext.broadcast(_Hot(hot_entries(index, min_docs, hot), shards))

    def ask(batches):
        for b in text_slices(batches):
            ids = _doc_ids(b)
            _, owner, _, hi, lo = line_keys(b.column(1), min_chars)
            cold = heavy.value.find(hi, lo) < 0
            hi, lo, owner = hi[cold], lo[cold], owner[cold]
            one = _distinct([hi, lo, owner])
            rows = list(_packed(_shard_of(hi[one], shards), hi[one], lo[one], ids[owner[one]]))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in rows], pa.int32()), pa.array([1] * len(rows), pa.int32()),
                     *(pa.array([p[k] for _, p in rows], pa.binary()) for k in range(3))], ["shard", "kind", "hi", "lo", "id"])

    asked = docs.mapInArrow(tidy(ask), "shard int, kind int, hi binary, lo binary, id binary")
    arrays = index.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("hi"), F.lit(None).cast("binary").alias("lo"),
                          F.lit(None).cast("binary").alias("id"), F.struct(*[c for c in index.columns if c != "keys"]).alias("arrays"))
    both = arrays.unionByName(asked, allowMissingColumns=True).repartition(shards, "shard").sortWithinPartitions("shard", "kind")

    def probe(batches):
        now = None  # one shard's arrays at a time: they sort before its questions
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == 0:
                    now = LineIndex(r["arrays"])
                    continue
                hi, lo, ids = (np.frombuffer(r[k], t) for k, t in (("hi", np.uint64), ("lo", np.uint64), ("id", np.int64)))
                count, largest = now.find(hi, lo)
                gone = (count >= min_docs) & (largest != ids)
                if gone.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[gone]), pa.array(int64(hi[gone])), pa.array(int64(lo[gone]))], ["doc_id", "hi", "lo"])

    gone = both.mapInArrow(tidy(probe), "doc_id long, hi long, lo long")
    lists = gone.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("gone")).withColumn("doc_id", F.nullif("doc_id", F.lit(int(NO_ID))))

    def rewrite(batches):
        for b in text_slices(batches):
            ids, texts = _doc_ids(b), b.column(1)
            n_lines, owner, place, hi, lo = line_keys(texts, min_chars)
            entry = heavy.value.find(hi, lo)
            out = entry >= 0
            out[out] = heavy.value.largest[entry[out]] != ids[owner[out]]
            lists = b.column(2)
            pairs = lists.flatten()
            size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
            size = np.where(pc.is_valid(lists).to_numpy(zero_copy_only=False), size, 0)
            if len(pairs):
                mine = {t for t in zip(np.repeat(np.arange(b.num_rows), size).tolist(), pairs.field("hi").to_pylist(), pairs.field("lo").to_pylist(), strict=True)}
                asked_of = np.isin(owner, np.flatnonzero(size))
                at = np.flatnonzero(asked_of & ~out)
                out[at] = [t in mine for t in zip(owner[at].tolist(), int64(hi[at]).tolist(), int64(lo[at]).tolist(), strict=True)]
            kept = pc.fill_null(texts, "").to_pylist()
            dropped = np.bincount(owner[out], minlength=b.num_rows)
            for i in np.flatnonzero(dropped):
                lines, bad = kept[i].split("\n"), set(place[out & (owner == i)].tolist()) if dropped[i] else ()
                kept[i] = "\n".join(x for k, x in enumerate(lines) if k not in bad)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string()), b.column(3)],
                                             ["doc_id", "n_lines", "n_dropped", "kept", "carry"])

    joined = whole.join(lists, whole["doc_id"].eqNullSafe(lists["doc_id"]), "left").select(whole["doc_id"], "text", "gone", "carry")
    out = joined.mapInArrow(tidy(rewrite), f"doc_id long, n_lines long, n_dropped long, kept string, carry {whole.schema['carry'].dataType.simpleString()}")
    return out if carry else out.drop("carry")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), s AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), f AS (
  SELECT k.*, s.holder IS NOT NULL AND s.holder <> k.doc_id AS gone FROM k LEFT JOIN s USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id"""
