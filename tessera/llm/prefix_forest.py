"""Approximate nearest neighbours by cosine with a hash-prefix forest.

Every distinct vector has a long hash string in each of ``TREES`` trees: 10
symbols of 6 bits, each the place and sign of the greatest of 32 coordinates
after a random rotation of the tree. In a tree's order of strings a shared prefix of
x symbols is a range; the range at x = 0 is the whole tree.

How it runs:

1. Usable rows are collapsed to distinct vectors (salted, since one vector may be
   a third of all rows) with their six smallest ids, hashed once and written. Six
   are enough: five neighbours and the query itself.
2. Trees are cut into chunks by their strings' first one or two symbols, buckets
   of more than ``CHUNK_BYTES`` by a salt as well, and those with more than ``QUERIES``
   queries by blocks of queries. The table of bucket sizes has at most 24 x 64^2
   numbers and goes to the tasks.
3. Descent: each chunk sorts its strings to an array and finds, for every query and
   every prefix length, how many strings share it (two binary searches each).
   The counts are added up over trees and salts.
4. Synchronous ascent: all trees of a query go up together to the longest prefix
   at which they hold ``sought`` strings in all (a string counts in each tree that
   has it). Everything found there is a candidate: nothing is cut off, and a
   query that finds too little ends at the root, that is at all vectors.
5. The chunks' candidates are compared with the query on the vectors themselves and
   the best of each chunk are merged.

``sought`` is fitted: of at most ``SAMPLE`` queries (those with the least vector
hashes) the true neighbours are found by brute force, and the least number of a
geometric series is taken at which 0.95 of them share the reached prefix in some
tree. On vectors without any structure this may be a large part of the table;
recall goes first. All rows are indexed, all queries are answered.

Defined cases: vectors that are null or empty, hold null or non-finite entries or
only zeros, have another length than most (of equally frequent lengths the
greatest is taken) or a null id take no part. Equal vectors tie and come by id;
rows with the same id are different rows, and a query leaves out only its own.
Fewer candidates give fewer ranks, an empty table an empty result. Other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import read, work_area

TREES, SYMBOLS, BITS, WIDTH = 24, 10, 6, 32
CHUNK_BYTES = 4 << 20
QUERIES = 2048
SAMPLE = 256
RECALL = 0.95
SEED = 20240611
RESULT = "query_id long, rank int, vec_id long, score double"


class Strings:
    """Hash strings of unit vectors: one 60-bit number per tree."""

    def __init__(self, length: int):
        rng = np.random.default_rng(SEED)
        self.width = min(WIDTH, length)
        need = SYMBOLS * self.width
        turns = []
        for _ in range(TREES):
            got = []
            while sum(g.shape[1] for g in got) < need:
                got.append(np.linalg.qr(rng.standard_normal((length, min(length, need))))[0])
            turns.append(np.hstack(got)[:, :need])
        self.turns = turns

    def of(self, unit: np.ndarray) -> np.ndarray:
        out = np.zeros((len(unit), TREES), np.int64)
        for t, turn in enumerate(self.turns):
            y = (unit @ turn).reshape(len(unit), SYMBOLS, self.width)
            at = np.abs(y).argmax(axis=2)
            symbols = 2 * at + (np.take_along_axis(y, at[:, :, None], 2)[:, :, 0] < 0)
            for k in range(SYMBOLS):
                out[:, t] = (out[:, t] << BITS) | symbols[:, k]
        return out


def matrix(values: pa.Array, kind: str) -> np.ndarray:
    """Equally long binary values as rows of doubles."""
    n = len(values)
    raw = b"".join(values.to_pylist())
    return np.frombuffer(raw, kind).reshape(n, -1).astype(float) if n else np.empty((0, 0))


def labels_of(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), "<i8").reshape(len(values), TREES)


def binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def ranges(labels: np.ndarray, strings: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the sorted labels that share ``level`` symbols with the strings."""
    shift = BITS * (SYMBOLS - np.asarray(level, np.int64))
    low = (strings >> shift) << shift
    return np.searchsorted(labels, low, "left"), np.searchsorted(labels, low + (np.int64(1) << shift) - 1, "right")


class Chunks:
    """Where strings and queries of each bucket are dealt: ``depth`` symbols
    make a bucket; ``items`` and ``queries`` are its sizes."""

    def __init__(self, depth: int, items: np.ndarray, queries: np.ndarray, per_chunk: int):
        self.depth, self.items = depth, items
        self.salts = -(-items // per_chunk)
        self.blocks = -(-queries // QUERIES)

    def bucket(self, labels: np.ndarray) -> np.ndarray:
        return labels >> (BITS * (SYMBOLS - self.depth))

    def number(self, tree, bucket, salt, block):
        return ((tree * (1 << (BITS * self.depth)) + bucket) << 44) | (salt << 20) | block

    def of_items(self, labels: np.ndarray, spread: np.ndarray):
        """(rows, chunk numbers, tree of each) of every place of the items."""
        for t in range(TREES):
            b = self.bucket(labels[:, t])
            blocks = self.blocks[t, b]
            rows = np.repeat(np.arange(len(b)), blocks)
            if len(rows):
                block = np.arange(len(rows)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                yield t, rows, self.number(t, b[rows], spread[rows] % self.salts[t, b[rows]], block)

    def visits(self, labels: np.ndarray, levels: np.ndarray):
        """(tree, rows, buckets) that queries at their levels have to see: their own
        bucket, all below a shorter prefix, or all of the first tree at the root."""
        for t in range(TREES):
            own = np.flatnonzero(levels >= self.depth)
            yield t, own, self.bucket(labels[own, t])
            for x in range(1 if t else 0, self.depth):
                rows = np.flatnonzero(levels == x)
                span = 1 << (BITS * (self.depth - x))
                low = (self.bucket(labels[rows, t]) >> (BITS * (self.depth - x))) * span
                rows, low = np.repeat(rows, span), (low[:, None] + np.arange(span)).ravel()
                there = self.items[t, low] > 0
                yield t, rows[there], low[there]

    def of_queries(self, labels: np.ndarray, spread: np.ndarray, levels: np.ndarray):
        for t, rows, bucket in self.visits(labels, levels):
            salts = self.salts[t, bucket]
            at = np.repeat(np.arange(len(rows)), salts)
            if len(at):
                salt = np.arange(len(at)) - np.repeat(np.cumsum(salts) - salts, salts)
                yield t, rows[at], self.number(t, bucket[at], salt, spread[rows[at]] % self.blocks[t, bucket[at]])


def _spread(keys: pa.Array) -> np.ndarray:
    """A number of each key that deals it."""
    return np.frombuffer(b"".join(keys.to_pylist()), "<u8").reshape(len(keys), 2)[:, 0].astype(np.int64) & ((1 << 40) - 1)


def usable_rows(vectors: DataFrame, area) -> tuple[DataFrame, int, str]:
    """(vec_id, key, vec) of the rows that take part, their length, and the number
    type of ``vec``. Vectors are scaled by a power of two, which keeps the
    cosine to the last bit and its products in range."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null and size(embedding) > 0")
    sizes = vectors.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = sizes["length"] if sizes else 0

    def prepare(batches):
        for b in batches:
            flat = pc.fill_null(b.column(1).flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            x = flat.reshape(b.num_rows, length)
            most = np.abs(x).max(axis=1)
            rows = np.flatnonzero(np.isfinite(x).all(axis=1) & (most > 0))
            x = np.ldexp(x[rows], -np.frexp(most[rows])[1][:, None]) + 0.0
            vec = [r.tobytes() for r in x.astype(kind)]
            keys = [hashlib.blake2b(v, digest_size=16).digest() for v in vec]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(keys, pa.binary()), pa.array(vec, pa.binary())], ["vec_id", "key", "vec"])

    chosen = vectors.filter(F.size("embedding") == length)
    return area.write(chosen.mapInArrow(prepare, "vec_id long, key binary, vec binary"), "rows"), length, kind


def distinct_vectors(rows: DataFrame, length: int, kind: str, keep: int, every: int, area) -> DataFrame:
    """key, vec, ids (the ``keep`` smallest), asked (some row is a query), labels."""
    salts = max(1, rows.count() // 100_000)
    least = lambda ids: F.slice(F.sort_array(ids), 1, keep)
    part = rows.groupBy("key", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt")).agg(
        F.first("vec").alias("vec"), least(F.collect_list("vec_id")).alias("ids"), F.bool_or(F.col("vec_id") % every == 0).alias("asked"))
    whole = part.groupBy("key").agg(F.first("vec").alias("vec"), least(F.flatten(F.collect_list("ids"))).alias("ids"), F.bool_or("asked").alias("asked"))

    def label(batches):
        strings = Strings(length)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                s = b.slice(i, 1024)
                x = matrix(s.column(1), kind)
                yield pa.RecordBatch.from_arrays([*s.columns, binary(strings.of(x / norms(x)[:, None]))], ["key", "vec", "ids", "asked", "labels"])

    return area.write(whole.mapInArrow(label, "key binary, vec binary, ids array<long>, asked boolean, labels binary"), "vectors")


def _counted(pairs: DataFrame, depth: int, values: int) -> list[np.ndarray]:
    """Sums per (tree, bucket) as arrays; the bound is trees x 64^depth rows."""
    out = [np.zeros((TREES, 1 << (BITS * depth)), np.int64) for _ in range(values)]
    for r in pairs.groupBy("tree", "bucket").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(values)]).collect():
        for k in range(values):
            out[k][r["tree"], r["bucket"]] = r[f"v{k}"]
    return out


def _tally(counts: list[np.ndarray]):
    tree, bucket = np.nonzero(sum(counts))
    names = ["tree", "bucket", *[f"v{k}" for k in range(len(counts))]]
    yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(bucket.astype(np.int64)), *[pa.array(c[tree, bucket]) for c in counts]], names)


def _slices(batches, rows: int = 256):
    """A query may visit 64^depth buckets: few queries at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _dealt(df: DataFrame, chunks: Chunks, columns: dict, queries: bool) -> DataFrame:
    """The rows of ``df`` (key, labels, ...) at every chunk they belong to, with
    their label there; ``columns`` are carried along."""
    names, schema = list(columns), ", ".join(["chunk long", "label long", *[f"{n} {t}" for n, t in columns.items()]])
    extra = ["level"] if queries else []

    def deal(batches):
        for b in _slices(batches) if queries else batches:
            labels, spread = labels_of(b.column("labels")), _spread(b.column("key"))
            places = chunks.of_queries(labels, spread, b.column("level").to_numpy()) if queries else chunks.of_items(labels, spread)
            for t, rows, numbers in places:
                for i in range(0, len(rows), 8192):
                    at = rows[i : i + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[i : i + 8192]), pa.array(labels[at, t]), *[b.column(n).take(pa.array(at)) for n in names]], ["chunk", "label", *names])

    return df.select(*dict.fromkeys(["key", "labels", *extra, *names])).mapInArrow(deal, schema)


def _top(score: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` greatest, and of all that come close to the last."""
    if len(score) > most:
        least = np.partition(score, len(score) - most)[len(score) - most] - 1e-9
        return np.flatnonzero((score >= least) & (score > -np.inf))
    return np.flatnonzero(score > -np.inf)


def _best_rows(q: np.ndarray, x: np.ndarray, score: np.ndarray, ids: list, most: int):
    """(place, ordinal in its ids, id, score) of the best rows; scores that decide
    are worked out one by one, alike wherever the vectors meet."""
    at = _top(score, most)
    exact = (x[at] * q).sum(axis=1) / (norms(x[at]) * norms(q[None])[0])
    found = sorted((-s, i, n, k) for s, k in zip(exact.tolist(), at.tolist(), strict=True) for n, i in enumerate(ids[k]))
    return [(k, n, i, -s) for s, i, n, k in found[:most]]


def count_shared(items: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """Descent: key and s<x>, the number of strings that share x symbols in its chunks."""
    levels = list(range(depth, SYMBOLS + 1))
    schema = ", ".join(["key binary", *[f"s{x} long" for x in levels]])

    def descend(left: pa.Table, right: pa.Table) -> pa.Table:
        labels, strings = np.sort(left.column("label").to_numpy()), right.column("label").to_numpy()
        found = [np.subtract(*reversed(ranges(labels, strings, x))) for x in levels]
        return pa.table([right.column("key").combine_chunks(), *[pa.array(f.astype(np.int64)) for f in found]], names=["key", *[f"s{x}" for x in levels]])

    shared = items.groupBy("chunk").cogroup(queries.groupBy("chunk")).applyInArrow(descend, schema)
    return shared.groupBy("key").agg(*[F.sum(f"s{x}").alias(f"s{x}") for x in levels])


def compare(items: DataFrame, queries: DataFrame, kind: str, keep: int) -> DataFrame:
    """key, other, ordinal, vec_id, score: the best rows of each chunk for each query."""
    names = ["key", "other", "ordinal", "vec_id", "score"]
    schema = pa.schema(list(zip(names, (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.float64()), strict=True)))

    def collect(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left, right = left.take(pc.sort_indices(left, [("label", "ascending")])), right.take(pc.sort_indices(right, [("label", "ascending")]))
        x, q = (matrix(t.column("vec").combine_chunks(), kind) for t in (left, right))
        unit, asked = x / norms(x)[:, None], q / norms(q)[:, None]
        ids, keys, others = left.column("ids").to_pylist(), right.column("key").to_pylist(), left.column("key").to_pylist()
        low, high = ranges(left.column("label").to_numpy(), right.column("label").to_numpy(), right.column("level").to_numpy())
        out = []
        for i in range(0, len(q), 64):
            first, last = int(low[i : i + 64].min()), int(high[i : i + 64].max())
            score = asked[i : i + 64] @ unit[first:last].T
            for k, row in enumerate(score, i):
                row = row[low[k] - first : high[k] - first]
                out += [(keys[k], others[low[k] + p], n, v, s) for p, n, v, s in _best_rows(q[k], x[low[k] : high[k]], row, ids[low[k] : high[k]], keep)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema) if out else schema.empty_table()

    return items.groupBy("chunk").cogroup(queries.groupBy("chunk")).applyInArrow(collect, "key binary, other binary, ordinal int, vec_id long, score double")


def true_neighbours(vectors: DataFrame, sample: list, kind: str, keep: int) -> dict:
    """The best rows of the sampled queries among all vectors: key -> list of (key,
    ordinal, id, labels)."""
    q = matrix(pa.array([r["vec"] for r in sample], pa.binary()), kind)
    asked = q / norms(q)[:, None]

    def best(batches):
        for b in batches:
            x = matrix(b.column("vec"), kind)
            score, ids = asked @ (x / norms(x)[:, None]).T if len(x) else np.empty((len(q), 0)), b.column("ids").to_pylist()
            rows = [(k, *r) for k in range(len(q)) for r in _best_rows(q[k], x, score[k], ids, keep)]
            at = pa.array([r[1] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), b.column("key").take(at), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64()),
                 pa.array([r[4] for r in rows], pa.float64()), b.column("labels").take(at)], ["q", "key", "ordinal", "vec_id", "score", "labels"])

    found = vectors.select("key", "vec", "ids", "labels").mapInArrow(best, "q int, key binary, ordinal int, vec_id long, score double, labels binary")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "ordinal"))
    out: dict = {}
    for r in found.withColumn("place", place).filter(F.col("place") <= keep).orderBy("q", "place").collect():
        out.setdefault(r["q"], []).append(r)
    return out


def fit_sought(totals: np.ndarray, matches: list[np.ndarray], whole: int, recall: float) -> int:
    """The least number of a geometric series at which the share ``recall`` of the
    true neighbours share the prefix that is reached. ``totals``: per sampled query the
    strings found at every prefix length; ``matches``: the longest prefix that
    each of its neighbours shares with it in any tree."""
    sought = 8.0
    while sought < whole:
        reached = (totals >= sought)[:, ::-1].argmax(axis=1)
        level = np.where((totals >= sought).any(axis=1), SYMBOLS - reached, 0)
        hits = [m >= x for m, x in zip(matches, level.tolist(), strict=True)]
        if np.concatenate(hits).mean() >= recall:
            break
        sought *= 1.2
    return int(min(sought, whole))


def nearest(vectors: DataFrame, every: int, k: int = 5, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for every row whose
    vec_id is divisible by ``every``. ``vectors``: vec_id, embedding."""
    spark, area, keep = vectors.sparkSession, work_area(vectors.sparkSession), k + 1
    rows, length, kind = usable_rows(vectors, area)
    if not length:
        return spark.createDataFrame([], RESULT)
    whole = distinct_vectors(rows, length, kind, keep, every, area)
    total = whole.count()
    asked = area.write(whole.filter("asked").select("key", "vec", "labels"), "queries")
    if asked.isEmpty():
        return spark.createDataFrame([], RESULT)
    per_chunk = min(8192, max(256, CHUNK_BYTES // (8 * length)))
    depth = 1 if total <= per_chunk << BITS else 2

    def sizes(batches):
        counts = [np.zeros((TREES, 1 << (BITS * depth)), np.int64) for _ in range(2)]
        for b in batches:
            at, wanted = labels_of(b.column("labels")) >> (BITS * (SYMBOLS - depth)), b.column("asked").to_numpy(zero_copy_only=False)
            for t in range(TREES):
                counts[0][t] += np.bincount(at[:, t], minlength=counts[0].shape[1])
                counts[1][t] += np.bincount(at[wanted, t], minlength=counts[0].shape[1])
        yield from _tally(counts)

    items, queries = _counted(whole.select("labels", "asked").mapInArrow(sizes, "tree int, bucket long, v0 long, v1 long"), depth, 2)

    # descent
    chunks = Chunks(depth, items, queries, per_chunk)
    own = asked.withColumn("level", F.lit(depth).cast("long"))
    shared = area.write(count_shared(_dealt(whole, chunks, {}, False), _dealt(own, chunks, {"key": "binary"}, True), depth), "shared")

    # the number sought, from a bounded sample
    sums = [items.reshape(TREES, 1 << (BITS * x), -1).sum(axis=2) for x in range(depth)]

    def totals_of(labels: np.ndarray, counts: list[np.ndarray]) -> np.ndarray:
        short = [sum(sums[x][t, labels[:, t] >> (BITS * (SYMBOLS - x))] for t in range(TREES)) for x in range(depth)]
        return np.stack([*short, *counts], axis=1)

    names = [f"s{x}" for x in range(depth, SYMBOLS + 1)]
    counted = area.write(asked.join(shared, "key"), "counted")
    sample = counted.orderBy("key").limit(SAMPLE).collect()
    labels = np.stack([np.frombuffer(r["labels"], "<i8") for r in sample])
    totals = totals_of(labels, [np.array([r[n] for r in sample]) for n in names])
    matches = []
    for q, found in sorted(true_neighbours(whole, sample, kind, keep).items()):
        theirs = np.stack([np.frombuffer(r["labels"], "<i8") for r in found])
        shared_symbols = np.count_nonzero(((theirs ^ labels[q])[..., None] >> (BITS * np.arange(SYMBOLS))) == 0, axis=2).max(axis=1)
        itself = next((n for n, r in enumerate(found) if r["key"] == sample[q]["key"]), len(found))
        matches.append(np.delete(shared_symbols, [n for n in (itself,) if n < len(found)])[:k])
    sought = fit_sought(totals, matches, TREES * total, recall) if any(map(len, matches)) else TREES * total

    # ascent
    def climb(batches):
        for b in batches:
            found = totals_of(labels_of(b.column("labels")), [b.column(n).to_numpy() for n in names]) >= sought
            level = np.where(found.any(axis=1), SYMBOLS - found[:, ::-1].argmax(axis=1), 0)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("vec"), b.column("labels"), pa.array(level.astype(np.int64))], ["key", "vec", "labels", "level"])

    climbed = area.write(counted.mapInArrow(climb, "key binary, vec binary, labels binary, level long"), "climbed")

    def seen(batches):
        counts = [np.zeros((TREES, 1 << (BITS * depth)), np.int64)]
        for b in _slices(batches):
            for t, _, bucket in chunks.visits(labels_of(b.column("labels")), b.column("level").to_numpy()):
                counts[0][t] += np.bincount(bucket, minlength=counts[0].shape[1])
        yield from _tally(counts)

    (visited,) = _counted(climbed.select("labels", "level").mapInArrow(seen, "tree int, bucket long, v0 long"), depth, 1)
    chunks = Chunks(depth, items, visited, per_chunk)
    found = compare(_dealt(whole, chunks, {"key": "binary", "vec": "binary", "ids": "array<long>"}, False), _dealt(climbed, chunks, {"key": "binary", "vec": "binary", "level": "long"}, True), kind, keep)

    # the best of all chunks, then of every query row
    once = found.groupBy("key", "other", "ordinal").agg(F.max("vec_id").alias("vec_id"), F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id", "ordinal"))
    best = once.withColumn("place", place).filter(F.col("place") <= keep)
    best = area.write(best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", (F.col("other") == F.col("key")).alias("own")))).alias("best")), "best")
    mine = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "key").join(best, "key")
    itself = F.array_position(F.transform("best", lambda r: r["own"] & (r["vec_id"] == F.col("query_id"))), True)
    others = F.slice(F.filter(F.col("best"), lambda r, i: i + 1 != F.col("itself")), 1, k)
    return mine.withColumn("itself", itself).select("query_id", F.posexplode(others).alias("rank", "r")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score"))


def op12_prefix_forest(spark, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), every=50)
