"""Embedding whitening by blockwise QR and a bidiagonal qd solver.

Entries c become whole numbers x = floor(1024 c) + 100000. With S their sums and
n the number of vectors, a component is a unit eigenvector v of the covariance of
x (divisor n) with eigenvalue e; a vector's whitened value is (x - S/n) v / sqrt(e).

How it runs, in four passes over the vectors and without a shuffle of them:

1. n and S, exactly: whole sums per task, added up by Spark as decimals.
2. Every task reduces its centred rows block by block to one triangle R (QR of
   the triangle so far on top of the next block). The triangles, d x d numbers
   each, are written and reduced 16 to one, round by round, so that at most 16
   reach the driver whatever the number of tasks. x - S/n is formed with S/n in
   two doubles; no product of uncentred numbers is ever made.
3. ``bidiagonal.directions`` takes R to the values and directions (Householder,
   dqds, twisted factorisations). The covariance of the whitened rows is then
   measured on the rows themselves: count, mean and centred products per block,
   merged pairwise like the triangles.
4. Every row is projected.

What goes to tasks with the code are S and 8 directions: d x 8 numbers.

Defined cases: vectors that are null or hold null or non-finite entries are left
out, as are those whose 1024 c has a magnitude of 2^40 or more (its whole number
would not be exact) and those whose length isn't the most frequent one (of equally
frequent ones the greatest). Repeated rows count each, and a null vec_id stays
null. Components whose eigenvalue is under 1e-13 of the trace are rounding and are left
out: a single vector, or equal ones, give no rows, like an empty table. A
deviation beyond a long is null there and exact in ``deviation_exact``
(null beyond 38 digits). Other columns are not read.
"""

from __future__ import annotations

import decimal
import pickle
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bidiagonal import directions
from tessera.llm.common import read, work_area

SHIFT, SCALE = 100_000, 1024
LARGEST = float(1 << 40)
BLOCK = 4096
FAN_IN = 16
_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def clean_rows(vectors: pa.Array, length: int | None = None):
    """(length, places of the usable vectors of that length, their whole
    numbers x) for each length, or for the given one."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    entries = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) * SCALE
    usable = np.abs(entries) < LARGEST  # false for NaN
    ends = np.cumsum(sizes)
    good = np.concatenate([[0], np.cumsum(usable)])
    whole = good[ends] - good[ends - sizes] == sizes
    for d in np.unique(sizes) if length is None else [length]:
        if d:
            rows = np.flatnonzero(whole & (sizes == d))
            at = (ends - sizes)[rows][:, None] + np.arange(d)
            yield int(d), rows, np.floor(entries[at]).astype(np.int64) + SHIFT


def _sums(batches):
    total: dict[int, list] = {}
    for b in batches:
        for d, rows, x in clean_rows(b.column(1)):
            n, s = total.get(d, (0, 0))
            total[d] = (n + len(rows), s + x.sum(axis=0))
    for d, (n, s) in total.items():
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(s, pa.int64())], ["length", "dim", "n", "s"])


def _fold(area, states: DataFrame, merge, name: str) -> list:
    """The states (one pickled value a task) merged FAN_IN to one, in rounds of
    written tables, until at most FAN_IN are left."""

    def level(batches):
        held = None
        for b in batches:
            for value in b.column(0).to_pylist():
                value = pickle.loads(value)
                held = value if held is None else merge(held, value)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], ["state"])

    states = area.write(states, f"{name}-0")
    left, k = states.count(), 0
    while left > FAN_IN:
        left, k = -(-left // FAN_IN), k + 1
        states = area.write(states.repartition(left).mapInArrow(level, "state binary"), f"{name}-{k}")
    return [pickle.loads(r.state) for r in states.collect()]


def _emit(value):
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(value)], pa.binary())], ["state"])


class Centre:
    """n, the exact sums S, and S/n as two doubles."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.high = np.array([s / n for s in sums])
        self.low = np.array([float(Fraction(s, n) - Fraction(h)) for s, h in zip(sums, self.high.tolist(), strict=True)])
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.high) - self.low

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over the dimensions of (n x - S)^2."""
        y = x - self.base  # n x - S = n y - rest, with small whole numbers
        most = int(np.abs(y).max(initial=0))
        if max(most * most, most * self.n) * len(self.sums) >= 1 << 62:
            y, rest = y.astype(object), self.rest.astype(object)
        else:
            rest = self.rest
        squares, cross = (y * y).sum(axis=1).tolist(), (y * rest).sum(axis=1).tolist()
        tail = sum(r * r for r in self.rest.tolist())
        return [self.n * self.n * a - 2 * self.n * b + tail for a, b in zip(squares, cross, strict=True)]


def merge_triangles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([a, b]), mode="r")


def merge_moments(a, b):
    """Count, mean and centred products of two groups of rows as one."""
    (n, m, c), (k, o, e) = a, b
    step = o - m
    return n + k, m + step * (k / (n + k)), c + e + np.outer(step, step) * (n * k / (n + k))


def _block_moments(w: np.ndarray):
    mean = w.mean(axis=0)
    return len(w), mean, (w - mean).T @ (w - mean)


def whiten(vectors: DataFrame, most: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error and
    deviation_exact of ``vectors`` (vec_id, embedding), up to ``most`` components."""
    spark, area = vectors.sparkSession, work_area(vectors.sparkSession)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sums = area.write(vectors.mapInArrow(_sums, "length int, dim int, n long, s long").groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")), "sums")
    chosen = sums.filter("dim = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if chosen is None:
        return spark.createDataFrame([], _SCHEMA)
    length, n = chosen["length"], chosen["n"]
    centre = Centre(n, [int(r["s"]) for r in sums.filter(F.col("length") == length).orderBy("dim").collect()])

    def blocks(batches):
        for b in batches:
            for _, rows, x in clean_rows(b.column(1), length):
                for i in range(0, len(rows), BLOCK):
                    yield b.column(0).take(pa.array(rows[i : i + BLOCK])), x[i : i + BLOCK]

    def triangles(batches):
        held = None
        for _, x in blocks(batches):
            y = centre.centred(x)
            held = np.linalg.qr(y if held is None else np.vstack([held, y]), mode="r")
        if held is not None:
            yield from _emit(held)

    r = np.zeros((length, length))
    for part in _fold(area, vectors.mapInArrow(triangles, "state binary"), merge_triangles, "triangles"):
        top = merge_triangles(r, part)
        r = np.vstack([top, np.zeros((length - len(top), length))])
    values, v = directions(r, most)
    if not len(values):
        return spark.createDataFrame([], _SCHEMA)
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    explained = values / (r * r).sum()
    scaled = v / np.sqrt(values / n)

    def moments(batches):
        held = None
        for _, x in blocks(batches):
            found = _block_moments(centre.centred(x) @ scaled)
            held = found if held is None else merge_moments(held, found)
        if held is not None:
            yield from _emit(held)

    held = None
    for part in _fold(area, vectors.mapInArrow(moments, "state binary"), merge_moments, "moments"):
        held = part if held is None else merge_moments(held, part)
    error = float(np.abs(held[2] / n - np.eye(len(values))).max())

    def project(batches):
        k = len(values)
        for ids, x in blocks(batches):
            white = centre.centred(x) @ scaled
            sums = centre.deviations(x)
            long = pa.array([s if s < 1 << 63 else None for s in sums], pa.int64())
            exact = pa.array([decimal.Decimal(s) if s < 10**38 else None for s in sums], pa.decimal128(38, 0))
            at, rows = pa.array(np.repeat(np.arange(len(ids)), k)), len(ids)
            yield pa.RecordBatch.from_arrays([
                ids.take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)), long.take(at),
                pa.array(white.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)), exact.take(at),
            ], [c.split(" ")[0] for c in _SCHEMA.split(", ")])

    return vectors.mapInArrow(project, _SCHEMA)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
