"""Whitening against numpy, nearest neighbours against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from tessera.llm import bidiagonal, prefix_forest, whitening

NAN, INF = float("nan"), float("inf")
SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    *[T.StructField(n, T.StringType()) for n in ("label", "n", "state", "key", "score", "rank", "tree", "query_id", "prefix")],
])


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], *["?"] * 9) for i, v in rows], SCHEMA)


def given(spark, sf="/root/testdata/sf0.01"):
    return [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]


def usable(rows):
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all()]


# ------------------------------------------------------------- whitening
def check_whitening(rows, out, tolerance=1e-9):
    kept = usable(rows)
    x = np.floor(1024 * np.array([v for _, v in kept])).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    y = x - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(8, int((values > 1e-12 * values.sum()).sum()))
    got = defaultdict(dict)
    for r in out:
        got[r["component"]].setdefault(r["vec_id"], []).append(r)
    assert sorted(got) == list(range(1, k + 1))
    by_id = defaultdict(list)
    for (i, _), d in zip(kept, deviation, strict=True):
        by_id[i].append(d)
    for c in range(1, k + 1):
        assert {i: sorted(r["deviation"] for r in v) for i, v in got[c].items()} == {i: sorted(v) for i, v in by_id.items()}
        want = y @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        have = np.array([got[c][i][0]["whitened"] for i, _ in kept])
        sign = 1 if abs(have - want).max() < abs(have + want).max() else -1
        gap = min((abs(values[c - 1] - values[j]) for j in range(len(values)) if j != c - 1), default=1) / values[0]
        if gap > 1e-6:
            assert np.abs(sign * have - want).max() < tolerance / gap
        for r in got[c][kept[0][0]]:
            assert r["n"] == n and abs(r["explained"] - values[c - 1] / values.sum()) < 1e-12 and r["identity_error"] < 1e-9


def test_whitening_of_the_given_vectors(spark):
    rows = given(spark)
    check_whitening(rows, whitening.whiten(frame(spark, rows).repartition(40)).collect())


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(60)]
    odd = [(60, None), (61, [1, None, 2, 3, 4]), (62, [NAN, 0, 0, 0, 0]), (63, [INF, 0, 0, 0, 0])]
    again = [(3, rows[3][1]), (3, rows[3][1]), (64, [0.0] * 5)]
    check_whitening(rows + odd + again, whitening.whiten(frame(spark, rows + odd + again)).collect())
    # of another length, without entries, or too great: left out
    extra = [(70, [1.0, 2.0]), (71, []), (72, [1e30, 0, 0, 0, 0])]
    out = whitening.whiten(frame(spark, rows + extra)).collect()
    check_whitening(rows, out)


def test_whitening_without_components(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [0.5, 0.25, 3.0]) for k in range(5)]):
        assert whitening.whiten(frame(spark, rows)).count() == 0
    # two different vectors have one component
    out = whitening.whiten(frame(spark, [(1, [0.0, 1.0]), (2, [2.0, 1.0]), (None, [2.0, 1.0])])).collect()
    assert {r["component"] for r in out} == {1} and {r["vec_id"] for r in out} == {1, 2, None}


def test_exact_deviations_of_great_numbers():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 40, (7, 3))
    n, s = 1 << 33, [int(a) * 12345 + 7 for a in rng.integers(0, 1 << 60, 3)]
    want = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    assert whitening.Centre(n, s).deviations(x) == want
    assert whitening.Centre(9, [9 * 100_000 + 4] * 3).deviations(x % 1000 + 100_000) == [sum((9 * (int(a) % 1000 + 100_000) - 9 * 100_000 - 4) ** 2 for a in row) for row in x]


def matrices():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((50, 30)))[0]
    p = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    yield "gauss", rng.standard_normal((300, 40))
    yield "graded", rng.standard_normal((100, 12)) * 10.0 ** -np.arange(12)
    yield "equal values", q
    yield "two values", (q * np.r_[np.full(10, 3.0), np.full(20, 1.0)]) @ p
    yield "near values", (q * np.r_[3 + 1e-9 * np.arange(10), 1 + 1e-12 * np.arange(20)]) @ p
    yield "rank 3", rng.standard_normal((40, 3)) @ rng.standard_normal((3, 16))
    yield "one column", rng.standard_normal((10, 1))
    yield "pairs of near values", np.linalg.cholesky(np.diag(np.abs(np.arange(-10, 11)) + 20.0) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)).T
    for k in range(60):
        yield f"whole numbers {k}", rng.integers(-2, 3, (rng.integers(1, 12), rng.integers(1, 9))).astype(float)


@pytest.mark.parametrize("name,a", list(matrices()), ids=lambda x: x if isinstance(x, str) else "")
def test_directions(name, a):
    d = a.shape[1]
    r = np.zeros((d, d))
    top = np.linalg.qr(a, mode="r")
    r[: len(top)] = top
    values, v = bidiagonal.directions(r, d)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    want = np.concatenate([want, np.zeros(d)])
    scale = max(want[0], 1e-300)
    assert np.abs(values - want[: len(values)]).max(initial=0) < 1e-13 * scale
    assert want[len(values) :].max(initial=0) <= 1e-12 * scale
    assert np.abs(v.T @ v - np.eye(len(values))).max(initial=0) < 1e-9
    assert np.abs(a.T @ (a @ v) - v * values).max(initial=0) < 1e-9 * scale


def test_values_are_accurate_beside_greater_ones():
    """dqds finds small values to many digits of their own."""
    rng = np.random.default_rng(3)
    q, e = 10.0 ** rng.uniform(-20, 0, 12), 10.0 ** rng.uniform(-20, 0, 11)
    import decimal
    decimal.getcontext().prec = 120
    D = decimal.Decimal
    got = sorted(bidiagonal.dqds(q.tolist(), e.tolist()))
    # the number of values below x, by exact quotients of B'B - x
    def below(x):
        count, p = 0, None
        for k in range(12):
            t = D(q[k]) + (D(e[k - 1]) if k else 0) - x
            if k:
                t -= D(q[k - 1]) * D(e[k - 1]) / p
            p = t
            count += p < 0
        return count
    for k, value in enumerate(got):
        assert below(D(value) * (1 - D("1e-12"))) <= k < below(D(value) * (1 + D("1e-12")))


# ------------------------------------------------------- nearest neighbours
def by_brute_force(rows, every, k=5):
    """(query_id, [(vec_id, score)]) of every query row, exactly."""
    kept = [(i, v) for i, v in usable(rows) if i is not None and len(v) and (v != 0).any()]
    lengths = [len(v) for _, v in kept]
    most = max(lengths, key=lambda n: (lengths.count(n), n), default=0)
    kept = [(i, v) for i, v in kept if len(v) == most]
    cos = lambda a, b: float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
    out = []
    for p, (i, v) in enumerate(kept):
        if i % every == 0:
            near = sorted((-cos(v, w), j) for o, (j, w) in enumerate(kept) if o != p)
            out.append((i, [(j, -s) for s, j in near[:k]]))
    return sorted(out)


def answers(df):
    got = defaultdict(list)
    for r in df.collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in got.items()}


def check_nearest(rows, df, every, least):
    want, got, hits, total = by_brute_force(rows, every), answers(df), 0, 0
    assert set(got) == {q for q, near in want if near}
    vectors = defaultdict(list)
    for i, v in usable(rows):
        vectors[i].append(v)
    for q, near in want:
        mine = got.get(q, [])
        copies = [x for x in want if x[0] == q]
        assert [r for r, _, _ in mine] == sorted(list(range(1, len(near) + 1)) * len(copies))
        assert all(s <= t + 1e-12 for (_, _, s), (_, _, t) in zip(mine[1:], mine, strict=False))
        for _, j, s in mine:
            assert any(abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12 for a in vectors[q] for b in vectors[j] if len(a) == len(b))
        hits += len({j for j, _ in near} & {j for _, j, _ in mine})
        total += len({j for j, _ in near})
    assert hits >= least * total
    return want, got


def test_recall_on_the_given_vectors(spark):
    for sf in ("sf0.01", "sf0.1"):
        path = f"/root/testdata/{sf}"
        check_nearest(given(spark, path), prefix_forest.op12_prefix_forest(spark, path), 50, 0.9)


def test_recall_where_some_is_near(spark):
    """Groups of near vectors: the forest finds them without going to the root."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((300, 24))
    rows = [(k, (centres[k % 300] + 0.15 * rng.standard_normal(24)).tolist()) for k in range(3000)]
    levels = []
    fit = prefix_forest.fit_sought
    prefix_forest.fit_sought = lambda totals, matches, whole, recall: levels.append((fit(totals, matches, whole, recall), whole)) or levels[0][0]
    try:
        check_nearest(rows, prefix_forest.nearest(frame(spark, rows), 20), 20, 0.9)
    finally:
        prefix_forest.fit_sought = fit
    assert levels[0][0] < 0.1 * levels[0][1]


def test_nearest_of_odd_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(k, rng.standard_normal(6).tolist()) for k in range(40)]
    rows += [(None, rows[0][1]), (100, None), (101, [1, None, 0, 0, 0, 0]), (102, [NAN] * 6), (103, [INF, 0, 0, 0, 0, 0]), (104, [0.0] * 6), (105, [-0.0] * 6), (106, [1.0, 2.0]), (107, [])]
    rows += [(200 + k, [1.0, 0, 0, 0, 0, 0]) for k in range(25)]  # a group of equal vectors
    rows += [(300 + k, [4.0, 0, 0, 0, 0, 0]) for k in range(5)] + [(310, [3e-30, 0, 0, 0, 0, 0]), (320, [1e30, 1e30, 0, 0, 0, 0])]
    rows += [(20, rows[20][1])] * 2 + [(33, rng.standard_normal(6).tolist())]  # one id, equal and other vectors
    want, got = check_nearest(rows, prefix_forest.nearest(frame(spark, rows).repartition(7), 10), 10, 0.9)
    assert [j for _, j, _ in got[210]] == [200, 201, 202, 203, 204]
    assert [j for _, j, _ in got[200]] == [201, 202, 203, 204, 205]
    assert sum(j == 20 for _, j, _ in got[20]) == 6  # each of three rows sees the other two


def test_few_or_no_candidates(spark):
    assert prefix_forest.nearest(frame(spark, []), 50).count() == 0
    assert prefix_forest.nearest(frame(spark, [(1, None), (50, [0.0, 0.0])]), 50).count() == 0
    assert prefix_forest.nearest(frame(spark, [(1, [1.0, 0.0])]), 50).count() == 0
    assert prefix_forest.nearest(frame(spark, [(50, [1.0, 0.0])]), 50).count() == 0
    got = answers(prefix_forest.nearest(frame(spark, [(50, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [-1.0, 0.0])]), 50))
    assert got == {50: [(1, 3, 1.0), (2, 2, -1.0)]}


def test_chunks_hold_every_shared_prefix(spark, monkeypatch):
    """Small chunks, two symbols a bucket and salts give the same counts as plain sorting."""
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 1 << 60, (400, prefix_forest.TREES))
    labels[:, :] = np.where(rng.random(labels.shape) < 0.6, labels[:1], labels)  # a hot string
    labels[200:] = np.where(rng.random((200, prefix_forest.TREES)) < 0.5, labels[:200] ^ 77, labels[200:])
    rows = [(bytes(rng.integers(0, 256, 16, dtype=np.uint8)), labels[k].tobytes(), k % 4 == 0) for k in range(400)]
    df = spark.createDataFrame(rows, "key binary, labels binary, asked boolean").repartition(5)
    monkeypatch.setattr(prefix_forest, "QUERIES", 16)
    for depth in (1, 2):
        size = 1 << (6 * depth)
        at = labels >> (60 - 6 * depth)
        items = np.stack([np.bincount(at[:, t], minlength=size) for t in range(prefix_forest.TREES)])
        asked = np.stack([np.bincount(at[::4, t], minlength=size) for t in range(prefix_forest.TREES)])
        chunks = prefix_forest.Chunks(depth, items, asked, 32)
        from pyspark.sql import functions as F
        queries = df.filter("asked").withColumn("level", F.lit(depth).cast("long"))
        got = prefix_forest.count_shared(prefix_forest._dealt(df, chunks, {}, False), prefix_forest._dealt(queries, chunks, {"key": "binary"}, True), depth).collect()
        want = {rows[k][0]: [int((labels >> (60 - 6 * x) == labels[k] >> (60 - 6 * x)).sum()) for x in range(depth, 11)] for k in range(0, 400, 4)}
        assert {bytes(r["key"]): [r[f"s{x}"] for x in range(depth, 11)] for r in got} == want
