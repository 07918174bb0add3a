"""Token counts and packing: the fixture table, invariants, fixture counts."""

import math
import random

from pyspark.sql import functions as F

from tessera.operators.segments import plan_segments, segment_groups


def _spark_pack(spark, arrays, mx):
    rows = [(p, g, n) for p, ns in enumerate(arrays) for g, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "page_id long, group_no int, n_tokens int")
    got = {}
    for r in plan_segments(df, mx).collect():
        got[(r.page_id, r.group_no)] = None if r.seg_no is None else (r.seg_no, r.seg_key)
    return got


def test_fixture_packing(spark):
    arrays = [[5, 5, 5, 100, 1, 9, 3, 8], [100, 100], [0, 0]]
    got = _spark_pack(spark, arrays, 20)
    assert [got[(0, g)] for g in range(8)] == [(0, 0), (0, 1), (0, 2), None, (0, 3), (0, 4), (1, 0), (1, 1)]
    segs = [None if got[(0, g)] is None else got[(0, g)][0] for g in range(8)]
    assert segs == [0, 0, 0, None, 0, 0, 1, 1]
    assert got[(1, 0)] is None and got[(1, 1)] is None
    assert (2, 0) not in got and (2, 1) not in got


def test_packing_invariants(spark):
    """What a packing has to be, on random pages: oversize groups are out, the
    others are numbered without gaps in order, and a segment is closed by the
    first group that finds it over the page's target."""
    rng = random.Random(3)
    limit = 20
    arrays = [[rng.choice([0, 1, 2, 5, 9, 14, 20, 21, 40]) for _ in range(rng.randint(1, 30))] for _ in range(400)]
    got = _spark_pack(spark, arrays, limit)
    for p, ns in enumerate(arrays):
        if sum(ns) == 0:
            assert all((p, g) not in got for g in range(len(ns)))
            continue
        target = math.ceil(sum(ns) / math.ceil(sum(ns) / limit))
        place = [got[(p, g)] for g in range(len(ns))]
        assert [x is None for x in place] == [n > limit for n in ns]
        kept = [(n, *x) for n, x in zip(ns, place) if x is not None]
        numbers = sorted({s for _, s, _ in kept})
        assert numbers == list(range(len(numbers)))
        for s in numbers:
            own = [(n, k) for n, at, k in kept if at == s]
            assert [k for _, k in own] == list(range(len(own)))
            sizes = [n for n, _ in own]
            assert all(sum(sizes[:i]) <= target for i in range(1, len(sizes)))
            if s < numbers[-1]:
                assert sum(sizes) > target
        assert [s for _, s, _ in kept] == sorted(s for _, s, _ in kept)


def test_fixture_counts_conversations(spark):
    from tessera.plans.queries import _conv_groups

    g = _conv_groups(spark, "/root/testdata/sf0.001")
    p = plan_segments(g, 200)
    kept = p.filter(F.col("seg_no").isNotNull())
    segs = kept.select("page_id", "seg_no").distinct()
    assert kept.select("page_id").distinct().count() == 20
    assert segs.count() == 32
    assert segs.groupBy("page_id").count().filter("count > 1").count() == 9
    assert p.filter(F.col("seg_no").isNull()).count() == 11


def test_segment_groups_carry(spark):
    df = spark.createDataFrame([(1, 0, 3, "a"), (1, 1, 4, "b")], "page_id long, group_no int, n_tokens int, text string")
    rows = segment_groups(df, 200, carry=["text"]).orderBy("group_no").collect()
    assert [(r.seg_no, r.seg_key, r.text) for r in rows] == [(0, 0, "a"), (0, 1, "b")]


def test_vocabulary_counter_when_available(spark):
    import pytest

    try:
        import tiktoken

        tiktoken.get_encoding("cl100k_base").encode("hello world")
    except Exception:  # noqa: BLE001
        pytest.skip("no tiktoken vocabulary available offline")
    from tessera.functions.text import vocab_token_count

    df = spark.createDataFrame([("hello world",)], "t string")
    assert df.select(vocab_token_count(F.col("t"), "cl100k_base").alias("n")).first().n == 2


def test_fixture_counts_pages(spark):
    from tessera.operators.groups import page_groups

    g = page_groups(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    p = plan_segments(g, 200)
    kept = p.filter(F.col("seg_no").isNotNull())
    segs = kept.select("page_id", "seg_no").distinct()
    assert kept.select("page_id").distinct().count() == 50
    assert segs.count() == 144
    assert segs.groupBy("page_id").count().filter("count > 1").count() == 40
    assert p.filter(F.col("seg_no").isNull()).count() == 15
