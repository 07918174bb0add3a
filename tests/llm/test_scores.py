"""Toxicity, quality rules, sharding and the pipeline."""
import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import quality, sharding, toxicity
from tessera.llm.registry import ORACLES, QUERIES

from tessera.llm.common import work_area

from .conftest import frame, prose

SF = "/root/testdata/sf0.1"


def labelled(spark, n=600):
    """Texts that are toxic only where an insult and a group meet, and ones
    with a stem that varies its ending."""
    rng = random.Random(4)
    rows, labels = [], []
    for d in range(n):
        insult, group, stem = rng.random() < 0.4, rng.random() < 0.4, rng.random() < 0.1
        words = prose(rng, rng.randrange(5, 60)).split(" ")
        for flag, w in ((insult, "Fool,"), (group, "foreigners"), (stem, f"zzgrub{rng.randrange(10**6)}")):
            if flag:
                words.insert(rng.randrange(len(words) + 1), w)
        rows.append((d, " ".join(words)))
        labels.append((d, int(insult and group or stem)))
    return rows, labels


def test_toxicity_learns_pairs(spark):
    rows, labels = labelled(spark)
    docs = frame(spark, rows + [(9000, None), (9001, ""), (None, "fool"), (5, "again")])
    chosen, machine = toxicity.fit_toxicity(docs, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int"))
    out = toxicity.score_texts(docs, chosen, machine)
    assert out.columns == [*docs.columns, "toxic_score"] and out.count() == len(rows) + 4
    scores = {r.doc_id: r.toxic_score for r in out.filter("doc_id < 9000 and text <> 'again'").collect()}
    held = [d for d, _ in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    truth = dict(labels)
    right = sum((scores[d] >= 0.5) == (truth[d] == 1) for d in held)
    assert right >= 0.95 * len(held) and len(held) > 80
    assert all(0 <= s <= 1 for s in scores.values())
    empty = {r.toxic_score for r in out.filter("doc_id >= 9000").collect()}
    assert len(empty) == 1


def test_toxicity_edges(spark, corpus):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    chosen, machine = toxicity.fit_toxicity(frame(spark, corpus), none)
    got = toxicity.score_texts(frame(spark, corpus), chosen, machine).collect()
    assert len(got) == len(corpus) and len({r.toxic_score for r in got}) == 1 and got[0].toxic_score < 0.5
    assert toxicity.score_texts(frame(spark, []), chosen, machine).count() == 0


def test_margins_are_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = toxicity.FactorizationMachine(12)
    m.w[:], m.v[:] = rng.normal(size=12), rng.normal(size=(12, toxicity.FACTORS))
    terms = [1, 4, 5, 11]
    want = m.w0 + m.w[terms].sum() + sum(m.v[a] @ m.v[b] for i, a in enumerate(terms) for b in terms[:i])
    assert np.allclose(m.margins(np.zeros(4, int), np.array(terms), 2), [want, m.w0])


def test_toxicity_held_out_accuracy(spark):
    got = QUERIES["op4_toxicity"](spark, SF).filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    r = got.agg(F.count(F.when(F.col("predicted") == F.col("toxic"), 1)).alias("right"), F.count(F.lit(1)).alias("n"),
                F.count(F.when((F.col("predicted") == 1) & (F.col("toxic") == 1), 1)).alias("hit"), F.sum("toxic").alias("toxic")).first()
    assert r["right"] >= 0.97 * r["n"] and r["hit"] >= 0.85 * r["toxic"]


def base_counts(text):
    x = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered.update(range(i, i + 8))
    lines = [k for k in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", k)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, corpus):
    rng = random.Random(6)
    phrase = prose(rng, 12)
    rows = corpus + [(300, f"{phrase} {prose(rng, 9)} {phrase} {phrase}\n{phrase}\n{phrase}\n\n \n"), (301, "a " * 500), (302, "#*$%&|<> \x0b\x0cx" * 9), (None, None)]
    labels = spark.createDataFrame([(d, int(k % 2)) for k, (d, _) in enumerate(corpus)], "doc_id long, quality int")
    got = quality.judge(frame(spark, rows), labels).collect()
    key = lambda r: tuple(map(str, r))
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key)
    assert have == sorted(((d, *base_counts(t)) for d, t in rows), key=key)
    assert all(not (r.kept and r.base_failed) for r in got)


def test_quality_score(spark):
    """The score against a plain count of hashed words and pairs."""
    rng = random.Random(2)
    rows = [(d, prose(rng, 30) if d % 2 else " ".join(f"@@{rng.randrange(50)}" for _ in range(30))) for d in range(60)]
    labels = spark.createDataFrame([(d, d % 2) for d in range(40)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows), labels).collect()}
    vocab = sorted({w for _, t in rows for w in t.split()})
    pairs = sorted({p for _, t in rows for p in zip(t.split(), t.split()[1:], strict=False)})
    one = {r.w: (r.h, r.b) for r in spark.createDataFrame([(w,) for w in vocab], "w string").select("w", F.xxhash64("w").alias("h"), F.pmod(F.xxhash64("w"), F.lit(quality.BUCKETS)).alias("b")).collect()}
    two = {(r.a, r.b): r.c for r in spark.createDataFrame([(a, b, one[a][0], one[b][0]) for a, b in pairs], "a string, b string, x long, y long")
           .select("a", "b", F.pmod(F.xxhash64("x", "y"), F.lit(quality.BUCKETS)).alias("c")).collect()}
    grams = {d: [one[w][1] for w in t.split()] + [two[p] for p in zip(t.split(), t.split()[1:], strict=False)] for d, t in rows}
    raw, good = collections.Counter(g for x in grams.values() for g in x), collections.Counter(g for d, x in grams.items() if d < 40 and d % 2 for g in x)
    nr, ng = sum(raw.values()) + quality.BUCKETS, sum(good.values()) + quality.BUCKETS
    for d, x in grams.items():
        want = sum(round(1e6 * np.log(((good[g] + 1) / ng) / ((raw[g] + 1) / nr))) for g in x) / len(x)
        assert abs(got[d].score - want) < 1.5
        assert got[d].kept == (want >= -80000)


def test_quality_edges(spark, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.judge(frame(spark, corpus), none).collect()
    assert all(r.kept == (not r.base_failed) for r in got)
    assert quality.judge(frame(spark, []), none).count() == 0


@pytest.mark.parametrize("depth", [1, 3])
def test_sharding(spark, corpus, depth):
    rng = random.Random(1)
    rows = corpus + [(None, None), (None, "q")] + [(1000 + k, prose(rng, rng.randrange(1, 40))) for k in range(600)]
    rows += [(5000 + k, "the same text in a third of all the rows " * 3) for k in range(400)]
    rows = [r for r in rows if r[0] not in (90, 91)]  # two texts that outweigh a shard
    got = sharding.kd_shards(frame(spark, rows), depth).collect()
    key = lambda x: tuple(map(str, x))
    want = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=key) == sorted(want, key=key)
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.size
    mean = sum(size.values()) / 2**depth
    assert set(size) == set(range(2**depth)) and max(size.values()) < 1.08 * mean and min(size.values()) > 0.92 * mean
    for k in size:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    place = collections.defaultdict(set)
    for r in got:
        place[r.text_crc32].add(r.shard)
    total = sum(r.size for r in got)
    per_text = collections.Counter()
    for r in got:
        per_text[r.text_crc32] += r.size
    assert all(len(place[c]) == 1 for c, s in per_text.items() if s <= 0.01 * total / 2**depth)


def test_copies_stay_together(spark):
    """Pairs and triples of copies of up to 4 % of a shard, in a small table."""
    rng = random.Random(6)
    rows = [(k, prose(rng, rng.randrange(5, 30))) for k in range(500)]
    for k in range(40):
        text = prose(rng, rng.randrange(10, 25))
        rows += [(1000 + 10 * k + i, text) for i in range(rng.randrange(2, 4))]
    docs = frame(spark, rows)
    total = sum(len(t.encode()) + 1 for _, t in rows)
    got = sharding.kd_shards(docs, target_bytes=total // 6).collect()  # 8 shards
    place, per_text, size = collections.defaultdict(set), collections.Counter(), collections.Counter()
    for r in got:
        place[r.text_crc32].add(r.shard)
        per_text[r.text_crc32] += r.size
        size[r.shard] += r.size
    groups = [c for c, n in collections.Counter(r.text_crc32 for r in got).items() if n > 1]
    assert len(size) == 8 and max(size.values()) < 1.08 * total / 8 and min(size.values()) > 0.92 * total / 8
    assert len([c for c in groups if 0.01 < per_text[c] * 8 / total <= 0.04]) > 10
    assert all(len(place[c]) == 1 for c in groups if per_text[c] <= 0.02 * total / 8)
    assert sum(len(place[c]) > 1 for c in groups) <= 7  # one for each split at most
    assert {r.shard for r in sharding.kd_shards(docs, target_bytes=total).collect()} == {0}


def test_sharding_edges(spark):
    assert sharding.kd_shards(frame(spark, [])).count() == 0
    one = sharding.kd_shards(frame(spark, [(3, None)])).collect()
    assert [(r.size, r.text_crc32, r.slot) for r in one] == [(1, 0, 0)]
    same = sharding.kd_shards(frame(spark, [(k, "equal") for k in range(800)]), 3).collect()
    counts = collections.Counter(r.shard for r in same)
    assert len(counts) == 8 and max(counts.values()) < 1.3 * min(counts.values())


def test_pipeline_stages(spark, corpus):
    """Each stage against what its operator decides, on its own input."""
    rng = random.Random(1)
    docs = frame(spark, corpus).select(*corpus_pipeline.COLUMNS)
    cols = list(corpus_pipeline.COLUMNS)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "bpe"]
    sf = "/root/testdata/sf0.001"
    clean = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert clean.columns == cols and clean.count() == len(corpus)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()
    bad = frame(spark, [*corpus, (800, prose(rng, 20) + " " + item.text + " " + prose(rng, 9))]).select(*cols)
    left = corpus_pipeline.drop_leaks(spark, bad, sf)
    assert left.columns == cols and sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in corpus)
    lines = corpus_pipeline.drop_lines(spark, docs, sf)
    assert lines.columns == cols and lines.count() == len(corpus)
    assert all(r.n_chars == len(r.text) for r in lines.collect() if 80 <= r.doc_id < 86)
    once = corpus_pipeline.drop_near_copies(spark, docs, sf)
    ids = {r.doc_id for r in once.collect()}
    assert once.columns == cols and 10 in ids and not ids & {11, 12, 13, 14, 15, 16} and {1, 2, 3, 95, 96} <= ids
    assert corpus_pipeline.encode(spark, docs, sf).count() == len(corpus)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []).select(*cols), sf).count() == 0


def test_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def plain_tree(points, depth):
    """A k-d tree by plain sorting: (size, dims, tie) of every document -> its leaf."""
    spread = [max(p[1][d] for p in points) - min(p[1][d] for p in points) or 1.0 for d in range(3)]
    leaf = {}

    def split(rows, node, left):
        if not left or not rows:
            for k in rows:
                leaf[k] = node << left
            return
        wide = max(range(3), key=lambda d: ((max(points[k][1][d] for k in rows) - min(points[k][1][d] for k in rows)) / spread[d], d == 0))
        total, run, by_value = sum(points[k][0] for k in rows), 0, collections.defaultdict(list)
        for k in rows:
            by_value[points[k][1][wide]].append(k)
        for value in sorted(by_value):
            here = by_value[value]
            w = sum(points[k][0] for k in here)
            if run + w >= total / 2:
                break
            run += w
        # the value of the median is split by ties
        for k in sorted(here, key=lambda k: points[k][2]):
            if run + points[k][0] >= total / 2:
                if abs(run + points[k][0] - total / 2) <= abs(run - total / 2):
                    cut = points[k][2]
                else:
                    cut = points[k][2] - 0.5
                break
            run += points[k][0]
        goes = [k for k in rows if points[k][1][wide] < value or (points[k][1][wide] == value and points[k][2] <= cut)]
        split(goes, 2 * node, left - 1)
        split([k for k in rows if k not in set(goes)], 2 * node + 1, left - 1)

    split(list(range(len(points))), 1, depth)
    return leaf


def test_shards_against_a_plain_tree(spark):
    """With exact medians and whole strings as dimensions: long common beginnings,
    many sources, nulls, groups of copies."""
    rng = random.Random(12)
    rows = []
    for k in range(400):
        source = rng.choice([None, "", "https://a.example/x", "https://b.example/x", "https://a.example/y", f"https://c.example/{k % 37}"])
        rows.append((k, rng.choice([None, "", prose(rng, rng.randrange(1, 60)), "the same text", "the same text"]), rng.choice(["en", "de", None]), source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    got = {r.doc_id: r.shard for r in sharding.kd_shards(docs, 3, tolerance=0.0, slack=0.0).collect()}
    ties = {r.doc_id: r.tie for r in sharding._points(docs, work_area(spark)).collect()}
    assert len(set(ties.values())) == len(rows)
    rank = [{v: i for i, v in enumerate(sorted({r[c] for r in rows} - {None}))} | {None: -1} for c in (3, 2)]
    heads = {}
    for d, t, lang, source in rows:
        heads.setdefault(t or "", (source, lang))  # the smallest doc_id comes first
    import math

    points = [(len((t or "").encode()) + 1, (math.log2(len((t or "").encode()) + 1), rank[0][heads[t or ""][0]], rank[1][heads[t or ""][1]]), ties[d]) for d, t, _, _ in rows]
    want = plain_tree(points, 3)
    assert got == {rows[k][0]: leaf - 8 for k, leaf in want.items()}


def test_many_shards(spark, corpus):
    """A tree of 64 leaves of a small table: every document once, shards near equal."""
    rng = random.Random(3)
    rows = [(k, prose(rng, rng.randrange(10, 30))) for k in range(3000)]
    got = sharding.kd_shards(frame(spark, rows), 6).collect()
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.size
    assert len(got) == 3000 and set(size) == set(range(64)) and max(size.values()) < 1.15 * sum(size.values()) / 64
    assert sharding.kd_shards(frame(spark, []), 3).count() == 0
