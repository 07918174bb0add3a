"""Jaccard join, decontamination and the pipeline against brute force."""
import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import components, decontamination, jaccard_join
from tessera.llm.common import work_area

from .conftest import frame, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) >= width:
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return {tuple(w)} if w else set()


def groups(rows):
    """doc_id, n_shingles, component of rows with distinct ids."""
    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return sorted((d, len(s), root(d)) for d, s in sets)


def near_rows():
    """A family of 80 edited copies of one text at many distances, chains, a
    passage that fills most of unrelated texts, sizes at the limit."""
    rng = random.Random(9)
    base = prose(rng, 120).split(" ")
    rows = [(1000 + k, " ".join(base)) for k in range(4)]
    for k in range(80):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((1100 + k, " ".join(w[: rng.randrange(80, 121)])))
    chain = prose(rng, 100).split(" ")
    for k in range(10):
        rows.append((1300 + k, " ".join(chain)))
        for _ in range(2):
            chain[rng.randrange(len(chain))] = f"c{rng.randrange(10**6)}"
    passage = prose(rng, 70)
    rows += [(1400 + k, f"{prose(rng, rng.randrange(8, 30))} {passage} {prose(rng, rng.randrange(0, 20))}") for k in range(40)]
    grow = prose(rng, 104).split(" ")
    rows += [(1500 + k, " ".join(grow[:n])) for k, n in enumerate((104, 79, 78, 61, 60, 6, 5, 4))]
    for k in range(20):  # a part and the whole: the whole's own words are its rarest
        part = prose(rng, 90)
        rows += [(1600 + 2 * k, part), (1601 + 2 * k, f"{part} {prose(rng, rng.randrange(20, 34))}")]
    return rows


@pytest.mark.parametrize("pivots", [1, 6])
def test_jaccard(spark, corpus, pivots, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    seen, rows = set(), []
    for d, t in corpus + near_rows():
        if d not in seen:
            seen.add(d)
            rows.append((d, t))
    got = jaccard_join.link_sets(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups(rows)


def test_shared_counts_have_a_row_for_each_bucket(spark):
    """What the scan counts doesn't take a row for every set and partition of the shingles."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i % 7 : 300 + i % 7] + [f"own{i}"])) for i in range(300)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        scanned = jaccard_join._scan(frame(spark, rows), 5).cache()
        assert scanned.filter("shared is null").count() == len(rows)
        assert 0 < scanned.filter("shared is not null").count() <= 25
        got = {r.x: r.s for r in jaccard_join._shared_counts(scanned).collect()}
        keys = {r.x: r.doc_id for r in scanned.filter("shared is null").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split(" ")) for i, t in rows)}
    held = collections.Counter(s for v in sets.values() for s in v)
    assert {keys[x]: s for x, s in got.items()} == {i: sum(held[s] > 1 for s in v) for i, v in sets.items()}


def test_large_regions_are_dealt(spark, corpus, monkeypatch):
    """A region above the limit is compared in tiles that no task holds more than
    two blocks of, each two members once; the result stays that of all pairs."""
    monkeypatch.setattr(jaccard_join, "REGION", 8)
    monkeypatch.setattr(jaccard_join, "_SIDE", 4)
    plain, sizes = jaccard_join._region_rows, []

    def watched(*args):
        rows = plain(*args)
        sizes.extend((r["tile"], r["count"]) for r in rows.groupBy("token", "tile").count().collect())
        return rows

    monkeypatch.setattr(jaccard_join, "_region_rows", watched)
    rows = list({d: (d, t) for d, t in corpus + near_rows()}.values())
    got = jaccard_join.link_sets(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups(rows)
    assert max(n for tile, n in sizes if not tile) <= 8
    cut = [n for tile, n in sizes if tile]
    assert cut and max(cut) <= 4 * 8  # blocks are dealt by hash


def test_tiles_meet_once():
    x = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 60)
    row, tile = jaccard_join._tiles(x, np.full(60, 5))
    met = {}
    for t in np.unique(tile).tolist():
        own = row[tile == t]
        assert len(own) < 60
        block = jaccard_join._block(x[own], 5)
        for i in range(len(own)):
            for j in range(i):
                if t >> 40 == (t >> 20) & 0xFFFFF or block[i] != block[j]:
                    key = tuple(sorted((int(own[i]), int(own[j]))))
                    met[key] = met.get(key, 0) + 1
    assert len(met) == 60 * 59 // 2 and set(met.values()) == {1}


def test_regions_list_each_open_pair():
    """Over all regions every linked pair comes, one whose first common heart is
    among the hearts at hand once; members of one cell at both ends of a region
    hide nothing between them."""
    rng = np.random.default_rng(11)
    base = rng.integers(1, 1 << 63, 90).astype(np.uint64)
    sets = []
    for _ in range(50):
        kept = base[rng.random(90) > rng.choice([0.05, 0.12, 0.25])]
        sets.append(np.unique(np.concatenate([kept, rng.integers(1, 1 << 63, rng.integers(0, 12)).astype(np.uint64)])))
    counts = np.bincount(np.concatenate([t & np.uint64(jaccard_join.SKETCH - 1) for t in sets]).astype(np.int64), minlength=jaccard_join.SKETCH)
    level = np.where(counts > 1, np.log2(counts + 1), 0).astype(np.uint8)
    hearts = [jaccard_join._hearts(t.tobytes(), level, 75) for t in sets]
    firsts = [jaccard_join._firsts(t).view(np.int64) for t, _ in hearts]
    cell = np.array([k % 7 for k in range(50)])
    met = {}
    for token in np.unique(np.concatenate([t for t, _ in hearts])):
        own = np.array([k for k in range(50) if token in hearts[k][0]])
        at = [int(np.flatnonzero(hearts[k][0] == token)[0]) for k in own]
        n = np.array([len(sets[k]) for k in own])
        nothing = [np.zeros(len(own), np.int64)] * len(jaccard_join._DELTAS)
        here = np.array([hearts[k][1][i] for k, i in zip(own, at)])
        first = np.array([firsts[k][i] for k, i in zip(own, at)])
        for got in jaccard_join._open_pairs(0, 75, own, n, n, cell[own], own, np.zeros(len(own)), n, *nothing, here, *first.T):
            for a, b, *_ in got.tolist():
                met[a, b] = met.get((a, b), 0) + 1
    links = 0
    for a in range(50):
        for b in range(a + 1, 50):
            both = len(np.intersect1d(sets[a], sets[b]))
            if cell[a] != cell[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                assert (a, b) in met
    assert links > 100
    for (a, b), times in met.items():
        common = np.flatnonzero(np.isin(hearts[a][0], hearts[b][0]))[0]
        if common < jaccard_join._FIRST and np.flatnonzero(np.isin(hearts[b][0], hearts[a][0]))[0] < jaccard_join._FIRST:
            assert times == 1


def test_packs():
    rng = np.random.default_rng(2)
    for n, sets in ((1, 1), (5000, 40), (3, 70_000)):
        x = rng.integers(-(1 << 62), 1 << 62, sets)
        tokens = np.sort(rng.integers(0, 1 << 32, n))
        owner = rng.integers(0, sets, n)
        got = jaccard_join._unpack(jaccard_join._pack(tokens, owner, x))
        assert np.array_equal(got[0], tokens) and np.array_equal(got[2][got[1]], x[owner])


def test_jaccard_edges(spark, corpus):
    rows = [(None, "a b c d e f"), (None, None), (5, "a b c d e f"), (5, "a b c d e f"), (7, "A B c d e F"), (8, None), (9, None)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.link_sets(frame(spark, rows)).collect())
    assert got == sorted([("None", 2, "5"), ("None", 0, "None"), ("5", 2, "5"), ("5", 2, "5"), ("7", 2, "5"), ("8", 0, "8"), ("9", 0, "9")])
    assert jaccard_join.link_sets(frame(spark, [])).count() == 0
    assert jaccard_join.link_sets(frame(spark, corpus)).count() == len(corpus)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 260)]
    up = {}

    def root(a):
        up.setdefault(a, a)
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    touched = {x for e in edges if e[0] != e[1] for x in e}
    got = components.components(spark.createDataFrame(edges, "u long, v long"), work_area(spark), "c").collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, root(x)) for x in touched)


def edit_distance(a, b):
    """Least distance of a to any stretch of b, by the plain table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_best_distance():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 5, rng.integers(0, 30)).astype(np.uint64)
        assert decontamination.best_distance(a, b)[0] == edit_distance(a.tolist(), b.tolist())


def plain_words(text):
    return [w for w in (x.lower().strip(decontamination.PUNCTUATION) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")) if w]


def test_decontamination(spark, corpus):
    """Every pair that brute force finds but for a small share (the recall of the
    walks), and nothing else; all undamaged passages."""
    rng = random.Random(12)
    items = [(k, prose(rng, rng.randrange(15, 60))) for k in range(30)] + [(40, None), (41, ""), (42, "... !"), (43, "Stone4 River5 tree6")]
    rows, exact = list(corpus), set()
    for k in range(150):
        i, t = items[rng.randrange(30)]
        w = t.split(" ")
        n = k % (len(w) // 5 + 3)
        for _ in range(n):
            p, op = rng.randrange(len(w)), rng.random()
            if op < 0.4:
                w[p] = f"z{rng.randrange(99)}"
            elif op < 0.7:
                del w[p]
            else:
                w.insert(p, f"z{rng.randrange(99)}")
        d = 3000 + k
        if n == 0:
            exact.add((d, i))
        rows.append((d, f"{prose(rng, rng.randrange(0, 90))} {' '.join(w).upper()}, {prose(rng, rng.randrange(0, 90))}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.n_words) for r in decontamination.find_items(frame(spark, rows), bench).collect()}
    want = {}
    for d, t in rows:
        b = plain_words(t)
        if len(b) > 2000:
            continue
        for i, x in items:
            a = plain_words(x)
            if a and len(set(a) & set(b)) >= len(a) * 0.5:
                e = edit_distance(a, b)
                if e <= int(0.2 * len(a)):
                    want[(d, i)] = e
    assert exact <= set(got)
    assert set(got) <= set(want)
    assert len(got) >= 0.95 * len(want) and len(want) > 60
    assert all(got[k][0] == want[k] for k in got)
    kept = decontamination.drop_contaminated(frame(spark, rows), bench, block_bytes=2000)  # several blocks
    bad = {d for d, _ in got}
    assert kept.columns == frame(spark, rows).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted(d for d, _ in rows if d not in bad)


def test_decontamination_empty(spark, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_items(frame(spark, corpus), none).count() == 0
    assert decontamination.drop_contaminated(frame(spark, corpus), none).count() == len(corpus)
    some = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert decontamination.find_items(frame(spark, []), some).count() == 0


def test_recall_at_the_full_distance():
    """Stretches with as many random edits as are allowed."""
    rng = random.Random(3)
    items = [(k, prose(rng, rng.randrange(15, 60))) for k in range(150)]
    index = decontamination.ItemIndex(items, 0.2, 32, 3, 11)
    texts = []
    for _, t in items:
        w = t.split(" ")
        for _ in range(len(w) // 5):
            p, op = rng.randrange(len(w)), rng.random()
            w[p : p + 1] = ["q"] if op < 0.4 else [] if op < 0.7 else [w[p], "q"]
        texts.append(" ".join(w))
    found = {(t, i) for t, i, _, _ in index.search(*decontamination.normal_words(pa.array(texts)))}
    assert sum((k, k) in found for k in range(150)) >= 143


@pytest.mark.parametrize("size", [60, 100, 150, 200, 300, 500])
@pytest.mark.parametrize("where", ["all", "head"])
def test_recall_of_long_items(size, where):
    """As many edits as are allowed, all over the item or in its first half."""
    rng = random.Random(size)
    items = [(k, prose(rng, rng.randrange(size, size + size // 10))) for k in range(80)]
    index = decontamination.ItemIndex(items, 0.2, 32, 3, 11)
    texts = []
    for _, t in items:
        w = t.split(" ")
        for _ in range(len(w) // 5):
            p, op = rng.randrange(len(w) // (1 if where == "all" else 2)), rng.random()
            w[p : p + 1] = ["q"] if op < 0.4 else [] if op < 0.7 else [w[p], "q"]
        texts.append(" ".join([prose(rng, rng.randrange(1, 60)), *w, prose(rng, 30)]))
    found = {(t, i) for t, i, _, _ in index.search(*decontamination.normal_words(pa.array(texts)))}
    assert sum((k, k) in found for k in range(80)) >= 76
    assert all(t == i for t, i in found)
