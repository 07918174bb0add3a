"""Substring and line dedup against brute force."""
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import fm_index, line_dedup, substring_dedup

from .conftest import frame

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeats(rows, w):
    seqs = [words_of(t) for _, t in rows]
    count = Counter(tuple(s[i : i + w]) for s in seqs for i in range(len(s) - w + 1))
    out = []
    for (d, _), s in zip(rows, seqs, strict=True):
        gone = set()
        for i in range(len(s) - w + 1):
            if count[tuple(s[i : i + w])] > 1:
                gone.update(range(i, i + w))
        kept = " ".join(x for i, x in enumerate(s) if i not in gone)
        out.append((d, len(s), len(gone), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,gram,hot,index_words", [(35, 8, 512, 1 << 20), (12, 3, 1, 50), (12, 12, 2, 200), (9, 2, 0, 1)])
def test_substrings(spark, corpus, window, gram, hot, index_words):
    rows = corpus + [(200, "a b c d " * 40), (None, "a b c d " * 30), (None, None)]
    got = substring_dedup.drop_repeated_substrings(frame(spark, rows), window, gram, hot, index_words).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == repeats(rows, window)
    for r in got:
        assert sum(x.words for x in r.removed) == r.n_removed


def test_substrings_empty(spark):
    assert substring_dedup.drop_repeated_substrings(frame(spark, [])).count() == 0


def test_matching_statistics():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (50, 3, 80)])
    weights = np.ones(len(text), np.int64)
    ends = np.flatnonzero(text)
    got = fm_index.FMIndex(text, weights, 13).matching_statistics(text, ends, 12)
    s = "".join(map(str, text))
    for e, m in zip(ends.tolist(), got.tolist(), strict=True):
        best = 0
        for k in range(1, 13):
            p = s[e - k + 1 : e + 1]
            if k <= e + 1 and "0" not in p and len(re.findall(f"(?={p})", s)) > 1:
                best = k
            else:
                break
        assert m == best


def drop_lines(rows, least=40, docs=5):
    keys = defaultdict(list)
    for n, (d, t) in enumerate(rows):
        for k in {x.strip(SPACE).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in (t or "").split("\n")}:
            keys[k].append(-1 if d is None else d)
    out = []
    for d, t in rows:
        lines, kept = (t or "").split("\n"), []
        for x in lines:
            k = x.strip(SPACE).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            if len(k) < least or len(keys[k]) < docs or max(keys[k]) == (-1 if d is None else d):
                kept.append(x)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [10_000, 3, 1_000_000])
def test_lines(spark, corpus, hot):
    rows = corpus + [(None, "This line is long enough to be looked at, and common."), (None, None)]
    got = line_dedup.drop_repeated_lines(frame(spark, rows), hot=hot, shards=3).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got), key=str) == drop_lines(rows)


def test_lines_carry_and_empty(spark, corpus):
    docs = frame(spark, corpus)
    out = line_dedup.drop_repeated_lines(docs, carry=("lang", "gone"))
    assert {(r.doc_id, r.carry.lang, r.carry.gone) for r in out.collect()} == {(r.doc_id, r.lang, r.gone) for r in docs.collect()}
    assert line_dedup.drop_repeated_lines(frame(spark, [])).count() == 0


def test_perfect_hash_and_index():
    rng = np.random.default_rng(3)
    hi = np.sort(np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)))
    sizes, bits = line_dedup.build_mph(hi)
    assert sorted(line_dedup.PerfectHash(sizes, bits).slots(hi).tolist()) == list(range(len(hi)))
    lo = rng.integers(0, 1 << 63, len(hi), dtype=np.uint64)
    hi2, lo2 = np.insert(hi, 7, hi[7]), np.insert(lo, 7, lo[7] - np.uint64(1))  # two keys that differ in one half only
    count, largest = np.arange(len(hi2)) + 1, np.arange(len(hi2)) * 3
    index = line_dedup.LineIndex(line_dedup.LineIndex.row(0, hi2, lo2, count, largest))
    c, m = index.find(hi2, lo2)
    assert np.array_equal(c, count) and np.array_equal(m, largest)
    other = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert not index.find(other, other)[0].any()

