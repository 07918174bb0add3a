"""Benchmark decontamination by edit distance: CGK embedding and LSH.

A document holds a benchmark item when some stretch of its words is within an
edit distance of floor(``edits`` * n) words of the item's n words (words
lower-cased, ASCII punctuation at their ends cut, words of punctuation alone
skipped).

- *Where to look.* A stretch that close shares at least n - 2 - 3 floor(edits n)
  of the item's three-word grams (each edit spoils at most three). By length
  class of the items (factor 1.5): starts whose item-sized window has fewer words
  that begin some item's gram than the least such number of the class cannot
  match and are passed over; where an item is so short that the number is not
  positive, every start is looked at.
- *Embedding.* From every start left, ``repeats`` CGK random walks map the words
  to a longer sequence: each step puts out the current word and advances by a
  random bit that depends on the step and the word. Edit distance becomes
  Hamming distance: walks fall into step again after an edit.
- *LSH.* Each walk is sampled at ``sampled`` steps; windows whose samples equal
  an item's are candidates. Steps are drawn from a range that fits the length class, so
  a window has the size of the items it is compared with. Walks drift apart with
  their length, so items of ``_LONG`` words or more are entered from every
  ``_APART``-th word on with walks of ``_STEPS`` steps, however long they are: as
  many edits as an item may have leave some of its parts at no more than their
  share. ``repeats`` is set so that a stretch with as many random edits as are
  allowed is found with probability 0.95 or more (tests/llm: 15 to 500 words).
- *Verification.* The exact edit distance between a candidate item and the
  words around the candidate start decides.

The benchmark is the stated query set: it is read in blocks of at most
``block_bytes`` of text, each of them a broadcast of bounded size, against all
documents. Documents aren't shuffled; whole texts are searched.

Defined cases: null or empty items match nothing; items with equal words are all
reported; null texts hold nothing; rows with the same doc_id are reported each
(once per row and item); empty tables give an empty result; other columns are
not read.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import gram_hashes, hash_strings, mix64, read, split_words, text_slices, tidy, work_area
from tessera.llm.toxicity import PUNCTUATION

_PAD = np.uint64(0)
_LONG, _APART, _STEPS = 60, 20, 64


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalized words of the texts, and the number of each."""
    words, counts = split_words(texts)
    if not len(words):
        return np.empty(0, np.uint64), counts
    coded = words.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    plain = pc.ascii_trim(pc.utf8_lower(coded.dictionary), characters=PUNCTUATION)
    keep = pc.greater(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
    code = coded.indices.to_numpy()
    kept = keep[code]
    total = np.concatenate([[0], np.cumsum(kept)])
    ends = np.cumsum(counts)
    return hash_strings(plain)[code[kept]], total[ends] - total[ends - counts]


def best_distance(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Least edit distance of item to any stretch of words, and where the first
    such stretch ends."""
    n = len(item)
    steps = np.arange(n + 1)
    col, best, end = steps.copy(), n, 0
    for k, w in enumerate(words):
        new = np.empty_like(col)
        new[0] = 0
        new[1:] = np.minimum(col[1:] + 1, col[:-1] + (item != w))
        col = np.minimum.accumulate(new - steps) + steps
        if col[n] < best:
            best, end = int(col[n]), k + 1
    return best, end


class _LengthClass:
    """The items of one length class: where to look for them, and LSH tables."""

    def __init__(self, index: "ItemIndex", own: np.ndarray, flat: np.ndarray, first: np.ndarray, repeats: int, sampled: int, rng):
        size, most = index.size[own], index.most[own]
        self.span = int((size + most).max())
        self.need = int((size - 2 - 3 * most).min())
        self.seeds = np.unique(np.concatenate([gram_hashes(index.words[i], 3) for i in own])) if self.need > 0 else None
        long = size.min() >= _LONG
        steps = _STEPS if long else max(1, int(1.5 * size.min()))
        # a walk of _STEPS takes 32 words, give or take 4: the last part has 40 left
        skips = [np.arange(0, n - 39, _APART) if long else np.zeros(1, np.int64) for n in size.tolist()]
        entry, skip = np.repeat(own, [len(k) for k in skips]), np.concatenate(skips)
        self.reach = int(skip.max() + most.max()) if long else 0
        self.coins = rng.integers(0, 1 << 63, (repeats, steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.picks = [np.sort(rng.choice(steps, min(sampled, steps), replace=False)) for _ in range(repeats)]
        self.tables = []
        for r in range(repeats):
            keys = self.keys(r, flat, first[entry] + skip, first[entry] + index.size[entry])
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], entry[order], skip[order]))

    def keys(self, r: int, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Keys of walk r from the starts."""
        at, key = start.copy(), np.zeros(len(start), np.uint64)
        picks = set(self.picks[r].tolist())
        for j in range(max(picks) + 1):
            w = np.where(at < end, words.take(np.minimum(at, len(words) - 1)), _PAD)
            if j in picks:
                key = key * np.uint64(0x9E3779B97F4A7C15) + w
            at += ((w * self.coins[r, j]) >> np.uint64(63)).astype(np.int64)
        return mix64(key)

    def starts(self, h: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Starts whose windows can hold an item, and the places up to ``reach``
        words after one, where a later part of the item can begin."""
        every = np.arange(len(h))
        if self.seeds is None or not len(grams):
            return every
        at = np.minimum(np.searchsorted(self.seeds, grams), len(self.seeds) - 1)
        hit = np.concatenate([[0], np.cumsum(self.seeds[at] == grams)])  # one that runs over a text's end only adds starts
        good = hit[np.minimum(every + self.span, len(grams))] - hit[np.minimum(every, len(grams))] >= self.need
        if self.reach:
            total = np.concatenate([[0], np.cumsum(good)])
            good = total[every + 1] > total[np.maximum(every - self.reach, 0)]
        return every[good]


class ItemIndex:
    """LSH tables of a block of items."""

    def __init__(self, items: list[tuple[int, str]], edits: float, repeats: int, sampled: int, seed: int):
        h, counts = normal_words(pa.array([t for _, t in items], pa.string()))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        self.ids = [i for (i, _), c in zip(items, counts, strict=True) if c]
        self.words = [h[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.most = (self.size * edits).astype(np.int64)
        if not len(self.ids):
            return
        self.level = np.floor(np.log(self.size) / np.log(1.5)).astype(np.int64)
        rng = np.random.default_rng(seed)
        flat, first = np.concatenate(self.words), np.cumsum(self.size) - self.size
        self.classes = [_LengthClass(self, np.flatnonzero(self.level == c), flat, first, repeats, sampled, rng) for c in np.unique(self.level)]

    def search(self, h: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item place, edits, last word) of the items found in the texts."""
        if not len(self.ids) or not len(h):
            return []
        first, ends = np.cumsum(counts) - counts, np.cumsum(counts)
        grams, found = gram_hashes(h, 3), []
        for c in self.classes:
            start = c.starts(h, grams)
            if not len(start):
                continue
            text = np.searchsorted(ends, start, side="right")
            for r, (known, item, skip) in enumerate(c.tables):
                keys = c.keys(r, h, start, ends[text])
                lo, hi = np.searchsorted(known, keys), np.searchsorted(known, keys, side="right")
                who = np.flatnonzero(hi > lo)
                for i in who.tolist():
                    t = int(text[i])
                    found += [(t, int(item[k]), max(int(start[i] - skip[k]), int(first[t]))) for k in range(lo[i], hi[i])]
        out: dict[tuple[int, int], tuple[int, int]] = {}
        done: dict[tuple[int, int], int] = {}
        for t, i, s in sorted(set(found)):
            if s < done.get((t, i), -1):
                continue  # inside the stretch that was compared last
            a, b = max(first[t], s - self.most[i]), min(ends[t], s + 2 * self.size[i])
            best, end = best_distance(self.words[i], h[a:b])
            done[(t, i)] = s + self.size[i] // 2
            if best <= self.most[i] and best < out.get((t, i), (1 << 30, 0))[0]:
                out[(t, i)] = (best, int(a - first[t] + end))
        return [(t, i, e, w) for (t, i), (e, w) in out.items()]


def find_items(docs: DataFrame, benchmark: DataFrame, edits: float = 0.2, repeats: int = 32, sampled: int = 3, block_bytes: int = 4 << 20, seed: int = 11) -> DataFrame:
    """doc_id, item_id, n_words (of the item), edits and last_word (the place in
    the document where the best stretch ends) of every item in every document."""
    out = None
    for group in _grouped(_blocks(benchmark, edits, repeats, sampled, block_bytes, seed)):

        def search(batches, group=group):
            for b in text_slices(batches, most=4 << 20):
                words = normal_words(b.column(1))
                for x in (index.value for index in group):
                    rows = x.search(*words)
                    if rows:
                        t, i, e, w = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array(t)), pa.array([x.ids[j] for j in i], pa.int64()), pa.array([int(x.size[j]) for j in i], pa.int64()), pa.array(e, pa.int64()), pa.array(w, pa.int64())],
                            ["doc_id", "item_id", "n_words", "edits", "last_word"])

        part = docs.select("doc_id", "text").mapInArrow(tidy(search), "doc_id long, item_id long, n_words long, edits long, last_word long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = 0.2, repeats: int = 32, sampled: int = 3, block_bytes: int = 4 << 20, seed: int = 11) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item."""
    at = docs.columns.index("text")
    for group in _grouped(_blocks(benchmark, edits, repeats, sampled, block_bytes, seed)):

        def clean(batches, group=group):
            for b in text_slices(batches, most=4 << 20):
                words = normal_words(b.column(at))
                bad = {t for index in group for t, *_ in index.value.search(*words)}
                yield b.filter(pa.array([k not in bad for k in range(b.num_rows)]))

        docs = docs.mapInArrow(tidy(clean), docs.schema)
    return docs


def _grouped(blocks):
    """Up to 16 blocks (64 MB) for one pass over the documents."""
    blocks = iter(blocks)
    while group := list(islice(blocks, 16)):
        yield group


def _blocks(benchmark: DataFrame, edits: float, repeats: int, sampled: int, block_bytes: int, seed: int):
    """Broadcast indexes of the benchmark's items, block by block."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").filter("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // (block_bytes // 2)) or 1
    by_block = work_area(spark).write(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")), "items")
    for k in range(blocks):
        own = sorted((r["item_id"] is not None, r["item_id"] or 0, r["text"]) for r in by_block.filter(F.col("block") == k).collect())
        yield spark.sparkContext.broadcast(ItemIndex([(i if known else None, t) for known, i, t in own], edits, repeats, sampled, seed))


def op10_cgk_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_items(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
