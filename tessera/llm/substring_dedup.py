"""Substring dedup with FM-index shards.

Words covered by a window of ``window`` consecutive words whose word sequence
also starts anywhere else in the corpus, the same document included, are found
and removed.

Sharding: a window's *anchor* is the smallest hash among its ``gram``-word
grams, so it depends on the window's words alone. Consecutive windows with the
same anchor place form a *run* (some 14 windows); equal windows always lie in
runs of the same anchor. Runs are dealt by anchor, and each shard answers for
all windows of its anchors by itself: documents are never compared with shards
that cannot hold their windows.

Steps:

1. Every document is cut into runs; equal runs (by a 64-bit hash of their
   words) are counted, already inside each slice of documents, so copies cost
   little. Anchors met once in the whole corpus hold no repeated window.
   Where all runs of an anchor are equal, they repeat as a whole.
2. The words of the other runs, one representative each, are fetched from its
   document. An anchor with over ``hot`` different runs (a passage with
   different neighbours in every document) is dealt on by window instead of by
   run, equal windows being added up first; no shard gets a hot anchor whole.
3. Each shard indexes its runs, weighted by their number, in compressed
   FM-indexes (a wavelet matrix over the Burrows-Wheeler transform) of about
   ``index_words`` words, and streams the runs against them: backward search
   gives the matching statistics of every place, and windows whose statistic
   reaches the window length are reported.
4. The reports go back from runs to documents, and each document drops the
   words that its reported windows cover.

Words are compared by 64-bit hashes. Joins are equi-joins on run or document;
those with a hot side (copies of one run) are plain joins that adaptive
execution splits. A group holds one document's runs.

Defined cases: a null text has no words; texts shorter than the window have no
window and lose nothing; rows with the same doc_id are separate documents (equal
rows repeat each other); an empty table gives an empty result; other columns of
the input are not read.
"""

from __future__ import annotations



import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import gram_hashes, hash_strings, int64, mix64, one_row_per, read, split_words, text_slices, work_area
from tessera.llm.fm_index import FMIndex

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest of the width values from every place on."""
    at, have = np.arange(len(values)), 1
    v = values
    while have < width:
        step = min(have, width - have)
        a, b = v[:-step], v[step:]
        left = a <= b
        at = np.where(left, at[:-step], at[step:])
        v = np.where(left, a, b)
        have += step
    return at


def cut_runs(texts: pa.Array, window: int, gram: int):
    """Word hashes of the texts, one after another, the number of words of each,
    and the runs: text, first word in the text, first word over all, number of
    windows, anchor, hash of all words of the run."""
    words, counts = split_words(texts)
    h = hash_strings(words)
    first = np.cumsum(counts) - counts
    windows = np.maximum(counts - window + 1, 0)
    doc, place = one_row_per(windows)
    if not len(doc):
        e = np.empty(0, np.int64)
        return h, counts, (e, e, e, e, e.astype(np.uint64), e.astype(np.uint64))
    start = first[doc] + place
    grams = gram_hashes(h, gram)
    anchor_at = _sliding_min(grams, window - gram + 1)[start]
    cut = np.flatnonzero(np.concatenate([[True], (anchor_at[1:] != anchor_at[:-1]) | (doc[1:] != doc[:-1])]))
    n = np.diff(np.append(cut, len(doc)))
    begin, end = start[cut], start[cut] + n + window - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_BACK, len(h)), dtype=np.uint64)])
    run = mix64((sums[end] - sums[begin]) * _powers(_BASE, len(h))[begin] + n.astype(np.uint64))
    return h, counts, (doc[cut], place[cut], begin, n, grams[anchor_at[cut]], run)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash that tells rows of one doc_id apart, text."""
    return docs.select(F.coalesce("doc_id", F.lit(np.iinfo(np.int64).min).cast("long")).alias("doc_id"), F.hash("doc_id", "text").alias("h"), "text")


def _batch(names: str, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names.split())


def _find_repeats(units: DataFrame, window: int, index_words: int) -> DataFrame:
    """unit and the packed bits of its repeated windows, for the units (route,
    unit, n, c, words) that have any. Units of one route share a shard."""

    def shard(batches):
        held, size, route = [], 0, None

        def flush():
            sizes = np.array([len(w) for _, _, _, w in held])
            n, c = np.array([x[1] for x in held]), np.array([x[2] for x in held])
            flat = np.unique(np.concatenate([w for *_, w in held]), return_inverse=True)[1] + 1
            begin = np.cumsum(sizes + 1) - (sizes + 1)
            text = np.zeros(int((sizes + 1).sum()), np.int64)
            owner, k = one_row_per(sizes)
            text[begin[owner] + k] = flat
            weights = np.repeat(c, sizes + 1)
            index = FMIndex(text, weights, window + 1)
            # a unit that occurs twice repeats as a whole; the others are searched
            alone = np.flatnonzero(c < 2)
            who, k = one_row_per(n[alone])
            found = index.matching_statistics(text, begin[alone][who] + k + window - 1, window) >= window
            masks = {int(u): found[who == i] for i, u in enumerate(alone)} if len(alone) < 64 else dict(zip(alone.tolist(), np.split(found, np.cumsum(n[alone])[:-1]), strict=True))
            rows = [(held[i][0], np.packbits(masks[i] if i in masks else np.ones(n[i], bool)).tobytes()) for i in range(len(held)) if i not in masks or masks[i].any()]
            if rows:
                yield _batch("unit mask", pa.array([u for u, _ in rows], pa.int64()), pa.array([m for _, m in rows], pa.binary()))

        for b in batches:
            for r, u, n, c, w in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if r != route and size >= index_words:
                    yield from flush()
                    held, size = [], 0
                route = r
                held.append((u, n, c, np.frombuffer(w, np.uint64)))
                size += n + window
        if held:
            yield from flush()

    return units.repartition("route").sortWithinPartitions("route").mapInArrow(shard, "unit long, mask binary")


def repeated_windows(docs: DataFrame, window: int, gram: int, hot: int, index_words: int) -> DataFrame:
    """doc_id, h (see ``_keyed``) and a list of (first word, number of windows,
    packed bits of the repeated ones or null for all) of every document that has
    repeated windows."""
    area = work_area(docs.sparkSession)
    keyed = _keyed(docs)

    def count(batches):
        for b in text_slices(batches):
            _, _, (doc, place, _, n, anchor, run) = cut_runs(b.column(2), window, gram)
            order = np.lexsort((run, anchor))
            a, r = anchor[order], run[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (r[1:] != r[:-1])])) if len(a) else order
            rep = order[new]
            c = np.diff(np.append(new, len(order)))
            yield _batch("anchor run c doc_id h start n", int64(anchor[rep]), int64(run[rep]), c.astype(np.int32), b.column(0).take(pa.array(doc[rep])),
                         b.column(1).take(pa.array(doc[rep])), place[rep].astype(np.int32), n[rep].astype(np.int16))

    counted = keyed.mapInArrow(count, "anchor long, run long, c int, doc_id long, h int, start int, n short").repartition("anchor")
    runs = counted.groupBy("anchor", "run").agg(F.sum("c").alias("c"), *[F.first(x).alias(x) for x in ("doc_id", "h", "start", "n")])
    at_anchor = Window.partitionBy("anchor")
    runs = runs.withColumn("total", F.sum("c").over(at_anchor)).withColumn("kinds", F.count(F.lit(1)).over(at_anchor))
    runs = area.write(runs.filter("total > 1").drop("total"), "runs")
    whole = runs.filter("kinds = 1").select("run", F.lit(0).alias("offset"), "n", F.lit(None).cast("binary").alias("mask"))

    wanted = runs.filter("kinds > 1").groupBy("doc_id", "h").agg(F.collect_list(F.struct("anchor", "run", "c", "start", "n", (F.col("kinds") > hot).alias("hot"))).alias("runs"))

    def fetch(batches):
        for b in text_slices(batches):
            words, counts = split_words(b.column(0))
            h = hash_strings(words)
            first = np.cumsum(counts) - counts
            lists = b.column(1)
            rows = lists.flatten()
            owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            get = lambda k: rows.field(k).to_numpy(zero_copy_only=False)
            anchor, run, c, start, n, is_hot = (get(k) for k in ("anchor", "run", "c", "start", "n", "hot"))
            begin = first[owner] + start
            n = n.astype(np.int64)
            cold = np.flatnonzero(~is_hot)
            if len(cold):
                blobs = [h[i : i + k + window - 1].tobytes() for i, k in zip(begin[cold].tolist(), n[cold].tolist(), strict=True)]
                yield _batch("route unit run offset n c words", anchor[cold], run[cold], run[cold], np.zeros(len(cold), np.int32), n[cold].astype(np.int32), c[cold], pa.array(blobs, pa.binary()))
            which = np.flatnonzero(is_hot)
            if len(which):
                row, k = one_row_per(n[which])
                at = begin[which][row] + k
                unit = int64(gram_hashes(h, window, _BACK)[at])
                yield _batch("route unit run offset n c words", unit, unit, run[which][row], k.astype(np.int32), np.ones(len(at), np.int32), c[which][row],
                             pa.array([h[i : i + window].tobytes() for i in at.tolist()], pa.binary()))

    fields = "route long, unit long, run long, offset int, n int, c long, words binary"
    units = area.write(keyed.join(wanted, ["doc_id", "h"]).select("text", "runs").mapInArrow(fetch, fields), "units")
    one = units.groupBy("unit").agg(F.first("route").alias("route"), F.first("n").alias("n"), F.sum("c").alias("c"), F.first("words").alias("words"))
    found = _find_repeats(one.select("route", "unit", "n", "c", "words"), window, index_words)
    part = units.select("unit", "run", "offset", "n").join(found, "unit").select("run", "offset", "n", "mask")
    reports = area.write(whole.unionByName(part), "reports")

    def refs(batches):
        for b in text_slices(batches):
            _, _, (doc, place, _, _, _, run) = cut_runs(b.column(2), window, gram)
            yield _batch("run doc_id h start", int64(run), b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), place.astype(np.int32))

    hits = keyed.mapInArrow(refs, "run long, doc_id long, h int, start int").join(reports, "run")
    return hits.groupBy("doc_id", "h").agg(F.collect_list(F.struct((F.col("start") + F.col("offset")).alias("start"), "n", "mask")).alias("hits"))


def drop_repeated_substrings(docs: DataFrame, window: int = 35, gram: int = 8, hot: int = 512, index_words: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space)
    and the removed intervals (first word, words) of every row of docs."""
    hits = repeated_windows(docs, window, gram, hot, index_words)

    def rewrite(batches):
        for b in text_slices(batches):
            words, counts = split_words(b.column(1))
            first = np.cumsum(counts) - counts
            lists = b.column(2)
            sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
            rows = lists.flatten()
            n = rows.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.repeat(first, sizes) + rows.field("start").to_numpy(zero_copy_only=False)
            starts = []
            for i, k, mask in zip(begin.tolist(), n.tolist(), rows.field("mask").to_pylist(), strict=True):
                bits = np.arange(k) if mask is None else np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=k))
                starts.append(bits + i)
            edge = np.zeros(len(words) + 1, np.int64)
            if starts:
                at = np.unique(np.concatenate(starts))
                edge[at] += 1
                np.subtract.at(edge, at + window, 1)
            gone = np.cumsum(edge[:-1]) > 0
            removed = np.add.reduceat(np.append(gone, False), np.append(first, len(gone)))[:-1].astype(np.int64) if len(first) else np.empty(0, np.int64)
            removed[counts == 0] = 0
            kept_words = words.filter(pa.array(~gone)) if gone.any() else words
            ends = np.concatenate([[0], np.cumsum(counts - removed)]).astype(np.int32)
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), kept_words), " ")
            spans = []
            for i, f, k in zip(range(b.num_rows), first.tolist(), counts.tolist(), strict=True):
                if removed[i]:
                    flips = np.flatnonzero(np.diff(np.concatenate([[0], gone[f : f + k].astype(np.int8), [0]])))
                    spans.append([{"start": int(s), "words": int(e - s)} for s, e in zip(flips[::2], flips[1::2], strict=True)])
                else:
                    spans.append([])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), pa.array(removed), kept.cast(pa.string()),
                                              pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())])))], ["doc_id", "n_words", "n_removed", "kept", "removed"])

    joined = _keyed(docs).join(hits, ["doc_id", "h"], "left").select("doc_id", "text", "hits")
    fields = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start long, words long>>"
    return joined.mapInArrow(rewrite, fields).withColumn("doc_id", F.nullif("doc_id", F.lit(np.iinfo(np.int64).min).cast("long")))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_repeated_substrings(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35
), win AS (
  SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS seq FROM starts
), rep AS (
  SELECT seq FROM win GROUP BY seq HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM win JOIN rep USING (seq)
), pos AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w
), left_ AS (
  SELECT p.doc_id, count(*) AS n_left, string_agg(word, ' ' ORDER BY p.pos) AS kept
  FROM pos p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos WHERE g.pos IS NULL GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_left, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_ USING (doc_id)"""
