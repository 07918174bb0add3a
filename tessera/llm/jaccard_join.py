"""Exact Jaccard join of shingle sets in a metric space.

Two documents link when the Jaccard similarity of their sets of distinct
``width``-word shingles (64-bit hashes, A-Z lower-cased) is at least
``percent`` / 100; r = 1 - percent / 100 is the radius of the Jaccard distance,
a metric.

1. *Classes.* Documents with equal sets are one class; the join works on
   classes, represented by their smallest doc_id. In the same pass over the
   texts every shingle of every class is dealt by hash, packed in a few bytes
   each, to be counted: a set of whose shingles fewer than t |x| are held by any
   other set has no neighbour within r and is done. (Counting uses 32 bits of
   the hashes in each partition; a false match only keeps a set in.) Of the
   others the whole sets are written once. Their documents are found with a
   Bloom filter of fixed size and an exact join.
2. *Pivots and cells.* Sets with an equal min-hash (``PIVOTS`` hash functions,
   so ``PIVOTS`` rows a set) meet; the most central of them - the least share of
   shingles that nobody else holds - is their pivot. Distances to pivots are
   computed exactly: at most ``PIVOTS`` comparisons a set, however large a family
   of copies is. Sets within r of a pivot link to it and form its Voronoi cell.
3. *Regions.* Two linked sets share one of the first |x| - ceil(t |x|) + 1
   shingles of each, in any order common to all sets. The order is rarest first,
   by a sketch of shingle counts of fixed size over the sets left, so that a
   line or passage of many documents comes last. Each shingle in that position
   that the sketch doesn't show to be one set's alone is the heart of a region
   that holds all sets of that prefix: this replicates a set to every region
   where a neighbour can be. A pair is looked at as if the heart were its first
   common shingle, as in one region it is: there neither set shares what it holds
   before the heart, which bounds the overlap; and a region in whose order the pair
   has a common shingle earlier (of each set the ``_FIRST`` first hearts are at
   hand) leaves the pair to the region of that one.
4. *Tiles and windows.* A region within one cell is done. One of more than
   ``REGION`` members is dealt: its members fall by hash into blocks of about
   ``REGION``, and every two blocks, and each block with itself, are a tile that a
   task of its own can compare; so each two members meet in exactly one tile, and
   no task holds more than two blocks, however large a family is. (The sketch
   tells which regions can be that large; only their members are counted. The
   list of the large regions, at most one in ``REGION`` of all prefix shingles,
   is broadcast.) Tiles stand where the dealt method lets regions recurse with
   new pivots. Inside a tile, ``_SIDE`` by ``_SIDE`` members at a time, the
   cells that meet there are joined with each other: by the triangle inequality
   x can link to y only if |d(x, p) - d(y, p)| <= r for a pivot p of both, and
   only if sizes and shareable shingles allow the overlap. Beyond distances, each
   set carries bitmaps of what it lacks of its pivot and adds to it: x and y share
   at most what p has and neither lacks, and what both add. The pairs left, each
   once, are compared exactly.
5. Links make components.

Every link between different sets is in a component through links that were
verified on the whole sets; pairs inside a cell are not listed.

Defined cases: a document with fewer words than ``width`` has its whole word
sequence as the one shingle; without words or text its set is empty and links
with nothing, not even with equal texts; rows with the same doc_id are one
document, whose set is that of all its rows' classes, each row of the result
with its own n_shingles; null doc_ids are left alone (component null); an empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import gram_hashes, hash_strings, int64, mix64, one_row_per, partitions, read, split_words, text_slices, tidy, work_area
from tessera.llm.components import components

SKETCH = 1 << 20
PIVOTS = 4
REGION = 1 << 13  # members of a region or a block
_SIDE = 1 << 10
_WORDS = 4  # 64-bit words of a difference's bitmap
_DELTAS = [f"{k}{i}" for k in ("lacks", "adds") for i in range(_WORDS)]
_FIRST = 8  # hearts that a member of a region brings along
_PART = 1 << 16  # counts of one sketch row


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words, counts = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    h = hash_strings(words)
    grams = gram_hashes(h, width)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(grams[at : at + n - width + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[at : at + n].tobytes())], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _batch(names: str, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names.split())


def _pack(tokens: np.ndarray, owner: np.ndarray, x: np.ndarray) -> bytes:
    """Ascending 32-bit tokens as three-byte steps (255, 255, 255: add that and
    go on) with the places of their sets, and the keys of the sets."""
    used, place = np.unique(owner, return_inverse=True)
    step = np.diff(tokens, prepend=0)
    extra = step // 0xFFFFFF
    full = np.insert(step % 0xFFFFFF, np.repeat(np.arange(len(step)), extra), 0xFFFFFF) if extra.any() else step
    three = np.ascontiguousarray(full.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :3]
    return np.array([len(used), len(tokens)], "<u4").tobytes() + x[used].tobytes() + place.astype("<u4" if len(used) > 65536 else "<u2").tobytes() + three.tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, the places of their sets among the pack's, and the keys of these."""
    sets, n = np.frombuffer(data, "<u4", 2).tolist()
    x = np.frombuffer(data, np.int64, sets, 8)
    at, kind = 8 + 8 * sets, np.dtype("<u4" if sets > 65536 else "<u2")
    place = np.frombuffer(data, kind, n, at)
    three = np.frombuffer(data, np.uint8, -1, at + n * kind.itemsize).reshape(-1, 3).astype(np.int64)
    step = three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16
    return np.cumsum(step)[step != 0xFFFFFF].astype(np.uint32), place, x


SCAN = "doc_id long, n long, x long, y long, bucket int, shared binary"
_SHARED = np.dtype([("x", "<i8"), ("shared", "<u4")])


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """Rows of two kinds: (doc_id, n, x, y): size and 128-bit key of a document's
    set; (bucket, shared): how many shingles of each set of a bucket of keys x, in
    one partition of the shingles, other sets hold too (``_SHARED``). A set has its
    shingles in as many partitions as it has shingles, so a row for each would
    grow with the partitions too; there is one for each bucket."""
    parts = partitions(docs.sparkSession)

    def deal(batches):
        for b in text_slices(batches, most=6 << 20):
            sets = shingle_sets(b.column(1), width)
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            size = np.array([len(s) for s in sets], np.int64)
            yield _batch("part doc_id n x y data", pa.array(np.arange(len(sets)) % parts, pa.int32()), b.column(0), size, keys[:, 0].copy(), keys[:, 1].copy(), pa.nulls(len(sets), pa.binary()))
            one = np.sort(np.unique(keys[:, 0], return_index=True)[1])  # copies count once
            tokens = np.concatenate([sets[i] for i in one]) if len(one) else np.empty(0, np.uint64)
            owner = np.repeat(one, size[one])
            part = ((tokens >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort((part.astype(np.uint64) << np.uint64(32)) | (tokens & np.uint64(0xFFFFFFFF)))
            tokens, owner = (tokens[order] & np.uint64(0xFFFFFFFF)).astype(np.int64), owner[order]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
            for k in range(parts):
                i, j = cuts[k], cuts[k + 1]
                if j > i:
                    e = pa.nulls(1, pa.int64())
                    yield _batch("part doc_id n x y data", pa.array([k], pa.int32()), e, e, e, e, pa.array([_pack(tokens[i:j], owner[i:j], keys[:, 0])], pa.binary()))

    def count(batches):
        packs: dict[int, list] = {}
        for b in batches:
            plain = b.filter(pc.is_null(b.column(5)))
            yield _batch("doc_id n x y bucket shared", *(plain.column(k) for k in range(1, 5)), pa.nulls(plain.num_rows, pa.int32()), pa.nulls(plain.num_rows, pa.binary()))
            for part, data in zip(b.column(0).to_pylist(), b.column(5).to_pylist(), strict=True):
                if data is not None:
                    packs.setdefault(part, []).append(_unpack(data))
        while packs:
            _, held = packs.popitem()
            names = np.unique(np.concatenate([x for _, _, x in held]))
            rows = np.concatenate([(tokens.astype(np.uint64) << np.uint64(32)) | np.searchsorted(names, x).astype(np.uint64)[place] for tokens, place, x in held])
            del held
            rows.sort()
            rows = rows[np.concatenate([[True], rows[1:] != rows[:-1]])]  # copies count once
            same = (rows[1:] ^ rows[:-1]) < np.uint64(1 << 32)  # the same token in the next set
            many = np.concatenate([same, [False]])
            many[1:] |= same
            shared = np.bincount((rows[many] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(names))
            full = np.flatnonzero(shared)
            out = np.empty(len(full), _SHARED)
            out["x"], out["shared"] = names[full], shared[full]
            bucket = (out["x"].astype(np.uint64) % np.uint64(parts)).astype(np.int64)
            out = out[np.argsort(bucket, kind="stable")]
            used, first = np.unique(np.sort(bucket), return_index=True)
            e = pa.nulls(len(used), pa.int64())
            yield _batch("doc_id n x y bucket shared", e, e, e, e, pa.array(used, pa.int32()), pa.array([c.tobytes() for c in np.split(out, first[1:])][: len(used)], pa.binary()))

    dealt = docs.select("doc_id", "text").mapInArrow(tidy(deal), "part int, doc_id long, n long, x long, y long, data binary")
    return dealt.repartition(parts, "part").mapInArrow(tidy(count), SCAN)


def _shared_counts(scanned: DataFrame) -> DataFrame:
    """(x, s): the shingles of a set that any other set holds too, of the sets that have such."""

    def add(batches):
        sums: dict[int, list] = {}

        def total(packs):
            rows = np.concatenate(packs)
            rows = rows[np.argsort(rows["x"], kind="stable")]
            first = np.flatnonzero(np.concatenate([[True], rows["x"][1:] != rows["x"][:-1]]))
            out = rows[first]
            out["shared"] = np.add.reduceat(rows["shared"], first)
            return out

        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                packs = sums.setdefault(k, [])
                packs.append(np.frombuffer(data, _SHARED))
                if sum(map(len, packs[1:])) > max(1 << 18, len(packs[0])):
                    sums[k] = [total(packs)]
        while sums:
            out = total(sums.popitem()[1])
            yield _batch("x s", np.ascontiguousarray(out["x"]), out["shared"].astype(np.int64))

    parts = partitions(scanned.sparkSession)
    return scanned.filter("shared is not null").select("bucket", "shared").repartitionById(parts, F.col("bucket")).mapInArrow(tidy(add), "x long, s long")


_BLOOM = 1 << 24  # bits


def _bloom_places(ids: np.ndarray) -> np.ndarray:
    h = mix64(ids.view(np.uint64))
    return np.stack([(h >> np.uint64(k)) & np.uint64(_BLOOM - 1) for k in (0, 20, 40)]).astype(np.int64)


def _bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over a column of longs."""

    def fill(batches):
        bits = np.zeros(_BLOOM, bool)
        for b in batches:
            bits[_bloom_places(b.column(0).to_numpy()).ravel()] = True
        packed = np.packbits(bits).reshape(64, -1)
        for k in np.flatnonzero(packed.any(axis=1)).tolist():
            yield _batch("k bits", pa.array([k], pa.int32()), pa.array([zlib.compress(packed[k].tobytes(), 1)], pa.binary()))

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                more = np.frombuffer(zlib.decompress(data), np.uint8)
                sums[k] = sums[k] | more if k in sums else more
        for k, bits in sums.items():
            yield _batch("k bits", pa.array([k], pa.int32()), pa.array([bits.tobytes()], pa.binary()))

    rows = ids.mapInArrow(tidy(fill), "k int, bits binary").repartition("k").mapInArrow(merge, "k int, bits binary").collect()
    out = np.zeros((64, _BLOOM // 8 // 64), np.uint8)
    for r in rows:
        out[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _known_sets(docs: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """(x, node, n, s, shingles) of the sets in known (x, node, n, s)."""
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(known.select("node")))

    def build(batches):
        bits = np.unpackbits(bloom.value).astype(bool)
        for b in text_slices(batches, most=6 << 20):
            ids = b.column(0)
            maybe = bits[_bloom_places(pc.fill_null(ids, 0).to_numpy())].all(axis=0) & ids.is_valid().to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(maybe))
            sets = shingle_sets(b.column(1), width)
            x = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes())[:8] for s in sets), np.int64)
            yield _batch("node x shingles", b.column(0), x, pa.array([s.tobytes() for s in sets], pa.binary()))

    return docs.select("doc_id", "text").mapInArrow(tidy(build), "node long, x long, shingles binary").join(known, ["x", "node"])


def _counts(sets: DataFrame) -> DataFrame:
    """Counts of shingles by bucket: (part, data), part being the stretch of the sketch."""

    def scan(batches):
        counts = np.zeros(SKETCH, np.uint32)
        for b in batches:
            for raw in b.column(0).to_pylist():
                np.add.at(counts, (np.frombuffer(raw, np.uint64) & np.uint64(SKETCH - 1)).astype(np.int64), 1)
        for k in range(SKETCH // _PART):
            part = counts[k * _PART : (k + 1) * _PART]
            full = np.flatnonzero(part)
            if len(full):  # few counts: (place, count) pairs; many: all of them
                data = b"s" + np.stack([full.astype(np.uint32), part[full]]).tobytes() if len(full) < _PART // 2 else b"d" + part.tobytes()
                yield _batch("part data", pa.array([k], pa.int32()), pa.array([data], pa.binary()))

    return sets.select("shingles").mapInArrow(tidy(scan), "part int, data binary")


def _levels(rows: DataFrame) -> np.ndarray:
    """The sketch over all sets: log2 of a bucket's count, 0 for a count of one (SKETCH bytes)."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total = sums.setdefault(k, np.zeros(_PART, np.int64))
                raw = np.frombuffer(data, np.uint32, offset=1)
                if data[:1] == b"s":
                    at, n = raw.reshape(2, -1)
                    total[at] += n
                else:
                    total += raw
        for k, total in sums.items():
            yield _batch("part level", pa.array([k], pa.int32()), pa.array([np.where(total > 1, np.log2(total + 1), 0).astype(np.uint8).tobytes()], pa.binary()))

    parts = rows.repartition("part").mapInArrow(add, "part int, level binary").collect()
    out = np.zeros(SKETCH, np.uint8)
    for r in parts:
        out[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(r["level"], np.uint8)
    return out


def _leads(sets: DataFrame) -> DataFrame:
    """(token, x, n, s): the min-hashes of every set."""
    seeds = mix64(np.arange(1, PIVOTS + 1, dtype=np.uint64))

    def scan(batches):
        for b in text_slices(batches, text="shingles"):
            lows = [[(mix64(h ^ k)).min() for k in seeds] for h in (np.frombuffer(raw, np.uint64) for raw in b.column(3).to_pylist())]
            token = mix64(np.array(lows, np.uint64).reshape(-1, PIVOTS) + seeds).ravel()
            yield _batch("token x n s", int64(token), *(np.repeat(b.column(k).to_numpy(), PIVOTS) for k in range(3)))

    return sets.select("x", "n", "s", "shingles").mapInArrow(tidy(scan), "token long, x long, n long, s long")


def _hearts(raw: bytes, level: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the first shingles of a set, rarest first, those that another set may
    hold, and their places in that order."""
    h = np.frombuffer(raw, np.uint64)
    own = level[h & np.uint64(SKETCH - 1)]
    order = np.argsort((own.astype(np.uint64) << np.uint64(58)) | (h >> np.uint64(6)), kind="stable")[: _prefix_length(len(h), percent)]
    alone = int((own[order] == 0).sum())  # they come first
    return h[order[alone:]], np.arange(alone, len(order))


def _firsts(tokens: np.ndarray) -> np.ndarray:
    """For every heart of a set, the first ``_FIRST`` of those before it (0: none)."""
    out = np.zeros((len(tokens), _FIRST), np.uint64)
    for k in range(min(_FIRST, len(tokens))):
        out[k + 1 :, k] = tokens[k]
    return out


def _large_regions(sets: DataFrame, levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hearts of the regions of more than REGION members, ascending, and their
    numbers of blocks (0: all in one cell, nothing to compare)."""
    heavy = (np.int64(2) << levels.astype(np.int64)) - 2 > REGION  # the most that a bucket of this level can have
    if not heavy.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    sketch = sets.sparkSession.sparkContext.broadcast(levels)

    def scan(batches):
        level = sketch.value
        can = (np.int64(2) << level.astype(np.int64)) - 2 > REGION
        for b in text_slices(batches, text="shingles", most=4 << 20):
            token = [h[can[h & np.uint64(SKETCH - 1)]] for h, _ in (_hearts(raw, level, percent) for raw in b.column(1).to_pylist())]
            if token:
                yield _batch("token cell", int64(np.concatenate(token)), np.repeat(b.column(0).to_numpy(), [len(t) for t in token]))

    rows = sets.select("cell", "shingles").mapInArrow(tidy(scan), "token long, cell long")
    large = rows.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.min("cell").alias("low"), F.max("cell").alias("high")).filter(F.col("rows") > REGION).collect()
    token = np.array([r["token"] for r in large], np.int64).view(np.uint64)
    blocks = np.array([0 if r["low"] == r["high"] else -(-r["rows"] // REGION) for r in large], np.int64)
    order = np.argsort(token)
    return token[order], blocks[order]


def _tiles(x: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members x of regions of so many blocks: which member goes to which tile.
    A tile is first block, second block, number of blocks in 20 bits each, or 0
    for a region in one piece."""
    row, other = one_row_per(blocks)
    own = _block(x[row], blocks[row])
    tile = np.minimum(own, other) << 40 | np.maximum(own, other) << 20 | blocks[row]
    return row, np.where(blocks[row] > 1, tile, 0)


def _block(x: np.ndarray, blocks) -> np.ndarray:
    return (mix64(x.view(np.uint64)) % np.asarray(blocks).astype(np.uint64)).astype(np.int64)


def _met_before(a: np.ndarray, b: np.ndarray, firsts: list[np.ndarray]) -> np.ndarray:
    """Whether the members a and b have one of their first hearts in common."""
    met = np.zeros(len(a), bool)
    for f in firsts:
        at = np.flatnonzero(~met & (f[a] != 0))
        mine = f[a[at]]
        for g in firsts:
            met[at] |= g[b[at]] == mine
    return met


def _open_pairs(tile: int, percent: int, x, n, s, cell, p, d, size, *more):
    """(a, b, n, m) of the open pairs of one tile, _SIDE by _SIDE members at a time."""
    r = 1 - percent / 100
    order = np.argsort(cell, kind="stable")  # a slice whose first and last members share a cell is within one then
    x, n, s, cell, p, d, size, *more = (c[order] for c in (x, n, s, cell, p, d, size, *more))
    words, place, firsts = [w.view(np.uint64) for w in more[: len(_DELTAS)]], more[len(_DELTAS)], more[len(_DELTAS) + 1 :]
    rest = n - place
    both = np.rint((1 - d) * (n + size) / (2 - d)).astype(np.int64)  # with the pivot: 1 - d = both / (n + size - both)
    left = right = np.arange(len(x))
    if tile >> 40 != (tile >> 20) & 0xFFFFF:
        block = _block(x, tile & 0xFFFFF)
        left, right = np.flatnonzero(block == tile >> 40), np.flatnonzero(block != tile >> 40)
    one = left is right

    def count(f, at, a, b):
        return sum(np.bitwise_count(f(words[k][a], words[k][b])) for k in range(at, at + _WORDS)).astype(np.int64)

    for i in range(0, len(left), _SIDE):
        u = left[i : i + _SIDE]
        for j in range(i if one else 0, len(right), _SIDE):
            v = right[j : j + _SIDE]
            if cell[u[0]] == cell[v[-1]] == cell[u[-1]] == cell[v[0]]:
                continue
            need = percent * (n[u, None] + n[v])
            good = cell[u, None] != cell[v]
            if one:
                good &= u[:, None] < v
            good &= (100 + percent) * np.minimum(s[u, None], s[v]) >= need
            good &= (100 + percent) * np.minimum(rest[u, None], rest[v]) >= need
            good &= ~((p[u, None] == p[v]) & (np.abs(d[u, None] - d[v]) > r + 1e-9))
            a, b = np.nonzero(good)
            a, b = u[a], v[b]
            a, b = np.where(x[a] < x[b], a, b), np.where(x[a] < x[b], b, a)
            if len(a):  # pairs with one pivot: a shares with the pivot n - adds of its own, adds being n - both
                same = np.flatnonzero(p[a] == p[b])
                f, g = a[same], b[same]
                kept = size[f] - count(np.bitwise_or, 0, f, g)
                adds, only = n[f] - both[f], count(lambda y, z: y & ~z, _WORDS, f, g)
                lost = (100 + percent) * (kept + np.maximum(adds - only, 0)) < percent * (n[f] + n[g])
                open_ = np.ones(len(a), bool)
                open_[same[lost]] = False
                a, b = a[open_], b[open_]
                new = ~_met_before(a, b, firsts)
                a, b = a[new], b[new]
            if len(a):
                yield np.stack([x[a], x[b], n[a], n[b]], 1)


_OWN = ["x", "n", "s", "cell", "p", "d", "size", *_DELTAS]
_HERE = ["place", *(f"first{i}" for i in range(_FIRST))]


def _region_rows(sets: DataFrame, levels: np.ndarray, percent: int) -> DataFrame:
    """(token, tile, _OWN, _HERE): every set in every tile of every region that it
    is in, with the heart's place in its order and the first hearts before that."""
    sketch, large = (sets.sparkSession.sparkContext.broadcast(v) for v in (levels, _large_regions(sets, levels, percent)))

    def hearts(batches):
        level, (big, blocks) = sketch.value, large.value
        for b in text_slices(batches, text="shingles", most=4 << 20):
            found = [_hearts(raw, level, percent) for raw in b.column(len(_OWN)).to_pylist()]
            if not found:
                continue
            owner, token, place = np.repeat(np.arange(len(found)), [len(t) for t, _ in found]), *map(np.concatenate, zip(*found, strict=True))
            firsts = np.concatenate([_firsts(t) for t, _ in found])
            times = np.ones(len(token), np.int64)
            if len(big):
                at = np.minimum(np.searchsorted(big, token), len(big) - 1)
                times = np.where(big[at] == token, blocks[at], 1)
            if not times.any():
                continue
            cuts = np.searchsorted(np.cumsum(times), np.arange(0, times.sum(), 1 << 18), side="right")  # bounded batches
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(token)], strict=True):
                if i < j:
                    row, tile = _tiles(b.column(0).to_numpy()[owner[i:j]], times[i:j])
                    own = (b.column(k).to_numpy()[owner[i:j]][row] for k in range(len(_OWN)))
                    yield _batch(" ".join(["token", "tile", *_OWN, *_HERE]), int64(token[i:j][row]), tile, *own, place[i:j][row], *(int64(firsts[i:j, k][row]) for k in range(_FIRST)))

    return sets.select(*_OWN, "shingles").mapInArrow(tidy(hearts), "token long, tile long, " + ", ".join(f"{c} {'double' if c == 'd' else 'long'}" for c in [*_OWN, *_HERE]))


def _region_pairs(sets: DataFrame, levels: np.ndarray, percent: int) -> DataFrame:
    """(a, b, n, m): pairs of sets (x, n, s, cell, p, d, size, deltas, shingles;
    size is that of the pivot p) that share the heart of a region and that neither
    a common cell, nor sizes and shareable shingles, nor the distances to a common
    pivot or the differences from it decide."""

    def pairs(batches):
        found, count = [], 0

        def take():
            nonlocal found, count
            out, found, count = np.unique(np.concatenate(found), axis=0), [], 0
            return _batch("a b n m", *(np.ascontiguousarray(out[:, k]) for k in range(4)))

        def tiles():
            """The tiles one after another; one may go on in the next batch."""
            now, held = None, []
            for b in batches:
                if not b.num_rows:
                    continue
                cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
                token, tile, cell = cols[0], cols[1], cols[5]
                cuts = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (tile[1:] != tile[:-1]), [True]]))
                mixed = np.minimum.reduceat(cell, cuts[:-1]) != np.maximum.reduceat(cell, cuts[:-1])
                mixed[[0, -1]] = True  # the first may belong to the tile held, the last may go on
                for k in np.flatnonzero(mixed).tolist():
                    i, j = cuts[k], cuts[k + 1]
                    if (token[i], tile[i]) != now:
                        if held:
                            yield int(now[1]), held
                        now, held = (token[i], tile[i]), []
                    held.append([c[i:j].copy() for c in cols[2:]])
            if held:
                yield int(now[1]), held

        for tile, held in tiles():
            if len(held) > 1 or len(held[0][0]) > 1:
                for got in _open_pairs(tile, percent, *map(np.concatenate, zip(*held, strict=True))):
                    found.append(got)
                    count += len(got)
                    if count > 1 << 18:
                        yield take()
        if found:
            yield take()

    rows = _region_rows(sets, levels, percent)
    return rows.repartition("token", "tile").sortWithinPartitions("token", "tile").mapInArrow(tidy(pairs), "a long, b long, n long, m long").distinct()


def _feasible(p: str, q: str, percent: int):
    """The sizes (n) and shareable shingles (s) allow the overlap."""
    n, m, s, t = (F.col(f"{a}.{b}") for a, b in ((p, "n"), (q, "n"), (p, "s"), (q, "s")))
    need = percent * (n + m)
    return ((100 + percent) * F.least(s, t) >= need) & ((100 + percent) * F.least(n, m) >= need)


def _bitmap(h: np.ndarray) -> list[int]:
    bits = np.zeros(64 * _WORDS, bool)
    bits[(h >> np.uint64(9)) % np.uint64(64 * _WORDS)] = True
    return np.packbits(bits).view(np.int64).tolist()


def _verify(pairs: DataFrame, sets: DataFrame, fan: int = 512, deltas: bool = False) -> DataFrame:
    """(a, b, both): the exact intersection sizes of the pairs (a, b). A set b of
    many pairs is copied to as many tasks as it has ``fan`` pairs. With ``deltas``
    also the bitmaps of what a lacks of b and adds to it."""
    more = _DELTAS if deltas else []
    width = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / fan).cast("int").alias("fan"))
    left = pairs.join(width, "b").join(sets.select(F.col("x").alias("a"), "shingles"), "a").select(
        "b", F.pmod(F.xxhash64("a"), F.col("fan")).cast("int").alias("salt"), F.lit(1).alias("kind"), "a", F.col("shingles"))
    right = width.join(sets.select(F.col("x").alias("b"), "shingles"), "b").select(
        "b", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("a"), "shingles")
    rows = left.unionByName(right).repartition("b", "salt").sortWithinPartitions("b", "salt", "kind")

    def compare(batches):
        base = None
        for b in batches:
            out = []
            for pivot, kind, a, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if kind == 0:
                    base = s
                    continue
                at = np.minimum(np.searchsorted(base, s), len(base) - 1)
                same = base[at] == s
                row = [a, pivot, int(same.sum())]
                if more:
                    lacks = np.ones(len(base), bool)
                    lacks[at[same]] = False
                    row += _bitmap(base[lacks]) + _bitmap(s[~same])
                out.append(row)
            if out:
                yield _batch(" ".join(["a", "b", "both", *more]), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True)))

    return rows.mapInArrow(tidy(compare), ", ".join(f"{c} long" for c in ("a", "b", "both", *more)))


def _linked(percent: int):
    """On n, m (sizes) and both."""
    return F.col("both") * 100 >= (F.col("n") + F.col("m") - F.col("both")) * percent


def link_sets(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    area = work_area(docs.sparkSession)
    scanned = area.write(_scan(docs, width), "scan")
    own = scanned.filter("bucket is null").select("doc_id", F.col("n").alias("n_shingles"), "x", "y")
    classes = area.write(own.filter("n_shingles > 0 and doc_id is not null").groupBy("x", "y").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n")), "classes")
    # s: the shingles of a set that any other set can share
    known = area.write(classes.join(_shared_counts(scanned), "x").filter(F.col("s") * 100 >= F.col("n") * percent).select("x", "node", "n", "s"), "known")
    sets = area.write(_known_sets(docs, known, width), "sets")

    # cells: every set against the most central set of each of its min-hashes
    leads = area.write(_leads(sets), "leads")
    rank = F.struct(((F.col("n") - F.col("s")) * 1_000_000 / F.col("n")).cast("long").alias("lone"), F.xxhash64("x").alias("tie"), "x", "n", "s")
    pivots = leads.groupBy("token").agg(F.min(rank).alias("q"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    met = leads.alias("p").join(pivots, "token").filter((F.col("p.x") != F.col("q.x")) & _feasible("p", "q", percent))
    near = area.write(met.select(F.col("p.x").alias("a"), F.col("q.x").alias("b"), F.col("p.n").alias("n"), F.col("q.n").alias("m"), F.col("q.lone").alias("lone"), F.col("q.tie").alias("tie")).distinct(), "near")
    seen = area.write(near.join(_verify(near.select("a", "b"), sets, deltas=True), ["a", "b"]), "distances")
    links = seen.filter(_linked(percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    dist = 1 - F.col("both") / (F.col("n") + F.col("m") - F.col("both"))
    first = seen.groupBy("a").agg(  # of each set's pivots the most central one, linked or not
        F.min(F.when(_linked(percent), F.struct("lone", "tie", "b")))["b"].alias("cell"), F.min(F.struct("lone", "tie", "b", dist.alias("d"), "m", *_DELTAS)).alias("p"))
    first = area.write(first.select("a", "cell", F.col("p.b").alias("p"), F.col("p.d").alias("d"), F.col("p.m").alias("size"), *[f"p.{c}" for c in _DELTAS]), "cells")
    up = first.filter("cell is not null").select(F.col("a").alias("cell"), F.col("cell").alias("over"))
    marked = sets.join(first, sets["x"] == first["a"], "left").drop("a")
    # a pivot may be in another pivot's cell, and is at no distance from itself
    marked = marked.withColumn("cell", F.coalesce("cell", "x")).join(up, "cell", "left").withColumn("cell", F.coalesce("over", "cell")).drop("over")
    marked = area.write(marked.select("x", "n", "s", "cell", F.coalesce("p", "x").alias("p"), F.coalesce("d", F.lit(0.0)).alias("d"),
                                       F.coalesce("size", "n").alias("size"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _DELTAS], "shingles"), "marked")

    pairs = area.write(_region_pairs(marked, _levels(_counts(sets)), percent), "pairs")
    seen = pairs.join(_verify(pairs.select("a", "b"), sets), ["a", "b"])
    links = links.unionByName(seen.filter(_linked(percent)).select(F.col("a").alias("u"), F.col("b").alias("v")))
    ids = known.select(F.col("x").alias("u"), F.col("node").alias("p")), known.select(F.col("x").alias("v"), F.col("node").alias("q"))
    edges = links.join(ids[0], "u").join(ids[1], "v").select(F.col("p").alias("u"), F.col("q").alias("v"))
    comps = components(edges, area, "components")
    linked = own.join(classes.select("x", "y", "node"), ["x", "y"], "left").join(comps, "node", "left")
    return linked.select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link_sets(read(spark, sf_dir, "documents", "doc_id", "text"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, CASE WHEN len(words) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), inter AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other
)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY w.doc_id"""
