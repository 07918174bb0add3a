"""BPE encoding and decoding, with tree concatenation for long texts.

Encoding gives exactly what the tokenizers library gives for the whole text.

Unsplit text - a pre-token, which no white space or punctuation divides - of more
than ``half`` symbols is cut in the middle, again and again. Halves are encoded as
if they went on (without the end-of-word mark, but for the last). Neighbours are
then joined pairwise, level by level: a window of tokens on both sides of the join
is encoded anew and grows (doubling) until its first token is the left half's and
its last token is the right half's. Then every two neighbouring tokens are a pair
that encodes to itself, which makes the whole sequence the one the library gives.
Between two words a join is free, since no token reaches across white space; so
every distinct word is encoded once and looked up afterwards.

A document of at most ``leaf`` characters is encoded in one task. A longer one is
cut into leaves of whole words of about ``leaf`` characters that are dealt over all
tasks and joined again; a word longer than a leaf is cut into halves of at most
``leaf`` symbols, which tasks encode in parallel (each again by halves) and whose
joins are made where the document comes together.

Decoding is the library's decode(ids, skip_special_tokens=False).
``encode_digests`` encodes, decodes and digests in one pass, with one tokenizer a
task, whose memory goes back when the partition ends.

Only documents over ``leaf`` characters are shuffled, as leaves and ids; a
group holds one document's ids, equal documents apart.

Defined cases: a null text is empty and has no ids; rows with the same doc_id,
even equal rows, give a row each; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe_words
from tessera.llm.common import SPACES, read, text_slices

TOKENIZER = "word_bpe_49k.json"
LEAF = 1 << 16
HALF = 12
KEEP = 100_000
_GAP = re.compile(f"[{SPACES}]")


class TreeEncoder(bpe_words.WordEncoder):
    """Word encoder that can also encode unsplit text by halves."""

    def __init__(self, path: str, half: int = HALF, keep: int = KEEP):
        super().__init__(path, keep)
        self.path, self.half_size = path, half
        with open(path) as f:
            added = json.load(f)["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        self.special_at = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")

    @cached_property
    def models(self):
        """The model without and with the end-of-word mark; loaded where unsplit text is met."""
        inner = bpe_words.load(self.path).model
        inner.end_of_word_suffix = None
        return inner, self.tok.model

    @cached_property
    def text_of(self) -> list[str]:
        """The symbols of each id; the word mark is an end, not a symbol."""
        return [(self.tok.id_to_token(i) or "").removesuffix(bpe_words.WORD_END) for i in range(self.tok.get_vocab_size())]

    def half(self, symbols: str, last: bool) -> list[int]:
        """Ids of a piece of a pre-token (in the byte alphabet)."""
        return [t.id for t in self.models[last].tokenize(symbols)]

    def join(self, left: list[int], right: list[int], last: bool, window: int = 4) -> list[int]:
        """The ids of two neighbouring halves as one; last: the pre-token ends
        with the right one."""
        while True:
            i, j = max(0, len(left) - window), min(len(right), window)
            whole_right = j == len(right)
            text = "".join(map(self.text_of.__getitem__, left[i:] + right[:j]))
            mid = self.half(text, last and whole_right)
            agree_left = i == 0 or (len(mid) > 1 and mid[0] == left[i])
            agree_right = whole_right or (len(mid) > 1 and mid[-1] == right[j - 1])
            if agree_left and agree_right:
                return left[:i] + mid + right[j:]
            window *= 2

    def join_all(self, halves: list[list[int]], last: bool = True) -> list[int]:
        """Join the halves of one pre-token pairwise, level by level."""
        while len(halves) > 1:
            end = len(halves) - 1
            halves = [self.join(halves[k], halves[k + 1], last and k + 1 == end) if k < end else halves[k] for k in range(0, len(halves), 2)]
        return halves[0] if halves else []

    def unsplit(self, symbols: str, last: bool = True) -> list[int]:
        """Ids of unsplit text, by halves where it is long."""
        if len(symbols) <= self.half_size:
            return self.half(symbols, last)
        parts = cut_long(symbols, self.half_size)
        return self.join_all([self.half(x, last and k == len(parts) - 1) for k, x in enumerate(parts)], last)

    def leaf(self, kind: str, part: str) -> list[int]:
        """Ids of one leaf."""
        if kind == "words":
            return self.texts(pa.array([part]))[0].tolist()
        if kind == "id":
            return [int(part)]
        if kind == "pre":
            return [i for x in part.split("\n") for i in self.unsplit(x)]
        return self.unsplit(part, kind == "last")

    def concatenate(self, leaves) -> list[int]:
        """Ids of the leaves (kind, ids) of a text, in order."""
        out, halves = [], []
        for kind, ids in leaves:
            if kind in ("half", "last"):
                halves.append(ids)
                if kind == "last":
                    out += self.join_all(halves)
                    halves = []
            else:
                out += ids
        return out

    def _encode_new(self, words: list[str]) -> None:
        """Words that may hold long unsplit text are encoded by halves."""
        super()._encode_new([w for w in words if len(w) <= self.half_size])
        long = [w for w in words if len(w) > self.half_size]
        if long:
            found = [self.concatenate((kind, self.leaf(kind, part)) for kind, part in long_word_leaves(self, w, self.half_size)) for w in long]
            self._add(long, np.array([i for ids in found for i in ids], np.int32), np.array(list(map(len, found)), np.int64))


def cut_words(text: str, leaf: int):
    """The text as pieces of whole words of about leaf characters; a longer word
    is a piece of its own. Yields (piece, is one long word)."""
    at = 0
    while at < len(text):
        if len(text) - at <= leaf:
            yield text[at:], False
            return
        gap = max(text.rfind(c, at, at + leaf) for c in SPACES)
        if gap > at:
            yield text[at:gap], False
            at = gap
            continue
        if text[at] in SPACES:
            at += 1
            continue
        found = _GAP.search(text, at)
        end = found.start() if found else len(text)
        yield text[at:end], end - at > leaf
        at = end


def cut_long(symbols: str, leaf: int) -> list[str]:
    """Halves of halves, each of at most leaf symbols."""
    if len(symbols) <= leaf:
        return [symbols]
    mid = len(symbols) // 2
    return cut_long(symbols[:mid], leaf) + cut_long(symbols[mid:], leaf)


def long_word_leaves(enc: TreeEncoder, word: str, leaf: int):
    """(kind, text) of a long word's leaves: "id" a special token, "pre"
    pre-tokens one a line, "half" / "last" the halves of one long pre-token."""

    def plain(part):
        short, held = [], 0
        for symbols, _ in enc.tok.pre_tokenizer.pre_tokenize_str(enc.tok.normalizer.normalize_str(part)):
            if len(symbols) > leaf or held > leaf:
                if short:
                    yield "pre", "\n".join(short)
                short, held = [], 0
            if len(symbols) > leaf:
                halves = cut_long(symbols, leaf)
                yield from (("half", h) for h in halves[:-1])
                yield "last", halves[-1]
            else:
                short.append(symbols)
                held += len(symbols)
        if short:
            yield "pre", "\n".join(short)

    at = 0
    for m in enc.special_at.finditer(word):
        yield from plain(word[at : m.start()])
        yield "id", str(enc.special[m[0]])
        at = m.end()
    yield from plain(word[at:])


def _bytes(ids) -> bytes:
    return np.asarray(ids, "<i4").tobytes()


def _lists(ids: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    ends = np.cumsum(counts).tolist()
    ids = ids.tolist()
    return [ids[e - n : e] for e, n in zip(ends, counts.tolist(), strict=True)]


def _encoded(docs: DataFrame, tokenizer: str, leaf: int, half: int, finish, schema: str) -> DataFrame:
    """``finish(encoder, doc_ids, lists of ids)`` of all documents, as record batches."""
    docs = docs.select("doc_id", "text")
    long = F.coalesce(F.length("text"), F.lit(0)) > leaf

    def whole(batches):
        with bpe_words.encoder(tokenizer, TreeEncoder, half=half) as enc:
            for b in text_slices(batches, most=1 << 20):
                yield finish(enc, b.column(0), _lists(*enc.texts(b.column(1))))

    def leaves(batches):
        with bpe_words.encoder(tokenizer, TreeEncoder, half=half) as enc:
            # rows are told apart by their place, which a repeated task finds again
            row = TaskContext.get().partitionId() << 40
            for b in text_slices(batches):
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    row, rows = row + 1, []
                    for piece, one_word in cut_words(text, leaf):
                        for kind, part in long_word_leaves(enc, piece, leaf) if one_word else [("words", piece)]:
                            rows.append((row, doc, len(rows), kind, part))
                    rows = rows or [(row, doc, 0, "words", "")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
                                                     ["row", "doc_id", "n", "kind", "part"])

    def encode(batches):
        with bpe_words.encoder(tokenizer, TreeEncoder, half=half) as enc:
            for b in batches:
                out = [_bytes(enc.leaf(kind, part)) for kind, part in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(out, pa.binary())], ["row", "doc_id", "n", "kind", "ids"])

    def together(batches):
        with bpe_words.encoder(tokenizer, TreeEncoder, half=half) as enc:
            for b in batches:
                for r in range(b.num_rows):
                    parts = sorted((x["n"], x["kind"], x["ids"]) for x in b.column(1)[r].as_py())
                    ids = enc.concatenate((kind, np.frombuffer(raw, "<i4").tolist()) for _, kind, raw in parts)
                    yield finish(enc, b.column(0).slice(r, 1), [ids])

    pieces = docs.filter(long).mapInArrow(leaves, "row long, doc_id long, n long, kind string, part string")
    coded = pieces.repartition("row", "n").mapInArrow(encode, "row long, doc_id long, n long, kind string, ids binary")
    trees = coded.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("n", "kind", "ids")).alias("parts")).select("doc_id", "parts")
    return docs.filter(~long).mapInArrow(whole, schema).unionByName(trees.mapInArrow(together, schema))


def encode_texts(docs: DataFrame, tokenizer: str, leaf: int = LEAF, half: int = HALF) -> DataFrame:
    """doc_id, ids (binary: little-endian 32-bit numbers) of every document."""

    def finish(_, doc_ids, ids):
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(list(map(_bytes, ids)), pa.binary())], ["doc_id", "ids"])

    return _encoded(docs, tokenizer, leaf, half, finish, "doc_id long, ids binary")


def decode_ids(coded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids, and the decoded text of every document."""

    def decode(batches):
        with bpe_words.encoder(tokenizer, bpe_words.Library) as library:
            for b in text_slices(batches, text="ids", most=1 << 20):
                texts = library.tok.decode_batch([np.frombuffer(x, "<i4").tolist() for x in b.column(1).to_pylist()], skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return coded.mapInArrow(decode, "doc_id long, ids binary, decoded string")


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digested(tok, doc_ids: pa.Array, ids: list[list[int]]) -> pa.RecordBatch:
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    texts = tok.decode_batch(ids, skip_special_tokens=False)
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(list(map(len, ids)), pa.int64()), pa.array([sha(" ".join(map(str, x))) for x in ids], pa.string()), pa.array(list(map(sha, texts)), pa.string())],
        [c.split(" ")[0] for c in _DIGESTS.split(", ")])


def digests(coded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded documents."""

    def digest(batches):
        with bpe_words.encoder(tokenizer, bpe_words.Library) as library:
            for b in text_slices(batches, text="ids", most=1 << 20):
                yield _digested(library.tok, b.column(0), [np.frombuffer(x, "<i4").tolist() for x in b.column(1).to_pylist()])

    return coded.mapInArrow(digest, _DIGESTS)


def encode_digests(docs: DataFrame, tokenizer: str, leaf: int = LEAF, half: int = HALF) -> DataFrame:
    """``digests`` of ``encode_texts`` in one pass over the documents."""
    return _encoded(docs, tokenizer, leaf, half, lambda enc, doc_ids, ids: _digested(enc.tok, doc_ids, ids), _DIGESTS)


def op7_bpe_tree(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    return encode_digests(read(spark, sf_dir, "documents", "doc_id", "text"), path)
