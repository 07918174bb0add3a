"""Fast, exact encoding of whole texts with a public tokenizer file.

The tokenizer's normalizer turns white space into one space and its
pre-tokenizer drops it, so no token, normalization or special token reaches
across the ASCII white space between two words: a text's ids are the ids of
its words, one after another. Every distinct word is therefore given to the
library once and looked up afterwards; the table is bounded by ``keep`` words and
``POOL`` ids. When full it drops the words of one slice of texts only, and starts
anew if too many are left. ``encoder`` gives a task its encoder and
gives the memory back when the task's partition ends, since Spark reuses its
Python workers for other work. ``kept_encoder`` gives a task the encoder of its
Python worker, whose table (``KEPT`` words) later tasks of the worker find filled.
"""

from __future__ import annotations

import os
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import release, split_words, strings

#: Ids that a table of words may hold before it starts anew.
POOL = 1 << 22
#: Words that an encoder has which stays in its Python worker.
KEPT = 1 << 20
#: What the vocabulary's tokens at the end of a word end with.
WORD_END = "</w>"
#: Characters whose normalized and lower-cased forms have as many UTF-8 bytes
#: as they have, and which never combine: ASCII and the Latin-1 letters.
_PLAIN = "^[\x21-\x7eÀ-ÖØ-öø-ÿ]+$"


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class WordEncoder:
    """Ids of words and of texts, for a tokenizer that drops white space."""

    def __init__(self, path: str, keep: int = 1 << 20):
        self.tok = load(path)
        self.keep = keep
        size = self.tok.get_vocab_size()
        names = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.bytes_of = np.array([len(n.removesuffix(WORD_END)) for n in names], np.int64)
        self._reset()

    def _reset(self):
        self.at: dict[str, int] = {}
        self.pool = np.empty(1 << 18, np.int32)
        self.used = 0
        self.start = np.empty(1 << 16, np.int64)
        self.size = np.empty(1 << 16, np.int64)
        self.slices = np.zeros(1 << 16, np.int32)  # of texts that had the word

    def _thin(self):
        """Drop the words that one slice of texts had; all, if more than half of what is kept are left."""
        n = len(self.at)
        keep = np.flatnonzero(self.slices[:n] > 1)
        size = self.size[keep]
        if len(keep) > self.keep // 2 or size.sum() > POOL // 2:
            self._reset()
            return
        words, start = list(self.at), self.start[keep]
        ids = self.pool[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        self._reset()
        self._add([words[k] for k in keep.tolist()], ids, size)
        self.slices[: len(keep)] = 1

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.at)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while n + len(words) > len(self.start):
            self.start, self.size, self.slices = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.slices))
        self.pool[self.used : self.used + len(ids)] = ids
        self.size[n : n + len(words)] = sizes
        self.start[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.at.update(zip(words, range(n, n + len(words)), strict=True))

    def _encode_new(self, words: list[str]) -> None:
        col = pa.array(words, pa.string())
        rule = pc.and_(pc.match_substring_regex(col, _PLAIN), pc.and_not(pc.less(pc.utf8_length(col), 200), pc.match_substring(col, "<|")))
        plain = strings(col.filter(rule))
        other = strings(col.filter(pc.invert(rule)))
        for i in range(0, len(plain), 6400):
            part = plain[i : i + 6400]
            texts = ["\n".join(part[k : k + 100]) for k in range(0, len(part), 100)]
            ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.cumsum(self.bytes_of[ids])
            want = np.cumsum(pc.binary_length(pa.array(part)).to_numpy().astype(np.int64))
            last = np.searchsorted(ends, want)
            if not np.array_equal(ends[np.minimum(last, len(ends) - 1)], want):
                other += part  # never for the characters above; the library decides
                continue
            self._add(part, ids, np.diff(last, prepend=-1))
        for w in other:
            ids = self.tok.encode(w, add_special_tokens=False).ids
            self._add([w], np.array(ids, np.int32), np.array([len(ids)]))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of each."""
        words, counts = split_words(texts)
        if len(words) == 0:
            return np.empty(0, np.int32), np.zeros(len(counts), np.int64)
        coded = words.dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        names = strings(coded.dictionary)
        if len(self.at) > self.keep or self.used > POOL:
            self._thin()
        place = np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(place < 0)
        if len(new):
            names = [names[i] for i in new.tolist()]
            self._encode_new(names)
            place[new] = np.fromiter(map(self.at.__getitem__, names), np.int64, len(new))
        self.slices[place] += 1
        place = place[coded.indices.to_numpy()]
        size = self.size[place]
        ends = np.cumsum(size)
        shift = np.repeat(self.start[place] - (ends - size), size)
        shift += np.arange(len(shift))
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.pool[shift], np.diff(bounds)


_KEPT: dict[str, WordEncoder] = {}


@contextmanager
def kept_encoder(path: str):
    """The Python worker's encoder for this file; it stays when the partition ends."""
    if path not in _KEPT:
        _KEPT[path] = WordEncoder(path, keep=KEPT)
    try:
        yield _KEPT[path]
    except BaseException:
        _KEPT.pop(path, None)  # a table may be half filled
        raise
    finally:
        release()


class Library:
    """The tokenizer alone."""

    def __init__(self, path: str):
        self.tok = load(path)


@contextmanager
def encoder(path: str, make=WordEncoder, **options):
    """An encoder (or ``Library``) for the time of one partition."""
    made = make(path, **options)
    try:
        yield made
    finally:
        vars(made).clear()  # the task's function may still hold the object
        release()
