"""Token files, WARC archives and BPE: round trips and the library itself."""
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import bpe_tree, bpe_words, id_coder, token_files, warc
from tessera.llm.common import work_area

from .conftest import frame

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def hard_texts():
    rng = random.Random(3)
    alphabets = ["abcdefgh", "the in er on st", "aé ß Ω Σ ς", "日本語 한", "012 34", "'s't're ,.!?", "<|endoftext|>", "aaaa", "İ é́  \u0085 x"]
    texts = [None, "", "   ", "a" * 5000, "ab" * 3000]
    for _ in range(150):
        t = ""
        while len(t) < rng.choice([10, 200, 1500]):
            k = rng.choice(alphabets)
            t += k if k.startswith("<") else "".join(rng.choice(k) for _ in range(rng.choice([1, 5, 60, 300])))
        texts.append(t.replace(" ", "") if rng.random() < 0.5 else t)
    return texts + texts[3:6]


@pytest.mark.parametrize("size", [0, 1, 2, 255, 256, 257, 5000, 40000])
@pytest.mark.parametrize("kind", ["zero", "random", "cycle", "skewed"])
def test_coder(size, kind):
    rng = np.random.default_rng(size)
    ids = {"zero": np.zeros(size, int), "random": rng.integers(0, 49408, size), "cycle": np.arange(size) % 7 * 6000, "skewed": rng.geometric(0.05, size) % 49408}[kind]
    frame_ = id_coder.encode_block(ids)
    assert np.array_equal(id_coder.decode_block(frame_), ids)
    assert id_coder.frame_size(frame_, 0) == len(frame_)
    if size >= 5000 and kind != "random":
        assert len(frame_) < size * (1.2 if kind == "skewed" else 0.2)
    if size:
        broken = bytearray(frame_)
        broken[len(broken) // 2] ^= 4
        with pytest.raises(ValueError):
            id_coder.decode_block(bytes(broken))


def test_models_learn_from_every_id():
    rng = np.random.default_rng(1)
    model = id_coder._Model(90, 50)
    for _ in range(40):
        model.predict(50)
        model.learn(rng.integers(0, 90, 50))
    for tally in model.tally:
        assert tally.sum() - 8 == 40 * 50


def test_word_encoder_resets():
    enc, tok = bpe_words.WordEncoder(PATH, keep=20), library()
    for t in hard_texts():
        ids, counts = enc.texts(pa.array([t, t], pa.string()))
        want = tok.encode(t or "", add_special_tokens=False).ids
        assert ids.tolist() == want * 2 and counts.tolist() == [len(want)] * 2


def test_word_table_is_kept():
    """A full table keeps the words of several slices of texts, and later tasks find it."""
    tok = library()
    with pytest.raises(ValueError), bpe_words.kept_encoder(PATH) as broken:
        raise ValueError
    with bpe_words.kept_encoder(PATH) as enc:
        assert enc is not broken
        enc.keep = 40
        for k in range(9):
            text = " ".join(["often", "heard,", "Words", "ünd", "日本"] + [f"w{k}x{i}" for i in range(30)])
            ids, counts = enc.texts(pa.array([text]))
            assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]
            assert k < 2 or "often" in enc.at and "w0x1" not in enc.at
            assert len(enc.at) <= 80
    with bpe_words.kept_encoder(PATH) as again:
        assert again is enc and "often" in again.at
    bpe_words._KEPT.clear()


@pytest.mark.parametrize("block", [64, id_coder.BLOCK])
def test_token_files(spark, corpus, block):
    rows = [r for r in corpus if r[0] != 96] + [(500 + k, t) for k, t in enumerate(hard_texts())]
    folder = work_area(spark).path("t")
    token_files.write_token_files(frame(spark, rows), folder, PATH, files=5, block=block)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, folder).collect())
    tok, start, want = library(), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)


def test_token_files_edges(spark):
    folder = work_area(spark).path("t")
    token_files.write_token_files(frame(spark, []), folder, PATH)
    assert token_files.read_token_files(spark, folder).count() == 0
    folder = work_area(spark).path("t")
    token_files.write_token_files(frame(spark, [(None, "b"), (2, None), (None, "a")]), folder, PATH, files=2)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_token_files(spark, folder).collect())
    assert got == [(0, None, 2), (2, None, 2), (4, 2, 1)]


@pytest.mark.parametrize("leaf", [7, 40, 300])
def test_bpe(spark, leaf):
    texts = hard_texts()
    docs = frame(spark, [(k % 100, t) for k, t in enumerate(texts)] + [(None, "x y")])
    got = bpe_tree.digests(bpe_tree.encode_texts(docs, PATH, leaf), PATH).collect()
    tok, want = library(), []
    for d, t in [(k % 100, t) for k, t in enumerate(texts)] + [(None, "x y")]:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=str) == sorted(want, key=str)
    got = bpe_tree.encode_digests(docs, PATH, leaf, 3).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=str) == sorted(want, key=str)


def test_joins_act_on_given_words(spark):
    """The given documents have words that are encoded by halves, as the library does."""
    words = sorted({w for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() for w in (r.text or "").split()})
    enc, tok = bpe_tree.TreeEncoder(PATH), library()
    joins, join = [], enc.join
    enc.join = lambda *a: joins.append(a) or join(*a)
    ids, counts = enc.texts(pa.array(words))
    ends = counts.cumsum().tolist()
    assert len(joins) > 100
    for w, n, e in zip(words, counts.tolist(), ends, strict=True):
        if len(w) > 12:
            assert ids[e - n : e].tolist() == tok.encode(w, add_special_tokens=False).ids, w


def test_words_leave_with_the_partition():
    """An encoder's table is bounded, and empty after its partition."""
    with bpe_words.encoder(PATH, bpe_tree.TreeEncoder, keep=10) as enc:
        for k in range(50):
            enc.texts(pa.array([f"word{k} other{k}"]))
            assert len(enc.at) <= 12
    assert not vars(enc)


def test_bpe_empty(spark):
    assert bpe_tree.decode_ids(bpe_tree.encode_texts(frame(spark, []), PATH), PATH).count() == 0


def test_join_of_halves():
    """Any cut of any unsplit text joins to what the library gives."""
    enc, rng = bpe_tree.TreeEncoder(PATH), random.Random(8)
    for _ in range(300):
        s = "".join(rng.choice(["in", "the", "er", "on", "a", "t", "ing", "re", "ou", "s"]) for _ in range(rng.randrange(2, 60)))
        cut = rng.randrange(1, len(s))
        assert enc.join(enc.half(s[:cut], False), enc.half(s[cut:], True), True, 1) == enc.half(s, True)


PAGES = "page_id long, url string, html string, digest string, same string, kind string, refers_to long"


def page_rows():
    rng = random.Random(1)
    big = "".join(rng.choice("abc <>\r\n") for _ in range(9000))
    rows = [(1, "http://a", None), (2, None, ""), (3, "http://b\r\nWARC-Type: x", "<p>é</p>"), (4, "u", big), (5, "u", big), (6, "v", big[:999]), (7, "v", big[:999]),
            (8, "v", big[:1000]), (9, "w", big[:1000]), (10, "w", "\r\n\r\nWARC/1.1\r\n\r\n" * 90), (11, "x", "é" * 700), (12, "x", "é" * 700), (13, "x", "é" * 500), (14, "x", "0\r\n\r\n" * 300)]
    rows += [(20, "r", big), (20, "r", big), (None, "n", big), (None, "n", "short")]
    return [(*r, "?", "?", "?", 77) for r in rows]


@pytest.mark.parametrize("segment,archive", [(700, 3000), (1 << 15, 1 << 24)])
def test_warc(spark, segment, archive):
    rows = page_rows()
    folder = work_area(spark).path("w")
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), folder, 1000, segment, archive)
    got = warc.read_archives(spark, folder, with_payload=True).collect()
    head = {}
    for p, _, html, *_ in rows:
        b = (html or "").encode()
        if len(b) >= 1000 and p is not None:
            head[b] = max(head.get(b, p), p)
    want = []
    for p, _, html, *_ in rows:
        b = (html or "").encode()
        to = head.get(b) if p is not None and head.get(b) != p else None
        want.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to, b))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got), key=str) == sorted(want, key=str)


def test_warc_empty_and_broken(spark):
    folder = work_area(spark).path("w")
    warc.write_archives(spark.createDataFrame([], PAGES), folder)
    assert warc.read_archives(spark, folder).count() == 0
    records = warc.page_records(1, "u", b"x" * 900, hashlib.sha1(b"x" * 900).hexdigest(), None, 300)
    parsed = list(warc.parse_records(b"".join(r + warc.END for r in records)))
    parts = [(int(h[b"warc-segment-number"]), block) for h, block in parsed]
    total = int(parsed[-1][0][b"warc-segment-total-length"])
    random.Random(1).shuffle(parts)
    block = warc.reassemble(parts, total)
    assert warc.unchunked(block[block.index(warc.END) + 4 :]) == b"x" * 900
    for bad in (parts[1:], parts + parts[:1]):
        with pytest.raises(ValueError):
            warc.reassemble(bad, total)
    with pytest.raises(ValueError):
        warc.reassemble(parts, total + 1)
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
