"""Token ids of a corpus in compressed binary files, in document order.

Documents are sorted by range over doc_id; every task encodes its documents
and writes one file: a sequence of block frames. A frame's payload is the table
of its documents (doc_id and number of ids) followed by one block of
``id_coder`` (adaptive context-mixing range coder; blocks are reset, and
checksummed, independently). A document may run over several blocks of its
file. Files are written by Spark's text writer, whose line end closes a frame,
so any file system that Spark writes will do; their names sort in document
order.

Reading parses each file by frame lengths, decodes block by block, and takes
the files' positions in the corpus from the sums of their ids: a table with a
row per file.

Memory: a Python worker keeps one table of words for all its tasks (bounded, see
``bpe_words``); a task holds one slice of texts, the ids of the block being filled and
one file's bytes on reading (a range partition's ids, about one byte each).

Defined cases: a null text is empty and has the end id only; rows with the same
doc_id are separate documents, ordered by text; null doc_ids come first; an
empty table writes no frame and reads as an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bpe_words, id_coder
from tessera.llm.common import partitions, read, text_slices, work_area

TOKENIZER = "word_bpe_49k.json"
MAGIC = b"DOCS"
NULL_ID = np.iinfo(np.int64).min


def pack_frame(doc_ids: np.ndarray, counts: np.ndarray, opens: bool, ids: np.ndarray) -> bytes:
    """One frame: documents that have ids here, and the ids. opens: the first
    document begins in this frame (else it is continued)."""
    head = struct.pack("<IB", len(doc_ids), opens) + doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes()
    return MAGIC + struct.pack("<II", len(head), zlib.crc32(head)) + head + id_coder.encode_block(ids)


def unpack_frames(data: bytes):
    """(doc_ids, counts, opens, ids) of every frame of a file."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != MAGIC:
            raise ValueError(f"no frame at byte {at}")
        size, crc = struct.unpack_from("<II", data, at + 4)
        head = data[at + 12 : at + 12 + size]
        if zlib.crc32(head) != crc:
            raise ValueError("document table is damaged")
        n, opens = struct.unpack_from("<IB", head)
        at += 12 + size
        end = at + id_coder.frame_size(data, at)
        yield np.frombuffer(head, "<i8", n, 5), np.frombuffer(head, "<u4", n, 5 + 8 * n), bool(opens), id_coder.decode_block(data[at:end])
        at = end
        if data[at : at + 1] != b"\n":
            raise ValueError("frame isn't closed")
        at += 1


class _Filler:
    """Fills blocks with the documents of one file."""

    def __init__(self, block: int):
        self.block = block
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple[int, int]] = []
        self.held, self.opens = 0, True

    def add(self, doc_id: int, ids: np.ndarray):
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, self.block - self.held)
            self.parts.append(ids[at : at + take])
            self.docs.append((doc_id, take))
            self.held += take
            at += take
            if self.held == self.block:
                yield self.frame(at == len(ids))

    def frame(self, next_opens: bool) -> bytes:
        table = np.array(self.docs, np.int64).reshape(-1, 2)
        out = pack_frame(table[:, 0], table[:, 1], self.opens, np.concatenate(self.parts))
        self.parts, self.docs, self.held, self.opens = [], [], 0, next_opens
        return out


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, files: int | None = None, block: int = id_coder.BLOCK) -> None:
    """Encode docs (doc_id, text) and write their ids into folder."""
    spread = docs.select("doc_id", "text").repartitionByRange(files or partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def frame(x):
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], ["frame"])

    def encode(batches):
        filler = _Filler(block)
        with bpe_words.kept_encoder(tokenizer) as enc:
            for b in text_slices(batches):
                ids, counts = enc.texts(b.column(1))
                ends = np.cumsum(counts)
                whole = np.insert(ids, ends, end_id)  # the end id after every document
                ends = ends + np.arange(1, len(ends) + 1)
                for doc, i, j in zip(pc.fill_null(b.column(0), int(NULL_ID)).to_pylist(), (ends - counts - 1).tolist(), ends.tolist(), strict=True):
                    for x in filler.add(doc, whole[i:j]):
                        yield frame(x)
        if filler.held:
            yield frame(filler.frame(True))

    spread.mapInArrow(encode, "frame binary").select(F.col("frame").cast("string")).write.text(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("own_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches):
        for b in batches:
            for k in range(b.num_rows):
                name, at = b.column(0)[k].as_py().rpartition("/")[2], 0
                last = None  # the document that may go on: doc_id, start, tokens, crc
                for doc_ids, counts, opens, ids in unpack_frames(b.column(1)[k].as_py()):
                    raw = memoryview(ids.astype("<u4").tobytes())
                    rows, own = [], 0
                    for i, (doc, n) in enumerate(zip(doc_ids.tolist(), counts.tolist(), strict=True)):
                        piece = raw[4 * own : 4 * (own + n)]
                        if i == 0 and not opens:
                            last = (last[0], last[1], last[2] + n, zlib.crc32(piece, last[3]))
                        else:
                            if last:
                                rows.append(last)
                            last = (doc, at + own, n, zlib.crc32(piece))
                        own += n
                    at += own
                    if rows:
                        yield _rows(name, rows, schema)
                if last:
                    yield _rows(name, [last], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    area = work_area(spark)
    docs = area.write(files.mapInArrow(decode, "file string, doc_id long, own_start long, n_tokens long, ids_crc32 long"), "docs")
    sums = docs.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    before = sums.select("file", (F.sum("n").over(Window.orderBy(number)) - F.col("n")).alias("before"))
    return docs.join(before, "file").select(
        F.when(F.col("doc_id") != int(NULL_ID), F.col("doc_id")).alias("doc_id"), (F.col("before") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32",
    )


def _rows(name, rows, schema):
    doc, start, n, crc = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([name] * len(doc)), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], schema=schema)


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = work_area(spark).path("tokens")
    write_token_files(read(spark, sf_dir, "documents", "doc_id", "text"), folder, public_tokenizers.path(TOKENIZER))
    return read_token_files(spark, folder)
