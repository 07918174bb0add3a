"""Stand-in inputs built from the test tables, and offline model backends.

Nothing here does pipeline work. The builders only produce rows in the
schema a stage expects (pages with inline markup, reply chunks, fit
candidates); the backends play the part of the language model and answer with
letter-rotated text. The clean ones read the request messages; the faulty ones
also read the request's columns (ids, attempt, texts) to make faults on a fixed
schedule, so that every outcome class occurs.
"""

from __future__ import annotations

import json
import re
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import rot13

# --------------------------------------------------------------------------
# markup: pages with multi-shred groups, from documents
# --------------------------------------------------------------------------
_TAGS = (("<em>", "</em>"), ("<code>", "</code>"), ('<a href="#">', "</a>"))
_SPACES = re.compile("[ \t\r\f\x0b]+")


def _paragraph_html(line: str) -> str:
    """Every other word in ``em``, ``code`` or ``a`` in turn."""
    words = line.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").split(" ")
    for k, (opened, closed) in enumerate(_TAGS):
        words[2 * k + 1 :: 6] = [opened + w + closed for w in words[2 * k + 1 :: 6]]
    return f"<p>{' '.join(words)}</p>"


def _document_html(text: str) -> str:
    """One ``<p>`` per line with runs of spaces made single; empty lines dropped."""
    lines = (_SPACES.sub(" ", line).strip(" ") for line in text.split("\n"))
    return f"<!DOCTYPE html><html><body>{''.join([_paragraph_html(line) for line in lines if line])}</body></html>"


def markup_pages(documents: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` from ``documents``: one ``<p>`` per line,
    every other word wrapped in ``em``, ``code`` or ``a`` in turn. Row-local."""

    return documents.select(
        F.col("doc_id").alias("page_id"),
        F.format_string("docs/%s/%d.html", F.col("source"), F.col("doc_id")).alias("url"),
        _documents_html(F.col("text")).alias("html"),
    )


# --------------------------------------------------------------------------
# model stand-ins (backends)
# --------------------------------------------------------------------------
def _user_text(messages: Column) -> Column:
    users = F.filter(messages, lambda m: m["role"] == "user")
    return F.element_at(users, -1)["content"]


_ROTATED = bytes.maketrans((ascii_lowercase + ascii_uppercase).encode(), "".join(x[13:] + x[:13] for x in (ascii_lowercase, ascii_uppercase)).encode())
_FIT_JSON = re.compile(r'JSON: """\n(\{.*\})\n"""', re.S)


@F.arrow_udf(T.StringType())
def _rotated_texts(texts: pa.Array) -> pa.Array:
    there, ends, data = texts.buffers()
    if data is None:
        return texts
    turned = np.frombuffer(_ROTATED, np.uint8)[np.frombuffer(data, np.uint8)]  # no byte of a longer character is a letter
    return pa.Array.from_buffers(texts.type, len(texts), [there, ends, pa.py_buffer(turned)], offset=texts.offset)


def rotated(text: Column | str) -> Column:
    """``rot13`` of a whole column, which looks no character up (not for use inside a lambda)."""
    return _rotated_texts(F.col(text) if isinstance(text, str) else text)


def _object(text: str | None) -> dict | None:
    try:
        found = json.loads(text or "")
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _dumped(pieces: dict) -> str:
    return json.dumps(pieces, ensure_ascii=False, separators=(",", ":"))


def _rotated_values(pieces: dict[str, str]) -> dict[str, str]:
    turned = "\0".join(pieces.values()).encode().translate(_ROTATED).decode().split("\0")
    if len(turned) != len(pieces):  # a text with that character
        turned = [v.encode().translate(_ROTATED).decode() for v in pieces.values()]
    return dict(zip(pieces, turned))


def _answers(answer, *columns: pa.Array) -> pa.Array:
    """``answer`` to each row whose first column, the last user turn, is there."""
    return pa.array([None if row[0] is None else answer(*row) for row in zip(*(c.to_pylist() for c in columns))], pa.string())


def _rotated_payload(user: str) -> str | None:
    pieces = _object(user[user.find("{"):user.rfind("}") + 1]) if "{" in user else None
    return None if pieces is None else _dumped(_rotated_values(pieces))


@F.arrow_udf(T.StringType())
def _documents_html(texts: pa.Array) -> pa.Array:
    return _answers(_document_html, texts)


@F.arrow_udf(T.StringType())
def _translations(users: pa.Array) -> pa.Array:
    return _answers(_rotated_payload, users)


def _translate_content(requests: DataFrame) -> Column:
    return _translations(_user_text(F.col("messages")))


def _fit_pieces(user: str) -> dict | None:
    found = _FIT_JSON.search(user)
    return _object(found[1]) if found else None


def _perfect_fit(user: str) -> str | None:
    pieces = _fit_pieces(user)
    return None if pieces is None else _dumped(_rotated_values(pieces))


@F.arrow_udf(T.StringType())
def _perfect_fits(users: pa.Array) -> pa.Array:
    return _answers(_perfect_fit, users)


def _faulty_fit(user: str, page_id: int | None, group_no: int, attempt: int, trans_text: str | None) -> str | None:
    cls = 8 if page_id is None else (page_id + 3 * group_no) % 8
    if cls == 4 and attempt == 0:
        return "I am not sure."
    if cls == 6 or cls == 4 and attempt == 1:
        return _dumped({"0": trans_text})
    if cls >= 7 and group_no % 2 and attempt % 2 == 0:
        return "{}"
    pieces = _fit_pieces(user)
    if pieces is None:
        return None
    if cls >= 7 and group_no % 2:
        return _dumped({k: len(v) for k, v in pieces.items()})
    turned = _rotated_values(pieces)
    if cls >= 7:
        return _dumped({str(int(k) + 1): v for k, v in turned.items()})
    perfect = _dumped(turned)
    return f"Result:\n{perfect[:-1]},}}\nThanks." if cls == 5 else perfect


@F.arrow_udf(T.StringType())
def _faulty_fits(users: pa.Array, page_ids: pa.Array, group_nos: pa.Array, attempts: pa.Array, trans_texts: pa.Array) -> pa.Array:
    return _answers(_faulty_fit, users, page_ids, group_nos, attempts, trans_texts)


def _extended_fit(user: str, page_id: int | None, group_no: int) -> str | None:
    perfect = _perfect_fit(user)
    if perfect is None or page_id is None:
        return None
    return perfect.removesuffix('"}') + "\u2603" * ((page_id + group_no) % 4) + '"}'


@F.arrow_udf(T.StringType())
def _extended_fits(users: pa.Array, page_ids: pa.Array, group_nos: pa.Array) -> pa.Array:
    return _answers(_extended_fit, users, page_ids, group_nos)


def _reply(df: DataFrame, content: Column, finish: Column | None = None) -> DataFrame:
    return df.select(
        "*",
        F.lit(1).alias("calls"),
        content.alias("content"),
        (finish if finish is not None else F.lit("stop")).alias("finish_reason"),
        F.lit(None).cast("string").alias("error"),
    )


def rot13_translate_backend(requests: DataFrame) -> DataFrame:
    """Clean translation model: every value letter-rotated, same keys."""
    return _reply(requests, _translate_content(requests))


def faulty_translate_backend(requests: DataFrame) -> DataFrame:
    """Translation model with faults by page: class ``page_id % 8``.

    5: prose around the object and a trailing comma (still readable);
    6: finish reason ``length`` (text complete); 7: no JSON at all (the
    segment is unreadable); other classes: clean.
    """
    r = requests.withColumn("_clean", _translate_content(requests))
    clean = F.col("_clean")
    cls = F.pmod(F.col("page_id"), F.lit(8))
    content = (
        F.when(cls == 5, F.concat(F.lit("Here you go:\n"), F.regexp_replace(clean, r"\}$", ",}"), F.lit("\nDone.")))
        .when(cls == 7, F.lit("Sorry, I cannot translate this."))
        .otherwise(clean)
    )
    finish = F.when(cls == 6, F.lit("length")).otherwise(F.lit("stop"))
    return _reply(r, content, finish).drop("_clean")


def rot13_fit_backend(requests: DataFrame) -> DataFrame:
    """Clean fit model: every piece letter-rotated (a perfect fit)."""
    return _reply(requests, _perfect_fits(_user_text(F.col("messages"))))


def faulty_fit_backend(requests: DataFrame) -> DataFrame:
    """Fit model with faults by group: class ``(page_id + 3 * group_no) % 8``.

    0-3: perfect; 4: no JSON, then the whole translation in one piece, then
    perfect from attempt 2; 5: perfect inside prose with a trailing comma;
    6: always the whole translation in one piece (a wrong count); 7 with an
    even group: keys shifted by one (count right, keys out of range); 7 with
    an odd group: ``{}`` and non-string pieces in turn (never a candidate).
    """
    return _reply(requests, _faulty_fits(_user_text(F.col("messages")), F.col("page_id"), F.col("group_no"), F.col("attempt"), F.col("trans_text")))


def extended_fit_backend(requests: DataFrame) -> DataFrame:
    """Fit model that adds ``(page_id + group_no) % 4`` snowmen to the last piece of a
    perfect fit: partial scores between 0 and 1."""
    return _reply(requests, _extended_fits(_user_text(F.col("messages")), F.col("page_id"), F.col("group_no")))


def keyless_translate_backend(requests: DataFrame) -> DataFrame:
    """Translation model with faults by segment, ``(page_id + seg_no) % 4``: 1: the first key
    is missing; 2: a key that was not asked for; 3: no JSON at all."""
    m = F.from_json(F.regexp_extract(_user_text(F.col("messages")), r"(?s)\{.*\}", 0), "map<string,string>")
    rot = F.transform_values(m, lambda k, v: rot13(v))
    cls = F.pmod(F.col("page_id") + F.col("seg_no"), F.lit(4))
    content = (
        F.when(cls == 1, F.to_json(F.map_filter(rot, lambda k, v: k != "0")))
        .when(cls == 2, F.regexp_replace(F.to_json(rot), r"\}$", ',"x99":"?"}'))
        .when(cls == 3, F.lit("Sorry, I cannot translate this."))
        .otherwise(F.to_json(rot))
    )
    return _reply(requests, content)


# --------------------------------------------------------------------------
# other stand-in tables
# --------------------------------------------------------------------------
def reply_chunks(documents: DataFrame, width: int = 40) -> DataFrame:
    """``chunks(request_id, seq, role, content, finish_reason)``: each document
    cut every ``width`` characters; role only on seq 0, finish reason on the last."""
    documents = documents.repartition(documents.sparkSession.sparkContext.defaultParallelism)  # may be one row group
    n = F.greatest(F.ceil(F.length("text") / F.lit(width)), F.lit(1)).cast("int")
    d = documents.select(F.col("doc_id"), "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"), n.alias("n"))
    return d.select(
        F.format_string("d-%d", "doc_id").alias("request_id"),
        F.col("seq").cast("int").alias("seq"),
        F.when(F.col("seq") == 0, F.lit("assistant")).alias("role"),
        F.substring(F.col("text"), F.col("seq") * width + 1, width).alias("content"),
        F.when(F.col("seq") == F.col("n") - 1, F.lit("stop")).alias("finish_reason"),
    )


def conversation_candidates(conversations: DataFrame) -> DataFrame:
    """``candidates(page_id, group_no, attempt, score, reason, pieces, bad_values, n_shreds)``
    from conversation turns: group = conversation, attempt = turn, score from
    the text length (tenths, so ties occur); pieces = words."""
    words = F.split(F.col("text"), " ")
    score = F.pmod(F.length("text"), F.lit(11)) / F.lit(10.0)
    pieces = F.map_from_arrays(
        F.transform(words, lambda w, i: i.cast("string")), words
    )
    return conversations.select(
        F.col("conv_id").alias("page_id"),
        F.lit(0).alias("group_no"),
        F.col("turn").cast("int").alias("attempt"),
        score.alias("score"),
        F.lit("").alias("reason"),
        pieces.alias("pieces"),
        F.lit(False).alias("bad_values"),
        F.size(words).alias("n_shreds"),
    )


def faulty_reply_texts(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, content)``: reply texts with a fault class ``conv_id % 8``.

    0 clean object; 1 prose and a trailing comma; 2 two objects; 3 single
    quotes; 4 cut off; 5 a duplicated key; 6 a number as value; 7 ``{}``.
    """
    t = F.regexp_replace(F.col("text"), "\n", " ")
    obj = F.to_json(F.create_map(F.lit("0"), t, F.lit("1"), F.lit("x")))
    cls = F.pmod(F.col("conv_id"), F.lit(8))
    content = (
        F.when(cls == 0, obj)
        .when(cls == 1, F.concat(F.lit("Sure:\n"), F.regexp_replace(obj, r"\}$", ",}"), F.lit("\nBye")))
        .when(cls == 2, F.concat(obj, F.lit(" and "), obj))
        .when(cls == 3, F.concat(F.lit("{'0':'"), t, F.lit("'}")))
        .when(cls == 4, F.concat(F.lit('{"0":"'), t))
        .when(cls == 5, F.concat(F.lit('{"0":"a","0":"'), t, F.lit('"}')))
        .when(cls == 6, F.concat(F.lit('{"0":'), F.length(t).cast("string"), F.lit("}")))
        .otherwise(F.lit("{}"))
    )
    return conversations.select("conv_id", "turn", content.alias("content"))


def reply_entries(segments: DataFrame) -> DataFrame:
    """``(page_id, seg_no, key, value)``: reply entries for planned segments,
    with key 0 missing when ``page_id % 3 == 1`` and an extra key 99 when
    ``page_id % 3 == 2``."""
    cls = F.pmod(F.col("page_id"), F.lit(3))
    base = segments.filter(~((cls == 1) & (F.col("seg_key") == 0))).select(
        "page_id", "seg_no", F.col("seg_key").cast("string").alias("key"), F.lit("v").alias("value")
    )
    extra = segments.filter((cls == 2) & (F.col("seg_key") == 0)).select(
        "page_id", "seg_no", F.lit("99").alias("key"), F.lit("v").alias("value")
    )
    return base.unionByName(extra)


class FlakyRotationModel:
    """Stand-in for a model service behind ``python_backend``.

    Answers with the letter-rotated JSON payload of the last user message.
    The first call for a payload whose length is a multiple of 7 fails with
    a retryable error; a payload whose length is a multiple of 11 is answered
    with finish reason ``length``.
    """

    def failures(self, payload: str) -> int:
        """How many calls for a payload fail before it is answered."""
        return 1 if len(payload) % 7 == 0 else 0

    def __call__(self, model, messages, temperature, call):
        import codecs
        import json
        import re

        from tessera.operators.calls import RetryableError

        user = [m for m in messages if m["role"] == "user"][-1]["content"]
        found = re.search(r"\{.*\}", user, re.S)
        payload = found.group(0) if found else "{}"
        if call.attempt < self.failures(payload):
            raise RetryableError("rate limited")
        obj = json.loads(payload)
        out = json.dumps({k: codecs.encode(v, "rot13") for k, v in obj.items()}, ensure_ascii=False, separators=(",", ":"))
        return out, ("length" if len(payload) % 11 == 0 else "stop")


class OftenFlakyModel(FlakyRotationModel):
    """Fails 0 to 3 times, by the payload's length."""

    def failures(self, payload: str) -> int:
        return len(payload) % 4


class StreamingEcho:
    """A model that streams the user's text back in pieces of ``width`` characters.

    A stream of text whose length is a multiple of 3 breaks after its second piece, on
    the first attempt; asked to go on after a part, the model streams the rest.
    """

    def __init__(self, width: int = 1000):
        self.width = width

    def __call__(self, model, messages, temperature, call):
        from tessera.operators.calls import RetryableError

        text = messages[-1]["content"] if messages[-1]["role"] == "user" else messages[-2]["content"]
        done = messages[-1]["content"] if messages[-1]["role"] == "assistant" else ""
        rest = text[len(done):] if text.startswith(done) else "?"
        cuts = range(0, max(len(rest), 1), self.width)
        for n, at in enumerate(cuts):
            if n == 2 and call.attempt == 0 and len(text) % 3 == 0:
                raise RetryableError("the stream broke")
            yield {"role": "assistant" if n == 0 else None, "content": rest[at : at + self.width], "finish_reason": "stop" if at == cuts[-1] else None}


class CutRotationModel:
    """A model whose replies hold at most ``width`` characters: it answers the last
    user turn letter-rotated, and goes on where the assistant's turn after it ends."""

    def __init__(self, width: int = 150):
        self.width = width

    def __call__(self, model, messages, temperature):
        import codecs

        user = [m for m in messages if m["role"] == "user"][-1]["content"]
        done = len(messages[-1]["content"]) if messages[-1]["role"] == "assistant" else 0
        part = codecs.encode(user, "rot13")[done : done + self.width]
        return part, ("length" if done + self.width < len(user) else "stop")


def text_requests(rows: DataFrame, request_id: Column, text: Column) -> DataFrame:
    """One request per row: its text as the user's turn."""
    from tessera.operators.requests import build_messages

    return rows.select(
        request_id.alias("request_id"), F.lit("local-model").alias("model"), F.lit(0.01).alias("temperature"),
        build_messages(F.lit("Answer."), F.lit(None), text).alias("messages"))
