"""Segment payloads, prompts and chat messages as columns.

Prompt wording is our own; only the roles and the inputs of each message
follow the behaviour being reproduced. Every request is an independent row (the history is
cleared before each fit attempt, D9), so requests need no driver state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.options import Options

MESSAGE_TYPE = "array<struct<role:string,content:string>>"


def translate_system_msg(src_lang: Column, tgt_lang: Column) -> Column:
    """System text of the translation task."""
    return F.format_string(
        "You are an expert translator. Translate %s text into fluent, natural %s "
        "of the quality a skilled human translator would give.",
        src_lang,
        tgt_lang,
    )


def translate_user_msg(src_lang: Column, tgt_lang: Column, payload_json: Column) -> Column:
    """D3: instruction (identifiers and non-sentences stay unchanged) + JSON payload."""
    return F.format_string(
        "The JSON object below holds %s text taken from one part of a single web page. "
        "Translate every value into %s and answer with a JSON object with the same keys. "
        "Leave function and command names (snake_case, PascalCase, camelCase) and any "
        "text that is not an ordinary sentence as it is.\n%s\n",
        src_lang,
        tgt_lang,
        payload_json,
    )


FIT_SYSTEM_MSG = (
    "You are an expert translator. Split a translation into parts and put each part "
    "into the matching field of a JSON object."
)


def fit_user_msg(trans: Column, ori: Column, shreds_json: Column) -> Column:
    """Translation, original text and the shreds JSON; no character may be dropped."""
    parts = (
        F.lit('Translation:\n"""\n'), trans, F.lit('\n"""\nOriginal text:\n"""\n'), ori,
        F.lit('\n"""\nThe original text is split into these pieces:\nJSON: """\n'), shreds_json,
        F.lit('\n"""\nSplit the translation the same way, one part per key, and drop no character of the translation.'),
    )
    return F.concat(*[F.coalesce(p, F.lit("null")) for p in parts])


def keyed_json(items: Column, key: str, value: str) -> Column:
    """JSON object ``{"0": .., "1": ..}`` from an array of structs, in integer key order."""
    entries = F.transform(
        F.array_sort(F.transform(items, lambda x: F.struct(x[key].alias("k"), x[value].alias("v")))),
        lambda e: F.struct(e["k"].cast("string").alias("key"), e["v"].alias("value")),
    )
    return F.to_json(F.map_from_entries(entries))


def shreds_json(shreds: Column) -> Column:
    """Shred texts of a group keyed "0".."n-1" by position."""
    entries = F.transform(shreds, lambda s, i: F.struct(i.cast("string").alias("key"), s["text"].alias("value")))
    return F.to_json(F.map_from_entries(entries))


def build_messages(system: Column, history: Column, user: Column, to_continue: Column | bool = False) -> Column:
    """System, then history, then the user turn unless continuing."""
    if isinstance(to_continue, bool):
        to_continue = F.lit(to_continue)
    sys_msg = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))
    user_msg = F.array(F.struct(F.lit("user").alias("role"), user.alias("content")))
    empty = F.array().cast(MESSAGE_TYPE)
    hist = F.coalesce(history.cast(MESSAGE_TYPE), empty)
    return F.concat(sys_msg.cast(MESSAGE_TYPE), hist, F.when(to_continue, empty).otherwise(user_msg.cast(MESSAGE_TYPE)))


def translate_requests(seg_rows: DataFrame, options: Options) -> DataFrame:
    """One request row per segment.

    ``seg_rows`` holds one row per kept group with ``page_id, seg_no,
    seg_key, group_no, text, n_shreds, shreds``. The groups travel inside the
    request row, so reply keys are matched without a join (F5).
    Aggregation on ``(page_id, seg_no)`` reuses the ``page_id`` partitioning. Rows that
    are segments already (``segments.page_segments``) come with their ``groups``.
    """
    item = F.struct("seg_key", "group_no", "text", "n_shreds", "shreds")
    req = seg_rows if "groups" in seg_rows.columns else seg_rows.groupBy("page_id", "seg_no").agg(F.array_sort(F.collect_list(item)).alias("groups"))
    payload = keyed_json(
        F.transform("groups", lambda g: F.struct(g["seg_key"].alias("k"), F.regexp_replace(g["text"], "\n", "").alias("v"))),
        "k",
        "v",
    )
    src, tgt = F.lit(options.source_language), F.lit(options.target_language)
    return req.select(
        F.format_string("t-%d-%d", "page_id", "seg_no").alias("request_id"),
        "page_id",
        "seg_no",
        F.lit(options.translate_model).alias("model"),
        F.lit(options.translate_temperature).alias("temperature"),
        build_messages(translate_system_msg(src, tgt), F.lit(None), translate_user_msg(src, tgt, payload)).alias(
            "messages"
        ),
        "groups",
    )


def fit_temperature(attempt: Column, options: Options) -> Column:
    """``t0 * growth ** attempt``."""
    return F.lit(options.fit_temperature) * F.pow(F.lit(options.fit_temperature_growth), attempt)


def fit_requests(fit_rows: DataFrame, attempt: int, options: Options) -> DataFrame:
    """One fit request per multi-shred group and attempt.

    ``fit_rows``: ``page_id, group_no, n_shreds, shreds, src_text, trans_text`` and, in
    rounds, the ``best`` score so far.
    """
    a = F.lit(attempt)
    msgs = build_messages(
        F.lit(FIT_SYSTEM_MSG),
        F.lit(None),
        fit_user_msg(F.col("trans_text"), F.col("src_text"), shreds_json(F.col("shreds"))),
    )
    return fit_rows.select(
        F.format_string("f-%d-%d-%d", F.col("page_id"), F.col("group_no"), a).alias("request_id"),
        "page_id",
        "group_no",
        a.alias("attempt"),
        F.lit(options.fit_model).alias("model"),
        fit_temperature(a, options).alias("temperature"),
        msgs.alias("messages"),
        "n_shreds",
        "shreds",
        "src_text",
        "trans_text",
        *[c for c in ("best",) if c in fit_rows.columns],
    )


def chat_messages(conversations: DataFrame, system_prompt: str, user_prompt: str | None = None) -> DataFrame:
    """Ordered message list per conversation.

    History is every non-system turn in order (an existing system turn is
    replaced by the prepended one). With ``user_prompt`` a new user turn is
    added; without it the request continues the log.
    """
    hist = conversations.filter(F.col("role") != "system").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("h")
    )
    history = F.transform("h", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    to_continue = user_prompt is None
    return hist.select(
        "conv_id",
        build_messages(F.lit(system_prompt), history, F.lit(user_prompt or ""), to_continue).alias("messages"),
    )


def chat_message_rows(
    conversations: DataFrame, system_prompt: str, bucket_turns: int | None = None
) -> DataFrame:
    """D7, D8 as rows ``(conv_id, pos, role, content)``: the system prompt at 0,
    then every non-system turn in order. No list is built, and with
    ``bucket_turns`` the positions of a very long conversation are counted
    per block of turns (``tessera.operators.running``)."""
    from tessera.operators.running import running_sum

    h = conversations.filter(F.col("role") != "system").select("conv_id", "turn", "role", F.col("text").alias("content"))
    bucket = None
    if bucket_turns is not None:
        bucket = "_turn_bucket"
        h = h.withColumn(bucket, F.floor(F.col("turn") / F.lit(bucket_turns)).cast("long"))
    h = running_sum(h, "conv_id", ["turn"], F.lit(1).cast("long"), "pos", bucket)
    sys_rows = h.select("conv_id").distinct().select(
        "conv_id", F.lit(0).cast("long").alias("pos"), F.lit("system").alias("role"), F.lit(system_prompt).alias("content")
    )
    return h.select("conv_id", "pos", "role", "content").unionByName(sys_rows)


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def append_round(log: DataFrame, user_col: str, assistant_col: str) -> DataFrame:
    """A finished round adds its user and assistant turns to the log."""
    new = F.array(_turn("user", F.col(user_col)), _turn("assistant", F.col(assistant_col))).cast(MESSAGE_TYPE)
    return log.withColumn("history", F.concat(F.coalesce(F.col("history").cast(MESSAGE_TYPE), F.array().cast(MESSAGE_TYPE)), new))


def append_reply(log: DataFrame, user_col: str, assistant_col: str, first: bool) -> DataFrame:
    """D8 for a reply in parts: the first part closes a round, later ones go on
    with the assistant's turn that is the last of the history."""
    if first:
        return append_round(log, user_col, assistant_col)
    longer = F.concat(F.element_at("history", -1)["content"], F.col(assistant_col))
    kept = F.slice("history", 1, F.size("history") - 1)
    return log.withColumn("history", F.concat(kept, F.array(_turn("assistant", longer)).cast(MESSAGE_TYPE)))


def conversation_of(requests: DataFrame) -> DataFrame:
    """D7 backwards: ``messages`` as ``system, history, user`` (its last turn)."""
    m = F.col("messages").cast(MESSAGE_TYPE)
    has_system = m[0]["role"] == "system"
    turns = F.when(has_system, F.slice(m, 2, F.size(m))).otherwise(m)
    out = requests.withColumn("system", F.when(has_system, m[0]["content"]).otherwise(F.lit(""))).withColumn("_turns", turns)
    return out.withColumn("user", F.element_at("_turns", -1)["content"]).withColumn("history", F.slice("_turns", 1, F.size("_turns") - 1)).drop("_turns", "messages")


def exploded_messages(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """Messages as rows ``(*keys, pos, role, content)``."""
    return df.select(*key_cols, F.posexplode("messages").alias("pos", "m")).select(
        *key_cols, F.col("pos").cast("int").alias("pos"), F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )

