"""The model-call stage and its bookkeeping as table operations.

A *backend* is a function ``requests DataFrame -> DataFrame`` that returns
the request columns plus ``calls INT, content STRING, finish_reason STRING,
error STRING``. A backend with a method ``stage(requests, work, name)`` runs in
the work area of its caller, where it may keep tables of its own. There are

- ``python_backend(fn)``: live calls through a user function, paced, retried and
  resumed (``tessera.operators.live``);
- ``replay_backend(replies)``: a left join with stored replies (E2);
- ``shared_backend(backend, path)``: equal requests asked once, replies kept between
  runs (E2);
- ``continued_backend(backend)``: replies that stopped at the length limit are
  continued (D7, D8, E8);
- any DataFrame function (the synthetic models of tests and bench).

``call_model`` writes the replies to the shared work area before anything
reads them: a retried or re-planned downstream stage re-reads the stored
replies.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.running import last_marked, running_sum
from tessera.options import Options
from tessera.session import WorkArea

REPLY_FIELDS = [
    T.StructField("calls", T.IntegerType(), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("finish_reason", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
]
REPLY_SCHEMA = T.StructType([T.StructField("request_id", T.StringType(), False), *REPLY_FIELDS])

Backend = Callable[[DataFrame], DataFrame]


def call_model(
    requests: DataFrame, backend: Backend, work: WorkArea, name: str, keep: set[str] | None = None, by: str | None = None, schema: str | None = None
) -> DataFrame:
    """Run the backend over all request rows and store the result.

    The prompt messages are dropped before storing (they are rebuilt from
    the request columns when needed); the reply is kept with its request key.
    ``keep`` (optional) names the only columns to store, ``by`` one that is stored in folders
    (``schema``: what is read from those).
    """
    if work.resume and work.done(name):
        return work.read(name, schema)  # stored replies of an earlier attempt of this run
    out = run_backend(backend, requests, work, name)
    return work.write(out.select(*[c for c in out.columns if (c in keep if keep else c != "messages")]), name, by=by)


def run_backend(backend: Backend, requests: DataFrame, work: WorkArea, name: str) -> DataFrame:
    """The backend's replies, in the caller's work area where it has a stage."""
    return backend.stage(requests, work, name) if hasattr(backend, "stage") else backend(requests)


# --------------------------------------------------------------------------
# E2 replay
# --------------------------------------------------------------------------
def replay_backend(replies: DataFrame) -> Backend:
    """Offline form of the call: left join on ``request_id``.

    ``replies`` has ``REPLY_SCHEMA``. A request without a stored reply gets
    ``error = 'no reply'``.
    """

    def run(requests: DataFrame) -> DataFrame:
        r = replies.select("request_id", *[F.col(f.name) for f in REPLY_FIELDS])
        out = requests.join(r, "request_id", "left")
        return out.withColumn(
            "error", F.when(F.col("content").isNull() & F.col("error").isNull(), F.lit("no reply")).otherwise(F.col("error"))
        )

    return run


class Staged:
    """A backend that works in stages of others."""

    def __call__(self, requests: DataFrame) -> DataFrame:
        return self.stage(requests, WorkArea(requests.sparkSession), "calls")

    def stage(self, requests: DataFrame, work: WorkArea, name: str) -> DataFrame:
        raise NotImplementedError


def message_key(model: str = "model", temperature: str = "temperature", messages: str = "messages") -> Column:
    """SHA-256 of a request's model, temperature and messages."""
    return F.sha2(F.to_json(F.struct(F.col(model).alias("m"), F.col(temperature).alias("t"), F.col(messages).alias("c")), {"ignoreNullFields": "false"}), 256)


class shared_backend(Staged):  # noqa: N801 - reads like the other backends
    """Replies addressed by content. Requests with the same model, temperature
    and messages are asked once and their reply goes to all of them. With ``path``, complete
    replies are kept there (a table by key, appended to) and not asked for by later
    runs. Failed calls are not kept. Not used unless asked for: by default every
    request is a call of its own.
    """

    def __init__(self, backend: Backend, path: str | None = None):
        self.backend, self.path = backend, path

    def known(self, work: WorkArea) -> DataFrame:
        """key, content, finish_reason of the kept replies."""
        schema = "key string, content string, finish_reason string"
        if self.path and WorkArea.complete(work.spark, self.path):
            kept = work.spark.read.schema(schema).parquet(self.path)
            # two runs at a time may both have asked: one reply is taken
            return kept.groupBy("key").agg(F.min_by(F.struct("content", "finish_reason"), F.struct("content", "finish_reason")).alias("r")).select("key", "r.*")
        return work.spark.createDataFrame([], schema)

    def stage(self, requests: DataFrame, work: WorkArea, name: str) -> DataFrame:
        keyed = work.write(requests.withColumn("_key", message_key()), f"{name}_keyed")
        known = work.write(self.known(work), f"{name}_known")
        once = keyed.groupBy(F.col("_key").alias("request_id")).agg(F.first("model").alias("model"), F.first("messages").alias("messages"), F.first("temperature").alias("temperature"))
        new = once.join(known.select(F.col("key").alias("request_id")), "request_id", "left_anti")
        asked = call_model(new, self.backend, work, f"{name}_once", keep={"request_id", *[f.name for f in REPLY_FIELDS]})
        if self.path and not (work.resume and work.done(f"{name}_kept")):
            fresh = asked.filter("error is null").select(F.col("request_id").alias("key"), "content", "finish_reason")
            fresh.write.mode("append").parquet(self.path)
            work.write(fresh.select("key"), f"{name}_kept")
        found = asked.select(F.col("request_id").alias("_key"), *[f.name for f in REPLY_FIELDS]).unionByName(
            known.select(F.col("key").alias("_key"), F.lit(0).alias("calls"), "content", "finish_reason", F.lit(None).cast("string").alias("error")))
        return keyed.join(found, "_key", "left").drop("_key")


class continued_backend(Staged):  # noqa: N801
    """A conversation goes on until its reply is whole.

    Every round asks the requests whose reply stopped at the length limit again, with
    the turns so far as history and no user turn; the replies of all rounds are one
    reply, in order. After ``rounds`` rounds what is still cut keeps its finish reason
    ``length``. A call that fails for good ends its conversation with that error.
    """

    def __init__(self, backend: Backend, rounds: int = 16):
        self.backend, self.rounds = backend, rounds

    def stage(self, requests: DataFrame, work: WorkArea, name: str) -> DataFrame:
        from tessera.operators.requests import append_reply, build_messages, conversation_of

        requests = work.write(requests, f"{name}_first")
        talk = conversation_of(requests.select("request_id", "model", "temperature", "messages"))
        parts: list[str] = []
        for k in range(self.rounds):
            asked = talk.withColumn("messages", build_messages(F.col("system"), F.col("history"), F.col("user"), F.lit(k > 0)))
            replies = call_model(asked, self.backend, work, f"{name}_part_{k}")
            parts.append(f"{name}_part_{k}")
            cut = replies.filter(truncated() & F.col("error").isNull())
            talk = append_reply(cut, "user", "content", first=k == 0).select("request_id", "model", "temperature", "system", "history", "user")
            if k + 1 < self.rounds and talk.isEmpty():
                break
        rounds = None
        for k, part in enumerate(parts):
            one = work.read(part).select("request_id", F.lit(k).alias("seq"), F.lit("assistant").alias("role"), *[f.name for f in REPLY_FIELDS])
            rounds = one if rounds is None else rounds.unionByName(one)
        whole = assemble_chunks(rounds).select("request_id", "content", "finish_reason")
        ends = rounds.groupBy("request_id").agg(F.sum("calls").cast("int").alias("calls"), F.max_by("error", "seq").alias("error"))
        out = ends.join(whole, "request_id")
        out = out.withColumn("content", F.when(F.col("error").isNull(), F.col("content")))
        return requests.join(out, "request_id", "left")


# --------------------------------------------------------------------------
# E1, E4, E6, E7, E8 live calls
# --------------------------------------------------------------------------
class RetryableError(Exception):
    """Raised by a call function for errors that should back off (rate limit, server error)."""


def python_backend(
    fn: Callable,
    options: Options = Options(),
    sleep: Callable[[float], None] = time.sleep,
    clock: Callable[[], float] = time.time,
) -> Backend:
    """E1 + E3 + E4 + E6 + E7: live calls of ``fn(model, messages, temperature)``.

    ``fn`` returns ``(content, finish_reason)`` or an iterable of pieces; with a
    parameter ``call`` it is told the request, the attempt and the text so far. See
    ``tessera.operators.live``.
    """
    from tessera.operators.live import LiveCalls

    return LiveCalls(fn, options, sleep, clock)


def truncated(finish_reason: Column | str = "finish_reason") -> Column:
    """The reply stopped at the length limit (its text is still parsed)."""
    c = F.col(finish_reason) if isinstance(finish_reason, str) else finish_reason
    return F.coalesce(c == F.lit("length"), F.lit(False))


# --------------------------------------------------------------------------
# E3 chunk assembly
# --------------------------------------------------------------------------
def assemble_chunks(chunks: DataFrame, block: int = 1024) -> DataFrame:
    """Streamed pieces -> one reply per request.

    Content is the pieces in ``seq`` order; role is the last non-null role;
    finish reason is the one of the last piece. Two levels: pieces are first
    joined per block of ``block`` sequence numbers (spread over tasks, so a
    request with a huge number of pieces is not sorted in one task), then the
    blocks are joined per request in block order.
    """
    c = chunks.withColumn("_blk", F.floor(F.col("seq") / F.lit(block)).cast("long"))
    parts = c.groupBy("request_id", "_blk").agg(
        F.expr("listagg(coalesce(content, ''), '') WITHIN GROUP (ORDER BY seq)").alias("_part"),
        F.max_by(F.col("role"), F.when(F.col("role").isNotNull(), F.col("seq"))).alias("_role"),
        F.max(F.when(F.col("role").isNotNull(), F.col("seq"))).alias("_role_seq"),
        F.max_by("finish_reason", "seq").alias("_finish"),
        F.max("seq").alias("_last_seq"),
        F.count(F.lit(1)).alias("_n"),
    )
    return parts.groupBy("request_id").agg(
        F.expr("listagg(_part, '') WITHIN GROUP (ORDER BY _blk)").alias("content"),
        F.max_by("_role", "_role_seq").alias("role"),
        F.max_by("_finish", "_last_seq").alias("finish_reason"),
        F.sum("_n").cast("int").alias("n_chunks"),
    )


# --------------------------------------------------------------------------
# E5 rate check, E7 back-off schedule on a call log
# --------------------------------------------------------------------------
def rate_check(
    calls: DataFrame,
    key: str,
    ts: str,
    tie: str,
    limit: int,
    period_sec: float,
    bucket_sec: float | None = None,
) -> DataFrame:
    """E5: call i breaks the limit if ``ts_i - ts_{i-limit} < period``.

    Adds ``prev_ts`` (the ``limit``-th earlier call of the same key) and
    ``breaks`` (null when there is no such call).

    With ``bucket_sec`` the timeline of every key is cut into time buckets
    so that one hot key is spread over many tasks: each bucket receives the
    last ``limit`` calls before it and the lag runs per
    ``(key, bucket)``. Without it, the lag runs per key.
    """
    def secs_of(c):
        return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)

    secs = secs_of(ts)
    if bucket_sec is None:
        w = Window.partitionBy(key).orderBy(ts, tie)
        out = calls.withColumn("prev_ts", F.lag(ts, limit).over(w))
    else:
        b = calls.withColumn("_bucket", F.floor(secs / F.lit(bucket_sec)).cast("long"))
        bw = Window.partitionBy(key, "_bucket").orderBy(F.col(ts).desc(), F.col(tie).desc())
        # last `limit` calls of every non-empty bucket (bounded per bucket)
        tails = b.withColumn("_rn", F.row_number().over(bw)).filter(F.col("_rn") <= limit)
        # one row per non-empty bucket: its calls (limit at most) and those of the buckets before
        buckets = tails.groupBy(key, "_bucket").agg(F.max("_rn").alias("_n"))
        buckets = buckets.withColumn("_upto", F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket")))
        buckets = buckets.withColumn("_before", F.col("_upto") - F.col("_n"))
        near = Window.partitionBy(key).orderBy("_before").rangeBetween(1, 2 * limit)
        buckets = buckets.withColumn("_next", F.collect_list(F.struct("_bucket", "_before")).over(near))
        tails = tails.join(buckets.drop("_before", "_n"), [key, "_bucket"])
        # a call is carried into a later bucket while fewer than `limit` calls lie between: `limit` rows a bucket
        reach = F.filter("_next", lambda x: x["_before"] - F.col("_upto") + F.col("_rn") <= limit)
        carried = tails.withColumn("_to", F.explode(reach))
        carried = carried.select(
            *[F.col(c) for c in calls.columns], F.col("_to._bucket").alias("_bucket"), F.lit(True).alias("_carry")
        )
        both = b.withColumn("_carry", F.lit(False)).unionByName(carried)
        w = Window.partitionBy(key, "_bucket").orderBy(ts, tie)
        out = both.withColumn("prev_ts", F.lag(ts, limit).over(w)).filter(~F.col("_carry")).drop("_carry", "_bucket")
    # wall-clock difference for TIMESTAMP_NTZ (no session time zone involved)
    gap = F.expr(f"timestampdiff(MICROSECOND, prev_ts, `{ts}`)") / F.lit(1e6)
    return out.withColumn("gap_sec", gap).withColumn("breaks", gap < F.lit(period_sec))


def _errors_in_a_row(log: DataFrame, key: str, order: list[str], outcome: str, bucket: str | None, states: DataFrame | None) -> DataFrame:
    """Adds ``_n``: listed errors of the key since its last success, up to this row,
    those before the log (``states``) included, and ``_grown``: the sum of the logarithms
    of their factors without the last one's (``_factor``)."""
    listed = F.col(outcome) == "listed"
    d = running_sum(log, key, order, listed.cast("long"), "_cum", bucket)
    d = running_sum(d, key, order, F.when(listed, F.ln("_factor")).otherwise(0.0), "_sum", bucket)
    d = d.withColumn("_both", F.struct("_cum", "_sum"))
    d = last_marked(d, key, order, F.col(outcome) == "ok", "_both", "_at_ok", bucket)
    if states is None:
        before, grown = F.lit(0), F.lit(0.0)
    else:
        d = d.join(states.select(key, F.col("errors").alias("_errors"), F.col("grown").alias("_before")), key, "left")
        before, grown = F.coalesce("_errors", F.lit(0)), F.coalesce("_before", F.lit(0.0))
    since = F.col("_at_ok").isNotNull()
    d = d.withColumn("_n", F.when(since, F.col("_cum") - F.col("_at_ok._cum")).otherwise(F.col("_cum") + before))
    d = d.withColumn("_after", F.when(since, F.col("_sum") - F.col("_at_ok._sum")).otherwise(F.col("_sum") + grown))
    return d.drop("_cum", "_sum", "_both", "_at_ok", "_errors", "_before")


def _delay(outcome: str, options: Options) -> Column:
    grown = F.col("_after") - F.when(F.col(outcome) == "listed", F.ln("_factor")).otherwise(0.0)
    listed = F.least(F.lit(options.backoff_cap_sec), F.lit(options.backoff_init_delay) * F.exp(grown))
    return F.when(F.col(outcome) == "ok", F.lit(None).cast("double")).when(F.col(outcome) == "listed", listed).otherwise(F.lit(options.backoff_init_delay))


def backoff_states(
    log: DataFrame, key: str, ts: str, tie: str, options: Options = Options(), states: DataFrame | None = None, bucket_sec: float = 30.0, outcome: str = "outcome",
) -> tuple[DataFrame, DataFrame]:
    """E7 carried from one part of a call log to the next.

    ``log``: the calls of one round (``ts`` in seconds); ``states``: ``(key, errors,
    grown)`` after the rounds before it. Returns the log with ``delay_sec`` and the states
    after it. The delay of a listed error is ``init`` times one factor ``base ± 1`` for every
    listed error of the key since its last success but the last, capped; the factor's
    jitter is drawn from the row's ``tie`` and attempt. Other errors wait ``init``.
    """
    jitter = F.pmod(F.xxhash64(F.lit("jitter"), tie, "attempt"), F.lit(1 << 30)) / F.lit(float(1 << 29)) - 1
    log = log.withColumn("_factor", F.lit(options.backoff_exp_base) + F.lit(options.backoff_jitter) * jitter)
    log = log.withColumn("_bucket", F.floor(F.col(ts) / bucket_sec).cast("long"))
    d = _errors_in_a_row(log, key, [ts, tie], outcome, "_bucket", states).withColumn("delay_sec", _delay(outcome, options))
    last = d.groupBy(key).agg(F.max_by(F.struct(F.col("_n").alias("errors"), F.col("_after").alias("grown")), F.struct(ts, tie)).alias("s")).select(key, "s.*")
    if states is not None:
        last = last.unionByName(states.join(last.select(key), key, "left_anti"))
    return d.drop("_factor", "_bucket", "_n", "_after"), last


def backoff_schedule(
    log: DataFrame,
    key: str,
    ts: str,
    tie: str,
    outcome: str,
    options: Options = Options(),
    bucket_sec: float | None = None,
) -> DataFrame:
    """E7 on a call log: the delay that follows each failed call.

    ``outcome`` is ``'ok'``, ``'listed'`` (an error that backs off) or any
    other error. The delay is shared per key and reset by a success: after
    the n-th listed error since the last success it is
    ``min(cap, init * base ** (n - 1))``; other errors wait ``init``.
    Successes get a null delay. (No jitter here, so it can be checked.)

    ``n`` = listed errors so far minus listed errors at the last success.
    With ``bucket_sec`` both running values are computed per time bucket
    (``tessera.operators.running``), so a hot key is spread over tasks.
    """
    order = [ts, tie]
    bucket = None
    if bucket_sec is not None:
        bucket = "_bo_bucket"
        log = log.withColumn(
            bucket, F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(bucket_sec * 1e6)).cast("long")
        )
    d = running_sum(log, key, order, (F.col(outcome) == "listed").cast("long"), "_cum", bucket)
    d = last_marked(d, key, order, F.col(outcome) == "ok", "_cum", "_at_ok", bucket)
    if bucket is not None:
        d = d.drop(bucket)
    n = F.col("_cum") - F.coalesce(F.col("_at_ok"), F.lit(0))
    delay = F.least(
        F.lit(options.backoff_cap_sec),
        F.lit(options.backoff_init_delay) * F.pow(F.lit(options.backoff_exp_base), n - 1),
    )
    d = d.withColumn(
        "delay_sec",
        F.when(F.col(outcome) == "ok", F.lit(None).cast("double"))
        .when(F.col(outcome) == "listed", delay)
        .otherwise(F.lit(options.backoff_init_delay)),
    )
    return d.drop("_cum", "_at_ok")
