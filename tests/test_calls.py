"""Call stage with a fake function, chunk assembly, rate check, back-off."""

from pyspark.sql import functions as F

from tessera.operators.calls import (
    RetryableError, assemble_chunks, backoff_schedule, backoff_states, call_model, continued_backend, python_backend, rate_check, shared_backend,
)
from tessera.operators.live import Gate, LaneStore, ask_lane, call_log
from tessera.options import Options
from tessera.plans import synthetic as syn
from tessera.session import WorkArea


def _requests(spark, n):
    rows = [(f"r-{i}", "m", [("system", "s"), ("user", f"u{i}")], 0.01) for i in range(n)]
    return spark.createDataFrame(rows, "request_id string, model string, messages array<struct<role:string,content:string>>, temperature double")


def test_python_backend_retries_and_errors(spark):
    def fn(model, messages, temperature):
        u = messages[-1]["content"]
        i = int(u[1:])
        if i % 3 == 1:
            raise RetryableError("busy")
        if i % 3 == 2:
            raise ValueError("bad")
        return "ok " + u, "stop"

    opts = Options(call_max_retry=2, rate_period_sec=0.0, backoff_init_delay=0.0, call_partitions=2)
    out = {r.request_id: r for r in python_backend(fn, opts, sleep=lambda s: None)(_requests(spark, 9)).collect()}
    assert out["r-0"].content == "ok u0" and out["r-0"].calls == 1 and out["r-0"].error is None
    assert out["r-1"].calls == 3 and out["r-1"].error.startswith("gave up after 3 calls")
    assert out["r-2"].calls == 3 and out["r-2"].content is None


class Clock:
    """A clock that sleeping moves on."""

    def __init__(self, now=1000.0):
        self.now, self.slept = now, []

    def __call__(self):
        return self.now

    def sleep(self, sec):
        self.slept.append(sec)
        self.now += sec


def _gate(clock, lane=0, lanes=1, step=1.0, tolerance=0.1, start=1000.0):
    return Gate(start, step, lanes, lane, tolerance, clock.sleep, clock)


def test_lanes_own_their_slots():
    """Each lane opens at its own slots only, and takes the next one when late."""
    a, b = Clock(), Clock(1005.3)
    first, late = _gate(a, 0, 2), _gate(b, 1, 2)
    assert [first.wait()[0] for _ in range(3)] == [0, 2, 4]
    assert [late.wait() for _ in range(2)] == [(7, 1007.0), (9, 1009.0)]
    assert first.wait(due=1010.5) == (12, 1012.0)
    # a sleep that takes too long costs the slot, not the limit
    c = Clock()
    slow = _gate(c)
    c.sleep = lambda sec: setattr(c, "now", c.now + sec + (0.5 if c.now < 1002 else 0))
    slow.sleep = c.sleep
    assert slow.wait()[0] == 0 and slow.wait()[0] == 3
    assert _gate(Clock(), step=0.0).wait() == (0, 1000.0)


def _rows(n, **more):
    return [{"request_id": f"r{i}", "model": "m", "messages": [{"role": "user", "content": str(i)}], "temperature": 0.0, "attempt": 0, "due": 0.0, "seq": 0, "text": None, **more} for i in range(n)]


def _lane(rows, fn, folder, in_flight=1, clock=None, store_sec=1e9):
    clock = clock or Clock()
    return [r for reply in ask_lane(iter(rows), fn, _gate(clock, step=0.0), LaneStore(folder, store_sec, clock), in_flight) for r in reply]


def test_the_set_in_flight_slides(tmpdir_path):
    """One slow call holds up one place, not the calls after it."""
    import threading
    import time

    done, release = [], threading.Event()

    def fn(model, messages, temperature):
        if messages[0]["content"] == "0":
            release.wait(10)
        else:
            time.sleep(0.01)
        done.append(int(messages[0]["content"]))
        if len(done) == 30:
            release.set()
        return "ok", "stop"

    out = _lane(_rows(31), fn, tmpdir_path, in_flight=3)
    assert done[-1] == 0 and sum(r["kind"] == "call" for r in out) == 31


def test_failed_calls_leave_the_task(tmpdir_path):
    """No task sleeps for an error: a failed call is a row."""
    clock = Clock()

    def fn(model, messages, temperature):
        if messages[0]["content"] == "1":
            raise RetryableError("busy")
        if messages[0]["content"] == "2":
            raise ValueError("bad")
        return "ok", "stop"

    out = [r for r in _lane(_rows(4), fn, tmpdir_path, clock=clock) if r["kind"] == "call"]
    assert [(r["request_id"], r["outcome"]) for r in out] == [("r0", "ok"), ("r1", "listed"), ("r2", "other"), ("r3", "ok")]
    assert clock.slept == []


def test_a_lost_lane_repeats_no_complete_reply(tmpdir_path):
    """The task dies in the middle of a stream; its next attempt asks only what is
    not whole, and goes on after the last stored piece."""
    asked, dead = [], []

    def fn(model, messages, temperature, call):
        asked.append((messages[0]["content"], messages[-1]["content"] if len(messages) > 1 else ""))
        start = len(messages[-1]["content"]) if len(messages) > 1 else 0
        for k in range(start, 5):
            if messages[0]["content"] == "2" and k == 3 and not dead:
                dead.append(1)
                raise KeyboardInterrupt("the task is lost")
            yield str(k), "stop" if k == 4 else None

    import pytest

    with pytest.raises(KeyboardInterrupt):
        _lane(_rows(4), fn, tmpdir_path)
    out = _lane(_rows(4), fn, tmpdir_path)
    assert asked == [("0", ""), ("1", ""), ("2", ""), ("2", "012"), ("3", "")]
    for i in range(4):
        pieces = [r for r in out if r["request_id"] == f"r{i}" and r["kind"] == "piece"]
        assert [r["seq"] for r in pieces] == list(range(5)) and "".join(r["content"] for r in pieces) == "01234"
    assert sorted(r["request_id"] for r in out if r["kind"] == "call") == ["r0", "r1", "r2", "r3"]


def test_openings_keep_the_limit_with_fewer_cores_than_lanes(spark):
    """Ten lanes on four cores, failed calls and two stages: over all openings none is
    within the period of the one ``limit`` before it."""
    limit, period = 6, 0.3
    opts = Options(rate_limit=limit, rate_period_sec=period, call_partitions=10, call_waves=2, backoff_init_delay=0.05, backoff_jitter=0.0, retry_gather_sec=0.5)

    def fn(model, messages, temperature, call):
        if call.attempt == 0 and int(messages[-1]["content"][1:]) % 3 == 0:
            raise RetryableError("busy")
        return "ok", "stop"

    work, backend = WorkArea(spark), python_backend(fn, opts)
    for name in ("one", "two"):
        out = call_model(_requests(spark, 40), backend, work, name)
        assert out.filter("content = 'ok'").count() == 40
    log = call_log(work, "one").unionByName(call_log(work, "two"))
    assert log.count() == 2 * (40 + 14)
    log = log.withColumn("opened_at", F.col("opened_at").cast("timestamp_ntz")).withColumn("all", F.lit(1))
    assert rate_check(log, "all", "opened_at", "request_id", limit, period).filter("breaks").count() == 0
    # and a failed call isn't asked before it is due
    calls = {}
    for r in log.filter("model = 'm'").orderBy("opened_at").collect():
        calls.setdefault(r.request_id, []).append(r)
    assert all((b.opened_at - a.opened_at).total_seconds() >= 0.05 for v in calls.values() for a, b in zip(v, v[1:]))


def test_backoff_states_go_on_from_round_to_round(spark):
    """The state carried over three parts of a log gives the delays of the whole log."""
    import random

    rng = random.Random(4)
    rows = [(f"r{i}", rng.choice("ab"), 0, 1000.0 + i * rng.choice([1.0, 7.0]), rng.choice(["ok", "listed", "listed", "other"])) for i in range(120)]
    rows.sort(key=lambda r: (r[3], r[0]))
    schema = "request_id string, model string, attempt int, closed_at double, outcome string"
    opts = Options(backoff_init_delay=0.5, backoff_cap_sec=20.0)
    whole = {r.request_id: r.delay_sec for r in backoff_states(spark.createDataFrame(rows, schema), "model", "closed_at", "request_id", opts)[0].collect()}
    got, states = {}, None
    for i in range(0, 120, 40):
        log, states = backoff_states(spark.createDataFrame(rows[i : i + 40], schema), "model", "closed_at", "request_id", opts, states)
        got |= {r.request_id: r.delay_sec for r in log.collect()}
        states = spark.createDataFrame(states.collect(), states.schema)
    assert got.keys() == whole.keys()
    delay = {}
    for rid, model, _, _, outcome in rows:
        if outcome == "ok":
            delay[model] = None
            assert got[rid] is None and whole[rid] is None
            continue
        assert abs(got[rid] - whole[rid]) < 1e-9
        if outcome == "other":
            assert got[rid] == 0.5
            continue
        before = delay.get(model)
        # each listed error in a row waits 1 to 3 times as long as the one before, up to the cap
        assert abs(got[rid] - 0.5) < 1e-9 if before is None else min(20.0, before) - 1e-9 <= got[rid] <= min(20.0, 3 * before) + 1e-9
        delay[model] = got[rid]


def test_equal_requests_are_asked_once_and_kept(spark, tmpdir_path):
    asked = []
    rows = [(f"r-{i}", "m", [("user", f"u{i % 3}")], 0.01 if i < 9 else 0.5) for i in range(12)]
    reqs = spark.createDataFrame(rows, "request_id string, model string, messages array<struct<role:string,content:string>>, temperature double")

    def fn(model, messages, temperature):
        if messages[-1]["content"] == "u2":
            raise ValueError("bad")
        return f"{messages[-1]['content']} at {temperature}", "stop"

    opts = Options(rate_period_sec=0.0, call_max_retry=0, backoff_init_delay=0.0, call_waves=1)
    for run in range(2):
        work = WorkArea(spark)
        backend = shared_backend(python_backend(fn, opts), f"{tmpdir_path}/kept")
        out = {r.request_id: r for r in call_model(reqs, backend, work, "c").collect()}
        for i in range(12):
            r = out[f"r-{i}"]
            if i % 3 == 2:
                assert r.content is None and r.error.startswith("gave up after 1 calls")
            else:
                assert r.content == f"u{i % 3} at {0.01 if i < 9 else 0.5}" and r.error is None and r.calls == (0 if run else 1)
        asked.append(call_log(work, "c_once").count())
    assert asked == [6, 2]  # the failed ones are asked again


def test_continued_replies(spark):
    """Parts are joined until the reply stops, the bound is met or a call fails."""
    def fn(model, messages, temperature):
        n = int(next(m["content"] for m in messages if m["role"] == "user")[1:])
        done = messages[-1]["content"] if messages[-1]["role"] == "assistant" else ""
        assert [m["role"] for m in messages] == ["system", "user"] + ["assistant"] * bool(done)
        if n == 7 and len(done) == 2:
            raise ValueError("bad")
        return "x", "stop" if len(done) + 1 == n else "length"

    opts = Options(rate_period_sec=0.0, call_max_retry=1, backoff_init_delay=0.0, call_waves=1)
    reqs = _requests(spark, 10).filter("request_id <> 'r-0'")
    out = {r.request_id: r for r in continued_backend(python_backend(fn, opts), rounds=6)(reqs).collect()}
    for n in range(1, 10):
        r = out[f"r-{n}"]
        if n == 7:
            assert r.content is None and r.error.startswith("gave up after 2 calls") and r.calls == 4
        else:
            assert r.content == "x" * min(n, 6) and r.calls == min(n, 6) and r.finish_reason == ("stop" if n <= 6 else "length")


def test_a_broken_call_stage_does_not_repeat_whole_waves(spark, tmpdir_path):
    """The third wave dies on its first try; the resumed run asks nothing again
    that the waves before have answered."""
    import os
    import uuid

    import pytest

    from tessera.operators.calls import call_model
    from tessera.session import WorkArea

    log, poison = os.path.join(tmpdir_path, "log"), os.path.join(tmpdir_path, "poison")
    os.makedirs(log)
    opts = Options(rate_period_sec=0.0, call_partitions=2, call_waves=4, call_max_retry=0)
    requests = _requests(spark, 40)
    wave = {r.request_id: r.w for r in requests.select("request_id", F.pmod(F.xxhash64("request_id"), F.lit(4)).alias("w")).collect()}
    victim = "u" + min(r for r, w in wave.items() if w == 2)[2:]

    def fn(model, messages, temperature):
        u = messages[-1]["content"]
        open(os.path.join(log, f"{u}-{uuid.uuid4().hex}"), "w").close()
        if u == victim and not os.path.exists(poison):
            open(poison, "w").close()
            raise KeyboardInterrupt("the task is lost")
        return "ok", "stop"

    run = f"waves-{uuid.uuid4().hex}"
    with pytest.raises(Exception):
        call_model(requests, python_backend(fn, opts), WorkArea(spark, run), "calls")
    out = call_model(requests, python_backend(fn, opts), WorkArea(spark, run, resume=True), "calls")
    assert out.count() == 40 and out.filter("error is null").count() == 40
    asked = {}
    for n in os.listdir(log):
        u = n.split("-")[0]
        asked[u] = asked.get(u, 0) + 1
    assert all(asked[f"u{r[2:]}"] == 1 for r, w in wave.items() if w != 2)
    assert len(asked) == 40


def test_rate_check_carries_few_rows(spark):
    """One key, many buckets, a large limit: rows carried stay near limit a bucket."""
    calls = spark.range(4000).selectExpr("id as event_id", "1L as user_id", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) as ts")
    plain = rate_check(calls, "user_id", "ts", "event_id", 50, 60.0)
    split = rate_check(calls, "user_id", "ts", "event_id", 50, 60.0, bucket_sec=20.0)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.select(plain.columns).collect()))


def test_chunk_assembly_restores_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = {r.request_id: r for r in assemble_chunks(syn.reply_chunks(docs)).collect()}
    for d in docs.collect():
        r = a[f"d-{d.doc_id}"]
        assert r.content == d.text and r.role == "assistant" and r.finish_reason == "stop"


def test_rate_check_bucketed_equals_plain(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("event_id", "user_id", "ts")
    plain = {r.event_id: (r.gap_sec, r.breaks) for r in rate_check(ev, "user_id", "ts", "event_id", 3, 86400.0).collect()}
    for b in (3600.0, 86400.0, 7 * 86400.0):
        got = {r.event_id: (r.gap_sec, r.breaks) for r in rate_check(ev, "user_id", "ts", "event_id", 3, 86400.0, bucket_sec=b).collect()}
        assert got == plain
    assert sum(1 for g, br in plain.values() if br) == 3815
    assert sum(1 for g, br in plain.values() if g is not None) == 9550


def test_backoff_schedule(spark):
    rows = [(1, i, o) for i, o in enumerate(["listed", "listed", "other", "listed", "ok", "listed"] + ["listed"] * 10)]
    df = spark.createDataFrame(rows, "k long, id long, outcome string").withColumn("ts", F.col("id").cast("timestamp"))
    got = [r.delay_sec for r in backoff_schedule(df, "k", "ts", "id", "outcome").orderBy("id").collect()]
    assert got[:6] == [1.0, 2.0, 1.0, 4.0, None, 1.0]
    assert got[-1] == 300.0


def test_backoff_bucketed_equals_plain(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select(
        "event_id", "user_id", "ts",
        F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "listed").otherwise("other").alias("outcome"),
    )
    plain = {r.event_id: r.delay_sec for r in backoff_schedule(ev, "user_id", "ts", "event_id", "outcome").collect()}
    for b in (3600.0, 86400.0):
        got = {r.event_id: r.delay_sec for r in backoff_schedule(ev, "user_id", "ts", "event_id", "outcome", bucket_sec=b).collect()}
        assert got == plain


def test_chat_rows_bucketed_equals_plain(spark):
    from tessera.operators.requests import chat_message_rows

    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    plain = sorted(tuple(r) for r in chat_message_rows(conv, "sys").collect())
    for b in (1, 2, 3):
        assert sorted(tuple(r) for r in chat_message_rows(conv, "sys", bucket_turns=b).collect()) == plain


def test_replay_missing_reply(spark):
    from tessera.operators.calls import replay_backend

    reqs = _requests(spark, 3)
    stored = spark.createDataFrame([("r-0", 1, "hi", "stop", None)], "request_id string, calls int, content string, finish_reason string, error string")
    out = {r.request_id: r for r in replay_backend(stored)(reqs).collect()}
    assert out["r-0"].content == "hi" and out["r-0"].error is None
    assert out["r-1"].content is None and out["r-1"].error == "no reply"


def test_chunk_assembly_blocks(spark):
    rows = [("q", i, "assistant" if i == 0 else None, chr(97 + i % 26), "stop" if i == 99 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "request_id string, seq int, role string, content string, finish_reason string")
    for b in (1, 7, 1024):
        r = assemble_chunks(df, block=b).first()
        assert r.content == "".join(chr(97 + i % 26) for i in range(100))
        assert (r.role, r.finish_reason, r.n_chunks) == ("assistant", "stop", 100)


def test_chat_messages_and_rounds(spark):
    from tessera.operators.requests import append_round, chat_messages, exploded_messages

    conv = spark.createDataFrame(
        [(1, 0, "system", "old"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo")],
        "conv_id long, turn long, role string, text string",
    )
    cont = exploded_messages(chat_messages(conv, "sys"), ["conv_id"]).orderBy("pos").collect()
    assert [(r.role, r.content) for r in cont] == [("system", "sys"), ("user", "hi"), ("assistant", "yo")]
    new = exploded_messages(chat_messages(conv, "sys", "next?"), ["conv_id"]).orderBy("pos").collect()
    assert [r.role for r in new] == ["system", "user", "assistant", "user"] and new[-1].content == "next?"
    log = spark.createDataFrame([(1, "q", "a")], "id long, u string, a string").withColumn("history", F.lit(None))
    h = append_round(append_round(log, "u", "a"), "u", "a").first().history
    assert [m.role for m in h] == ["user", "assistant", "user", "assistant"]
