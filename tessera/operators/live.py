"""Live model calls in paced, resumable rounds.

A stage of live calls is a loop of *rounds* over stored tables. A round asks what
is due and stores what came of it; no task sleeps for a failed call.

- **Slots (E4).** Calls may only be opened at slots, ``(period + tolerance) / limit``
  apart on one clock. The requests of a round are dealt to lanes, one task each;
  lane ``l`` of ``P`` owns the slots ``l, l + P, l + 2P, ...``. A call opens within the
  tolerance after its slot; one that comes too late takes its lane's next free slot.
  So all openings together keep the limit, whatever the number of cores, whichever
  lane starts late. A round's first slot comes after the last opening of the round
  before it. Clocks of the machines have to agree within the tolerance.
- **Pieces (E1, E3).** A call function may return ``(content, finish_reason)`` or an
  iterable of pieces. Pieces are rows ``(request_id, seq)``; ``assemble_chunks``
  joins them to replies. A stream that breaks keeps its pieces, and the next attempt
  goes on after them: the text so far is sent as the assistant's turn, with no user
  turn after it (D7, continue).
- **Lost tasks.** A lane puts what it has into a file of the work area every
  ``store_sec`` seconds, sooner when it holds much text. A repeated task reads these files: complete replies are not
  asked again, broken ones go on. (Only one attempt of a task may run: leave
  ``spark.speculation`` off.)
- **Retries (E6, E7).** A failed call is a row of the call log. After the round, the
  back-off state per key - errors since the last success - is brought forward over the
  round's log and stored; a failed request becomes due after its delay. The driver
  waits for the first due time and opens the next round.

The sets in flight slide: as soon as one of ``calls_in_flight`` calls ends, the next
request is taken.
"""

from __future__ import annotations

import inspect
import json
import math
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.calls import RetryableError, assemble_chunks, backoff_states
from tessera.options import Options
from tessera.session import WorkArea
from tessera.sources.files import list_names, read_bytes, write_bytes

RECORD = pa.schema([
    ("kind", pa.string()),  # "piece" or "call"
    ("request_id", pa.string()), ("attempt", pa.int32()), ("seq", pa.int32()),
    ("role", pa.string()), ("content", pa.string()), ("finish_reason", pa.string()),
    ("model", pa.string()), ("slot", pa.int64()), ("opened_at", pa.float64()), ("closed_at", pa.float64()),
    ("outcome", pa.string()), ("error", pa.string()),
])
RECORD_DDL = (
    "kind string, request_id string, attempt int, seq int, role string, content string, finish_reason string, "
    "model string, slot long, opened_at double, closed_at double, outcome string, error string"
)

#: Requests of a lane taken as Python objects at a time, and records given on at a time.
TAKE_ROWS, GIVE_RECORDS = 64, 512
#: About so many characters a lane holds before it stores or gives them on.
STORE_CHARS, GIVE_CHARS = 1 << 22, 1 << 20


@dataclass
class Call:
    """What a call function may ask to be told (parameter ``call``)."""

    request_id: str
    attempt: int
    text: str = ""  # what earlier attempts have received


@dataclass
class Gate:
    """The slots of one lane."""

    start: float
    step: float
    lanes: int
    lane: int
    tolerance: float
    sleep: Callable[[float], None]
    clock: Callable[[], float]
    taken: int = -1
    lock: threading.Lock = field(default_factory=threading.Lock)

    def wait(self, due: float = 0.0) -> tuple[int, float]:
        """Wait for the lane's next free slot: its number and the time of opening."""
        while True:
            now = self.clock()
            if due > now:
                self.sleep(due - now)
                continue
            if self.step <= 0:
                return 0, now
            with self.lock:
                turn = math.ceil((now - self.start) / (self.step * self.lanes) - self.lane / self.lanes)
                self.taken = max(self.taken + 1, turn, 0)
                slot = self.taken * self.lanes + self.lane
            at = self.start + slot * self.step
            while (now := self.clock()) < at:
                self.sleep(at - now)
            if now <= at + self.tolerance:
                return slot, now


class LaneStore:
    """What a lane has received, kept in files for a repeated task."""

    def __init__(self, folder: str, store_sec: float, clock: Callable[[], float]):
        self.folder, self.store_sec, self.clock = folder, store_sec, clock
        self.new: list[dict] = []
        self.lock, self.last, self.size = threading.Lock(), clock(), 0

    def load(self) -> list[dict]:
        lines = [x for name in list_names(self.folder) if name.endswith(".jsonl") for x in read_bytes(f"{self.folder}/{name}").decode().splitlines()]
        return [json.loads(x) for x in lines]

    def add(self, record: dict) -> None:
        with self.lock:
            self.new.append(record)
            self.size += len(record["content"] or "") + 200
            if self.size >= STORE_CHARS or self.clock() - self.last >= self.store_sec:
                self._put()

    def flush(self) -> None:
        with self.lock:
            self._put()

    def _put(self) -> None:
        if self.new:
            write_bytes(f"{self.folder}/{uuid.uuid4().hex}.jsonl", "\n".join(json.dumps(r) for r in self.new).encode())
            self.new, self.size = [], 0
        self.last = self.clock()


def _pieces(reply):
    """(role, content, finish_reason) of a reply: a pair, or an iterable of pairs,
    triples or mappings."""
    if isinstance(reply, tuple) and len(reply) == 2 and (reply[0] is None or isinstance(reply[0], str)):
        yield "assistant", reply[0], reply[1]
        return
    for piece in reply:
        if isinstance(piece, dict):
            yield piece.get("role"), piece.get("content"), piece.get("finish_reason")
        else:
            yield (None, *piece) if len(piece) == 2 else tuple(piece)


def _record(**values) -> dict:
    return {name: values.get(name) for name in RECORD.names}


def ask_lane(rows: Iterator[dict], fn, gate: Gate, store: LaneStore, in_flight: int) -> Iterator[list[dict]]:
    """All requests of one lane: yields the records of one reply after the other."""
    told = "call" in inspect.signature(fn).parameters
    held: dict[str, list[dict]] = {}
    for r in store.load():
        held.setdefault(r["request_id"], []).append(r)

    def ask(row: dict) -> list[dict]:
        rid, attempt, out = row["request_id"], row["attempt"], []
        before = sorted((r for r in held.get(rid, []) if r["kind"] == "piece"), key=lambda r: r["seq"])
        ended = [r for r in held.get(rid, []) if r["kind"] == "call"]
        if ended:
            return before + ended[:1]
        out += before
        seq = before[-1]["seq"] + 1 if before else row["seq"]
        text = (row["text"] or "") + "".join(r["content"] or "" for r in before)
        messages = [{"role": m["role"], "content": m["content"]} for m in row["messages"]]
        if text:
            messages.append({"role": "assistant", "content": text})
        slot, opened = gate.wait(row["due"])
        outcome, error = "ok", None
        try:
            reply = fn(row["model"], messages, float(row["temperature"]), **({"call": Call(rid, attempt, text)} if told else {}))
            for role, content, finish in _pieces(reply):
                piece = _record(kind="piece", request_id=rid, attempt=attempt, seq=seq, role=role, content=content, finish_reason=finish)
                out.append(piece)
                store.add(piece)
                seq += 1
        except Exception as e:  # noqa: BLE001 - every failure is a row result
            outcome, error = ("listed" if isinstance(e, RetryableError) else "other"), str(e)
        ended = _record(kind="call", request_id=rid, attempt=attempt, seq=seq, model=row["model"], slot=slot, opened_at=opened, closed_at=gate.clock(), outcome=outcome, error=error)
        store.add(ended)
        return [*out, ended]

    with ThreadPoolExecutor(max(1, in_flight)) as pool:
        running: set = set()
        try:
            for row in rows:
                while len(running) >= max(1, in_flight):
                    done, running = wait(running, return_when=FIRST_COMPLETED)
                    for f in done:
                        yield f.result()
                running.add(pool.submit(ask, row))
            while running:
                done, running = wait(running, return_when=FIRST_COMPLETED)
                for f in done:
                    yield f.result()
        except BaseException:
            store.flush()
            raise


class LiveCalls:
    """A backend that calls ``fn(model, messages, temperature[, call])``.

    ``stage`` runs all rounds in a work area; the tables of a resumable area are used
    again. Called directly, it takes an area of its own.
    """

    def __init__(self, fn, options: Options = Options(), sleep=time.sleep, clock=time.time):
        self.fn, self.options, self.sleep, self.clock = fn, options, sleep, clock
        self.free_at = 0.0  # the first time at which a new round may open calls

    def __call__(self, requests: DataFrame) -> DataFrame:
        return self.stage(requests, WorkArea(requests.sparkSession), "calls")

    @property
    def tolerance(self) -> float:
        return 0.02 * self.options.rate_period_sec

    @property
    def step(self) -> float:
        return (self.options.rate_period_sec + self.tolerance) / max(1, self.options.rate_limit)

    def stage(self, requests: DataFrame, work: WorkArea, name: str) -> DataFrame:
        """The requests with ``calls, content, finish_reason, error``. The log and the
        pieces stay in the area: ``call_log``, ``reply_pieces``."""
        o = self.options
        requests = work.write(requests, f"{name}_requests")
        asks = requests.select("request_id", "model", "messages", "temperature").dropDuplicates(["request_id"])
        due = asks.select("request_id", F.lit(0).alias("attempt"), F.lit(0.0).alias("due"), F.lit(0).alias("seq"))
        waiting, states, written, k = None, None, [], 0
        while due is not None:
            waves = max(1, o.call_waves) if k == 0 else 1
            rounds = []
            for w in range(waves):
                part = due.filter(F.pmod(F.xxhash64("request_id"), F.lit(waves)) == w) if waves > 1 else due
                rounds.append(self._round(part, asks, written, work, f"{name}_round_{k}_{w}"))
            written += rounds
            calls = work.spark.read.parquet(*map(work.path, rounds)).filter("kind = 'call'")
            failed, last = calls.agg(F.count_if(self._again()), F.max("opened_at")).first()
            self.free_at = max(self.free_at, (last or 0.0) + self.step)
            if failed or waiting is not None:
                waiting, states = self._after(calls, states, waiting, work, f"{name}_{k}")
                first = waiting.agg(F.min("due")).first()[0]
                due = None
                if first is not None:
                    if first > self.clock():
                        self.sleep(first - self.clock())
                    due = work.write(waiting.filter(F.col("due") <= max(first, self.clock()) + o.retry_gather_sec), f"{name}_{k}_due")
                    waiting = waiting.join(due.select("request_id"), "request_id", "left_anti")
            else:
                due = None
            k += 1
        return requests.join(self._replies(work, written), "request_id", "left")

    def _again(self):
        return (F.col("outcome") != "ok") & (F.col("attempt") < self.options.call_max_retry)

    def _round(self, due: DataFrame, asks: DataFrame, written: list[str], work: WorkArea, name: str) -> str:
        """Ask what is due and store the records."""
        if work.resume and work.done(name):
            return name
        o, fn, sleep, clock = self.options, self.fn, self.sleep, self.clock
        lanes = int(o.call_partitions or work.spark.sparkContext.defaultParallelism)
        start, step = max(clock(), self.free_at), self.step if o.rate_period_sec > 0 else 0.0
        tolerance = 0.9 * self.tolerance  # the rest is for rounding of stored times
        folder, store_sec, in_flight = work.path(f"{name}_lanes"), o.store_sec, o.calls_in_flight
        rows = due.join(asks, "request_id")
        if written:
            pieces = self._read(work, written, "piece").join(due.select("request_id"), "request_id", "left_semi")
            texts = assemble_chunks(pieces).select("request_id", F.col("content").alias("text"))
            rows = rows.join(texts, "request_id", "left")
        else:
            rows = rows.withColumn("text", F.lit(None).cast("string"))
        # the n-th row of lane l has the slot l + n P, or a later one of its lane
        rows = rows.withColumn("lane", F.pmod(F.xxhash64("request_id"), F.lit(lanes)).cast("int")).repartitionById(lanes, F.col("lane"))
        rows = rows.sortWithinPartitions("due", "request_id").select("request_id", "model", "messages", "temperature", "attempt", "due", "seq", "text", "lane")

        def ask(batches):
            each = (row for b in batches for k in range(0, b.num_rows, TAKE_ROWS) for row in b.slice(k, TAKE_ROWS).to_pylist())
            head = next(each, None)
            if head is None:
                return
            gate = Gate(start, step, lanes, head["lane"], tolerance, sleep, clock)
            store = LaneStore(f"{folder}/{head['lane']}", store_sec, clock)

            def rows():
                yield head
                yield from each

            out, size = [], 0
            for records in ask_lane(rows(), fn, gate, store, in_flight):
                out += records
                size += sum(len(r["content"] or "") for r in records)
                if len(out) >= GIVE_RECORDS or size >= GIVE_CHARS:
                    yield pa.RecordBatch.from_pylist(out, RECORD)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, RECORD)

        work.write(rows.mapInArrow(ask, RECORD_DDL), name)
        return name

    def _after(self, calls, states, waiting, work, name):
        """What waits after a round, and the back-off state of every key."""
        log, states = backoff_states(calls, self.options.backoff_key, "closed_at", "request_id", self.options, states)
        states = work.write(states, f"{name}_states")
        failed = log.filter(self._again()).select("request_id", (F.col("attempt") + 1).alias("attempt"), (F.col("closed_at") + F.col("delay_sec")).alias("due"), "seq")
        return work.write(failed if waiting is None else waiting.unionByName(failed), f"{name}_waiting"), states

    @staticmethod
    def _read(work: WorkArea, written: list[str], kind: str) -> DataFrame:
        return work.spark.read.parquet(*map(work.path, written)).filter(F.col("kind") == kind)

    def _replies(self, work: WorkArea, written: list[str]) -> DataFrame:
        """request_id, calls, content, finish_reason, error of every request."""
        if not written:
            return work.spark.createDataFrame([], "request_id string, calls int, content string, finish_reason string, error string")
        last = self._read(work, written, "call").groupBy("request_id").agg(
            (F.max("attempt") + 1).alias("calls"), F.max_by(F.struct("outcome", "error"), "attempt").alias("end"))
        whole = assemble_chunks(self._read(work, written, "piece")).select("request_id", "content", "finish_reason")
        ok = F.col("end.outcome") == "ok"
        return last.join(whole, "request_id", "left").select(
            "request_id", "calls", F.when(ok, F.col("content")).alias("content"), F.when(ok, F.col("finish_reason")).alias("finish_reason"),
            F.when(~ok, F.format_string("gave up after %d calls: %s", "calls", "end.error")).alias("error"))


def _rounds(work: WorkArea, name: str) -> list[str]:
    return [n for n in list_names(work.root) if n.startswith(f"{name}_round_") and not n.endswith("_lanes")]


def call_log(work: WorkArea, name: str) -> DataFrame:
    """Every call of a stage: request_id, attempt, model, slot, opened_at, closed_at, outcome, error."""
    calls = LiveCalls._read(work, _rounds(work, name), "call")
    return calls.select("request_id", "attempt", "model", "slot", *[F.timestamp_seconds(c).alias(c) for c in ("opened_at", "closed_at")], "outcome", "error")


def reply_pieces(work: WorkArea, name: str) -> DataFrame:
    """Every piece that a stage has received: request_id, seq, attempt, role, content, finish_reason."""
    return LiveCalls._read(work, _rounds(work, name), "piece").select("request_id", "seq", "attempt", "role", "content", "finish_reason")
