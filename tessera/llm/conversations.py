"""Conversation structure repair by secondary-sorted streaming.

A conversation is in order if its role initials match ``(s?(ua)+)?``. Every row
is kept (cost 0), given the role user or assistant (2) or deleted (3; blank and
duplicate rows have to be); a row without text may be inserted anywhere as user
or assistant (2); a truncated row that stays adds 1. Of the cheapest repairs the
one with the ASCII-least string of edit initials (D, I, K, R) is taken.

How it runs: one shuffle by conversation; inside a partition Spark sorts (on
disk where needed) by conversation, role and text to tell the first of equal
rows, then by conversation and turn. ``mapInPandas`` reads that stream and
carries the state of a dynamic program over its Arrow batches:

- four states: nothing yet (0), after s (S), after u (U), after a (A); of each
  the cheapest cost and the place of its edit string among the others'. Strings
  of two states always end in a row's letter and are never prefixes of each
  other, so these places decide all later comparisons;
- a state that another can stand in for at less cost is dropped. Costs, taken
  from the least, are then bounded, so the program meets few situations: each
  (situation, kind of row) is worked out once and looked up afterwards;
- a row's backpointers are the number of that situation, two bytes. Where all
  states come from the same one some rows back, the rows up to there are decided
  and leave at once; so a conversation of any length is held only as far back as
  its states still differ. Undecided rows beyond ``held_bytes`` are spilled to a
  file in Spark's local folder (the task's own, gone with it), their
  backpointers stay as two bytes a row.

A conversation with a third of all rows is one task's stream, as the named
method has it: it is read once, never collected, and takes bounded memory.

Defined cases: a null role or text is one space; null turns come first; equal
turns are ordered by role and text; a null conv_id is a conversation; an empty
role has no initial, so its row can stay anywhere; an initial other than s, u, a
can't stay; rows marked ``gone`` only say that their conversation exists; equal
rows are duplicates but for the first; texts of any length; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from array import array

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, read

NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
NAMES = {"u": "user", "a": "assistant"}
#: Where an initial leads from a state.
NEXT = {(NOTHING, "s"): AFTER_S, (NOTHING, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
#: What it costs at most to go on from the first state as from the second.
STANDS_IN = [
    [0, 0, 2, 0],
    [4 + DELETE, 0, 2, 4],
    [2 + DELETE, 2, 0, 2],
    [DELETE, 0, 2, 0],
]
COLUMNS = "conv_id long, step long, turn long, edit string, fault string, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _row_options() -> dict:
    """(initial, must go, truncated) -> for every state the edits of one row:
    (letters, next state, cost)."""
    table = {}
    for initial in ("s", "u", "a", "", "?"):
        for must_go in (False, True):
            for cut in (False, True):
                stay = TRUNCATED * cut
                rows = []
                for p in range(4):
                    inserted = [("", p, 0)] + [("I", NEXT[p, x], INSERT) for x in "ua" if (p, x) in NEXT]
                    moves = []
                    for letters, q, cost in inserted:
                        moves.append((letters + "D", q, cost + DELETE))
                        if must_go:
                            continue
                        if initial == "":
                            moves.append((letters + "K", q, cost + KEEP + stay))
                        elif (q, initial) in NEXT:
                            moves.append((letters + "K", NEXT[q, initial], cost + KEEP + stay))
                        moves += [(letters + "R", NEXT[q, x], cost + REROLE + stay) for x in "ua" if (q, x) in NEXT]
                    rows.append(moves)
                table[initial, must_go, cut] = rows
    return table


class Program:
    """The dynamic program over kinds of rows, each situation worked out once.

    A situation is (cost above the least, place of the edit string) of each
    state, None for one that is out of reach or dropped.
    """

    START = ((0, 0), None, None, None)

    def __init__(self):
        self.options = _row_options()
        self.kinds = {k: i for i, k in enumerate(self.options)}
        self.of_kind = list(self.options.values())
        self.steps: list[tuple] = []  # number -> (next situation, added cost, backpointers)
        self.known: dict[tuple, int] = {}

    def kind(self, role: str, text: str, duplicate: bool) -> tuple[int, str]:
        """Number of the kind of row, and its first fault."""
        seen = text.rstrip(SPACES)
        fault = "blank" if not seen else "duplicate" if duplicate else "truncated" if seen[-1] not in ".!?" else ""
        initial = role[:1]
        if initial not in ("s", "u", "a", ""):
            initial = "?"
        return self.kinds[initial, fault in ("blank", "duplicate"), fault == "truncated"], fault

    def step(self, situation: tuple, kind: int) -> int:
        """Number of the step that a row of this kind makes from a situation."""
        number = self.known.get((situation, kind))
        if number is None:
            number = self.known[situation, kind] = len(self.steps)
            self.steps.append(self._work_out(situation, kind))
        return number

    def _work_out(self, situation, kind):
        best: list[tuple | None] = [None] * 4
        for p, held in enumerate(situation):
            if held is None:
                continue
            for letters, q, cost in self.of_kind[kind][p]:
                found = (held[0] + cost, (held[1], letters), p)
                if best[q] is None or found < best[q]:
                    best[q] = found
        for q in range(4):
            if best[q] and any(best[o] and best[q][0] > best[o][0] + STANDS_IN[o][q] for o in range(4) if o != q):
                best[q] = None
        places = {b[1]: i for i, b in enumerate(sorted((b for b in best if b), key=lambda b: b[1]))}
        least = min(b[0] for b in best if b)
        return tuple(b and (b[0] - least, places[b[1]]) for b in best), least, tuple(b and (b[2], b[1][1]) for b in best)

    @staticmethod
    def ending(situation) -> tuple[int, str, int]:
        """Last state, closing inserts and their cost."""
        ends = {NOTHING: "", AFTER_A: "", AFTER_U: "I", AFTER_S: "II"}
        cost, _, p = min((held[0] + INSERT * len(ends[p]), (held[1], ends[p]), p) for p, held in enumerate(situation) if held)
        return p, ends[p], cost


class Conversation:
    """One conversation of the stream: rows in, decided rows out."""

    CHECK = 256  # undecided rows before the first look for a common state

    def __init__(self, conv_id, program: Program, held_bytes: int):
        self.conv_id, self.program, self.held_bytes = conv_id, program, held_bytes
        self.situation, self.cost = Program.START, 0
        self.back = array("H")  # backpointers of the undecided rows
        self.rows, self.size, self.spilled, self.file = [], 0, 0, None
        self.look_at = self.CHECK  # undecided rows at the next look; doubled where none was decided
        self.state = NOTHING  # the state before the first undecided row
        self.emitted = 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last_initial = None
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, turn, role: str, text: str, duplicate: bool):
        kind, fault = self.program.kind(role, text, duplicate)
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if self.last_initial is not None and self.last_initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = role[:1]
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            if turn != self.last_turn:
                self.turns += 1
            self.last_turn = turn
        number = self.program.step(self.situation, kind)
        self.situation, added, _ = self.program.steps[number]
        self.cost += added
        self.back.append(number)
        self.rows.append((turn, role, text, fault))
        self.size += len(role) + len(text) + 64
        if len(self.back) >= self.look_at:
            yield from self._decide()
            self.look_at = max(self.CHECK, 2 * len(self.back))
        if self.size > self.held_bytes:
            self._spill()

    def _decide(self):
        """Emit the rows that all remaining states agree on."""
        alive = {p for p, held in enumerate(self.situation) if held}
        at = len(self.back)
        while at and len(alive) > 1:
            at -= 1
            pointers = self.program.steps[self.back[at]][2]
            alive = {pointers[p][0] for p in alive}
        if at and at >= self.spilled:
            yield from self._emit(at, alive.pop())

    def _emit(self, upto: int, end: int, closing: str = ""):
        """The first rows, up to the state that is reached after them."""
        letters, p = [""] * upto, end
        for i in range(upto - 1, -1, -1):
            p, letters[i] = self.program.steps[self.back[i]][2][p]
        state = self.state
        for edits, (turn, role, text, fault) in zip(letters, self._taken(upto), strict=True):
            for letter in edits:
                if letter == "D":
                    yield self._out(turn, "D", fault, role, text)
                    continue
                initial = role[:1] if letter == "K" else "a" if state == AFTER_U else "u"
                if initial:
                    state = NEXT[state, initial]
                if letter == "I":
                    yield self._out(None, "I", "", NAMES[initial], "")
                else:
                    yield self._out(turn, letter, fault, role if letter == "K" else NAMES[initial], text)
        for letter in closing:
            initial = "a" if state == AFTER_U else "u"
            state = NEXT[state, initial]
            yield self._out(None, letter, "", NAMES[initial], "")
        self.state = end
        del self.back[:upto]

    def _out(self, turn, edit, fault, role, text):
        self.emitted += 1
        return (self.conv_id, self.emitted, turn, edit, fault, role, text, None, None, None, None, None, None)

    def _taken(self, upto: int):
        """The first held rows, spilled ones first; they are held no longer."""
        if self.file is not None:
            self.file.seek(0)
            left = self.spilled
            while left:
                block = pickle.load(self.file)
                left -= len(block)
                yield from block
            self.file.close()
            self.file = None
        n = upto - self.spilled
        self.spilled = 0
        rows, self.rows = self.rows[:n], self.rows[n:]
        self.size = sum(len(r) + len(t) + 64 for _, r, t, _ in self.rows)
        yield from rows

    def _spill(self):
        if self.file is None:
            folder = (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0]
            self.file = tempfile.TemporaryFile(dir=folder if folder and os.path.isdir(folder) else None)
        pickle.dump(self.rows, self.file, pickle.HIGHEST_PROTOCOL)
        self.spilled += len(self.rows)
        self.rows, self.size = [], 0

    def close(self):
        """The last rows, and the closing row with the counts."""
        end, closing, cost = Program.ending(self.situation)
        yield from self._emit(len(self.back), end, closing)
        gaps = 0 if self.first_turn is None else min(self.last_turn - self.first_turn + 1 - self.turns, (1 << 63) - 1)
        yield (self.conv_id, self.emitted + 1, None, None, None, None, None, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + cost)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split(" ")[0] for x in COLUMNS.split(", ")]
    out = pd.DataFrame({n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)}, dtype=object)
    for part in COLUMNS.split(", "):
        name, kind = part.split(" ")
        if kind == "long":
            out[name] = out[name].astype("Int64")
    return out


def repair(rows: DataFrame, held_bytes: int = 8 << 20, batch: int = 2000) -> DataFrame:
    """The edits of every conversation, in order, and its counts.

    ``rows``: conv_id, turn, role, text, gone. The result has a row per edit:
    conv_id, step, turn, edit (K, R, D, I), fault (of the original row), role and
    text (of the repaired row; of the original one where it is deleted), and at
    the end of each conversation a row with a null edit that holds gaps, blank,
    duplicate, truncated, illegal and cost. Rows of a conversation are neighbours
    in one partition, in order of ``step``.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("gone"),
        F.when(~F.col("gone"), space("role")).alias("role"), F.when(~F.col("gone"), space("text")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat_ws("\0", "role", "text")))).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "key", "role").orderBy(F.col("turn").asc_nulls_first()))
    rows = rows.withColumn("again", again > 1).select("conv_id", "turn", "role", "text", "gone", "again")
    rows = rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "again")
    # as strings, since pandas would make whole numbers beside nulls floating
    rows = rows.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "gone", "again")

    def edits(batches):
        program, talk, current = Program(), None, None
        for pdf in batches:
            ids, turns = ([None if x is None else int(x) for x in pdf[c]] for c in ("conv_id", "turn"))
            for conv, turn, role, text, gone, dup in zip(ids, turns, pdf["role"], pdf["text"], pdf["gone"], pdf["again"], strict=True):
                if talk is None or conv != current:
                    if talk is not None:
                        yield from talk.close()
                    talk, current = Conversation(conv, program, held_bytes), conv
                if not gone:
                    yield from talk.add(turn, role, text, bool(dup))
        if talk is not None:
            yield from talk.close()

    def stream(batches):
        out, size = [], 0
        for row in edits(batches):
            out.append(row)
            size += len(row[6] or "")
            if len(out) >= batch or size >= held_bytes:
                yield _frame(out)
                out, size = [], 0
        if out:
            yield _frame(out)

    return rows.mapInPandas(stream, COLUMNS)


def digests(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s result, without a shuffle: its
    counts, the string of its edits and the SHA-256 of the repaired lines."""
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def stream(batches):
        sha, audit, started = hashlib.sha256(), [], False
        for pdf in batches:
            done = []
            for i, (edit, role, text) in enumerate(zip(pdf["edit"], pdf["role"], pdf["text"], strict=True)):
                if edit is None:
                    conv, *values = (pdf[c].iat[i] for c in ("conv_id", *counts))
                    done.append((None if conv is None else int(conv), *map(int, values), "".join(audit), sha.hexdigest()))
                    sha, audit, started = hashlib.sha256(), [], False
                    continue
                audit.append(edit)
                if edit != "D":
                    sha.update((("\n" if started else "") + role + ":" + text).encode())
                    started = True
            out = pd.DataFrame(done, columns=[x.split(" ")[0] for x in schema.split(", ")])
            out["conv_id"] = out["conv_id"].astype("Int64")
            yield out

    plain = edits.select(*[F.col(c).cast("string") for c in ("conv_id", "edit", "role", "text", *counts)])
    return plain.mapInPandas(stream, schema)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows as op13's contract damages them,
    by ``crc32(conv_id:turn) % 20`` (nulls: one space)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(space("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return digests(repair(damage(rows)))
