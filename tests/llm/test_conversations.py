"""Conversation repair against an enumeration of all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from tessera.llm import conversations as C

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), *[T.StructField(n, T.StringType()) for n in ("gone", "key", "again", "edit", "step", "cost")],
])
ORDER = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["?"] * 6) for r in rows], SCHEMA)


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        talk = out.setdefault(conv, [])
        if kind:
            talk += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(t, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, t in out.items()}


def faults(talk):
    seen, out = set(), []
    for _, role, text in talk:
        bare = text.strip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(talk):
    """All edits of a short conversation: (cost, audit, lines)."""
    found = faults(talk)
    best = None
    choices = []
    for (_, role, text), fault in zip(talk, found, strict=True):
        extra = fault == "truncated"
        edits = [("D", 3, [])]
        if fault not in ("blank", "duplicate"):
            edits += [("K", extra, [(role, text)])] + [("R", 2 + extra, [(r, text)]) for r in ("user", "assistant")]
        choices.append(edits)
    gaps = [("", 0, [])] + [("I", 2, [(r, "")]) for r in ("user", "assistant")]
    parts = [x for edits in choices for x in (gaps, edits)] + [gaps + [("II", 4, [("user", ""), ("assistant", "")])]]
    for picked in itertools.product(*parts):
        cost = sum(p[1] for p in picked)
        if best is not None and cost > best[0]:
            continue
        lines = [x for p in picked for x in p[2]]
        if ORDER.fullmatch("".join(r[:1] for r, _ in lines)):
            found_one = (cost, "".join(p[0] for p in picked), [f"{r}:{t}" for r, t in lines])
            if best is None or found_one[:2] < best[:2]:
                best = found_one
    return best


def plain(rows):
    out = {}
    for conv, talk in damaged(rows).items():
        found = faults(talk)
        turns = [t for t, _, _ in talk if t is not None]
        initials = [r[:1] for _, r, _ in talk]
        cost, audit, lines = cheapest(talk)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def random_rows(seed, talks):
    rng, rows = random.Random(seed), []
    for conv in range(talks):
        for turn in range(rng.randrange(0, 5)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Why?", "", " \n", None, "Yes.", f"text {rng.randrange(9)}.", "É!"])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None, 7]), role, text))
    return rows


def test_against_all_edits(spark):
    rows = random_rows(3, 70) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (1 << 60, 1 << 61, "user", "a."), (1 << 60, (1 << 61) + 1, "assistant", "b")]
    got = C.digests(C.repair(C.damage(frame(spark, rows))))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert repaired(got) == plain(rows)


def test_given_conversations_against_a_plain_program(spark):
    """The whole given table against a program that keeps whole edit strings."""
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = repaired(C.op13_conversation_repair(spark, sf))
    assert got.keys() == {r[0] for r in rows}
    for conv, talk in damaged(rows).items():
        assert got[conv][5:7] == by_strings(talk), conv


def by_strings(talk):
    states = {"": (0, "")}  # initials reduced to "", "s", "su", "sua"
    step = {("", "s"): "s", ("", "u"): "su", ("s", "u"): "su", ("su", "a"): "sua", ("sua", "u"): "su"}
    for (_, role, _), fault in zip(talk, faults(talk), strict=True):
        new = {}
        for p, (cost, text) in states.items():
            for q, more, added in [(p, "", 0)] + [(step[p, x], "I", 2) for x in "ua" if (p, x) in step]:
                moves = [(q, "D", 3)]
                if fault not in ("blank", "duplicate"):
                    extra = fault == "truncated"
                    moves += [(step[q, role[:1]], "K", extra)] if (q, role[:1]) in step else []
                    moves += [(q, "K", extra)] if not role else []
                    moves += [(step[q, x], "R", 2 + extra) for x in "ua" if (q, x) in step]
                for r, letter, c in moves:
                    key = (cost + added + c, text + more + letter)
                    if r not in new or key < new[r]:
                        new[r] = key
        states = new
    ends = {"": "", "s": "II", "su": "I", "sua": ""}
    return min((c + 2 * len(ends[p]), t + ends[p]) for p, (c, t) in states.items())


@pytest.mark.parametrize("pattern", ["ua", "s", "uuas", "usaaa", "x"])
def test_long_conversations_in_small_memory(spark, pattern):
    """Rows leave once decided, others are spilled; the result is the same."""
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    rng = random.Random(pattern)
    talk = [(t, names[rng.choice(pattern)], f"text {rng.randrange(10 ** 6)}" + rng.choice([".", "?", "", "."])) for t in range(3000)]
    rows = spark.createDataFrame([(5, t, r, x, False) for t, r, x in talk], "conv_id long, turn long, role string, text string, gone boolean")
    edits = C.repair(rows, held_bytes=4000).collect()
    assert [r["step"] for r in edits] == list(range(1, len(edits) + 1))
    cost, audit = by_strings(talk)
    assert edits[-1]["cost"] == cost and "".join(r["edit"] for r in edits[:-1]) == audit
    kept = [(r["turn"], r["text"]) for r in edits[:-1] if r["edit"] in "KRD"]
    assert kept == [(t, x) for t, _, x in talk]
    assert ORDER.fullmatch("".join(r["role"][0] for r in edits[:-1] if r["edit"] != "D"))


def test_few_situations():
    """The program's numbers fit two bytes whatever rows come."""
    program, rng = C.Program(), random.Random(1)
    todo, seen = [C.Program.START], {C.Program.START}
    while todo:
        situation = todo.pop()
        for kind in range(len(program.of_kind)):
            after = program.steps[program.step(situation, kind)][0]
            if after not in seen:
                seen.add(after)
                todo.append(after)
    assert len(program.steps) < 1 << 16


def test_empty_and_all_gone(spark):
    assert repaired(C.digests(C.repair(C.damage(frame(spark, []))))) == {}
    rows = spark.createDataFrame([(4, 0, "user", "x", True), (4, None, None, None, True)], "conv_id long, turn long, role string, text string, gone boolean")
    assert repaired(C.digests(C.repair(rows))) == {4: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
