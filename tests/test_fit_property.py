"""G6-G10 through the attempt rounds, with replies of known worth; reply reading against the stdlib."""

import json
import random

from pyspark.sql import functions as F

from tessera.operators.fit import best_candidate, fit_rounds, grade_best
from tessera.options import Options
from tessera.session import WorkArea


# Kinds of replies, each with what it is worth: None (no candidate), a score, or
# "error" (a best candidate that cannot be applied). The worth follows from how
# the reply is made, not from reading it back.
def _reply(kind, pieces):
    n = len(pieces)
    right = {str(i): p for i, p in enumerate(pieces)}
    if kind == "perfect":
        return json.dumps(right), 1.0
    if kind == "perfect with chatter and a comma":
        return "ok " + json.dumps(right)[:-1] + ",}", 1.0
    if kind == "too few":
        return json.dumps({"0": "".join(pieces)}), 0.0
    if kind == "nothing":
        return "no", None
    if kind == "text after":
        return json.dumps(right) + " }", None
    if kind == "more letters":  # 2 m / (2 m + 3) on the compact text
        m = sum(len(p.replace(" ", "").replace(",", "").replace(".", "")) for p in pieces)
        return json.dumps({**right, str(n - 1): pieces[-1] + "zzz"}), 2 * m / (2 * m + 3)
    if kind == "numbers":
        return json.dumps({str(i): 1 for i in range(n)}), None
    if kind == "letters for keys":
        return json.dumps({"a" + str(i): p for i, p in enumerate(pieces)}), None
    return json.dumps({str(i + 1): p for i, p in enumerate(pieces)}), "error"  # shifted keys: scores 1.0, cannot be applied


KINDS = ["perfect", "perfect with chatter and a comma", "too few", "nothing", "text after", "more letters", "numbers", "letters for keys", "shifted"]


def test_rounds_end_with_what_the_replies_are_worth(spark):
    rng = random.Random(11)
    groups, replies = [], []
    for g in range(150):
        n = rng.randint(2, 4)
        pieces = [rng.choice(["ab ", "Cd", "e,f", " gh", "ij."]) for _ in range(n)]
        kinds = [rng.choice(KINDS[2:] if rng.random() < 0.9 else KINDS) for _ in range(11)]
        seq = [_reply(k, pieces) for k in kinds]
        groups.append((g, n, pieces, seq))
        replies += [(7, g, a, c) for a, (c, _) in enumerate(seq)]
    rows = [(7, g, n, [(i, 100 + i, p) for i, p in enumerate(pieces)], "".join(pieces), "".join(pieces)) for g, n, pieces, _ in groups]
    fit_rows = spark.createDataFrame(
        rows, "page_id long, group_no int, n_shreds int, shreds array<struct<shred_no:int,frag_no:int,text:string>>, "
        "src_text string, trans_text string",
    )
    stored = spark.createDataFrame(replies, "page_id long, group_no int, attempt int, content string")

    def backend(reqs):
        j = reqs.join(stored, ["page_id", "group_no", "attempt"], "left")
        return j.select("*", F.lit(1).alias("calls"), F.lit("stop").alias("finish_reason"),
                        F.lit(None).cast("string").alias("error"))

    cands = fit_rounds(fit_rows, backend, Options(), WorkArea(spark))
    graded = {r.group_no: r for r in grade_best(best_candidate(cands)).collect()}
    for g, _, _, seq in groups:
        worth = [w for _, w in seq]
        # the first that joins to the whole text ends the rounds
        first = next((k for k, w in enumerate(worth) if w in (1.0, "error")), None)
        if first is not None:
            want = ("E" if worth[first] == "error" else "S", 1.0)
        else:
            best = max((w for w in worth if w is not None), default=None)
            want = None if best is None else (("C", best) if best > 0 else None)
        r = graded.get(g)
        if first is None and want is None:
            assert r is None or r.score == 0.0, (g, seq)
        else:
            assert (r.status, round(r.score, 12)) == (want[0], round(want[1], 12)), (g, seq, r)


def _reply_text(rng):
    """A reply and the object it holds, or None where it holds none."""
    obj = {str(k): rng.choice(["a", "b c", "é", 'x"y', "t\ta", "1", "{", "}", ",}"[:1]]) for k in rng.sample(range(6), rng.randint(1, 4))}
    body = json.dumps(obj, ensure_ascii=rng.random() < 0.5)
    before, after = rng.choice(["", "Sure.", "here:\n", '"q" ']), rng.choice(["", " ok", "\n", ' "q"', "]"])
    kind = rng.randrange(8)
    if kind == 1:  # a comma too many is dropped
        return before + body[:-1] + rng.choice([",}", ", }", ",\n}"]) + after, obj
    if kind == 2:  # of a key that comes twice the last one counts
        key = rng.choice(list(obj))
        return before + body[:-1] + f', "{key}": "dup"}}' + after, obj | {key: "dup"}
    if kind == 3:  # cut off: no closing brace, unless one is in a string
        return (before + body[: rng.randint(0, len(body) - 1)], None) if "}" not in body[:-1] else (before + body, obj)
    if kind == 4:
        return before + body + rng.choice([" }", "] }", ", x }", " {}", body]), None
    if kind == 5:
        return rng.choice(["{ ", "{x} "]) + body, None
    if kind == 6:  # text after the object, at any depth
        deep = json.dumps({"0": {"a": {"b": {"c": [1, {"d": 2}]}}}})
        return deep + rng.choice([" }", "] }", ", {}"]), None
    return before + body + after, obj


def test_reply_reading(spark):
    from tessera.functions.json_reply import with_parsed_reply

    rng = random.Random(5)
    cases = [_reply_text(rng) for _ in range(600)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "content string")
    got = [r.m for r in with_parsed_reply(df, "content", "m").collect()]
    for (c, want), m in zip(cases, got):
        assert (None if m is None else dict(m)) == want, c


def test_deep_objects_are_read(spark):
    from tessera.functions.json_reply import with_parsed_reply

    deep = [json.dumps({"0": x}) for x in ("a", [1], {"a": 1}, {"a": {"b": [1, {"c": {}}]}})]
    df = spark.createDataFrame([(c,) for c in deep], "content string")
    assert all(r.m is not None for r in with_parsed_reply(df, "content", "m").collect())
