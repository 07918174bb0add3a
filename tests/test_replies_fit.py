"""F1-F6 reply reading and G1-G10 fitting, on the fixture tables."""

import json

from pyspark.sql import functions as F

from tessera.functions.json_reply import with_parsed_reply
from tessera.functions.similarity import ratio, with_match_score
from tessera.operators.fit import best_candidate, grade_best, validate_fit

REPLY_CASES = [
    ('{"0":"a","1":"b"}', {"0": "a", "1": "b"}, False),
    ('prose, then {"0":"a",} , then prose', {"0": "a"}, False),
    ('{"0":"a"} t {"1":"b"}', None, None),
    ("{'0':'a'}", None, None),
    ('{"0":"a', None, None),
    ('{"0":"a","0":"b"}', {"0": "b"}, False),
    ('{"0":1}', {"0": "1"}, True),
    ("{}", {}, False),
    ('{"0":NaN}', None, None),
    ('{"0":"x \\" y","1":null}', {"0": 'x " y', "1": None}, True),
]


def test_reply_cases(spark):
    df = spark.createDataFrame([(c,) for c, _, _ in REPLY_CASES], "content string")
    rows = with_parsed_reply(df, "content", "m", non_string="ns").collect()
    for (c, want, ns), r in zip(REPLY_CASES, rows):
        assert (None if r.m is None else dict(r.m)) == want, c
        assert r.ns == ns, c


FIT_CASES = [
    ({"0": "AB", "1": "c"}, 1.0, "S"),
    ({"1": "c", "0": "ab."}, 1.0, "S"),
    ({"0": "AB", "1": "x"}, "partial", "C"),
    ({"0": "AB c"}, 0.0, "C"),
    ({"1": "AB", "2": "c"}, 1.0, "E"),
    ({"x": "AB", "y": "c"}, None, "F"),
    ({"x": "AB c"}, 0.0, "E"),
    (None, None, "F"),
]


def test_fit_cases(spark):
    rows = []
    for gid, (pieces, _, _) in enumerate(FIT_CASES):
        content = "no json here" if pieces is None else json.dumps(pieces)
        rows.append((1, gid, 0, 2, "AB c", content, None))
    df = spark.createDataFrame(
        rows, "page_id long, group_no int, attempt int, n_shreds int, trans_text string, content string, error string"
    ).withColumn("shreds", F.array(
        F.struct(F.lit(0).alias("shred_no"), F.lit(10).alias("frag_no"), F.lit("ab ").alias("text")),
        F.struct(F.lit(1).alias("shred_no"), F.lit(11).alias("frag_no"), F.lit("c").alias("text")),
    ))
    v = validate_fit(df)
    cands = v.filter("candidate").select("page_id", "group_no", "attempt", "score", "reason", "pieces", "bad_values", "n_shreds", "shreds")
    graded = {r.group_no: r for r in grade_best(best_candidate(cands)).collect()}
    for gid, (_, score, status) in enumerate(FIT_CASES):
        r = graded.get(gid)
        if status == "F":
            assert r is None, gid
            continue
        assert r.status == status, gid
        if score == "partial":
            assert 0.0 < r.score < 1.0
            assert abs(r.score - ratio("abc", "abx")) < 1e-12
        else:
            assert r.score == score, gid


def test_best_candidate_ties_take_earliest(spark):
    rows = [(1, 0, a, s) for a, s in [(0, 0.5), (1, 0.9), (2, 0.9), (3, 0.1)]]
    df = spark.createDataFrame(rows, "page_id long, group_no int, attempt int, score double")
    df = df.select("*", F.lit("").alias("reason"), F.create_map(F.lit("0"), F.lit("x")).alias("pieces"),
                   F.lit(False).alias("bad_values"), F.lit(1).alias("n_shreds"),
                   F.lit(None).cast("array<struct<shred_no:int,frag_no:int,text:string>>").alias("shreds"))
    b = best_candidate(df).collect()[0]
    assert (b.attempt, b.score) == (1, 0.9)


def test_match_score_against_difflib(spark):
    pairs = [("Hello, World.", "hello world"), ("abcd", "bcde"), ("", ""), ("a b", "xyz"), ("ab" * 150, "ba" * 160)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.score for r in with_match_score(df, "a", "b").collect()]
    comp = [(a.replace(" ", "").replace(",", "").replace(".", "").lower(), b.replace(" ", "").replace(",", "").replace(".", "").lower()) for a, b in pairs]
    want = [1.0 if x == y else ratio(x, y) for x, y in comp]
    assert got == want
