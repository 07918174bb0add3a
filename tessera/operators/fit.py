"""Routing translated groups, fitting them back over their shreds.

Routing (G3-G5): a group whose compact text equals its translation needs
nothing (``S``, page untouched); a one-shred group takes the translation
whole (``S``); every other group goes to fit rounds.

Fit rounds (G8): attempt ``k`` sends one request per unresolved group at
temperature ``t0 * growth**k``; each reply is read (F1-F3) and validated
(G6, G7); every readable, non-empty reply that passes the piece-count check
or fails it becomes a *candidate*. A group leaves the rounds once a
candidate scores 1.0. A round writes what its replies came to and, in a folder of their
own, the groups left with their texts: the next round reads those, so that no text is
shuffled between rounds, and then they go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.json_reply import computed_once, int_key_order, numbered_keys, with_parsed_reply
from tessera.functions.similarity import with_match_score
from tessera.functions.text import same_compact
from tessera.operators.calls import Backend, call_model
from tessera.operators.requests import fit_requests
from tessera.options import Options
from tessera.session import WorkArea

KEYS = ["page_id", "group_no"]
ROUND_COLS = [*KEYS, "attempt", "score", "reason", "pieces", "bad_values"]
CANDIDATE_COLS = [*ROUND_COLS, "n_shreds", "first_frag", "frags"]


def route_groups(matched: DataFrame) -> DataFrame:
    """``route`` is ``unchanged``, ``single`` or ``multi`` for groups with a translation."""
    unchanged = same_compact("src_text", "trans_text")
    return matched.withColumn(
        "route",
        F.when(F.col("trans_text").isNull(), F.lit(None))
        .when(unchanged, F.lit("unchanged"))
        .when(F.col("n_shreds") == 1, F.lit("single"))
        .otherwise(F.lit("multi")),
    )


def validate_fit(replies: DataFrame) -> DataFrame:
    """G6, G7 on fit replies.

    Input rows carry ``n_shreds``, ``trans_text`` and the reply ``content``.
    Adds ``pieces`` (parsed map), ``candidate`` (the reply counts as a
    candidate), ``score`` and ``reason``:

    - unreadable, empty or failed reply: no candidate;
    - piece count differs: candidate with 0.0, checked before keys are read;
    - a non-integer key or a non-string piece: no candidate (raised);
    - otherwise the pieces joined in integer key order are scored against
      the translation: 1.0 is a perfect fit, less a partial one.
    """
    r = with_parsed_reply(replies, "content", "pieces", non_string="bad_values")
    r = r.withColumn("bad_values", F.coalesce(F.col("bad_values"), F.lit(False)))
    readable = F.col("error").isNull() & F.col("pieces").isNotNull() & (F.size("pieces") > 0)
    count_ok = F.size("pieces") == F.col("n_shreds")
    r = r.withColumn("_numbered", numbered_keys("pieces"))
    r = r.withColumn("_ordered", F.when(~F.col("_numbered"), int_key_order("pieces")))  # the sort is for the others
    ordered = F.col("_ordered")
    keys_ok = F.col("_numbered") | ~F.exists(ordered, lambda e: e["k"].isNull())
    r = r.withColumn(
        "_state",
        F.when(~readable, F.lit("invalid"))
        .when(~count_ok, F.lit("count"))
        .when(~keys_ok | F.col("bad_values"), F.lit("raised"))
        .otherwise(F.lit("scored")),
    )
    r = computed_once(r, "pieces", "bad_values", "_numbered", "_ordered", "_state")
    joined = F.when(F.col("_numbered"), F.array_join(F.map_values("pieces"), "")).otherwise(F.array_join(F.transform(ordered, lambda e: e["value"]), ""))
    r = r.withColumn("fitted", F.when(F.col("_state") == "scored", joined))
    r = with_match_score(r, "trans_text", "fitted", "_score")
    out = r.withColumn(
        "score",
        F.when(F.col("_state") == "scored", F.col("_score")).when(F.col("_state") == "count", F.lit(0.0)).cast("double"),
    ).drop("_score")
    reason = (
        F.when(F.col("_state") == "invalid", F.lit("reply is not a JSON object of pieces"))
        .when(
            F.col("_state") == "count",
            F.format_string("piece count differs, wanted %d, got %d", F.col("n_shreds"), F.size("pieces")),
        )
        .when(F.col("_state") == "raised", F.lit("Keys or pieces not readable."))
        .when(F.col("score") < 1.0, F.format_string("pieces differ from the translation, wanted [%s], joined [%s]", F.col("trans_text"), F.col("fitted")))
        .otherwise(F.lit(""))
    )
    return out.withColumn("candidate", F.col("_state").isin("count", "scored")).withColumn("reason", reason).drop(
        "_state", "_numbered", "_ordered"
    )


ROUND_DDL = (
    "page_id long, group_no int, attempt int, score double, reason string, pieces map<string,string>, bad_values boolean, n_shreds int, "
    "first_frag int, frags array<int>, candidate boolean, perfect boolean, status string, error string, best double, "
    "shreds array<struct<shred_no:int,frag_no:int,text:string>>, src_text string, trans_text string, unresolved int"
)
FIT_ROW_COLS = ["page_id", "group_no", "n_shreds", "shreds", "src_text", "trans_text"]


def fit_rounds(
    fit_rows: DataFrame,
    backend: Backend,
    options: Options,
    work: WorkArea,
    prefix: str = "fit",
) -> DataFrame:
    """Attempt rounds over a shrinking set of unresolved groups.

    ``fit_rows``: ``page_id, group_no, n_shreds, shreds, src_text,
    trans_text``. Per round one table is stored, made in the call stage itself: a row per
    reply, validated and graded, and (``unresolved`` 1) a row with its texts per group
    without a perfect fit, for the next round. Returns all candidates (``CANDIDATE_COLS``,
    ``status`` and ``error`` as ``grade_best`` has them); the pieces of one that scores no
    more than an earlier one of its group, which can't be chosen, are null. The driver only
    loops over attempt numbers and asks once per round how many groups are left.
    """

    def checked(replies: DataFrame) -> DataFrame:
        v = validate_fit(replies).withColumn("perfect", F.col("candidate") & F.coalesce(F.col("score") == 1.0, F.lit(False)))
        v = grade_best(v.withColumn("_error", F.col("error"))).withColumn("_better", F.coalesce(F.col("score") > F.col("best"), F.col("candidate")))
        r = v.withColumn("unresolved", F.explode(F.when(F.col("perfect"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
        r = r.withColumn("first_frag", F.col("shreds")[0]["frag_no"])
        reply, left = F.col("unresolved") == 0, F.col("unresolved") == 1
        own = {
            "pieces": F.when(reply & F.col("_better"), F.col("pieces")), "reason": F.when(reply, F.col("reason")), "first_frag": F.when(reply, F.col("first_frag")),
            "frags": F.when(reply, F.transform(F.col("shreds.frag_no"), lambda f: f - F.col("first_frag"))),
            "best": F.when(left, F.when(F.col("candidate"), F.greatest("best", "score")).otherwise(F.col("best"))),
        }
        return r.withColumns(own | {c: F.when(left, F.col(c)) for c in ("shreds", "src_text", "trans_text")})

    def call_and_check(reqs: DataFrame) -> DataFrame:
        return checked(backend(reqs))

    if hasattr(backend, "stage"):
        call_and_check.stage = lambda reqs, area, name: checked(backend.stage(reqs, area, name))
    keep = {*FIT_ROW_COLS, *CANDIDATE_COLS, "candidate", "perfect", "status", "error", "best", "unresolved"}
    found = None
    active = fit_rows.select(*FIT_ROW_COLS, F.lit(None).cast("double").alias("best"))
    for attempt in range(options.fit_attempts):
        name = f"{prefix}_round_{attempt}"
        call_model(fit_requests(active, attempt, options), call_and_check, work, name, keep=keep, by="unresolved", schema=ROUND_DDL)
        if attempt:  # its texts have been read
            work.drop(f"{prefix}_round_{attempt - 1}/unresolved=1")
        stored = work.read(name, ROUND_DDL)
        replies = stored.filter("unresolved = 0")
        found = replies if found is None else found.unionByName(replies)
        if replies.filter("not perfect").isEmpty():
            break
        if attempt + 1 == options.fit_attempts:
            work.drop(f"{name}/unresolved=1")
        active = stored.filter("unresolved = 1").select(*FIT_ROW_COLS, "best")
    if found is None:
        found = work.spark.createDataFrame([], ROUND_DDL)
    return found.filter("candidate").select(*CANDIDATE_COLS, "status", "error")


def best_candidate(cands: DataFrame) -> DataFrame:
    """Highest score, earliest attempt on ties, as a partial aggregate."""
    rank = F.struct(F.col("score"), (-F.col("attempt")).alias("neg_attempt"))
    best = cands.groupBy(*KEYS).agg(F.max_by(F.struct(*[c for c in cands.columns if c not in KEYS]), rank).alias("b"))
    return best.select(*KEYS, "b.*")


def grade_best(best: DataFrame) -> DataFrame:
    """G10 + apply check: ``status`` S (1.0), C (below 1.0), E (pieces cannot be applied).

    Pieces are applied by integer key; a key that is not an integer or not in
    ``0..n_shreds-1``, or a piece that is not a string, makes the group an
    error and leaves its text untouched.
    """
    n = F.col("n_shreds")
    fine = numbered_keys("pieces") & (F.size("pieces") <= n)
    best = best.withColumn("_ordered", F.when(~F.coalesce(fine, F.lit(False)), int_key_order("pieces")))
    bad_key = F.coalesce(F.exists("_ordered", lambda e: e["k"].isNull() | (e["k"] < 0) | (e["k"] >= n)), F.lit(False))
    status = (
        F.when(bad_key | F.col("bad_values"), F.lit("E"))
        .when(F.col("score") >= 1.0, F.lit("S"))
        .otherwise(F.lit("C"))
    )
    err = F.when(bad_key | F.col("bad_values"), F.lit("pieces cannot be applied"))
    return best.withColumn("status", status).withColumn("error", err).drop("_ordered")


def fit_edits(graded: DataFrame) -> DataFrame:
    """H1 input from fitted groups: ``(page_id, frag_no, new_text)`` for S and C."""
    ok = graded.filter(F.col("status").isin("S", "C"))
    e = ok.select("page_id", "first_frag", "frags", F.explode("pieces").alias("k", "v"))
    idx = F.col("k").try_cast("int")
    return e.select("page_id", (F.col("first_frag") + F.try_element_at("frags", idx + 1)).alias("frag_no"), F.col("v").alias("new_text"))


def chosen_edits(cands: DataFrame, whole: DataFrame) -> DataFrame:
    """The edits of the candidates of ``fit_rounds`` and of the groups that take their
    translation whole, ``(page_id, group_no, frag_no, new_text)``. They meet by page, once, with
    their pieces and numbers as text; a group's best one is found and taken apart where its
    page is."""
    fitted = cands.select(
        *KEYS, "attempt", "score", "status", "first_frag", F.array_join("frags", ",").alias("frags"), F.to_json("pieces").alias("pieces"), F.lit(None).cast("string").alias("new_text"))
    one = whole.select(
        *KEYS, F.lit(0).alias("attempt"), F.lit(1.0).alias("score"), F.lit("S").alias("status"), F.col("frag_no").alias("first_frag"), F.lit("0").alias("frags"),
        F.lit(None).cast("string").alias("pieces"), "new_text")
    best = best_candidate(fitted.unionByName(one).repartition("page_id"))
    pieces = F.coalesce(F.from_json("pieces", "map<string,string>"), F.create_map(F.lit("0"), F.col("new_text")))
    return fit_edits(best.withColumn("pieces", pieces).withColumn("frags", F.split("frags", ",").cast("array<int>")))
