"""Registered queries: one per operator group of the inventory.

Each query takes ``(spark, sf_dir)``, reads the given tables (or tables
Spark derives from them) and returns a DataFrame of scalar columns. All
integer columns are BIGINT and all fractional ones DOUBLE, so results
compare column by column with the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.json_reply import with_parsed_reply
from tessera.functions.similarity import with_match_score
from tessera.functions.text import compact_text, token_count
from tessera.operators.calls import assemble_chunks, backoff_schedule, call_model, continued_backend, python_backend, rate_check, replay_backend, shared_backend, truncated
from tessera.operators.live import call_log, reply_pieces
from tessera.operators.fit import best_candidate, grade_best, route_groups, validate_fit
from tessera.operators.groups import page_groups, shreds
from tessera.operators.replies import match_status
from tessera.operators.requests import chat_message_rows, fit_requests, translate_requests
from tessera.operators.segments import page_tokens, plan_segments, segment_groups, skipped_groups, with_encoding
from tessera.operators.tokenize import fragments
from tessera.options import ENCODING_MAP, Options
from tessera.plans import synthetic as syn
from tessera.plans.translation import translate_pages
from tessera.session import WorkArea
from tessera.sources.tree import plan_tree

SMALL_MAX = 200
OPTIONS = Options()


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _cores(spark: SparkSession) -> int:
    """Tasks for Python work on tables that may come as one file."""
    return spark.sparkContext.defaultParallelism


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "pages").repartition(_cores(spark))


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


# ---------------------------------------------------------------- B
def q_page_shreds(spark, sf):
    s = shreds(fragments(_t(spark, sf, "pages"), _cores(spark)))
    return s.select(*_long("page_id", "shred_no"), "text")


def q_page_groups(spark, sf):
    g = page_groups(_pages(spark, sf))
    return g.select(*_long("page_id", "group_no", "n_shreds"), "text")


def q_markup_groups(spark, sf):
    g = page_groups(syn.markup_pages(_t(spark, sf, "documents").repartition(_cores(spark))))
    return g.select(*_long("page_id", "group_no", "n_shreds"), "text")


def q_inline_tags(spark, sf):
    f = fragments(_t(spark, sf, "pages"), _cores(spark)).filter(F.col("kind") == "start")
    return f.groupBy("page_id").agg(
        F.count_if(F.col("is_inline")).cast("long").alias("n_inline"),
        F.count_if(~F.col("is_inline")).cast("long").alias("n_block"),
    )


# ---------------------------------------------------------------- C
def q_group_tokens(spark, sf):
    t = page_tokens(page_groups(_pages(spark, sf)), SMALL_MAX)
    return t.select(*_long("page_id", "n_groups", "total_tokens", "n_seg", "seg_target"))


def _model_of(conv_id):
    names = [m for m, _ in ENCODING_MAP] + ["local-model"]
    expr = F.lit(names[-1])
    for i, m in enumerate(names):
        expr = F.when(F.pmod(conv_id, F.lit(8)) == i, F.lit(m)).otherwise(expr)
    return expr


def q_encoding_lookup(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", "turn", "text", _model_of(F.col("conv_id")).alias("model"))
    e = with_encoding(c, "model")
    return e.select(*_long("conv_id", "turn"), "model", "encoding", token_count("text").cast("long").alias("n_tokens"))


def _conv_groups(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.select(
        F.col("conv_id").alias("page_id"),
        F.col("turn").alias("group_no"),
        "text",
        token_count("text").alias("n_tokens"),
    )


def q_segments_conversations(spark, sf):
    s = segment_groups(_conv_groups(spark, sf), SMALL_MAX)
    return s.select(*_long("page_id", "group_no", "seg_no", "seg_key"))


def q_segments_pages(spark, sf):
    s = segment_groups(page_groups(_pages(spark, sf)), SMALL_MAX)
    return s.select(*_long("page_id", "group_no", "seg_no", "seg_key"))


def q_skipped_conversations(spark, sf):
    p = plan_segments(_conv_groups(spark, sf), SMALL_MAX).filter(F.col("seg_no").isNull())
    return p.select(*_long("page_id", "group_no", "n_tokens"), F.lit("oversize").alias("reason"))


def q_skipped_pages(spark, sf):
    return skipped_groups(page_groups(_pages(spark, sf)), SMALL_MAX).select(*_long("page_id", "group_no", "n_tokens"), "reason")


# ---------------------------------------------------------------- D
def _conv_requests(spark, sf):
    g = _conv_groups(spark, sf).withColumn("n_shreds", F.lit(1)).withColumn(
        "shreds", F.array(F.struct(F.lit(0).alias("shred_no"), F.lit(0).alias("frag_no"), F.col("text")))
    )
    seg = segment_groups(g, SMALL_MAX, carry=["text", "n_shreds", "shreds"])
    return translate_requests(seg, OPTIONS)


def q_segment_requests(spark, sf):
    r = _conv_requests(spark, sf)
    return r.select(
        "request_id",
        *_long("page_id", "seg_no"),
        "model",
        F.col("temperature").cast("double").alias("temperature"),
        F.size("messages").cast("long").alias("n_messages"),
        F.col("messages")[0]["content"].alias("system_msg"),
        F.col("messages")[1]["content"].alias("user_msg"),
    )


def q_chat_history(spark, sf):
    e = chat_message_rows(_t(spark, sf, "conversations"), OPTIONS.default_system_prompt, bucket_turns=4)
    return e.select(*_long("conv_id", "pos"), "role", "content")


def _markup_translated(spark, sf):
    """Markup groups with the clean translation (letter rotation) attached."""
    g = page_groups(syn.markup_pages(_t(spark, sf, "documents").repartition(_cores(spark))))
    return g.select(
        "page_id", "group_no", "n_shreds", "shreds", F.col("text").alias("src_text"), syn.rotated("text").alias("trans_text")
    )


def q_fit_requests(spark, sf):
    routed = route_groups(_markup_translated(spark, sf)).filter(F.col("route") == "multi")
    r = fit_requests(routed.drop("route"), 0, OPTIONS)
    return r.select(
        "request_id",
        *_long("page_id", "group_no", "attempt"),
        F.col("temperature").cast("double").alias("temperature"),
        F.col("messages")[0]["content"].alias("system_msg"),
        F.col("messages")[1]["content"].alias("user_msg"),
    )


# ---------------------------------------------------------------- E
def q_replay(spark, sf):
    """Requests joined with a stored reply table; requests of every 8th
    conversation have a stored failed call instead of a reply."""
    reqs = _conv_requests(spark, sf)
    stored = syn.rot13_translate_backend(reqs)
    failed = F.pmod("page_id", F.lit(8)) == 7
    stored = stored.select(
        "request_id",
        "calls",
        F.when(~failed, F.col("content")).alias("content"),
        "finish_reason",
        F.when(failed, F.lit("gave up: rate limited")).alias("error"),
    )
    out = replay_backend(stored)(reqs)
    return out.select("request_id", *_long("page_id", "seg_no"), "content", "error")


def q_call_stage(spark, sf):
    """Segment requests through the live-call backend (paced,
    retried) with a stand-in model that fails some first calls and cuts some
    replies at the length limit."""
    opts = OPTIONS.with_(rate_limit=100000, rate_period_sec=1.0, backoff_init_delay=0.0)
    out = python_backend(syn.FlakyRotationModel(), opts)(_conv_requests(spark, sf))
    return out.select(
        "request_id",
        *_long("page_id", "seg_no", "calls"),
        "content",
        "finish_reason",
        truncated("finish_reason").alias("truncated"),
        "error",
    )


PACE = OPTIONS.with_(rate_limit=100, rate_period_sec=0.25, backoff_init_delay=0.01, backoff_jitter=0.0, backoff_key="request_id", retry_gather_sec=1.0, call_waves=1)


def q_call_openings(spark, sf):
    """The stored openings of a paced stage, failed calls and all, put through the
    rate check: no call opens within the period of the call ``limit`` before it."""
    work = WorkArea(spark)
    call_model(_conv_requests(spark, sf), python_backend(syn.FlakyRotationModel(), PACE), work, "paced")
    log = call_log(work, "paced").withColumn("opened_at", F.col("opened_at").cast("timestamp_ntz"))
    r = rate_check(log, "model", "opened_at", "request_id", PACE.rate_limit, PACE.rate_period_sec, bucket_sec=4 * PACE.rate_period_sec)
    return r.select("request_id", *_long("attempt"), "outcome", F.coalesce("breaks", F.lit(False)).alias("breaks"))


def q_streamed_replies(spark, sf):
    """Every document streamed back by the model, in pieces that are stored as
    rows; streams that broke go on from their last piece."""
    docs = _t(spark, sf, "documents").repartition(_cores(spark))
    reqs = syn.text_requests(docs, F.format_string("d-%d", "doc_id"), F.coalesce("text", F.lit("")))
    work, opts = WorkArea(spark), PACE.with_(rate_limit=1_000_000)
    out = call_model(reqs, python_backend(syn.StreamingEcho(), opts), work, "streamed")
    pieces = reply_pieces(work, "streamed").groupBy("request_id").agg(F.count(F.lit(1)).alias("pieces"), F.countDistinct("seq").alias("places"))
    return out.join(pieces, "request_id").select("request_id", *_long("calls", "pieces", "places"), "content", "finish_reason", "error")


def q_continued_replies(spark, sf):
    """Replies cut at a length are continued until they stop, with the
    reply so far as history."""
    turns = _t(spark, sf, "conversations").repartition(_cores(spark))
    reqs = syn.text_requests(turns, F.format_string("c-%d-%d", "conv_id", "turn"), F.col("text"))
    opts = PACE.with_(rate_limit=1_000_000)
    out = call_model(reqs, continued_backend(python_backend(syn.CutRotationModel(), opts), rounds=20), WorkArea(spark), "continued")
    return out.select("request_id", *_long("calls"), "content", "finish_reason", "error")


def q_shared_replies(spark, sf):
    """Equal requests are asked once, by the content of their messages; a second
    run finds all replies kept."""
    turns = _t(spark, sf, "conversations")
    reqs = syn.text_requests(turns, F.format_string("c-%d-%d", "conv_id", "turn"), F.substring("text", 1, 4))
    work, opts = WorkArea(spark), PACE.with_(rate_limit=1_000_000)
    backend = shared_backend(python_backend(syn.CutRotationModel(), opts), work.path("kept_replies"))
    first = call_model(reqs, backend, work, "first")
    asked = call_log(work, "first_once").count()
    second = call_model(reqs, backend, work, "second")
    both = first.select("request_id", "content").join(second.select("request_id", F.col("content").alias("again"), F.col("calls").alias("calls_again")), "request_id")
    return both.select("request_id", "content", "again", *_long("calls_again"), F.lit(asked).cast("long").alias("asked"))


def q_chunk_assembly(spark, sf):
    a = assemble_chunks(syn.reply_chunks(_t(spark, sf, "documents")))
    return a.select("request_id", "content", "role", "finish_reason", F.col("n_chunks").cast("long").alias("n_chunks"))


def q_rate_check(spark, sf):
    ev = _t(spark, sf, "events").select("event_id", "user_id", "ts")
    r = rate_check(ev, "user_id", "ts", "event_id", 3, 86400.0, bucket_sec=7 * 86400.0)
    return r.select(*_long("event_id", "user_id"), F.col("gap_sec").cast("double").alias("gap_sec"), "breaks")


def q_backoff(spark, sf):
    """The call log that the stage itself writes, and the delay after each call."""
    work = WorkArea(spark)
    call_model(_conv_requests(spark, sf), python_backend(syn.OftenFlakyModel(), PACE.with_(rate_limit=1_000_000)), work, "flaky")
    log = call_log(work, "flaky")
    b = backoff_schedule(log, "request_id", "opened_at", "attempt", "outcome", PACE, bucket_sec=60.0)
    return b.select("request_id", *_long("attempt"), "outcome", F.col("delay_sec").cast("double").alias("delay_sec"))


# ---------------------------------------------------------------- F
def q_parse_replies(spark, sf):
    r = syn.faulty_reply_texts(_t(spark, sf, "conversations"))
    r = with_parsed_reply(r, "content", "m", non_string="non_string")
    m = F.col("m")
    return r.select(
        *_long("conv_id", "turn"),
        F.when(m.isNotNull(), F.size(m)).cast("long").alias("n_keys"),
        F.try_element_at(m, F.lit("0")).alias("value_0"),
        "non_string",
    )


def q_match_replies(spark, sf):
    seg = segment_groups(_conv_groups(spark, sf), SMALL_MAX)
    return match_status(syn.reply_entries(seg), seg).select(*_long("page_id", "seg_no"), "key", "status")


# ---------------------------------------------------------------- G
def q_compact_unchanged(spark, sf):
    d = _t(spark, sf, "documents")
    c = compact_text("text")
    return d.select(
        *_long("doc_id"),
        c.alias("compact"),
        (c == compact_text(F.regexp_replace("text", r"\.", " ,"))).alias("same_punct"),
        (c == compact_text(F.concat("text", F.lit(" x")))).alias("same_appended"),
    )


PIECE = 150


def q_match_score(spark, sf):
    """G2 on page groups: every piece of 150 characters of every group text against
    itself with 0 to 3 characters appended that no text has, which scores
    2 |a| / (2 |a| + k) on the compacted piece."""
    g = page_groups(_pages(spark, sf)).select("page_id", "group_no", "text", F.ceil(F.length("text") / PIECE).cast("int").alias("n"))
    g = g.filter("n > 0").select("page_id", "group_no", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("piece"))
    a = F.substring(F.col("text"), F.col("piece") * PIECE + 1, F.lit(PIECE))
    g = g.select("page_id", "group_no", "piece", a.alias("a"), F.concat(a, F.repeat(F.lit("\u2603"), F.col("piece") % 4)).alias("b"))
    return with_match_score(g, "a", "b", "score").select(*_long("page_id", "group_no", "piece"), "score")


def with_inner_edits(groups: DataFrame) -> DataFrame:
    """Group texts beside a copy with edits inside: every fifth word dropped, every
    seventh reversed, two halves changed about where the group's number is odd."""
    words = F.split("text", " ")
    edited = F.transform(words, lambda w, i: F.when(i % 7 == 6, F.reverse(w)).when(i % 5 == 4, F.lit("")).otherwise(w))
    half = F.floor(F.size(words) / 2).cast("int")
    turned = F.when(F.col("group_no") % 2 == 1, F.concat(F.slice(edited, half + 1, F.size(words)), F.slice(edited, 1, half))).otherwise(edited)
    return groups.withColumn("edited", F.array_join(turned, " "))


def q_match_whole(spark, sf):
    """G2 on whole group texts with edits inside, of pages and of documents (whose lines
    are long enough for popular characters)."""
    markup = page_groups(syn.markup_pages(_t(spark, sf, "documents").repartition(_cores(spark)))).select("page_id", "group_no", "text", F.lit("documents").alias("origin"))
    both = page_groups(_pages(spark, sf)).select("page_id", "group_no", "text", F.lit("pages").alias("origin")).unionByName(markup)
    # a task's work grows faster than its texts: rows are dealt evenly by hash
    both = both.repartition(4 * _cores(spark), "origin", "page_id", "group_no")
    return with_match_score(with_inner_edits(both), "text", "edited", "score").select("origin", *_long("page_id", "group_no"), "score")


def q_fit_routes(spark, sf):
    r = route_groups(_markup_translated(spark, sf))
    return r.select(*_long("page_id", "group_no", "n_shreds"), "route")


def q_validate_fit(spark, sf):
    routed = route_groups(_markup_translated(spark, sf)).filter(F.col("route") == "multi").drop("route")
    reqs = fit_requests(routed, 0, OPTIONS)
    v = validate_fit(syn.faulty_fit_backend(reqs))
    return v.select(
        *_long("page_id", "group_no", "attempt"),
        "candidate",
        F.col("score").cast("double").alias("score"),
        F.split("reason", ",")[0].alias("reason_head"),
    )


def q_partial_fits(spark, sf):
    """Fits that differ from the translation in part, graded."""
    routed = route_groups(_markup_translated(spark, sf)).filter(F.col("route") == "multi").drop("route")
    v = validate_fit(syn.extended_fit_backend(fit_requests(routed, 0, OPTIONS))).filter("candidate")
    return grade_best(v).select(*_long("page_id", "group_no"), F.col("score").cast("double").alias("score"), "status")


def q_kept_report(spark, sf):
    """With ``"keep"`` a fault costs its own groups only: missing keys (M), keys that
    were not asked for (U) and unreadable segments (E) beside good ones."""
    opts = OPTIONS.with_(on_segment_error="keep", max_tokens=SMALL_MAX)
    r = translate_pages(_pages(spark, sf), syn.keyless_translate_backend, opts, syn.rot13_fit_backend).report
    return r.select(*_long("page_id", "s", "e", "m", "u", "x"), "page_status")


def q_fit_choice(spark, sf):
    c = syn.conversation_candidates(_t(spark, sf, "conversations"))
    g = grade_best(best_candidate(c.withColumn("shreds", F.lit(None).cast("array<struct<shred_no:int,frag_no:int,text:string>>"))))
    return g.select(*_long("page_id", "group_no", "attempt"), F.col("score").cast("double").alias("score"), "status")


# ---------------------------------------------------------------- H, I, J
def _markup_run(spark, sf):
    pages = syn.markup_pages(_t(spark, sf, "documents").repartition("doc_id"))  # texts are smaller than pages
    return translate_pages(pages, syn.faulty_translate_backend, OPTIONS, syn.faulty_fit_backend, clustered=True)


def q_rendered(spark, sf):
    return _markup_run(spark, sf).out_pages.select(*_long("page_id"), "html")


def q_report(spark, sf):
    r = _markup_run(spark, sf).report
    return r.select(*_long("page_id", "s", "c", "f", "e", "all", "m", "u", "x"), "page_status")


def q_translate_pages(spark, sf):
    pages = _pages(spark, sf)
    tr = translate_pages(pages, syn.rot13_translate_backend, OPTIONS, syn.rot13_fit_backend)
    return tr.report.select(*_long("page_id", "s", "c", "f", "e", "all", "m", "u", "x"), "page_status")


def q_rendered_texts(spark, sf):
    """H1, H2 on pages: the texts between the tags of every rendered page. Style
    text gets a ``>``, which must not be escaped where it is translated."""
    pages = _pages(spark, sf).withColumn("html", F.replace("html", F.lit("<style>"), F.lit("<style>a>b ")))
    out = translate_pages(pages, syn.rot13_translate_backend, OPTIONS, syn.rot13_fit_backend).out_pages
    body = F.regexp_replace(F.regexp_replace("html", r"(?s)<!--.*?-->", ""), r"(?is)<script[^>]*>.*?</script>", "")
    texts = F.filter(F.split(body, r"</?[A-Za-z!][^>]*>"), lambda t: ~t.rlike("\\A[ \n\u00a0]*\\z"))
    return out.select("page_id", F.posexplode(texts).alias("text_no", "text")).select(*_long("page_id", "text_no"), "text")


def q_page_faults(spark, sf):
    """A2, B1, I4: pages with faults by page_id - no content, no text, markup that
    the tokenizer refuses - beside good ones: what is reported and written."""
    kind = F.col("page_id") % 7
    pages = _pages(spark, sf).withColumn(
        "html", F.when(kind == 1, F.lit("")).when(kind == 2, F.concat(F.lit("<p>a<![foo[x]]>b</p>"), "html")).when(kind != 0, F.col("html")))
    tr = translate_pages(pages, syn.rot13_translate_backend, OPTIONS, syn.rot13_fit_backend)
    written = tr.out_pages.select("page_id", (F.length("html") == 0).alias("blank"))
    return tr.report.join(written, "page_id", "left").select(
        *_long("page_id", "s"), "page_status", F.col("blank").isNotNull().alias("written"), F.coalesce("blank", F.lit(False)).alias("blank"))


# ---------------------------------------------------------------- A
def q_tree_plan(spark, sf):
    p = _t(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("/data/src/"), F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)).alias("path")
    )
    plan = plan_tree(p, "/data/src", "/data/dst")
    done = plan.filter("page_id % 5 = 0").select("rel_path")  # targets that are there already
    t = plan_tree(p, "/data/src", "/data/dst", done)
    return t.select(*_long("page_id"), "rel_path", "ext", "action", "target_path")


QUERIES = {
    "page_shreds": q_page_shreds,
    "page_groups": q_page_groups,
    "markup_groups": q_markup_groups,
    "inline_tags": q_inline_tags,
    "group_tokens": q_group_tokens,
    "encoding_lookup": q_encoding_lookup,
    "segments_conversations": q_segments_conversations,
    "segments_pages": q_segments_pages,
    "skipped_conversations": q_skipped_conversations,
    "skipped_pages": q_skipped_pages,
    "segment_requests": q_segment_requests,
    "chat_history": q_chat_history,
    "fit_requests": q_fit_requests,
    "replay": q_replay,
    "call_stage": q_call_stage,
    "call_openings": q_call_openings,
    "streamed_replies": q_streamed_replies,
    "continued_replies": q_continued_replies,
    "shared_replies": q_shared_replies,
    "chunk_assembly": q_chunk_assembly,
    "rate_check": q_rate_check,
    "backoff": q_backoff,
    "parse_replies": q_parse_replies,
    "match_replies": q_match_replies,
    "compact_unchanged": q_compact_unchanged,
    "match_score": q_match_score,
    "match_whole": q_match_whole,
    "fit_routes": q_fit_routes,
    "validate_fit": q_validate_fit,
    "fit_choice": q_fit_choice,
    "partial_fits": q_partial_fits,
    "kept_report": q_kept_report,
    "rendered": q_rendered,
    "report": q_report,
    "translate_pages": q_translate_pages,
    "rendered_texts": q_rendered_texts,
    "page_faults": q_page_faults,
    "tree_plan": q_tree_plan,
}
