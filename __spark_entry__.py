"""

``entry(spark)`` runs the flagship query (page translation with the offline
letter-rotation model) on sf0.001. ``queries()`` lists one query per operator
group (see ``tessera/plans/queries.py``); ``oracle_sql()`` gives the DuckDB
SQL that computes the same result straight from the raw tables.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from types import SimpleNamespace

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from tessera.plans.queries import QUERIES  # noqa: E402
from tessera.session import ensure_checkpoint_dir, ship_package  # noqa: E402

# The training-data operators are optional: without their folder, or without
# corpus_pipeline.py, everything else works as before.
LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}
try:
    from tessera.llm import registry as _llm

    LLM_QUERIES.update(_llm.QUERIES)
    LLM_ORACLES.update(_llm.ORACLES)
    import corpus_pipeline as _pipeline

    LLM_QUERIES["pipeline"] = _pipeline.run
    if _pipeline.ORACLE_SQL:
        LLM_ORACLES["pipeline"] = _pipeline.ORACLE_SQL
except ImportError as e:  # their folder, corpus_pipeline.py or a library of theirs is missing
    if e.name is None or e.name in ("tessera", "pyspark") or e.name.startswith(("tessera.", "pyspark.")) and not e.name.startswith("tessera.llm"):
        raise
    print(f"without the training-data operators: {e}", file=sys.stderr)

SF_SMOKE = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return QUERIES["translate_pages"](spark, SF_SMOKE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            ship_package(spark)
            return fn(spark, sf_dir)

        return run

    return {k: wrap(v) for k, v in (QUERIES | LLM_QUERIES).items()}


# ---------------------------------------------------------------------------
# SQL oracle
# ---------------------------------------------------------------------------
NL = "chr(10)"
PAT = r"'[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f\x0B]'"
ROT_FROM = "'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'"
ROT_TO = "'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM'"
# Fixed values that the expected results are made from, written out here so that the SQL
# does not depend on the engine's own settings.
INLINE_TAGS = (
    "a", "abbr", "acronym", "b", "bdo", "big", "br", "button", "cite", "code", "dfn", "em", "i", "img",
    "input", "kbd", "label", "map", "object", "output", "q", "samp", "script", "select", "small", "span",
    "strong", "sub", "sup", "textarea", "time", "tt", "var",
)
ENCODING_MAP = (
    ("gpt-4-0613", "cl100k_base"),
    ("gpt-4-1106-preview", "cl100k_base"),
    ("gpt-3.5-turbo", "cl100k_base"),
    ("text-embedding-ada-002", "cl100k_base"),
    ("text-davinci-002", "p50k_base"),
    ("text-davinci-003", "p50k_base"),
    ("davinci", "p50k_base"),
)
OPT = SimpleNamespace(
    source_language="English", target_language="Simplified Chinese", translate_model="gpt-4-1106-preview",
    translate_temperature=0.01, fit_temperature=0.01, max_tokens=1638,
    default_system_prompt="you are a helpful assistant.", backoff_exp_base=2.0,
)


def _tok(x: str) -> str:
    return f"len(regexp_extract_all({x}, {PAT}))"


def _rot(x: str) -> str:
    return f"translate({x}, {ROT_FROM}, {ROT_TO})"


def _compact(x: str) -> str:
    return f"lower(translate({x}, ' ' || chr(10) || chr(9) || ',，.', ''))"


def _esc_html(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _esc_json(x: str) -> str:
    return f"replace(replace({x}, '\\', '\\\\'), '\"', '\\\"')"


def _lit(s: str) -> str:
    parts = s.split("\n")
    return f" || {NL} || ".join("'" + p.replace("'", "''") + "'" for p in parts)


SHREDS_CTE = r"""
_c AS (
  SELECT page_id,
    regexp_replace(regexp_replace(regexp_replace(html,
      '(?s)<!--.*?-->', '<>', 'g'),
      '(?is)<script[^>]*>.*?</script>', '<>', 'g'),
      '(?i)<!doctype[^>]*>', '<>', 'g') AS h
  FROM pages
), _a AS (
  SELECT page_id, regexp_split_to_array(h, '<[^>]*>') AS arr FROM _c
), _p AS (
  SELECT page_id, unnest(arr) AS piece, generate_subscripts(arr, 1) AS pos FROM _a
), _d AS (
  SELECT page_id, pos,
    replace(replace(replace(replace(replace(replace(replace(piece,
      '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)),
      '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t
  FROM _p
), _w AS (
  SELECT page_id, pos,
    CASE WHEN regexp_full_match(t, '[ \t\n\r\f]+')
         THEN CASE WHEN contains(t, chr(10)) THEN chr(10) ELSE ' ' END
         ELSE t END AS t
  FROM _d
), shreds AS (
  SELECT page_id,
         row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS shred_no,
         replace(t, chr(10), '') AS text
  FROM _w WHERE NOT regexp_full_match(t, '[\n\x{00A0}]*')
)"""

# markup: one group per non-empty normalized line; words = shreds
MARKUP_CTE = r"""
_l AS (
  SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents
), _ln AS (
  SELECT doc_id, unnest(arr) AS line, generate_subscripts(arr, 1) AS ln FROM _l
), _n AS (
  SELECT doc_id, ln, trim(regexp_replace(line, '[ \t\r\f\x0B]+', ' ', 'g')) AS p FROM _ln
), mgroups AS (
  SELECT doc_id AS page_id,
         row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS group_no,
         p AS text,
         len(string_split(p, ' ')) AS n_shreds
  FROM _n WHERE p <> ''
), _wa AS (
  SELECT page_id, group_no, n_shreds, string_split(text, ' ') AS ws FROM mgroups
), mwords AS (
  SELECT page_id, group_no, n_shreds, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM _wa
), mshreds AS (
  SELECT page_id, group_no, n_shreds, i, w,
         CASE WHEN i % 2 = 1 THEN w
              ELSE (CASE WHEN i > 0 THEN ' ' ELSE '' END) || w || (CASE WHEN i < n_shreds - 1 THEN ' ' ELSE '' END)
         END AS s
  FROM mwords
)"""


def _packing_cte(groups_sql: str, max_tokens: int) -> str:
    """Recursive CTE: ``packed(page_id, group_no, n, seg_no, seg_key)``, seg null when oversize."""
    m = max_tokens
    return f"""
_g AS (
  SELECT page_id, group_no, n, row_number() OVER (PARTITION BY page_id ORDER BY group_no) - 1 AS idx
  FROM ({groups_sql})
), _tot AS (
  SELECT page_id, sum(n) AS total FROM _g GROUP BY page_id HAVING sum(n) > 0
), _tt AS (
  SELECT page_id, CAST(ceil(total / ceil(total / {m}.0e0)) AS BIGINT) AS target FROM _tot
), _r AS (
  SELECT g.page_id, g.idx, tt.target,
         CASE WHEN g.n > {m} THEN NULL ELSE 0 END AS seg_no,
         CASE WHEN g.n > {m} THEN NULL ELSE 0 END AS seg_key,
         CASE WHEN g.n > {m} THEN 0 ELSE g.n END AS run,
         CASE WHEN g.n > {m} THEN 0 ELSE 1 END AS k,
         0 AS cur
  FROM _g g JOIN _tt tt USING (page_id) WHERE g.idx = 0
  UNION ALL
  SELECT g.page_id, g.idx, r.target,
    CASE WHEN g.n > {m} THEN NULL WHEN r.run > r.target AND r.k > 0 THEN r.cur + 1 ELSE r.cur END,
    CASE WHEN g.n > {m} THEN NULL WHEN r.run > r.target AND r.k > 0 THEN 0 ELSE r.k END,
    CASE WHEN g.n > {m} THEN r.run WHEN r.run > r.target AND r.k > 0 THEN g.n ELSE r.run + g.n END,
    CASE WHEN g.n > {m} THEN r.k WHEN r.run > r.target AND r.k > 0 THEN 1 ELSE r.k + 1 END,
    CASE WHEN g.n > {m} THEN r.cur WHEN r.run > r.target AND r.k > 0 THEN r.cur + 1 ELSE r.cur END
  FROM _r r JOIN _g g ON g.page_id = r.page_id AND g.idx = r.idx + 1
), packed AS (
  SELECT g.page_id, g.group_no, g.n, r.seg_no, r.seg_key FROM _r r JOIN _g g USING (page_id, idx)
)"""


CONV_GROUPS = f"SELECT conv_id AS page_id, turn AS group_no, text, {_tok('text')} AS n FROM conversations"

_SYS_T = (
    f"You are an expert translator. Translate {OPT.source_language} text into fluent, natural "
    f"{OPT.target_language} of the quality a skilled human translator would give."
)
_USER_T_HEAD = (
    f"The JSON object below holds {OPT.source_language} text taken from one part of a single web page. "
    f"Translate every value into {OPT.target_language} and answer with a JSON object with the same keys. "
    "Leave function and command names (snake_case, PascalCase, camelCase) and any "
    "text that is not an ordinary sentence as it is.\n"
)
_SYS_F = (
    "You are an expert translator. Split a translation into parts and put each part "
    "into the matching field of a JSON object."
)


def _conv_requests_sql() -> str:
    return f"""
WITH RECURSIVE {_packing_cte(CONV_GROUPS, 200)},
_txt AS (SELECT conv_id AS page_id, turn AS group_no, replace(text, chr(10), '') AS t FROM conversations),
req AS (
  SELECT p.page_id, p.seg_no,
    '{{' || string_agg('"' || p.seg_key || '":"' || {_esc_json('t.t')} || '"', ',' ORDER BY p.seg_key) || '}}' AS payload,
    '{{' || string_agg('"' || p.seg_key || '":"' || {_esc_json(_rot('t.t'))} || '"', ',' ORDER BY p.seg_key) || '}}' AS rot_payload
  FROM packed p JOIN _txt t USING (page_id, group_no)
  WHERE p.seg_no IS NOT NULL
  GROUP BY p.page_id, p.seg_no
)"""


def _markup_fit_cte() -> str:
    """Fit class and status of every markup group under the faulty models."""
    return f"""
_gs AS (
  SELECT g.page_id, g.group_no, g.text, g.n_shreds, {_tok('g.text')} AS n,
    CASE WHEN {_tok('g.text')} > {OPT.max_tokens} THEN 'X'
         WHEN {_compact('g.text')} = {_compact(_rot('g.text'))} THEN 'S'
         WHEN g.n_shreds = 1 THEN 'S'
         WHEN (g.page_id + 3 * g.group_no) % 8 <= 5 THEN 'S'
         WHEN (g.page_id + 3 * g.group_no) % 8 = 6 THEN 'C'
         WHEN g.group_no % 2 = 0 THEN 'E'
         ELSE 'F' END AS status
  FROM mgroups g
), _pf AS (
  SELECT page_id, bool_or(status <> 'X') AND page_id % 8 = 7 AS failed FROM _gs GROUP BY page_id
), mstatus AS (
  SELECT d.doc_id AS page_id, coalesce(pf.failed, false) AS failed FROM documents d LEFT JOIN _pf pf ON pf.page_id = d.doc_id
)"""


def oracle_sql() -> dict[str, str]:
    inline = ", ".join(f"'{t}'" for t in INLINE_TAGS)
    enc_case = " ".join(f"WHEN '{m}' THEN '{e}'" for m, e in ENCODING_MAP)
    models = [m for m, _ in ENCODING_MAP] + ["local-model"]
    model_case = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(models))
    user_t_head = _lit(_USER_T_HEAD)
    sql: dict[str, str] = {}

    sql["page_shreds"] = f"""
WITH {SHREDS_CTE}
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(shred_no AS BIGINT) AS shred_no, text FROM shreds"""

    sql["page_groups"] = f"""
WITH {SHREDS_CTE}
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(shred_no AS BIGINT) AS group_no,
       CAST(1 AS BIGINT) AS n_shreds, text FROM shreds"""

    sql["markup_groups"] = f"""
WITH {MARKUP_CTE}
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(group_no AS BIGINT) AS group_no,
       CAST(n_shreds AS BIGINT) AS n_shreds, text FROM mgroups"""

    sql["inline_tags"] = rf"""
WITH c AS (
  SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
                                 '(?is)(<script[^>]*>).*?</script>', '\1', 'g') AS h
  FROM pages
), t AS (
  SELECT page_id, lower(unnest(regexp_extract_all(h, '<([a-zA-Z][^\t\n\r\f />\x00]*)', 1))) AS tag FROM c
)
SELECT CAST(page_id AS BIGINT) AS page_id,
       CAST(count(*) FILTER (WHERE tag IN ({inline})) AS BIGINT) AS n_inline,
       CAST(count(*) FILTER (WHERE tag NOT IN ({inline})) AS BIGINT) AS n_block
FROM t GROUP BY page_id"""

    sql["group_tokens"] = f"""
WITH {SHREDS_CTE},
g AS (SELECT page_id, count(*) AS n_groups, sum({_tok('text')}) AS total FROM shreds GROUP BY page_id)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(n_groups AS BIGINT) AS n_groups,
       CAST(total AS BIGINT) AS total_tokens,
       CAST(ceil(total / 200.0e0) AS BIGINT) AS n_seg,
       CAST(ceil(total / ceil(total / 200.0e0)) AS BIGINT) AS seg_target
FROM g WHERE total > 0"""

    sql["encoding_lookup"] = f"""
WITH m AS (SELECT conv_id, turn, text, CASE conv_id % 8 {model_case} END AS model FROM conversations)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, model,
       CASE model {enc_case} ELSE 'cl100k_base' END AS encoding,
       CAST({_tok('text')} AS BIGINT) AS n_tokens
FROM m"""

    sql["segments_conversations"] = f"""
WITH RECURSIVE {_packing_cte(CONV_GROUPS, 200)}
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(group_no AS BIGINT) AS group_no,
       CAST(seg_no AS BIGINT) AS seg_no, CAST(seg_key AS BIGINT) AS seg_key
FROM packed WHERE seg_no IS NOT NULL"""

    page_groups_sql = f"SELECT page_id, shred_no AS group_no, {_tok('text')} AS n FROM shreds"
    sql["segments_pages"] = f"""
WITH RECURSIVE {SHREDS_CTE}, {_packing_cte(page_groups_sql, 200)}
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(group_no AS BIGINT) AS group_no,
       CAST(seg_no AS BIGINT) AS seg_no, CAST(seg_key AS BIGINT) AS seg_key
FROM packed WHERE seg_no IS NOT NULL"""

    sql["skipped_conversations"] = f"""
WITH RECURSIVE {_packing_cte(CONV_GROUPS, 200)}
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(group_no AS BIGINT) AS group_no,
       CAST(n AS BIGINT) AS n_tokens, 'oversize' AS reason
FROM packed WHERE seg_no IS NULL"""

    sql["skipped_pages"] = f"""
WITH RECURSIVE {SHREDS_CTE}, {_packing_cte(page_groups_sql, 200)}
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(group_no AS BIGINT) AS group_no,
       CAST(n AS BIGINT) AS n_tokens, 'oversize' AS reason
FROM packed WHERE seg_no IS NULL"""

    sql["segment_requests"] = f"""
{_conv_requests_sql()}
SELECT 't-' || page_id || '-' || seg_no AS request_id,
       CAST(page_id AS BIGINT) AS page_id, CAST(seg_no AS BIGINT) AS seg_no,
       '{OPT.translate_model}' AS model, CAST({OPT.translate_temperature} AS DOUBLE) AS temperature,
       CAST(2 AS BIGINT) AS n_messages,
       {_lit(_SYS_T)} AS system_msg,
       {user_t_head} || payload || {NL} AS user_msg
FROM req"""

    sql["chat_history"] = f"""
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(0 AS BIGINT) AS pos, 'system' AS role,
       '{OPT.default_system_prompt}' AS content
FROM (SELECT DISTINCT conv_id FROM conversations WHERE role <> 'system')
UNION ALL
SELECT CAST(conv_id AS BIGINT) AS conv_id,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS pos, role, text AS content
FROM conversations WHERE role <> 'system'"""

    fit_user = (
        _lit('Translation:\n"""\n') + " || " + _rot("g.text") + " || "
        + _lit('\n"""\nOriginal text:\n"""\n') + " || g.text || "
        + _lit('\n"""\nThe original text is split into these pieces:\nJSON: """\n') + " || sj.j || "
        + _lit('\n"""\nSplit the translation the same way, one part per key, and drop no character of the translation.')
    )
    sql["fit_requests"] = f"""
WITH {MARKUP_CTE},
sj AS (
  SELECT page_id, group_no,
         '{{' || string_agg('"' || i || '":"' || {_esc_json('s')} || '"', ',' ORDER BY i) || '}}' AS j
  FROM mshreds GROUP BY page_id, group_no
)
SELECT 'f-' || g.page_id || '-' || g.group_no || '-0' AS request_id,
       CAST(g.page_id AS BIGINT) AS page_id, CAST(g.group_no AS BIGINT) AS group_no, CAST(0 AS BIGINT) AS attempt,
       CAST({OPT.fit_temperature} AS DOUBLE) AS temperature,
       {_lit(_SYS_F)} AS system_msg,
       {fit_user} AS user_msg
FROM mgroups g JOIN sj USING (page_id, group_no)
WHERE g.n_shreds > 1 AND {_compact('g.text')} <> {_compact(_rot('g.text'))}"""

    sql["replay"] = f"""
{_conv_requests_sql()}
SELECT 't-' || page_id || '-' || seg_no AS request_id,
       CAST(page_id AS BIGINT) AS page_id, CAST(seg_no AS BIGINT) AS seg_no,
       CASE WHEN page_id % 8 <> 7 THEN rot_payload END AS content,
       CASE WHEN page_id % 8 = 7 THEN 'gave up: rate limited' END AS error
FROM req"""

    sql["call_stage"] = f"""
{_conv_requests_sql()}
SELECT 't-' || page_id || '-' || seg_no AS request_id,
       CAST(page_id AS BIGINT) AS page_id, CAST(seg_no AS BIGINT) AS seg_no,
       CAST(CASE WHEN length(payload) % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS calls,
       rot_payload AS content,
       CASE WHEN length(payload) % 11 = 0 THEN 'length' ELSE 'stop' END AS finish_reason,
       length(payload) % 11 = 0 AS truncated,
       CAST(NULL AS VARCHAR) AS error
FROM req"""

    sql["chunk_assembly"] = """
SELECT 'd-' || doc_id AS request_id, text AS content, 'assistant' AS role, 'stop' AS finish_reason,
       CAST(greatest(ceil(length(text) / 40.0e0), 1) AS BIGINT) AS n_chunks
FROM documents"""

    sql["rate_check"] = """
WITH l AS (
  SELECT event_id, user_id,
         CAST(epoch_us(ts) - epoch_us(lag(ts, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS DOUBLE)
           / CAST(1000000 AS DOUBLE) AS gap_sec
  FROM events
)
SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS user_id, gap_sec,
       gap_sec < 86400 AS breaks
FROM l"""

    sql["backoff"] = f"""
{_conv_requests_sql()}, calls AS (
  SELECT 't-' || page_id || '-' || seg_no AS request_id, length(payload) % 4 AS failures,
         unnest(generate_series(0, length(payload) % 4)) AS attempt
  FROM req
)
SELECT request_id, CAST(attempt AS BIGINT) AS attempt, CASE WHEN attempt < failures THEN 'listed' ELSE 'ok' END AS outcome,
       CASE WHEN attempt < failures THEN CAST(0.01e0 * pow({OPT.backoff_exp_base}e0, attempt) AS DOUBLE) END AS delay_sec
FROM calls"""

    sql["call_openings"] = f"""
{_conv_requests_sql()}, calls AS (
  SELECT 't-' || page_id || '-' || seg_no AS request_id, CASE WHEN length(payload) % 7 = 0 THEN 1 ELSE 0 END AS failures,
         unnest(generate_series(0, CASE WHEN length(payload) % 7 = 0 THEN 1 ELSE 0 END)) AS attempt
  FROM req
)
SELECT request_id, CAST(attempt AS BIGINT) AS attempt, CASE WHEN attempt < failures THEN 'listed' ELSE 'ok' END AS outcome, FALSE AS breaks
FROM calls"""

    sql["streamed_replies"] = """
SELECT 'd-' || doc_id AS request_id,
       CAST(CASE WHEN length(t) % 3 = 0 AND length(t) > 2000 THEN 2 ELSE 1 END AS BIGINT) AS calls,
       CAST(greatest(ceil(length(t) / 1000.0e0), 1) AS BIGINT) AS pieces,
       CAST(greatest(ceil(length(t) / 1000.0e0), 1) AS BIGINT) AS places,
       t AS content, 'stop' AS finish_reason, CAST(NULL AS VARCHAR) AS error
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""

    sql["continued_replies"] = f"""
SELECT 'c-' || conv_id || '-' || turn AS request_id,
       CAST(greatest(ceil(length(text) / 150.0e0), 1) AS BIGINT) AS calls,
       {_rot('text')} AS content, 'stop' AS finish_reason, CAST(NULL AS VARCHAR) AS error
FROM conversations"""

    sql["shared_replies"] = f"""
SELECT 'c-' || conv_id || '-' || turn AS request_id, {_rot('substr(text, 1, 4)')} AS content, {_rot('substr(text, 1, 4)')} AS again,
       CAST(0 AS BIGINT) AS calls_again,
       (SELECT CAST(count(DISTINCT substr(text, 1, 4)) AS BIGINT) FROM conversations) AS asked
FROM conversations"""

    sql["parse_replies"] = """
WITH t AS (SELECT conv_id, turn, replace(text, chr(10), ' ') AS t FROM conversations)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
       CAST(CASE conv_id % 8 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 5 THEN 1 WHEN 6 THEN 1 WHEN 7 THEN 0 END AS BIGINT) AS n_keys,
       CASE conv_id % 8 WHEN 0 THEN t WHEN 1 THEN t WHEN 5 THEN t WHEN 6 THEN CAST(length(t) AS VARCHAR) END AS value_0,
       CASE WHEN conv_id % 8 IN (0, 1, 5, 7) THEN false WHEN conv_id % 8 = 6 THEN true END AS non_string
FROM t"""

    sql["match_replies"] = f"""
WITH RECURSIVE {_packing_cte(CONV_GROUPS, 200)}
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(seg_no AS BIGINT) AS seg_no, CAST(seg_key AS VARCHAR) AS key,
       CASE WHEN page_id % 3 = 1 AND seg_key = 0 THEN 'M' ELSE 'matched' END AS status
FROM packed WHERE seg_no IS NOT NULL
UNION ALL
SELECT CAST(page_id AS BIGINT), CAST(seg_no AS BIGINT), '99', 'U'
FROM packed WHERE seg_no IS NOT NULL AND page_id % 3 = 2 AND seg_key = 0"""

    sql["compact_unchanged"] = f"""
SELECT CAST(doc_id AS BIGINT) AS doc_id, {_compact('text')} AS compact,
       {_compact('text')} = {_compact("regexp_replace(text, '[.]', ' ,', 'g')")} AS same_punct,
       {_compact('text')} = {_compact("text || ' x'")} AS same_appended
FROM documents"""

    sql["fit_routes"] = f"""
WITH {MARKUP_CTE}
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(group_no AS BIGINT) AS group_no, CAST(n_shreds AS BIGINT) AS n_shreds,
       CASE WHEN {_compact('text')} = {_compact(_rot('text'))} THEN 'unchanged'
            WHEN n_shreds = 1 THEN 'single' ELSE 'multi' END AS route
FROM mgroups"""

    sql["validate_fit"] = f"""
WITH {MARKUP_CTE},
m AS (
  SELECT page_id, group_no, (page_id + 3 * group_no) % 8 AS cls FROM mgroups
  WHERE n_shreds > 1 AND {_compact('text')} <> {_compact(_rot('text'))}
)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(group_no AS BIGINT) AS group_no, CAST(0 AS BIGINT) AS attempt,
       NOT (cls = 4 OR (cls = 7 AND group_no % 2 = 1)) AS candidate,
       CAST(CASE WHEN cls = 4 OR (cls = 7 AND group_no % 2 = 1) THEN NULL WHEN cls = 6 THEN 0.0 ELSE 1.0 END AS DOUBLE) AS score,
       CASE WHEN cls = 4 OR (cls = 7 AND group_no % 2 = 1) THEN 'reply is not a JSON object of pieces'
            WHEN cls = 6 THEN 'piece count differs' ELSE '' END AS reason_head
FROM m"""

    sql["partial_fits"] = f"""
WITH {MARKUP_CTE}, p AS (
  SELECT page_id, group_no, (page_id + group_no) % 4 AS k, length({_compact(_rot('text'))}) AS n
  FROM mgroups WHERE n_shreds > 1 AND {_compact('text')} <> {_compact(_rot('text'))}
)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(group_no AS BIGINT) AS group_no,
       CASE WHEN k = 0 THEN 1.0e0 ELSE CAST(2 * n AS DOUBLE) / CAST(2 * n + k AS DOUBLE) END AS score,
       CASE WHEN k = 0 THEN 'S' ELSE 'C' END AS status
FROM p"""

    sql["kept_report"] = f"""
WITH RECURSIVE {SHREDS_CTE}, {_packing_cte(page_groups_sql, 200)}, g AS (
  SELECT page_id, seg_no, seg_key, (page_id + seg_no) % 4 AS cls FROM packed
), c AS (
  SELECT page_id,
         count(*) FILTER (WHERE cls IN (0, 2) OR (cls = 1 AND seg_key > 0)) AS s,
         count(*) FILTER (WHERE cls = 3) AS e,
         count(*) FILTER (WHERE cls = 1 AND seg_key = 0) AS m,
         count(*) FILTER (WHERE cls = 2 AND seg_key = 0) AS u,
         count(*) FILTER (WHERE seg_no IS NULL) AS x
  FROM g GROUP BY page_id
)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(coalesce(s, 0) AS BIGINT) AS s, CAST(coalesce(e, 0) AS BIGINT) AS e,
       CAST(coalesce(m, 0) AS BIGINT) AS m, CAST(coalesce(u, 0) AS BIGINT) AS u, CAST(coalesce(x, 0) AS BIGINT) AS x, 'ok' AS page_status
FROM pages LEFT JOIN c USING (page_id)"""

    sql["fit_choice"] = """
WITH c AS (
  SELECT conv_id, turn, CAST(length(text) % 11 AS DOUBLE) / CAST(10 AS DOUBLE) AS score FROM conversations
), b AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn ASC) AS rn FROM c
)
SELECT CAST(conv_id AS BIGINT) AS page_id, CAST(0 AS BIGINT) AS group_no, CAST(turn AS BIGINT) AS attempt,
       score, CASE WHEN score >= 1.0 THEN 'S' ELSE 'C' END AS status
FROM b WHERE rn = 1"""

    wrap = (
        "CASE WHEN s.i % 2 = 0 THEN {x} "
        "WHEN ((s.i - 1) // 2) % 3 = 0 THEN '<em>' || {x} || '</em>' "
        "WHEN ((s.i - 1) // 2) % 3 = 1 THEN '<code>' || {x} || '</code>' "
        "ELSE '<a href=\"#\">' || {x} || '</a>' END"
    )
    new_text = (
        "CASE WHEN g.status = 'S' THEN " + _rot("s.s")
        + " WHEN g.status = 'C' AND s.i = 0 THEN " + _rot("g.text")
        + " ELSE s.s END"
    )
    sql["rendered"] = f"""
WITH {MARKUP_CTE}, {_markup_fit_cte()},
ph AS (
  SELECT s.page_id, s.group_no,
         '<p>' || string_agg({wrap.format(x=_esc_html(new_text))}, '' ORDER BY s.i) || '</p>' AS h
  FROM mshreds s JOIN _gs g USING (page_id, group_no)
  GROUP BY s.page_id, s.group_no
), pg AS (
  SELECT page_id, string_agg(h, '' ORDER BY group_no) AS body FROM ph GROUP BY page_id
)
SELECT CAST(m.page_id AS BIGINT) AS page_id,
       '<!DOCTYPE html>' || chr(10) || '<html><body>' || coalesce(pg.body, '') || '</body></html>' AS html
FROM mstatus m LEFT JOIN pg USING (page_id)
WHERE NOT m.failed"""

    sql["report"] = f"""
WITH {MARKUP_CTE}, {_markup_fit_cte()},
cnt AS (
  SELECT page_id,
         count(*) FILTER (WHERE status = 'S') AS s, count(*) FILTER (WHERE status = 'C') AS c,
         count(*) FILTER (WHERE status = 'F') AS f, count(*) FILTER (WHERE status = 'E') AS e,
         count(*) FILTER (WHERE status = 'X') AS x
  FROM _gs GROUP BY page_id
)
SELECT CAST(m.page_id AS BIGINT) AS page_id,
       CAST(CASE WHEN m.failed THEN 0 ELSE coalesce(s, 0) END AS BIGINT) AS s,
       CAST(CASE WHEN m.failed THEN 0 ELSE coalesce(c, 0) END AS BIGINT) AS c,
       CAST(CASE WHEN m.failed THEN 0 ELSE coalesce(f, 0) END AS BIGINT) AS f,
       CAST(CASE WHEN m.failed THEN 0 ELSE coalesce(e, 0) END AS BIGINT) AS e,
       CAST(CASE WHEN m.failed THEN 0 ELSE coalesce(s, 0) + coalesce(c, 0) + coalesce(f, 0) + coalesce(e, 0) END AS BIGINT) AS "all",
       CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS u,
       CAST(CASE WHEN m.failed THEN 0 ELSE coalesce(x, 0) END AS BIGINT) AS x,
       CASE WHEN m.failed THEN 'failed' ELSE 'ok' END AS page_status
FROM mstatus m LEFT JOIN cnt USING (page_id)"""

    sql["translate_pages"] = f"""
WITH {SHREDS_CTE},
cnt AS (
  SELECT page_id, count(*) FILTER (WHERE {_tok('text')} <= {OPT.max_tokens}) AS s,
         count(*) FILTER (WHERE {_tok('text')} > {OPT.max_tokens}) AS x
  FROM shreds GROUP BY page_id
)
SELECT CAST(p.page_id AS BIGINT) AS page_id, CAST(coalesce(s, 0) AS BIGINT) AS s,
       CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS f, CAST(0 AS BIGINT) AS e,
       CAST(coalesce(s, 0) AS BIGINT) AS "all", CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS u,
       CAST(coalesce(x, 0) AS BIGINT) AS x, 'ok' AS page_status
FROM pages p LEFT JOIN cnt USING (page_id)"""

    sql["tree_plan"] = r"""
WITH p AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS rel_path FROM pages
), e AS (
  SELECT page_id, rel_path, regexp_extract(regexp_extract(rel_path, '[^/]*$', 0), '^.*?[^.].*(\.[^.]*)$', 1) AS ext FROM p
)
SELECT CAST(page_id AS BIGINT) AS page_id, rel_path, ext,
       CASE WHEN ext = '.html' THEN 'translate' ELSE 'copy' END AS action,
       '/data/dst/' || rel_path AS target_path
FROM e WHERE rel_path NOT IN (SELECT rel_path FROM e WHERE page_id % 5 = 0)"""

    # only the pages' text is compared: what the tags are is seen in page_shreds
    rot = _rot("text")
    rotated = f"CASE WHEN text LIKE 'a>b %' THEN {rot} ELSE replace(replace(replace({rot}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END"
    styled = SHREDS_CTE.replace("regexp_replace(regexp_replace(regexp_replace(html,", "regexp_replace(regexp_replace(regexp_replace(replace(html, '<style>', '<style>a>b '),")
    sql["rendered_texts"] = f"""
WITH {styled}
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(shred_no AS BIGINT) AS text_no, {rotated} AS text FROM shreds"""

    sql["page_faults"] = f"""
WITH {SHREDS_CTE},
n AS (SELECT page_id, count(*) FILTER (WHERE {_tok('text')} <= {OPT.max_tokens}) AS s FROM shreds GROUP BY page_id)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(CASE WHEN page_id % 7 > 2 THEN coalesce(s, 0) ELSE 0 END AS BIGINT) AS s,
       CASE WHEN page_id % 7 IN (0, 2) THEN 'failed' ELSE 'ok' END AS page_status,
       page_id % 7 NOT IN (0, 2) AS written, page_id % 7 = 1 AS blank
FROM pages LEFT JOIN n USING (page_id)"""

    sql["match_score"] = f"""
WITH {SHREDS_CTE},
p AS (
  SELECT page_id, shred_no, text, unnest(range(0, CAST(ceil(length(text) / 150.0e0) AS BIGINT))) AS piece FROM shreds
), c AS (
  SELECT page_id, shred_no, piece, length({_compact('substr(text, piece * 150 + 1, 150)')}) AS n, piece % 4 AS k FROM p
)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(shred_no AS BIGINT) AS group_no, CAST(piece AS BIGINT) AS piece,
       CASE WHEN n + k = 0 THEN 1.0e0 ELSE 2.0e0 * n / (2.0e0 * n + k) END AS score
FROM c"""
    return sql | LLM_ORACLES
