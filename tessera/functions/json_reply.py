"""Reading a model reply as a strict JSON object of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def extract_object(col) -> Column:
    """text from the first ``{`` to the last ``}`` (across lines); '' if none."""
    return F.regexp_extract(_c(col), r"(?s)\{.*\}", 0)


def strip_trailing_commas(col) -> Column:
    """a comma before ``}`` is removed (also inside strings, as in the rule)."""
    return F.regexp_replace(_c(col), r",\s*\}", "}")


def reply_object(col) -> Column:
    """F1 + F2: the JSON text that is handed to the parser."""
    return strip_trailing_commas(extract_object(col))


_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def computed_once(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the named columns behind a generated row: a filter on them stays above.
    Moved below, it would hold (and evaluate for every row) a copy of all that they are
    made from for each mention of it, down to the parsed text."""
    rest = [c for c in df.columns if c not in names]
    one = df.select(*rest, F.explode(F.array(F.struct(*names))).alias("_once"))
    return one.select(*[F.col(f"_once.{c}").alias(c) if c in names else F.col(c) for c in df.columns])


def _cmp(a, b):
    return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0))


def _dedup_last(df: DataFrame, m: str, out: str) -> DataFrame:
    """``out`` = map column ``m`` with duplicate keys resolved last-wins (as Python dicts).

    ``from_json`` keeps every entry. Maps without a repeated key (checked
    with built-in, code-generated functions) pass unchanged; the others are
    sorted by (key, position) and an entry is kept when the next one has
    another key: O(n log n), for any value type. No lambda refers to
    anything but its own arguments, so inlining by the optimizer cannot make
    it quadratic.
    """
    entries = F.transform(
        F.map_entries(F.col(m)), lambda x, i: F.struct(x["key"].alias("k"), i.alias("i"), x["value"].alias("v"))
    )
    srt = F.array_sort(
        entries,
        lambda a, b: F.when(a["k"] != b["k"], _cmp(a["k"], b["k"])).otherwise(_cmp(a["i"], b["i"])),
    )
    t = f"_dd_{out}"
    has_dups = F.size(F.array_distinct(F.map_keys(F.col(m)))) < F.size(F.col(m))
    # the sort only runs for the (rare) maps that repeat a key
    df = df.withColumn(t, F.when(has_dups, srt))
    s = F.col(t)
    last = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))),
                      lambda x, y: F.when(y.isNull() | (y["k"] != x["k"]), x))
    kept = F.filter(last, lambda x: x.isNotNull())
    df = df.withColumn(
        out,
        F.when(F.col(m).isNull(), F.lit(None))
        .when(
            F.col(t).isNotNull(),
            F.map_from_entries(F.transform(kept, lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value")))),
        )
        .otherwise(F.col(m)),
    )
    return df.drop(t)


# a JSON string token, written as an unrolled loop (no deep regex recursion)
_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def has_non_string_value(col) -> Column:
    """True when the reply object holds a value that is not a JSON string.

    Linear check on the extracted object text: every string token is blanked
    to ``""``; a value that is not a string then shows as a ``:`` followed by
    something other than a quote. Only meaningful for readable objects. (With
    a duplicated key it looks at every occurrence, not only the last.)
    """
    return _non_string_value(_blanked(reply_object(col)))


def _blanked(obj) -> Column:
    return F.regexp_replace(_c(obj), _JSON_STRING, '""')


def _non_string_value(blanked) -> Column:
    return _c(blanked).rlike(r':\s*+[^"\s]')


def has_trailing_text(col) -> Column:
    """True when text follows the first complete top-level object.

    The JSON reader stops after the first value and ignores the rest, so
    ``{"0":"a"}] }`` would pass; Python's parser rejects it. Strings are
    blanked and everything that is no bracket becomes one mark; the depth is
    then counted bracket by bracket, so the rule holds at any depth: something
    that comes when the depth is back at zero is trailing text. Objects without
    inner brackets (nearly all) are judged by one pattern.
    """
    return _trailing_text(_blanked(reply_object(col)))


def _trailing_text(blanked) -> Column:
    blanked = _c(blanked)
    flat = blanked.rlike(r"^\{[^{}\[\]]*+\}$")
    marks = F.split(F.regexp_replace(F.regexp_replace(blanked, r"\s++", ""), r"[^{}\[\]]++", "x"), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("begun"), F.lit(False).alias("after"))
    counted = F.aggregate(
        marks, start,
        lambda a, c: F.struct(
            (a["depth"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("depth"),
            F.lit(True).alias("begun"),
            (a["after"] | (a["begun"] & (a["depth"] == 0) & (c != ""))).alias("after"),
        ),
        lambda a: a["after"],
    )
    return F.when(flat, F.lit(False)).otherwise(counted)


def with_parsed_reply(df: DataFrame, content: str = "content", out: str = "reply",
                      non_string: str | None = None, variants: str | None = None) -> DataFrame:
    """Adds ``out`` = reply text as ``map<string,string>``, null when it
    is not one JSON object.

    Wrapping the object in ``[...]`` and requiring exactly one element rejects
    ``{..} text {..}``; single quotes and NaN are rejected by the options.
    Duplicate keys: the last one wins. Non-string values arrive as their JSON
    text; ``non_string`` (optional) flags objects holding any value that is
    not a JSON string (null included). ``variants`` (optional) holds the
    values as variants for per-key checks, only for objects that have a
    non-string value (null otherwise).
    """
    obj, blank = f"_obj_{out}", f"_blank_{out}"  # the object is cut out and blanked once
    df = df.withColumn(obj, reply_object(content))
    df = df.withColumn(blank, _blanked(obj))
    j = F.concat(F.lit("["), F.col(obj), F.lit("]"))
    arr = F.from_json(j, "array<map<string,string>>", _STRICT)
    tmp = f"_raw_{out}"
    df = df.withColumn(tmp + "a", arr)
    df = df.withColumn(
        tmp, F.when((F.size(tmp + "a") == 1) & ~_trailing_text(blank), F.get(F.col(tmp + "a"), 0))
    )
    df = _dedup_last(df, tmp, out).drop(tmp, tmp + "a")
    flag = non_string or f"_ns_{out}"
    df = df.withColumn(flag, F.when(F.col(out).isNotNull(), _non_string_value(blank)))
    if variants:
        va = F.from_json(j, "array<map<string,variant>>", _STRICT)
        vt = f"_rawv_{out}"
        df = df.withColumn(vt, F.when(F.col(flag), F.get(va, 0)))
        df = _dedup_last(df, vt, variants).drop(vt)
    if not non_string:
        df = df.drop(flag)
    return df.drop(obj, blank)


def numbered_keys(m) -> Column:
    """True for a map whose keys are 0, 1, 2, ... in that order: its values are in integer key
    order as they are. (As many keys as numbers, so none of them holds a comma.)"""
    n = F.size(_c(m))
    return F.coalesce((n > 0) & (F.array_join(F.map_keys(_c(m)), ",") == F.array_join(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1).cast("array<string>"), ",")), F.lit(False))


def int_key_order(m) -> Column:
    """G6 order: entries of a piece map sorted by integer key (``k`` null when not an integer)."""
    keyed = F.transform(
        F.map_entries(_c(m)),
        lambda e: F.struct(e["key"].try_cast("int").alias("k"), e["key"].alias("key"), e["value"].alias("value")),
    )
    return F.array_sort(keyed)
