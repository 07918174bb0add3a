"""Column functions on text (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.options import COMPACT_CHARS, IGNORABLE_CHARS, TOKEN_PATTERN


_COMPACT = "[" + "".join("\\u%04x" % ord(ch) for ch in COMPACT_CHARS) + "]+"
_SIGMA = "\u03a3"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def drop_newlines(col) -> Column:
    """Newlines are deleted, not turned into spaces."""
    return F.regexp_replace(_c(col), "\n", "")


def is_ignorable(col) -> Column:
    """Text made only of newlines and no-break spaces is not a shred."""
    chars = "".join("\\u%04x" % ord(ch) for ch in IGNORABLE_CHARS)
    return _c(col).rlike(r"\A[" + chars + r"]*\z")


def token_count(col) -> Column:
    """C1 default counter: word runs plus single non-space symbols."""
    return F.size(F.regexp_extract_all(_c(col), F.lit(TOKEN_PATTERN), 0))


def compact_text(col) -> Column:
    """G1: drop spaces, newlines, tabs, commas (both widths) and dots; lower-case.

    One pattern instead of ``translate``, which looks every character up as a string of its own."""
    return F.lower(F.regexp_replace(_c(col), _COMPACT, ""))


def same_compact(left, right) -> Column:
    """``compact_text(left) == compact_text(right)``. Equal texts are compact alike; of others
    the beginnings are compared first: what they have left has to agree as far as the shorter
    goes. The last character left and texts with a capital sigma, whose lower case depends on
    what follows, are for the whole comparison."""
    a, b = _c(left), _c(right)
    heads = [F.translate(F.substring(c, 1, 16), COMPACT_CHARS, "") for c in (a, b)]
    n = F.least(*[F.length(h) for h in heads]) - 1
    x, y = (F.lower(F.substring(h, F.lit(1), n)) for h in heads)
    unlike = (n > 0) & (x != y) & ~F.contains(a, F.lit(_SIGMA)) & ~F.contains(b, F.lit(_SIGMA))
    return F.when(a == b, F.lit(True)).when(unlike, F.lit(False)).otherwise(compact_text(a) == compact_text(b))


def html_escape(col) -> Column:
    """Text as the tree serializer writes it (``&``, ``<``, ``>``)."""
    c = F.replace(_c(col), F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def rot13(col) -> Column:
    """Letter rotation used by the synthetic model of tests and bench."""
    src = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    dst = "nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM"
    return F.translate(_c(col), src, dst)


_ENCODERS: dict = {}


def _encoder(name: str):
    enc = _ENCODERS.get(name)
    if enc is None:
        import tiktoken

        enc = _ENCODERS[name] = tiktoken.get_encoding(name)
    return enc


def vocab_token_count(text, encoding) -> Column:
    """C1 with a real vocabulary: tokens of ``text`` under the ``encoding``
    column (see C2 ``with_encoding``), counted on Arrow batches with
    ``tiktoken``. Needs the vocabulary files where the tasks run; the
    default counter (``token_count``) needs nothing."""
    import pandas as pd
    from pyspark.sql import types as T

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series, encs: pd.Series) -> pd.Series:
        return pd.Series(
            [None if t is None else len(_encoder(e).encode(t, disallowed_special=())) for t, e in zip(texts, encs)],
            dtype="Int32",
        )

    return count(_c(text), _c(encoding) if not isinstance(encoding, str) else F.lit(encoding))
