"""B1: HTML page -> ordered fragment rows (the only parser step).

Each page row becomes one row per token of the parsed tree: start tag, text,
end tag, comment, doctype. Every fragment carries its parent, its index among
the parent's children, whether it is an inline element, and ``owner_block``,
the nearest enclosing element that is not inline. Grouping, numbering and
rendering are then plain window, aggregate and join work on these rows.

Tree building follows the stdlib ``html.parser`` tokenizer with the usual
tree-builder rules: tag names lower-cased, entities decoded, an end tag
closes up to the nearest open element of that name (unmatched ones are
ignored), void elements hold no children, whitespace-only text outside
``pre``/``textarea`` collapses to a newline (if it has one) or one space.
Every step is constant work per token, so a page costs time in its length.

A page that cannot be read (null, or markup that the tokenizer refuses) gets no
fragments but an error; the other pages of its task are not affected.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.options import IGNORABLE_CHARS, INLINE_TAGS, PRESERVE_WHITESPACE_TAGS, RAW_TEXT_TAGS, SKIPPED_TAGS, VOID_TAGS

FRAGMENT_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType(), False),
        T.StructField("frag_no", T.IntegerType(), False),
        # start | end | text | cdata | decl | pi | comment | doctype
        T.StructField("kind", T.StringType(), False),
        # element name for start/end; name of the parent element otherwise
        T.StructField("tag", T.StringType(), True),
        T.StructField("node_id", T.IntegerType(), False),
        T.StructField("parent_id", T.IntegerType(), False),
        T.StructField("child_idx", T.IntegerType(), False),
        T.StructField("is_inline", T.BooleanType(), False),
        T.StructField("owner_block", T.IntegerType(), False),
        # inside a skipped (script) subtree
        T.StructField("skip", T.BooleanType(), False),
        # text is raw (script/style): written back without escaping
        T.StructField("raw", T.BooleanType(), False),
        # serialized form of this token; null for plain text, whose form is
        # its text (escaped unless raw), so text is stored once
        T.StructField("src", T.StringType(), True),
        # string value of text-like nodes
        T.StructField("text", T.StringType(), True),
    ]
)

_INLINE = frozenset(INLINE_TAGS)
_VOID = frozenset(VOID_TAGS)
_PRESERVE = frozenset(PRESERVE_WHITESPACE_TAGS)
_RAW = frozenset(RAW_TEXT_TAGS)
_SKIP = frozenset(SKIPPED_TAGS)
_ASCII_SPACES = "\x20\x0a\x09\x0c\x0d"
#: Inline elements that hold ordinary text.
_INLINE_TEXT = _INLINE - _VOID - _PRESERVE - _RAW - _SKIP
ROOT_ID = -1


def _escape_text(s: str) -> str:
    if "&" not in s and "<" not in s and ">" not in s:
        return s
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _quote_attr(v: str) -> str:
    v = _escape_text(v)
    if '"' in v:
        if "'" in v:
            return '"' + v.replace('"', "&quot;") + '"'
        return "'" + v + "'"
    return '"' + v + '"'


def render_start_tag(name: str, attrs: dict, void: bool) -> str:
    if not attrs:
        return f"<{name}/>" if void else f"<{name}>"
    parts = [name]
    for k in sorted(attrs):
        parts.append(f"{k}={_quote_attr(attrs[k])}")
    return "<" + " ".join(parts) + ("/>" if void else ">")


#: A plain tag - a name, attributes in double quotes without entities - and the text after it.
_PLAIN = re.compile(r'<(/?)([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][-a-zA-Z0-9]*="[^"<>&]*")*)>([^<&]*)')
#: A whole plain element with text only, and the text after it.
_LEAF = re.compile(r'<([a-zA-Z][a-zA-Z0-9]*+)((?: [a-zA-Z][-a-zA-Z0-9]*+="[^"<>&]*+")*+)>([^<&]*+)</\1>([^<&]*+)')
#: A run of whole plain inline elements that hold ordinary text only, and the texts between them.
_LEAVES = re.compile(r'(?:<(' + "|".join(sorted(_INLINE_TEXT, key=len, reverse=True)) + r')(?: [a-zA-Z][-a-zA-Z0-9]*+="[^"<>&]*+")*+>[^<&]*+</\1>[^<&]*+)++')
_PLAIN_ATTRS = re.compile(r' ([^=]+)="([^"]*)"')
#: Kinds of leaves that may be shreds.
TEXT_KINDS = ("text", "cdata", "decl", "pi")


@lru_cache(4096)
def _plain_tag(name: str, attrs: str) -> tuple[str, str]:
    """Name and serialized form of a plain start tag."""
    name = name.lower()
    return name, render_start_tag(name, {k.lower(): v for k, v in _PLAIN_ATTRS.findall(attrs)}, name in _VOID)


class _Node:
    __slots__ = ("name", "node_id", "inline", "n_children", "owner", "child_owner", "skip", "child_idx")

    def __init__(self, name, node_id, inline, owner, skip, child_idx):
        self.name = name
        self.node_id = node_id
        self.inline = inline
        self.n_children = 0
        self.owner = owner
        self.child_owner = owner if inline else node_id
        self.skip = skip
        self.child_idx = child_idx


class PageTokenizer(HTMLParser):
    """Builds the fragment list of one page (``rows``, unless ``keep_rows`` is off) and its
    marks: what moves the grouping on, as ``(frag_no, owner_block, text)``, the text null
    for a tag that splits its block (``tessera.operators.groups``)."""

    def __init__(self, keep_rows: bool = True):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.keep_rows = keep_rows
        self.n = 0  # fragments so far
        self.marks: list[tuple] = []
        root = _Node("[document]", ROOT_ID, False, ROOT_ID, False, 0)
        self.stack: list[_Node] = [root]
        self.buf: list[str] = []
        self.open_names: Counter[str] = Counter()
        self.closed_void: Counter[str] = Counter()
        self.preserve_depth = 0

    # -- helpers -----------------------------------------------------------
    def _add_leaf(self, kind: str, text: str, src: str, raw: bool = False):
        p = self.stack[-1]
        idx = p.n_children
        p.n_children = idx + 1
        fid = self.n
        self.n = fid + 1
        if not p.skip and kind in TEXT_KINDS and text.strip(IGNORABLE_CHARS):
            self.marks.append((fid, p.child_owner, text))
        if self.keep_rows:
            self.rows.append((fid, kind, p.name, fid, p.node_id, idx, False, p.child_owner, p.skip, raw, src, text))

    def flush(self):
        buf = self.buf
        if not buf:
            return
        data = buf[0] if len(buf) == 1 else "".join(buf)
        buf.clear()
        if not self.preserve_depth and not data.strip(_ASCII_SPACES):
            data = "\n" if "\n" in data else " "
        self._add_leaf("text", data, None, self.stack[-1].name in _RAW)

    def _open(self, name: str, src: str, void_self_close: bool):
        if self.buf:
            self.flush()
        p = self.stack[-1]
        idx = p.n_children
        p.n_children = idx + 1
        fid = self.n
        self.n = fid + 1
        inline = name in _INLINE
        owner = p.child_owner
        skip = p.skip or name in _SKIP
        if not inline and not skip and p.node_id == owner:
            self.marks.append((fid, owner, None))
        if self.keep_rows:
            self.rows.append((fid, "start", name, fid, p.node_id, idx, inline, owner, skip, False, src, None))
        self.stack.append(_Node(name, fid, inline, owner, skip, idx))
        self.open_names[name] += 1
        if name in _PRESERVE:
            self.preserve_depth += 1
        if void_self_close and name in _VOID:
            self._pop_to(name)
            self.closed_void[name] += 1

    def _add_inline(self, name: str, src: str, text: str):
        """An inline element with text only: what opening it, its text and closing it give."""
        if self.buf:
            self.flush()
        p = self.stack[-1]
        idx = p.n_children
        p.n_children = idx + 1
        owner, skip, fid = p.child_owner, p.skip, self.n
        if text and not self.preserve_depth and not text.strip(_ASCII_SPACES):
            text = "\n" if "\n" in text else " "
        if text and not skip and text.strip(IGNORABLE_CHARS):
            self.marks.append((fid + 1, owner, text))
        self.n = fid + (3 if text else 2)
        if self.keep_rows:
            self.rows.append((fid, "start", name, fid, p.node_id, idx, True, owner, skip, False, src, None))
            if text:
                self.rows.append((fid + 1, "text", name, fid + 1, fid, 0, False, owner, skip, False, None, text))
            self.rows.append((self.n - 1, "end", name, fid, p.node_id, idx, True, owner, skip, False, f"</{name}>", None))

    def _add_leaves(self, found: list[tuple[str, str, str, str]]):
        """A run of inline elements with text only, and the texts after them (the last of
        which may go on), for a tokenizer that keeps marks only."""
        if self.buf:
            self.flush()
        p = self.stack[-1]
        owner, n, marks, kept = p.child_owner, self.n, self.marks, not p.skip
        collapsed = not self.preserve_depth
        last = len(found) - 1
        for k, (_, _, inner, text) in enumerate(found):
            if inner:
                if inner.isspace():  # what isn't has characters of every kind that counts
                    if collapsed and not inner.strip(_ASCII_SPACES):
                        inner = "\n" if "\n" in inner else " "
                    if kept and inner.strip(IGNORABLE_CHARS):
                        marks.append((n + 1, owner, inner))
                elif kept:
                    marks.append((n + 1, owner, inner))
                n += 3
            else:
                n += 2
            p.n_children += 1
            if not text:
                continue
            if k == last:
                self.buf.append(text)
                break
            if text.isspace():
                if collapsed and not text.strip(_ASCII_SPACES):
                    text = "\n" if "\n" in text else " "
                if kept and text.strip(IGNORABLE_CHARS):
                    marks.append((n, owner, text))
            elif kept:
                marks.append((n, owner, text))
            n += 1
            p.n_children += 1
        self.n = n

    def _pop_one(self):
        n = self.stack.pop()
        name = n.name
        self.open_names[name] -= 1
        if name in _PRESERVE:
            self.preserve_depth -= 1
        if self.keep_rows:
            src = "" if name in _VOID else f"</{name}>"
            self.rows.append((self.n, "end", name, n.node_id, self.stack[-1].node_id, n.child_idx, n.inline, n.owner, n.skip, False, src, None))
        self.n += 1

    def _pop_to(self, name: str):
        """Close up to the nearest open element of that name, if there is one."""
        if not self.open_names[name]:
            return
        last = None
        while last != name:
            last = self.stack[-1].name
            self._pop_one()

    # -- parser steps ------------------------------------------------------
    def updatepos(self, i, j):
        return j  # line numbers are not asked for

    def parse_starttag(self, i):
        """A run of plain tags and texts in one loop; other markup is left to the parser."""
        start = i
        rawdata, buf = self.rawdata, self.buf
        while True:
            if not self.keep_rows:
                m = _LEAVES.match(rawdata, i)
                if m is not None:
                    self._add_leaves(_LEAF.findall(rawdata, i, m.end()))
                    i = m.end()
                    continue
            m = _LEAF.match(rawdata, i)
            if m is not None:
                name, attrs, inner, text = m.groups()
                name, src = _plain_tag(name, attrs)
                if name in _INLINE_TEXT:
                    self._add_inline(name, src, inner)
                    if text:
                        buf.append(text)
                    i = m.end()
                    continue
            m = _PLAIN.match(rawdata, i)
            if m is None:
                return i if i > start else super().parse_starttag(i)
            close, name, attrs, text = m.groups()
            if close:
                if attrs:
                    return i
                self.handle_endtag(name.lower())
            else:
                name, src = _plain_tag(name, attrs)
                self._open(name, src, True)
                if name in self.CDATA_CONTENT_ELEMENTS:
                    self.set_cdata_mode(name)
                    return m.start(4)
            if text:
                buf.append(text)
            i = m.end()

    # -- parser callbacks --------------------------------------------------
    def _open_parsed(self, tag, attrs, void_self_close):
        self._open(tag, render_start_tag(tag, {k: "" if v is None else v for k, v in attrs}, tag in _VOID), void_self_close)

    def handle_starttag(self, tag, attrs):
        self._open_parsed(tag, attrs, True)

    def handle_startendtag(self, tag, attrs):
        self._open_parsed(tag, attrs, False)
        self.handle_endtag(tag)

    def handle_endtag(self, tag, check_closed: bool = True):
        if check_closed and self.closed_void[tag]:
            # the redundant end tag of a void element: dropped without ending the text
            self.closed_void[tag] -= 1
            return
        if self.buf:
            self.flush()
        self._pop_to(tag)

    def handle_data(self, data):
        self.buf.append(data)

    def handle_comment(self, data):
        self.flush()
        self._add_leaf("comment", data, f"<!--{data}-->")

    def handle_decl(self, decl):
        self.flush()
        data = decl[len("DOCTYPE "):] if decl.startswith("DOCTYPE ") else decl
        # the serializer ends a doctype with a newline
        self._add_leaf("doctype", data, f"<!DOCTYPE {data}>\n")

    def unknown_decl(self, data):
        self.flush()
        if data.upper().startswith("CDATA["):
            body = data[len("CDATA["):]
            self._add_leaf("cdata", body, f"<![CDATA[{body}]]>")
        else:
            self._add_leaf("decl", data, f"<?{data}?>")

    def handle_pi(self, data):
        self.flush()
        self._add_leaf("pi", data, f"<?{data}>")

    def finish(self) -> list[tuple]:
        self.close()
        self.flush()
        while len(self.stack) > 1:
            self._pop_one()
        return self.rows


def page_marks(html: str) -> list[tuple]:
    """The marks of one page: its shreds and the tags that split their block."""
    t = PageTokenizer(keep_rows=False)
    t.feed(html)
    t.finish()
    return t.marks


def try_marks(html: str | None, known: str | None = None) -> tuple[list[tuple], str | None]:
    """(marks, None) of a page or ([], error); ``known``: an error found before."""
    if known or html is None:
        return [], known or "page has no content"
    try:
        return page_marks(html), None
    except Exception as e:  # noqa: BLE001 - as in ``_try_tokenize``
        return [], f"page not readable: {type(e).__name__}: {e}"


def tokenize_html(html: str) -> list[tuple]:
    """Fragments of one page as tuples in FRAGMENT_SCHEMA order (no page_id)."""
    t = PageTokenizer()
    t.feed(html)
    return t.finish()


PAGE_ROWS_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType(), True),
        T.StructField("page_error", T.StringType(), True),
        # every field of a fragment but page_id; empty for an empty page, null for a page with an error
        T.StructField("frags", T.ArrayType(T.StructType(FRAGMENT_SCHEMA.fields[1:])), True),
    ]
)


def _try_tokenize(html: str | None) -> tuple[list[tuple] | None, str | None]:
    """(fragments, None) of a page or (None, error): one odd page must not end the run."""
    if html is None:
        return None, "page has no content"
    try:
        return tokenize_html(html), None
    except Exception as e:  # noqa: BLE001 - whatever the tokenizer raises is that page's result
        return None, f"page not readable: {type(e).__name__}: {e}"


def _page_batches(batches, max_rows: int = 65536):
    """mapInArrow body: Arrow batches of pages in, one row per page out, in
    batches of about ``max_rows`` fragments."""
    import numpy as np
    import pyarrow as pa

    types = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.BooleanType: pa.bool_()}
    fields = [pa.field(f.name, types[type(f.dataType)], f.nullable) for f in FRAGMENT_SCHEMA.fields[1:]]
    ids, errors, sizes, cols = [], [], [], [[] for _ in fields]

    def take():
        flat = pa.StructArray.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, fields)], fields=fields)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([e is not None for e in errors]))
        out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(errors, pa.string()), lists], ["page_id", "page_error", "frags"])
        for c in (ids, errors, sizes, *cols):
            c.clear()
        return out

    for batch in batches:
        for page_id, html, known in zip(*(c.to_pylist() for c in batch.columns)):
            rows, error = (None, known) if known else _try_tokenize(html)
            ids.append(page_id)
            errors.append(error)
            sizes.append(len(rows or ()))
            for c, values in zip(cols, zip(*(rows or ()))):
                c.extend(values)
            if len(cols[0]) >= max_rows:
                yield take()
    if ids:
        yield take()


def page_rows(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """B1: ``pages(page_id, html)`` -> one row per page (PAGE_ROWS_SCHEMA).

    Tokenizing is Python work, so it wants as many tasks as there are cores;
    with ``partitions`` the pages are spread round-robin over that many first
    (for a table of few row groups). Without it nothing is shuffled. A column
    ``page_error`` of the input (a file that could not be read) is kept.
    """
    known = F.col("page_error") if "page_error" in pages.columns else F.lit(None).cast("string")
    p = pages.select("page_id", "html", known.alias("page_error"))
    if partitions:
        p = p.repartition(partitions)
    return p.mapInArrow(_page_batches, PAGE_ROWS_SCHEMA)


def page_fragments(rows: DataFrame) -> DataFrame:
    """``page_rows`` -> ``fragments`` (FRAGMENT_SCHEMA), in document order per page."""
    f = rows.select("page_id", F.explode("frags").alias("f"))
    return f.select("page_id", "f.*")


def fragments(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """B1: ``pages(page_id, html)`` -> ``fragments``; see ``page_rows``."""
    return page_fragments(page_rows(pages, partitions))


def page_errors(rows: DataFrame) -> DataFrame:
    """``page_rows`` -> ``(page_id, error)`` of the pages that could not be read."""
    return rows.filter(F.col("page_error").isNotNull()).select("page_id", F.col("page_error").alias("error"))


def read_errors(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """``page_errors`` straight from pages: nothing but the errors leaves a task."""
    import pyarrow as pa

    def errors(batches):
        for batch in batches:
            found = []
            for page_id, html, known in zip(*(c.to_pylist() for c in batch.columns)):
                error = try_marks(html, known)[1]
                if error:
                    found.append((page_id, error))
            if found:
                ids, texts = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["page_id", "error"])

    known = F.col("page_error") if "page_error" in pages.columns else F.lit(None).cast("string")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "html", known.alias("page_error"))
    return (p.repartition(partitions) if partitions else p).mapInArrow(errors, "page_id long, error string")
