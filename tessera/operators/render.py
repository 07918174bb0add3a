"""H1, H2: applying translated pieces and writing the pages back.

A page is one row that holds its fragments in document order, each with its
serialized form, so a page is the concatenation of its fragments. The edits of
a page are gathered into one sorted array and meet the page in one join on
``page_id``; the token table itself is not shuffled. Between two edits the
unchanged fragments are joined as a slice, so a page costs time in its length.

Pages that come as their html are not stored as fragments at all: the html meets the
edits, and each page is tokenized and written as it streams by. A stored row of
fragments is some tens of times its html, and a reader takes thousands of rows at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import html_escape
from tessera.operators.tokenize import _escape_text, tokenize_html


def render_html(html: str, edits: dict[int, str]) -> str:
    """One page written back with the texts of some fragments replaced."""
    out = []
    for row in tokenize_html(html):
        frag_no, raw, src, text = row[0], row[9], row[10], row[11]
        if frag_no in edits:
            src, text = None, edits[frag_no] or ""
        out.append(src if src is not None else text if raw else _escape_text(text))
    return "".join(out)


def _written(batches, max_chars: int = 1 << 24):
    """mapInArrow body: ``(page_id, html, edits)`` in, ``(page_id, html)`` of the readable pages out."""
    import pyarrow as pa

    def take():
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["page_id", "html"])

    ids, texts, size = [], [], 0
    for batch in batches:
        for page_id, html, edits in zip(*batch.columns):  # a row at a time: an edit is a small Python object
            try:
                text = render_html(html.as_py(), {e["frag_no"]: e["new_text"] for e in edits.as_py() or ()})
            except Exception:  # noqa: BLE001 - as in tokenizing: ``read_errors`` reports the page
                continue
            ids.append(page_id.as_py())
            texts.append(text)
            size += len(text)
            if size >= max_chars:
                yield take()
                ids, texts, size = [], [], 0
    if ids:
        yield take()


def render_pages(rows: DataFrame, edits: DataFrame | None = None, drop_pages: DataFrame | None = None) -> DataFrame:
    """H1 + H2 (+ I4): ``out_pages(page_id, html)``.

    ``rows`` are page rows (``tokenize.page_rows``) or pages with their ``html``. ``edits(page_id, frag_no,
    new_text)`` replace shred texts, written as the serializer writes the text
    they replace: escaped, but for the text of raw elements (style). Other
    fragments keep their source form, newlines included. An empty page gives an
    empty text. Pages with a read error and pages in ``drop_pages(page_id)`` are
    not written.
    """
    as_html = "frags" not in rows.columns
    pages = rows.filter(F.col("page_error").isNull()) if "page_error" in rows.columns else rows
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").filter("html is not null") if as_html else pages.select("page_id", "frags")
    if drop_pages is not None:
        pages = pages.join(drop_pages.select("page_id").distinct(), "page_id", "left_anti")
    by_page = None if edits is None else edits.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("frag_no", "new_text"))).alias("edits"))
    if as_html:
        p = pages.join(by_page, "page_id", "left") if by_page is not None else pages.withColumn("edits", F.lit(None).cast("array<struct<frag_no:int,new_text:string>>"))
        return p.select("page_id", "html", "edits").mapInArrow(_written, "page_id long, html string")
    src = F.transform(
        "frags", lambda f: F.coalesce(f["src"], F.when(f["raw"], f["text"]).otherwise(html_escape(f["text"])))
    )
    if edits is None:
        return pages.select("page_id", F.array_join(src, "").alias("html"))
    p = pages.join(by_page, "page_id", "left").select("page_id", src.alias("src"), F.col("frags.raw").alias("raw"), "edits")

    def piece(e, i):
        first = F.coalesce(F.get("edits", i - 1)["frag_no"] + 2, F.lit(1))  # after the edit before
        kept = F.array_join(F.slice("src", first, e["frag_no"] + 1 - first), "")
        return F.concat(kept, F.when(F.get("raw", e["frag_no"]), e["new_text"]).otherwise(html_escape(e["new_text"])))

    last = F.get("edits", F.size("edits") - 1)["frag_no"]
    rest = F.array_join(F.slice("src", last + 2, F.size("src")), "")
    edited = F.concat(F.array_join(F.transform("edits", piece), ""), rest)
    return p.select("page_id", F.when(F.col("edits").isNull(), F.array_join("src", "")).otherwise(edited).alias("html"))
