"""Fragments -> shreds -> inline groups.

Grouping rule, relational form. A fragment *splits* its block when it is a
block element whose parent is its owner block (a block inside an inline
element does not split the outer group). The running count of splits inside
``(page_id, owner_block)`` in document order is ``run_no``; kept text
fragments with the same ``(page_id, owner_block, run_no)`` form one group.

Plan for pages: they are clustered by ``page_id`` as they come, one exchange of the
pages themselves; a task goes through the sorted pages, tokenizes one after the other
and keeps the running counts of one page while it does, so no row per word is ever
shuffled, sorted or stored. Pages that share a ``page_id`` are one page: their
fragments interleave by number.

Plan for stored fragments: one exchange on ``page_id`` (the page-level window comes
first, so the ``(page_id, owner_block)`` window, the group aggregate and the group
numbering all reuse that partitioning). Work per key is bounded by the size
of one page, which is a single input row.
"""

from __future__ import annotations

from heapq import merge
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import drop_newlines, is_ignorable, token_count
from tessera.operators.tokenize import TEXT_KINDS, try_marks

SHREDS_DDL = "array<struct<shred_no:int,frag_no:int,text:string>>"
GROUPS_DDL = f"page_id long, group_no int, text string, n_shreds int, shreds {SHREDS_DDL}"
PAGE_GROUPS_DDL = f"page_id long, error string, groups array<struct<group_no:int,text:string,n_shreds:int,shreds:{SHREDS_DDL}>>"


def mark_fragments(frags: DataFrame) -> DataFrame:
    """Shred flag, page-wide shred number and run number.

    Returns the shred rows and the splitting block tags (the only rows that
    move either running count), with ``shred_no`` and ``run_no``.
    """
    page_w = Window.partitionBy("page_id").orderBy("frag_no").rowsBetween(Window.unboundedPreceding, 0)
    block_w = (
        Window.partitionBy("page_id", "owner_block")
        .orderBy("frag_no")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    is_shred = F.col("kind").isin(*TEXT_KINDS) & ~F.col("skip") & ~is_ignorable("text")
    splits = (F.col("kind") == "start") & ~F.col("is_inline") & ~F.col("skip") & (
        F.col("parent_id") == F.col("owner_block")
    )
    # Only shreds and splitting tags change either running count; every other
    # fragment adds 0 to both, so it is dropped before the exchange.
    return (
        frags.withColumn("is_shred", is_shred)
        .withColumn("_split", splits)
        .filter(F.col("is_shred") | F.col("_split"))
        .withColumn("shred_no", (F.sum(F.col("is_shred").cast("int")).over(page_w) - 1).cast("int"))
        .withColumn("run_no", F.sum(F.col("_split").cast("int")).over(block_w).cast("int"))
        .drop("_split")
    )


def shreds(frags: DataFrame) -> DataFrame:
    """``shreds(page_id, shred_no, frag_no, owner_block, run_no, text)``."""
    return (
        mark_fragments(frags)
        .filter("is_shred")
        .select("page_id", "shred_no", "frag_no", "owner_block", "run_no", drop_newlines("text").alias("text"))
    )


def groups_from_shreds(sh: DataFrame) -> DataFrame:
    """``groups(page_id, group_no, text, n_shreds, shreds)``.

    ``shreds`` is ``array<struct<shred_no, frag_no, text>>`` in shred order,
    so texts, positions and parents stay together by construction.
    """
    g = sh.groupBy("page_id", "owner_block", "run_no").agg(
        F.min("shred_no").alias("first_shred"),
        F.count(F.lit(1)).cast("int").alias("n_shreds"),
        F.array_sort(F.collect_list(F.struct("shred_no", "frag_no", "text"))).alias("shreds"),
    )
    order_w = Window.partitionBy("page_id").orderBy("first_shred")
    return g.select(
        "page_id",
        (F.row_number().over(order_w) - 1).cast("int").alias("group_no"),
        F.array_join(F.transform("shreds", lambda s: s["text"]), "").alias("text"),
        "n_shreds",
        "shreds",
    )


def marked_groups(marks) -> list[tuple[list, list, list]]:
    """The groups of one page, each the lists of its ``shred_no``, ``frag_no`` and ``text``:
    marks of the same block with the same number of splits before them."""
    splits, groups, shred_no, block = {}, {}, 0, None
    for frag_no, owner, text in marks:
        if text is None:
            splits[owner] = splits.get(owner, 0) + 1
            block = None
            continue
        if owner != block:  # else it goes on in the group of the mark before
            block, (numbers, frags, texts) = owner, groups.setdefault((owner, splits.get(owner, 0)), ([], [], []))
        numbers.append(shred_no)
        frags.append(frag_no)
        texts.append(text.replace("\n", "") if "\n" in text else text)
        shred_no += 1
    return list(groups.values())


def _marks_or_none(html: str | None, known: str | None) -> list[tuple]:
    """The marks of a page; none for a page with an error, which ``page_errors`` reports."""
    return try_marks(html, known)[0]


def _group_batches(batches, max_shreds: int = 65536):
    """mapInArrow body: pages sorted by page_id in, one row per group out, in batches of
    about ``max_shreds`` shreds."""
    import numpy as np
    import pyarrow as pa

    def take():
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        flat = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(shreds, (pa.int32(), pa.int32(), pa.string()))], ["shred_no", "frag_no", "text"])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(ends, flat)],
            ["page_id", "group_no", "text", "n_shreds", "shreds"])

    ids, numbers, texts, sizes, shreds = [], [], [], [], ([], [], [])
    pages = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    for page_id, same in groupby(pages, key=lambda row: row[0]):
        marks = [_marks_or_none(html, known) for _, html, known in same]
        marks = marks[0] if len(marks) == 1 else merge(*marks, key=lambda m: m[0])
        for group_no, group in enumerate(marked_groups(marks)):
            ids.append(page_id)
            numbers.append(group_no)
            texts.append("".join(group[2]))
            sizes.append(len(group[2]))
            for c, values in zip(shreds, group):
                c.extend(values)
            if len(shreds[0]) >= max_shreds:
                yield take()
                for c in (ids, numbers, texts, sizes, *shreds):
                    c.clear()
    if ids:
        yield take()


def _page_group_batches(batches, max_shreds: int = 65536):
    """mapInArrow body: pages sorted by page_id in, one row per page out with its groups, and
    one per page row that can't be read with its error."""
    import numpy as np
    import pyarrow as pa

    def listed(sizes, values):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)

    def take():
        flat = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(shreds, (pa.int32(), pa.int32(), pa.string()))], ["shred_no", "frag_no", "text"])
        groups = pa.StructArray.from_arrays(
            [pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), listed(sizes, flat)], ["group_no", "text", "n_shreds", "shreds"])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(errors, pa.string()), listed(counts, groups)], ["page_id", "error", "groups"])

    ids, errors, counts, numbers, texts, sizes, shreds = [], [], [], [], [], [], ([], [], [])
    pages = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    for page_id, same in groupby(pages, key=lambda row: row[0]):
        read = [try_marks(html, known) for _, html, known in same]
        for error in [e for _, e in read if e]:
            ids.append(page_id)
            errors.append(error)
            counts.append(0)
        found = marked_groups(read[0][0] if len(read) == 1 else merge(*[m for m, _ in read], key=lambda m: m[0]))
        ids.append(page_id)
        errors.append(None)
        counts.append(len(found))
        numbers.extend(range(len(found)))
        for group in found:
            texts.append("".join(group[2]))
            sizes.append(len(group[2]))
            for c, values in zip(shreds, group):
                c.extend(values)
        if len(shreds[0]) >= max_shreds or len(ids) >= max_shreds:
            yield take()
            for c in (ids, errors, counts, numbers, texts, sizes, *shreds):
                c.clear()
    if ids:
        yield take()


def _clustered(pages: DataFrame, already: bool = False) -> DataFrame:
    known = F.col("page_error") if "page_error" in pages.columns else F.lit(None).cast("string")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "html", known.alias("page_error"))
    return (p if already else p.repartition("page_id")).sortWithinPartitions("page_id")


def groups_by_page(pages: DataFrame, clustered: bool = False) -> DataFrame:
    """B1-B11 on ``pages(page_id, html)``, a row per page: what ``groups_from_pages`` gives as
    rows, as an array in group order. A page row with an error has a row of its own.
    ``clustered``: pages with one id are in one partition as they come."""
    return _clustered(pages, clustered).mapInArrow(_page_group_batches, PAGE_GROUPS_DDL)


def groups_from_pages(pages: DataFrame) -> DataFrame:
    """B1-B11 on ``pages(page_id, html)``: the rows of ``groups_from_shreds``."""
    return _clustered(pages).mapInArrow(_group_batches, GROUPS_DDL)


def page_groups(pages: DataFrame, frags: DataFrame | None = None, counter=None) -> DataFrame:
    """Pages -> groups, with the token count of each group.

    ``frags`` (optional): the stored fragments of the pages. ``counter`` maps the text
    column to a token-count column; the default is the JVM-side rule ``token_count``;
    ``vocab_token_count`` uses a real vocabulary.
    """
    groups = groups_from_pages(pages) if frags is None else groups_from_shreds(shreds(frags))
    counter = counter or token_count
    return groups.withColumn("n_tokens", counter(F.col("text")))
