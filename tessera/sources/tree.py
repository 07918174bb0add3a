"""Translating a directory tree of files.

- A1 scan: every file under the root, whatever its name or size, listed level by
  level in tasks; names, sizes and times only.
- A3 split: the extension is taken like ``os.path.splitext``: exactly
  ``.html`` is work, everything else is copied.
- A4 skip: a file whose target already exists is left out (anti join on
  the relative path; targets appear by rename, so one that exists is whole).
- A5 target: the source root prefix is replaced by the target root (only
  the prefix, not every occurrence; deviation V1). A path outside the root is
  an error, not a row less.
- A2 read: only the files left are opened, by the tasks. A file that cannot be
  read or decoded is a failed page (or a copy that is not made) with its error.
- A6 write: the pages of a pass are staged by the tasks that hold them and renamed to
  their places when all are there.
- A7 copy: from file to file in the tasks, in blocks, each with its error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.calls import Backend
from tessera.options import Options
from tessera.plans.translation import Translation, translate_pages
from tessera.session import WorkArea
from tessera.sources.files import STAGING, bare_column, bare_path, copy_files, list_tree, publish_files, qualified, with_content


def file_extension(path_col) -> F.Column:
    """A3: extension of the base name as ``os.path.splitext`` gives it ('' if none)."""
    base = F.regexp_extract(path_col, r"[^/]*$", 0)
    return F.regexp_extract(base, r"^.*?[^.].*(\.[^.]*)$", 1)


def _relative(path_col, root: str) -> F.Column:
    """The path below the root; a path outside it raises."""
    prefix = bare_path(root).rstrip("/") + "/"
    bare = bare_column(path_col)
    outside = F.raise_error(F.concat(F.lit(f"not under {root}: "), path_col)).cast("string")
    return F.when(F.startswith(bare, F.lit(prefix)), F.substring(bare, len(prefix) + 1, 1 << 30)).otherwise(outside)


def plan_tree(files: DataFrame, root_src: str, root_dst: str, done: DataFrame | None = None) -> DataFrame:
    """A3-A5: ``files(path, ...)`` -> adds ``rel_path, ext, action, target_path``.

    ``action`` is ``translate`` for ``.html`` files and ``copy`` otherwise.
    ``done(rel_path)`` lists targets that exist already; those files are
    left out (A4).
    """
    out = files.withColumn("rel_path", _relative(F.col("path"), root_src))
    out = out.withColumn("ext", file_extension(F.col("rel_path")))
    out = out.withColumn("action", F.when(F.col("ext") == ".html", F.lit("translate")).otherwise(F.lit("copy")))
    out = out.withColumn("target_path", F.concat(F.lit(root_dst.rstrip("/") + "/"), F.col("rel_path")))
    if done is not None:
        out = out.join(done.select("rel_path").distinct(), "rel_path", "left_anti")
    return out


def scan_tree(spark: SparkSession, root: str, work: WorkArea | None = None, name: str = "tree") -> DataFrame:
    """A1: ``(path, length, modified, error)`` of every file under ``root``; a folder
    that can't be listed is a row with its error."""
    return list_tree(spark, root, work or WorkArea(spark), name)


def existing_targets(spark: SparkSession, root_dst: str, work: WorkArea, name: str = "targets") -> DataFrame:
    """A4 input: relative paths that already exist under the target root."""
    root = qualified(spark, root_dst)[1].toString()
    found = list_tree(spark, root_dst, work, name).filter("error is null").select(_relative(F.col("path"), root).alias("rel_path"))
    return found.filter(~F.startswith("rel_path", F.lit(STAGING)))


def numbered_pages(files: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """A2: pages to translate with a unique ``page_id`` (``monotonically_increasing_id``).

    The result is meant to be written once (the ids are then fixed, and the
    run works on a snapshot of the input files); a hash of the path could
    collide across a billion files and merge two pages.
    """
    read = with_content(files.select("path", "rel_path", "target_path"), encoding)
    return read.select(
        F.monotonically_increasing_id().alias("page_id"), F.col("rel_path").alias("url"), F.col("content").alias("html"), "file_error", "target_path",
    )


@dataclass
class TreePass:
    """One pass over files: pages worked on, their report, the run, and what could
    not be copied or listed (``rel_path, file_error``)."""

    tasks: int
    report: DataFrame
    translation: Translation | None
    copy_errors: DataFrame


def translate_files(
    plan: DataFrame,
    root_dst: str,
    backend: Backend,
    work: WorkArea,
    options: Options = Options(),
    fit_backend: Backend | None = None,
    encoding: str = "UTF-8",
) -> TreePass:
    """A2, A6-A8, J1, I1 for planned files (``path, rel_path, target_path, action``;
    a stored table).

    Copies are made first, then the pages are translated and published. A page that
    cannot be read, or is lost to a segment error, is reported ``failed`` and not written
    (I4): it stays to be done.
    """
    copies = work.write(copy_files(plan.filter(F.col("action") == "copy")), "copies")
    pages = work.write(numbered_pages(plan.filter(F.col("action") == "translate"), encoding), "tree_pages")
    tasks = pages.count()  # A8
    tr = translate_pages(pages.select("page_id", "url", "html", F.col("file_error").alias("page_error")), backend, options, fit_backend, work=work)
    publish_files(tr.out_pages.join(pages.select("page_id", "target_path"), "page_id"), "target_path", "html", root_dst, work, "pages")
    report = tr.report.join(pages.select("page_id", "target_path"), "page_id", "left")
    return TreePass(tasks, report, tr, copies.filter("file_error is not null"))


def translate_tree(
    spark: SparkSession,
    root_src: str,
    root_dst: str,
    backend: Backend,
    options: Options = Options(),
    fit_backend: Backend | None = None,
    encoding: str = "UTF-8",
    work: WorkArea | None = None,
) -> TreePass:
    """A1-A8 + J1 + I1 over a directory tree: all files without a target.

    With a resumable work area the listing, the pages and every stored reply of a broken
    pass are used again. Folders that could not be listed are among the ``copy_errors``.
    """
    area = work or WorkArea(spark)
    src, dst = (qualified(spark, r)[1].toString() for r in (root_src, root_dst))
    listed = scan_tree(spark, src, area)
    if not (area.resume and area.done("plan")):
        plan = plan_tree(listed.filter("error is null"), src, dst, existing_targets(spark, dst, area))
        area.write(plan.drop("error").repartition("path"), "plan")
    done = translate_files(area.read("plan"), dst, backend, area, options, fit_backend, encoding)
    missed = listed.filter("error is not null").select(F.col("path").alias("rel_path"), F.col("error").alias("file_error"))
    done.copy_errors = done.copy_errors.unionByName(missed)
    return done
