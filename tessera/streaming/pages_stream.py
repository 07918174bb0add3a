"""Translate files as they arrive (re-aim of "run again, only new files").

When the stream starts, one pass over the tree (``translate_tree``) does what earlier
runs have left; it also handles the names that Spark's file source hides. From then
on a micro-batch works on its own arrivals and on the pages that are due again, and on
nothing else: neither tree is listed, a target is looked up by its own path, in the
tasks.

The state is a table with one version a batch, under the stream's checkpoint: the pages
that failed, with their tries and the time from which they are due
(``backoff_init_delay`` times ``backoff_exp_base`` per further try, capped). Done pages need
no state, since their target says so; an existing target is never written over. A batch
that Spark repeats starts from the version before it and finds its own stored tables and
replies again.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.calls import Backend
from tessera.options import Options
from tessera.session import WorkArea
from tessera.sources.files import existing, qualified
from tessera.sources.tree import plan_tree, translate_files, translate_tree

ARRIVALS = "path string, modificationTime timestamp, length long, content binary"


def translate_stream(
    spark: SparkSession,
    root_src: str,
    root_dst: str,
    checkpoint: str,
    backend: Backend,
    options: Options = Options(),
    fit_backend: Backend | None = None,
    report_path: str | None = None,
    available_now: bool = True,
    encoding: str = "UTF-8",
    max_files_per_trigger: int = 10_000,
    clock=time.time,
):
    """Start the stream; returns the ``StreamingQuery``.

    ``report_path`` (optional) receives the per-page report of every pass
    as parquet (append). The work folder of a pass is named after its batch and
    kept until the pass is complete: a batch that Spark repeats goes on from the
    stored tables and replies. ``clock`` gives the time by which failed pages are due.
    """
    src, dst = (qualified(spark, r)[1].toString() for r in (root_src, root_dst))
    state = PageState(spark, checkpoint.rstrip("/") + "/page_state")

    def area_of(label: str) -> WorkArea:
        return WorkArea(spark, f"stream-{hash_of(checkpoint)}-{label}", resume=True)

    def report(done, batch_id: int) -> None:
        if report_path and done.tasks:
            done.report.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(report_path)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        area = area_of(str(batch_id))
        before = state.before(batch_id)
        arrived = plan_tree(batch.select("path").distinct(), src, dst)
        due = before.filter(F.col("due") <= clock())
        files = arrived.unionByName(due.select(*arrived.columns)).dropDuplicates(["rel_path"])
        files = area.write(files, "candidates")
        plan = area.write(files.join(existing(files.select("rel_path", "target_path")).select("rel_path"), "rel_path", "left_anti"), "plan")
        done = translate_files(plan, dst, backend, area, options, fit_backend, encoding)
        report(done, batch_id)
        failed = done.report.filter("page_status = 'failed'").select(F.col("url").alias("rel_path"))
        failed = failed.unionByName(done.copy_errors.select("rel_path"))
        state.write(plan.join(failed.distinct(), "rel_path", "left_semi"), before, files, batch_id, clock(), options)
        area.drop()

    area = area_of("start")
    report(translate_tree(spark, root_src, root_dst, backend, options, fit_backend, encoding, work=area), -1)
    area.drop()
    arrivals = (
        spark.readStream.format("binaryFile").schema(ARRIVALS).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files_per_trigger).load(root_src).select("path")
    )
    return start_query(arrivals, run_batch, checkpoint, available_now)


def start_query(arrivals: DataFrame, run_batch, checkpoint: str, available_now: bool):
    writer = arrivals.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


FILE_STATE = "path string, rel_path string, ext string, action string, target_path string, tries int, due double"


class PageState:
    """Versions of the table of failed pages; version ``n`` is written by batch ``n``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def before(self, batch_id: int) -> DataFrame:
        """The newest version older than this batch (empty if there is none)."""
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        versions = sorted((int(n) for n in names if n.isdigit() and int(n) < batch_id), reverse=True)
        for old in versions[2:]:  # no batch is repeated that would need it
            fs.delete(sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{old}"), True)
        found = next((v for v in versions if WorkArea.complete(self.spark, f"{self.root}/{v}")), None)
        if found is None:
            return self.spark.createDataFrame([], FILE_STATE)
        return self.spark.read.schema(FILE_STATE).parquet(f"{self.root}/{found}")

    def write(self, failed: DataFrame, before: DataFrame, tried: DataFrame, batch_id: int, now: float, options: Options) -> None:
        """What was not tried stays as it is; what failed has one try more."""
        tries = F.coalesce(F.col("_tries"), F.lit(0)) + 1
        delay = F.least(F.lit(options.backoff_cap_sec), F.lit(options.backoff_init_delay) * F.pow(F.lit(options.backoff_exp_base), tries - 1))
        again = failed.join(before.select("rel_path", F.col("tries").alias("_tries")), "rel_path", "left")
        again = again.select("path", "rel_path", "ext", "action", "target_path", tries.cast("int").alias("tries"), (F.lit(now) + delay).alias("due"))
        rest = before.join(tried.select("rel_path"), "rel_path", "left_anti").select(*again.columns)
        rest.unionByName(again).write.mode("overwrite").parquet(f"{self.root}/{batch_id}")


def hash_of(text: str) -> int:
    """A stable number for a folder name."""
    import zlib

    return zlib.crc32(text.encode())
