"""Session helpers: local sessions for tests/bench and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "tessera") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only where it is unset and the master is local (tests and bench) a
    fresh folder is made for this process; elsewhere tasks would write to their
    own disks, so an unset folder is an error.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        cur = spark.sparkContext.getCheckpointDir()
    if not cur:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        cur = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", cur)
        spark.sparkContext.setCheckpointDir(cur)
    return cur


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable on the Python workers of this context.

    The package is zipped in memory, written once into the shared checkpoint
    folder (through Hadoop's file system API when the folder is not local)
    and added with ``addPyFile``, so executors started anywhere can unpickle
    the Arrow-batch functions (tokenizer, similarity, call stage).
    """
    import io
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    data = buf.getvalue()
    base = ensure_checkpoint_dir(spark)
    name = f"tessera-pkg/tessera-{uuid.uuid4().hex}.zip"
    if "://" not in base or base.startswith("file:"):
        local = os.path.join(base[len("file:"):] if base.startswith("file:") else base, name)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as f:
            f.write(data)
        target = local
    else:
        jvm = sc._jvm
        path = jvm.org.apache.hadoop.fs.Path(base.rstrip("/") + "/" + name)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        out = fs.create(path, True)
        out.write(bytearray(data))
        out.close()
        target = path.toString()
    sc.addPyFile(target)
    _SHIPPED.add(key)


@contextmanager
def slim_stages(spark: SparkSession):
    """While stages are written: a stage's shuffle files go when it is stored, not when the
    driver happens to collect its garbage, and stored tables are compressed harder."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class WorkArea:
    """Named tables written under the shared checkpoint folder.

    Writing a stage out cuts the lineage: a lost executor re-reads the
    written table instead of re-running earlier stages, and a model-call
    stage is never repeated by a re-planned downstream job.

    With a fixed ``run_id`` and ``resume=True`` a restarted driver re-reads
    every stage that was written completely (Spark's ``_SUCCESS`` marker)
    instead of running it again, model calls included.
    """

    def __init__(self, spark: SparkSession, run_id: str | None = None, resume: bool = False):
        self.spark = spark
        self.resume = resume
        base = ensure_checkpoint_dir(spark)
        self.root = os.path.join(base, "tessera", run_id or uuid.uuid4().hex)

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def done(self, name: str) -> bool:
        """The table was written completely."""
        return self.complete(self.spark, self.path(name))

    @staticmethod
    def complete(spark: SparkSession, path: str) -> bool:
        """A table was written to this path, completely (Spark's ``_SUCCESS``)."""
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def write(self, df: DataFrame, name: str, mode: str = "overwrite", by: str | None = None) -> DataFrame:
        """``by`` (optional): a column of few values, each of which gets a folder of its own.
        Such a table without rows has no file that its columns could be read from."""
        if self.resume and mode == "overwrite" and self.done(name):
            return self.read(name)
        p = self.path(name)
        out = df.write.mode(mode)
        (out.partitionBy(by) if by else out).parquet(p)
        return self.read(name, df.schema if by else None)

    def read(self, name: str, schema=None) -> DataFrame:
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        """Delete the folder and all its tables, or one table (or folder of one), once nothing
        reads them any more."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
