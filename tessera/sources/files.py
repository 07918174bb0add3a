"""Files of a tree: listing on any file system, reading, copying and writing in tasks.

Spark's file sources leave out names that start with ``_`` or ``.`` and empty
files, so a tree is listed folder by folder: the folders of one level are rows, tasks
list them, and the level is a stored table (``list_tree``). The driver only goes
from level to level; no name passes through it. Tasks open single files: local or
mounted paths directly, others through ``pyarrow.fs`` (hdfs, s3, gs, abfs).

Copies go from file to file in blocks. Pages are written in two steps: tasks put
them under a staging folder of the target root, and only when all are there do tasks
rename them to their places; a job that is given up leaves no file (``stage_files``,
``publish_files``). A target that exists is complete.
"""

from __future__ import annotations

import contextlib
import os
import posixpath
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import WorkArea

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]+:(//[^/]*)?"


def bare_path(path: str) -> str:
    """Path without scheme and authority, ``.`` and ``..`` resolved."""
    return posixpath.normpath(re.sub(_SCHEME, "", path)).replace("//", "/")


def bare_column(col) -> F.Column:
    """The scheme and authority cut off a path column."""
    return F.regexp_replace(col, _SCHEME, "")


def qualified(spark: SparkSession, root: str):
    """``(file system, path)`` of a root as Hadoop names it: relative roots are
    taken from the working folder, ``..`` is resolved."""
    sc = spark.sparkContext
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    full = path.makeQualified(fs.getUri(), fs.getWorkingDirectory())
    return fs, jvm.org.apache.hadoop.fs.Path(full.toUri().normalize())


def scan_folder(path: str):
    """(name, is a folder, length, modified) of every entry of a folder, one by one.
    A link to a folder is not followed, so that a tree has no cycles."""
    local = _local(path)
    if local is not None:
        with os.scandir(local) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    yield e.name, True, 0, 0.0
                elif not e.is_dir():
                    st = e.stat(follow_symlinks=os.path.exists(e.path))
                    yield e.name, False, st.st_size, st.st_mtime
        return
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    for f in system.get_file_info(fs.FileSelector(at)):
        if f.type == fs.FileType.Directory:
            yield f.base_name, True, 0, 0.0
        else:
            yield f.base_name, False, f.size, f.mtime.timestamp() if f.mtime else 0.0


ENTRIES = "path string, is_folder boolean, length long, modified double, error string"


def _entries(batches):
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("is_folder", pa.bool_()), ("length", pa.int64()), ("modified", pa.float64()), ("error", pa.string())])
    rows: list[dict] = []
    for b in batches:
        for folder in b.column(0).to_pylist():
            try:
                for name, is_folder, length, modified in scan_folder(folder):
                    rows.append({"path": f"{folder.rstrip('/')}/{name}", "is_folder": is_folder, "length": length, "modified": modified, "error": None})
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
            except FileNotFoundError:
                pass  # gone, or never there: it has no files
            except OSError as e:
                rows.append({"path": folder, "is_folder": False, "length": 0, "modified": 0.0, "error": f"folder not listed: {type(e).__name__}: {e}"})
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def list_tree(spark: SparkSession, root: str, work: WorkArea, name: str) -> DataFrame:
    """``(path, length, modified, error)`` of every file under ``root``, hidden and
    empty ones too. A folder that can't be listed is a row with its error.

    A frontier of folders is listed level by level, in tasks; each level is a table of
    the work area, which a resumed run uses again. The driver asks for one number a
    level, that of its folders.
    """
    cores = spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(qualified(spark, root)[1].toString(),)], "path string")
    levels, folders = [], 1
    while folders:
        level = f"{name}_level_{len(levels)}"
        # a level's folders are dealt over the tasks one by one: one may hold most files
        found = work.write(frontier.repartition(min(folders, 32 * cores)).mapInArrow(_entries, ENTRIES), level)
        levels.append(work.path(level))
        frontier = found.filter("is_folder").select("path")
        folders = frontier.count()
    return spark.read.schema(ENTRIES).parquet(*levels).filter("not is_folder").drop("is_folder")


def tree_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """``(path, change)`` between two listings of a tree: new, changed (length or
    time), gone."""
    b = before.select("path", F.struct("length", "modified").alias("_b"))
    both = now.select("path", F.struct("length", "modified").alias("_n")).join(b, "path", "full")
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_n").isNull(), "gone").when(F.col("_b") != F.col("_n"), "changed")
    return both.select("path", change.alias("change")).filter("change is not null")


def _local(path: str) -> str | None:
    """The path on this machine, or None if it is on another file system."""
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    return None if re.match(_SCHEME, path) else path


def read_bytes(path: str) -> bytes:
    local = _local(path)
    if local is not None:
        with open(local, "rb") as f:
            return f.read()
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at) as f:
        return f.read()


def list_names(folder: str) -> list[str]:
    """Names in a folder, in order (none if it isn't there)."""
    local = _local(folder)
    if local is not None:
        return sorted(os.listdir(local)) if os.path.isdir(local) else []
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f.base_name for f in found)


def write_bytes(path: str, data: bytes) -> None:
    """Write a whole file: temporary name in the same folder, then rename."""
    local = _local(path)
    folder, base = posixpath.split(local if local is not None else path)
    part = f"{folder}/.{base[:100]}.{uuid.uuid4().hex}.part"
    if local is not None:
        os.makedirs(folder, exist_ok=True)
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, local)
        return
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    _, tmp = fs.FileSystem.from_uri(part)
    system.create_dir(posixpath.dirname(at), recursive=True)
    with system.open_output_stream(tmp) as f:
        f.write(data)
    system.move(tmp, at)


def with_content(files: DataFrame, encoding: str | None = None) -> DataFrame:
    """Adds ``content`` (bytes, or text with ``encoding``) and ``file_error``.

    A file that cannot be read or decoded has null content and its error; the
    others of its task are not affected. Files are handed over one by one, so a
    task holds one file's bytes besides a small batch.
    """
    kind = "string" if encoding else "binary"
    cols = files.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def read(batches):
        import pyarrow as pa

        for b in batches:
            paths = b.column(cols.index("path")).to_pylist()
            for k, path in enumerate(paths):
                data = error = None
                try:
                    data = read_bytes(path)
                    if encoding:
                        data = data.decode(encoding)
                except (OSError, UnicodeError) as e:
                    data, error = None, f"file not readable: {type(e).__name__}: {e}"
                row = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns, pa.array([data], pa.string() if encoding else pa.binary()), pa.array([error], pa.string())],
                    [*cols, "content", "file_error"])

    return files.mapInArrow(read, f"{fields}, content {kind}, file_error string")


BLOCK = 8 << 20


def copy_file(source: str, target: str) -> None:
    """Copy a file of any size block by block: temporary name, then rename."""
    from pyarrow import fs

    def opened(path):
        local = _local(path)
        return (fs.LocalFileSystem(), local) if local is not None else fs.FileSystem.from_uri(path)

    (a, source_at), (b, target_at) = opened(source), opened(target)
    folder, base = posixpath.split(target_at)
    part = f"{folder}/.{base[:100]}.{uuid.uuid4().hex}.part"
    b.create_dir(folder, recursive=True)
    try:
        with a.open_input_stream(source_at, buffer_size=0) as r, b.open_output_stream(part) as w:
            while block := r.read(BLOCK):
                w.write(block)
        b.move(part, target_at)
    except OSError:
        with contextlib.suppress(OSError):
            b.delete_file(part)
        raise


def copy_files(files: DataFrame) -> DataFrame:
    """Copies ``path`` to ``target_path`` in the tasks: ``(rel_path, file_error)`` of
    every file, null where it was copied. Contents never leave the task. Lazy: the result
    is meant to be stored."""

    def copy(batches):
        import pyarrow as pa

        for b in batches:
            for rel, source, target in zip(*(c.to_pylist() for c in b.columns), strict=True):
                error = None
                try:
                    copy_file(source, target)
                except OSError as e:
                    error = f"not copied: {type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([rel], pa.string()), pa.array([error], pa.string())], ["rel_path", "file_error"])

    return files.select("rel_path", "path", "target_path").mapInArrow(copy, "rel_path string, file_error string")


def existing(files: DataFrame, path_col: str = "target_path") -> DataFrame:
    """The rows whose file exists, looked up one by one in the tasks."""
    at = files.columns.index(path_col)

    def look(batches):
        import pyarrow as pa

        for b in batches:
            yield b.filter(pa.array([exists(p) for p in b.column(at).to_pylist()], pa.bool_()))

    return files.mapInArrow(look, files.schema)


def exists(path: str) -> bool:
    local = _local(path)
    if local is not None:
        return os.path.exists(local)
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.get_file_info(at).type != fs.FileType.NotFound


def move_file(source: str, target: str) -> None:
    local = _local(source)
    if local is not None:
        to = _local(target)
        os.makedirs(os.path.dirname(to), exist_ok=True)
        os.replace(local, to)
        return
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(source)
    to = fs.FileSystem.from_uri(target)[1]
    system.create_dir(posixpath.dirname(to), recursive=True)
    system.move(at, to)


STAGING = ".staging-"


def stage_files(df: DataFrame, path_col: str, content_col: str, staging: str) -> DataFrame:
    """First step of writing: each task writes its files under ``staging``. Returns
    ``(part, target)`` of every file; null content is not written. A repeated task writes
    new parts, of which the stored result names the last ones only."""

    def write(batches):
        import pyarrow as pa

        for b in batches:
            parts, targets = [], []
            for target, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data is not None:
                    parts.append(f"{staging}/{uuid.uuid4().hex}")
                    targets.append(target)
                    write_bytes(parts[-1], data.encode("utf-8") if isinstance(data, str) else data)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(targets, pa.string())], ["part", "target"])

    return df.select(path_col, content_col).mapInArrow(write, "part string, target string")


def _publish(batches):
    import pyarrow as pa

    for b in batches:
        for part, target in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if exists(part):
                move_file(part, target)
            elif not exists(target):
                raise FileNotFoundError(f"staged file is gone: {part} for {target}")
        yield pa.RecordBatch.from_arrays([b.column(1)], ["target"])


def publish_files(df: DataFrame, path_col: str, content_col: str, root: str, work: WorkArea, name: str) -> DataFrame:
    """Write files under ``root``, all or none: ``target`` of every one.

    Staged files and their targets are a stored table; if staging fails, its folder is
    deleted and nothing is seen under the targets. Once the table is complete, tasks
    rename the files, and a run that broke in between goes on with the rest.
    """
    staging = f"{root.rstrip('/')}/{STAGING}{posixpath.basename(work.root)}-{name}"
    try:
        staged = work.write(stage_files(df, path_col, content_col, staging), f"{name}_staged")
    except Exception:
        remove_folder(df.sparkSession, staging)
        raise
    out = work.write(staged.mapInArrow(_publish, "target string"), f"{name}_written")
    remove_folder(df.sparkSession, staging)
    return out


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
