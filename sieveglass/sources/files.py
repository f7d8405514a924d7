"""File and in-memory sources: DataFrames of (path, length, content).

Local files are listed by name on the driver and read by the tasks; links are
never followed and special files never opened. Null content with a length that
is small enough says that a file couldn't be read.
"""

from __future__ import annotations

import os
import stat
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import SKIP_ENDINGS, SKIP_FOLDERS

FILE = "path string, length long, content binary"
#: Bytes of contents in one Arrow batch, and held by the driver before they are written out.
BATCH, HELD = 32 << 20, 64 << 20


def local(root: str) -> bool:
    return "://" not in root


def wanted(path: str, endings: bool = True) -> bool:
    """functions.columns.should_scan for one path."""
    return not (set(path.split("/")[:-1]) & set(SKIP_FOLDERS)) and not (endings and path.lower().endswith(SKIP_ENDINGS))


def regular(path: str) -> bool:
    """Whether this is a file itself, not a link to one."""
    try:
        return stat.S_ISREG(os.lstat(path).st_mode)
    except OSError:
        return False


def walk(root: str) -> Iterator[tuple[str, int | None]]:
    """(path below the root, size) of regular files; folders that can't be listed have no size."""
    todo = [""]
    while todo:
        at = todo.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, at)), key=lambda e: e.name)
        except OSError:
            yield at or ".", None
            continue
        for e in entries:
            name = f"{at}/{e.name}" if at else e.name
            try:
                if e.is_dir(follow_symlinks=False):
                    todo.append(name)
                elif e.is_file(follow_symlinks=False):
                    yield name, e.stat(follow_symlinks=False).st_size
            except OSError:
                yield name, None


def _content(path: str, most: int | None) -> tuple[int | None, bytes | None]:
    """(size, bytes) of a regular file of at most that many bytes."""
    try:
        with os.fdopen(os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK), "rb") as f:
            found = os.fstat(f.fileno())
            if not stat.S_ISREG(found.st_mode):
                return None, None
            data = f.read() if most is None else f.read(most + 1)
            return (len(data), data) if most is None or len(data) <= most else (max(found.st_size, len(data)), None)
    except OSError:
        return None, None


def read(spark: SparkSession, rows: list[tuple[str, str, int | None, bool]], max_size: int | None = None) -> DataFrame:
    """(path, length, content) of (path shown, path, size, whether to read) rows."""
    listed = spark.createDataFrame(rows, "path string, at string, length long, reads boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0

            def batch(out=out) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["path", "length", "content"])

            for path, at, length, reads in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                data = None
                if reads and (max_size is None or length is None or length <= max_size):
                    size, data = _content(at, max_size)
                    length = length if size is None else size
                out.append((path, length, data))
                held += len(data or b"")
                if held > BATCH:
                    yield batch()
                    out.clear()
                    held = 0
            if out:
                yield batch()

    return listed.mapInArrow(run, FILE)


def directory(spark: SparkSession, root: str, max_size: int | None = None, endings: bool | None = None) -> DataFrame:
    """All files below a folder; larger files are listed with null content and never read, nor are those that the path policy leaves out (endings: as in wanted; None: all are read)."""
    if local(root):
        top = os.path.abspath(root)
        rows = [(f"{root.rstrip('/')}/{name}", os.path.join(top, name), size, size is not None and (endings is None or wanted(name, endings))) for name, size in walk(root)]
        return read(spark, rows, max_size)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    if max_size is None:
        return rows.select("path", "length", "content")
    large = rows.where(F.col("length") > max_size).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return rows.where(F.col("length") <= max_size).select("path", "length", "content").unionByName(large)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) without contents."""
    if local(root):
        return spark.createDataFrame([(f"{root.rstrip('/')}/{name}", size) for name, size in walk(root) if size is not None], "path string, length long")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def paths(spark: SparkSession, names: list[str], root: str, max_size: int | None = None) -> DataFrame:
    """Given files below a root, only these; links and special files are left out, what can't be read has null content."""
    top = os.path.abspath(root)
    found = [(f"{root.rstrip('/')}/{n}", os.path.join(top, n)) for n in dict.fromkeys(names)]
    return read(spark, [(shown, at, os.lstat(at).st_size if os.path.lexists(at) else None, True) for shown, at in found if regular(at) or not os.path.lexists(at)], max_size)


def batched(spark: SparkSession, rows: Iterator[tuple], schema: str, at: int) -> DataFrame:
    """Rows that the driver reads one by one; over HELD bytes (of field `at`) they are written to the folder that the session shares, a batch at a time."""
    held: list[tuple] = []
    size, folder = 0, None
    for r in rows:
        held.append(r)
        size += len(r[at] or b"") + 256
        if size > HELD:
            folder = folder or f"{shared(spark)}/rows-{uuid.uuid4().hex}"
            spark.createDataFrame(held, schema).write.mode("append").parquet(folder)
            held, size = [], 0
    rest = spark.createDataFrame(held, schema)
    return rest if folder is None else spark.read.schema(schema).parquet(folder).unionByName(rest)


def shared(spark: SparkSession) -> str:
    """The checkpoint folder, else the warehouse: both are shared by driver and executors."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")


def documents(table: DataFrame, path: F.Column, text: str = "text") -> DataFrame:
    return table.select(path.alias("path"), F.col(text).alias("content"))
