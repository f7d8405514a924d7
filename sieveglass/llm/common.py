"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between stages: the session's checkpoint folder. Where none is set, one of our own, but only if driver and executors are one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sieveglass-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def table_folder(spark: SparkSession, name: str) -> str:
    """A new folder's place in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def maybe_in(rows: DataFrame, key: str, others: DataFrame, bits: int = 16) -> DataFrame:
    """The rows whose key may be one of `others`, whose keys differ: all that are, and about one in `bits` of the rest. For a join that would else shuffle all rows; only a bitmap of that many bits a key is broadcast."""
    size = bits * max(1, others.count())
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(size))  # equal numbers of different types have one text
    own = others.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_bits"))
    found = rows.withColumn("_at", place).withColumn("_bucket", F.bitmap_bucket_number("_at")).join(F.broadcast(own), "_bucket")
    bit = F.expr("getbit(cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_at) div 8 as int) + 1, 1)), 16, 10) as int), cast(bitmap_bit_position(_at) % 8 as int))")
    return found.where(bit == 1).select(*rows.columns)


#: What a worker keeps between tasks, by name.
kept: dict[str, dict] = {}


def begin(*needs: str) -> None:
    """For the start of a task: workers outlive a stage, so what is kept for other operators goes, and memory that is free returns to the system."""
    for name, held in kept.items():
        if name not in needs:
            held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lowered, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def crc_mod_py(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def hashes(tokens: Iterable[bytes]) -> np.ndarray:
    """64-bit hashes that agree between processes."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(t) for t in tokens), np.uint64)


def auc(labels: np.ndarray, score: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], labels[order].astype(bool)
    _, first, n = np.unique(s, return_index=True, return_counts=True)
    rank = np.repeat(first + (n - 1) / 2 + 1, n)
    pos = int(y.sum())
    neg = len(y) - pos
    return float("nan") if not pos or not neg else float((rank[y].sum() - pos * (pos + 1) / 2) / (pos * neg))


