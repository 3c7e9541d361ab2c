"""Shared pieces of the training-data operators: session limits, shared tables, words and hashes."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when a count or a sum over it has proven that it is no larger than this.
BROADCAST_BYTES = 16 * 1024 * 1024
#: Rows in one Arrow batch: whole texts travel, so a batch is kept small.
BATCH_ROWS = 250


def tune(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small enough for whole texts; nothing else of the session is touched."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def lean() -> None:
    """In a Python worker: give large freed blocks back to the system at once, so that a worker's size is what it uses."""
    global _lean
    if not _lean:
        import ctypes

        import pyarrow as pa

        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        pa.set_memory_pool(pa.system_memory_pool())
        _lean = True


_lean = False


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it. Where none is set, a session
    of one machine gets one of its own; on a cluster that is an error, as executors couldn't share it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quirelake-"))
            base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors. narrow: df is
    much smaller than what it was made from, so an eighth of the shuffle partitions' files hold it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)) if narrow else df
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_not(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the counted rows are proven to fit; otherwise df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit // row_bytes + 1).count() <= limit // row_bytes else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text) -> bytes:
    """UTF-8 of a text, empty for null."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def words_of(text) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lowered; bytes.split() splits on just that white space."""
    return text_bytes(text).lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums and products of hashes stay spread."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows of hashed words; the whole sequence as one if it is shorter."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mix(out + h[i : len(h) - n + 1 + i] + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64))
    return mix(out + np.uint64(n))
