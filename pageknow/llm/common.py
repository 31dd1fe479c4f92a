"""Shared helpers: scratch tables in the cluster's shared folder, safe column renaming, checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 500_000
#: Rows that a Python worker is sent at a time when a table is written; rows may hold whole texts or sets.
BATCH_ROWS = 1_000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files go as soon as the table that needed them is written; else they stay until the driver collects its garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The driver keeps the text of the plans of its last 1,000 queries; those of written tables are kept up to so many characters.
PLAN_CONF, PLAN_CHARS = "spark.sql.maxPlanStringLength", 4_000
#: Folders of the tables that ``materialize`` wrote.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one is set only where it is unset (tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("pageknow.scratch.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="spark-pageknow-")
        spark.conf.set("pageknow.scratch.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def held(spark: SparkSession, conf: dict) -> Iterator[None]:
    """Settings of the session that hold meanwhile."""
    usual = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    batch = int(spark.conf.get(BATCH_CONF))
    conf = {BATCH_CONF: min(batch, BATCH_ROWS) if batch > 0 else BATCH_ROWS, CLEANUP_CONF: "true", PLAN_CONF: PLAN_CHARS}
    with held(spark, conf):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and that no result reads any more; others are left alone."""
    for t in tables:
        if path := _WRITTEN.pop(t, None):
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fill_partitions(df: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row work at least one task per core when the input has fewer splits than that."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def release() -> None:
    """Give what is free back to the system. A worker stays for later tasks, idle beside those of other steps, and would keep
    the most that it ever used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches (of ``size`` bytes, if they are not single rows), so that a worker holds few texts
    as Python objects at a time; memory is released after the last."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            left = [b.slice(k, rows)]
            while left:
                x = left.pop()
                if x.num_rows > 1 and x.nbytes > size:
                    half = x.num_rows // 2
                    left += [x.slice(half), x.slice(0, half)]
                else:
                    yield x
    release()


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id apart by their text; not null."""
    return F.xxhash64(text.cast("string"))


def without(docs: DataFrame, drop: DataFrame, how: str = "left_anti") -> DataFrame:
    """Rows of ``docs`` whose doc_id and ``text_key`` are not among ``drop`` (doc_id, key; distinct), or with "left_semi"
    those that are. Broadcasts only a counted, small side; else a shuffled join."""
    drop = drop.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"))
    side = F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop
    return docs.join(side, docs["doc_id"].eqNullSafe(drop["__d"]) & (text_key(docs["text"]) == drop["__k"]), how)


def checked_semi(df: DataFrame, ids: DataFrame, on: str, n_ids: int) -> DataFrame:
    """Rows of ``df`` whose key is among ``ids`` (distinct). Broadcasts only a counted, small side; else a shuffled join."""
    side = F.broadcast(ids) if n_ids <= BROADCAST_ROWS else ids
    return df.join(side, on, "left_semi")
