"""Tables that grow or are replaced by numbered batches.

A batch is written into an attempt folder of its own, then a small commit file that names the attempt is created under the
batch's number. Creating fails if the file is there, so of several attempts one counts; readers look up commits and open the
folders they name. What a failed or a second attempt leaves behind is never read, and nothing is changed in place.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's shared one, or under the warehouse where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a scratch folder and read from there: computed once, and found again if an executor is lost."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; false if it is there. Stores without an exclusive create need another committer here."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    try:
        stream = fs.create(p, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def commits(spark: SparkSession, root: str) -> dict[int, str]:
    """Batch numbers and their attempts, one small file a batch; a commit file that a crash left empty counts for nothing."""
    fs, p = _fs(spark, f"{root}/commits")
    if not fs.exists(p):
        return {}
    named = {int(s.getPath().getName()): (s.getPath().toString(), s.getLen()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()}
    return {n: _read_text(spark, path) for n, (path, size) in sorted(named.items()) if size}


def append(df: DataFrame, root: str, batch: int) -> bool:
    """Write ``df`` as a batch; false, and nothing written, if its number is committed. Usable in ``foreachBatch``."""
    spark = df.sparkSession
    name = f"{root}/commits/{int(batch):020d}"
    if int(batch) in commits(spark, root):
        return False
    if exists(spark, name):  # left empty by a crash
        fs, p = _fs(spark, name)
        fs.delete(p, False)
    attempt = f"{int(batch):020d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/attempts/{attempt}")
    return create_once(spark, name, attempt)


def _open(spark: SparkSession, root: str, attempts: list[str], schema: StructType | None) -> DataFrame | None:
    paths = [f"{root}/attempts/{a}" for a in attempts]
    if not paths:
        return spark.createDataFrame([], schema) if schema is not None else None
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", True)
    return reader.parquet(*paths)


def read(spark: SparkSession, root: str, schema: StructType | None = None) -> DataFrame | None:
    """The rows of all committed batches, columns aligned by name, gaps null; without a commit an empty table of ``schema``, or
    None if that is not given either."""
    return _open(spark, root, list(commits(spark, root).values()), schema)


def publish(df: DataFrame, root: str) -> int:
    """Replace a table: write ``df`` as the next version and return its number. Readers of the version before are not disturbed."""
    while True:
        n = max(commits(df.sparkSession, root), default=0) + 1
        if append(df, root, n):
            return n


def current(spark: SparkSession, root: str, schema: StructType | None = None, version: int | None = None) -> DataFrame | None:
    """The last published version, or an earlier one by its number."""
    done = commits(spark, root)
    at = max(done, default=None) if version is None else version
    return _open(spark, root, [done[at]] if at in done else [], schema)


def collect_garbage(spark: SparkSession, root: str, keep: set[str]) -> list[str]:
    """Delete attempt folders that ``keep`` does not name; to be called where no reader or writer uses them. Their names."""
    fs, p = _fs(spark, f"{root}/attempts")
    gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in keep] if fs.exists(p) else []
    for path in gone:
        fs.delete(path, True)
    return sorted(path.getName() for path in gone)


def compact(spark: SparkSession, root: str, new_root: str) -> int:
    """Rewrite all committed batches as one batch of another folder, under the last one's number. The other numbers are
    committed there as batches without rows, so playing one again changes nothing."""
    done = commits(spark, root)
    if not done:
        return 0
    last = max(done)
    if append(read(spark, root), new_root, last):
        for n in done:
            create_once(spark, f"{new_root}/commits/{n:020d}", _empty_attempt(spark, new_root, last))
    return last


def _empty_attempt(spark: SparkSession, root: str, batch: int) -> str:
    """An attempt without rows, with the columns of the folder's own."""
    name = f"{batch:020d}-none"
    if not exists(spark, f"{root}/attempts/{name}"):
        current(spark, root, version=batch).limit(0).write.parquet(f"{root}/attempts/{name}")
    return name
