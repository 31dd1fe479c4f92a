"""A stored hash index for nearest vectors: built once, searched by bucket joins.

Random hyperplanes give each vector one bucket number a table. The index keeps, by table, (bucket, id, metadata) in order of
buckets, and the vectors once. A query looks into the buckets whose planes it is closest to crossing (multi-probe), the
candidates, found once each, are ranked by their exact distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageknow.sources.commits import current, publish

#: A table has at least and at most so many planes.
LEAST_BITS, MOST_BITS = 4, 24
#: A probe crosses any of so many planes, those that are nearest.
CROSSED = 6


@dataclass(frozen=True)
class Params:
    tables: int = 24
    probes: int = 24
    bucket_rows: int = 16  # of a bucket, about; sets the number of planes
    bits: int = 0  # planes of a table; 0: by the number of rows


def bits_for(rows: int, p: Params = Params()) -> int:
    """Planes of a table: the more rows, the more."""
    return p.bits or max(LEAST_BITS, min(MOST_BITS, (max(1, rows) // p.bucket_rows).bit_length() - 1))


@lru_cache(maxsize=8)
def plane_signs(tables: int, bits: int, dimensions: int) -> np.ndarray:
    """(tables, bits, dimensions) of 1 and -1, from digests, so that they are the same everywhere; the first planes of a table
    do not depend on how many it has."""
    def signs(t: int, b: int) -> np.ndarray:
        raw = b"".join(hashlib.sha256(f"{t}:{b}:{k}".encode()).digest() for k in range(-(-dimensions // 256)))
        return np.unpackbits(np.frombuffer(raw, np.uint8))[:dimensions] * 2.0 - 1

    return np.array([[signs(t, b) for b in range(bits)] for t in range(tables)])


def usable(vector: Column, dimensions: int | None = None) -> Column:
    """Neither null nor empty, all entries finite, and of the wanted length."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    size = F.size(vector) == dimensions if dimensions else F.size(vector) > 0
    return F.coalesce(vector.isNotNull() & size & good, F.lit(False))


def _matrix(b: pa.RecordBatch, column: str) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)


def _sides(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(rows, tables, bits): distances to the planes, times a constant."""
    planes = plane_signs(tables, bits, x.shape[1])
    return (x @ planes.reshape(tables * bits, -1).T).reshape(len(x), tables, bits)


def _codes(side: np.ndarray) -> np.ndarray:
    return ((side >= 0) * (1 << np.arange(side.shape[2]))).sum(axis=2)


def _buckets(tables: int, bits: int, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 4_096):
            part = b.slice(k, 4_096)
            codes = _codes(_sides(_matrix(part, "v"), tables, bits))
            at = pa.array(np.repeat(np.arange(part.num_rows), tables))
            cols = [pa.array(np.tile(np.arange(tables, dtype=np.int32), part.num_rows)), pa.array(codes.ravel().astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*cols, *[part.column(c).take(at) for c in keep]], ["tab", "bucket", *keep])


def probed(side: np.ndarray, probes: int) -> np.ndarray:
    """(rows, tables, probes): the buckets that a point is in or nearest to: planes are crossed, alone or together, in order
    of the sum of their squared distances."""
    bits = side.shape[2]
    m = min(CROSSED, bits)
    near = np.argsort(np.abs(side), axis=2, kind="stable")[:, :, :m]
    cost = np.take_along_axis(side, near, axis=2) ** 2
    subsets = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
    total = cost @ subsets.T.astype(float)
    best = np.argsort(total, axis=2, kind="stable")[:, :, : min(probes, 1 << m)]
    flips = (1 << near) @ subsets.T  # disjoint bits, so sums are unions
    return _codes(side)[:, :, None] ^ np.take_along_axis(flips, best, axis=2)


def _probes(tables: int, bits: int, probes: int, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 1_024):
            part = b.slice(k, 1_024)
            got = probed(_sides(_matrix(part, "v"), tables, bits), probes)
            n, _, p = got.shape
            at = pa.array(np.repeat(np.arange(n), tables * p))
            cols = [pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), p), n)), pa.array(got.ravel().astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*cols, *[part.column(c).take(at) for c in keep]], ["tab", "bucket", *keep])


def _ddl(df: DataFrame, columns: list[str]) -> str:
    return "tab int, bucket int, " + ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def build(vectors: DataFrame, root: str, id_: str = "vec_id", vector: str = "embedding", metadata: tuple[str, ...] = (), p: Params = Params()) -> int:
    """Write the next version of the index of (id, vector, metadata) under ``root`` and return its number.

    Rows without an id and those whose vector is null, empty, not finite or not of the commonest length are left out. Repeated
    ids are rows each.
    An empty table gives an index without rows. The buckets and the vectors are written first and count from the moment the
    version's description is committed."""
    spark, keep = vectors.sparkSession, [id_, *metadata]
    rows = vectors.where(usable(vectors[vector]) & vectors[id_].isNotNull()).select(*[vectors[c] for c in keep], vectors[vector].alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").limit(1).collect()
    d, n = (sizes[0].d, sizes[0].n) if sizes else (1, 0)
    rows, bits = rows.where(F.size("v") == d), bits_for(n, p)
    in_buckets = rows.mapInArrow(lambda it: _buckets(p.tables, bits, keep, it), _ddl(rows, keep)).repartitionByRange("tab", "bucket").sortWithinPartitions("tab", "bucket")
    parts = {"buckets": publish(in_buckets, f"{root}/buckets"), "rows": publish(rows.repartition(id_).sortWithinPartitions(id_), f"{root}/rows")}
    told = {**asdict(p), "bits": bits, "dimensions": d, "n_rows": n, "id": id_, "metadata": list(metadata), **parts}
    return publish(spark.createDataFrame([told], "tables int, probes int, bucket_rows int, bits int, dimensions int, n_rows long, id string, metadata array<string>, buckets int, rows int"), f"{root}/about")


def about(spark: SparkSession, root: str):  # noqa: ANN201
    got = current(spark, root + "/about")
    if got is None:
        raise ValueError(f"no index in {root}")
    return got.first()


def candidates(spark: SparkSession, root: str, queries: DataFrame, id_: str = "vec_id", vector: str = "embedding", match: str | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, id): rows other than the query's own that share a probed bucket, once each; with ``match`` only those whose
    metadata column equals the query's."""
    a = about(spark, root)
    on = ["tab", "bucket", *([match] if match else [])]
    q = queries.where(usable(queries[vector], a.dimensions) & queries[id_].isNotNull()).select(queries[id_].alias("query_id"), *([queries[match]] if match else []), queries[vector].alias("v"))
    carry = ["query_id", *([match] if match else [])]
    asked = q.mapInArrow(lambda it: _probes(a.tables, a.bits, probes or a.probes, carry, it), _ddl(q, carry))
    held = current(spark, root + "/buckets", version=a.buckets).withColumnRenamed(a.id, "__id")
    met = asked.join(held, on).where(F.col("query_id") != F.col("__id"))
    return met.select("query_id", F.col("__id").alias(a.id)).distinct()


def search(spark: SparkSession, root: str, queries: DataFrame, k: int = 5, id_: str = "vec_id", vector: str = "embedding", match: str | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` nearest found, by exact squared distance d: score 1 / (1 + d) rounded to 6 places,
    ties by id. Queries without an id, of another length, null or not finite find nothing."""
    a = about(spark, root)
    met = candidates(spark, root, queries, id_, vector, match, probes)
    q = queries.where(usable(queries[vector], a.dimensions) & queries[id_].isNotNull()).select(queries[id_].alias("query_id"), queries[vector].alias("q"))
    rows = current(spark, root + "/rows", version=a.rows).select(a.id, "v")
    d = F.aggregate(F.zip_with("v", "q", lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)
    got = met.join(rows, a.id).join(q, "query_id").select("query_id", a.id, F.round(1 / (1 + d), 6).alias("score"))
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), a.id)
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", a.id, "score")


def recall(found: DataFrame, exact: DataFrame, id_: str = "vec_id") -> float:
    """The part of the exact neighbours (query_id, id) that were found."""
    both = exact.select("query_id", id_).join(found.select("query_id", id_).withColumn("__f", F.lit(1)), ["query_id", id_], "left")
    r = both.agg(F.count(F.lit(1)).alias("n"), F.count("__f").alias("f")).first()
    return r.f / r.n if r.n else 1.0
