"""Connected components: few edges are settled on the driver, others by alternating large-star and small-star steps, of which
nothing is collected but one flag a round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageknow.llm.common import BROADCAST_ROWS, discard, held, materialize

#: At most so many edges, of 16 bytes, are collected; a round of steps costs several jobs, whatever it holds.
FEW = 200_000
#: Rounds over at most so many edges are planned once, for a number of partitions that fits them. Adaptive plans start two or
#: more threads of the driver for each shuffle, which stay for a minute; many short rounds fill its memory with them.
SMALL, PART_EDGES = 400_000, 50_000
#: An id with so many edges is a hub; in large tables more are needed, so that there are at most BROADCAST_ROWS hubs.
HUB = 1_000


def _met(e: DataFrame, rows: int) -> DataFrame:
    """``e`` (u, v) with m, of each u the least v. The least of a hub is broadcast to its edges where they are, so they do
    not meet in one task; the others are joined by u."""
    at = max(HUB, 2 * rows // BROADCAST_ROWS)  # every edge counts at most twice
    m = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    if rows < at:  # too few edges for a hub
        return e.join(m.select("u", "m"), "u")
    m = materialize(m, "least")
    hubs = m.where(F.col("n") >= at).select("u", "m")
    tried = e.join(F.broadcast(hubs), "u", "left")
    light = tried.where("m IS NULL").select("u", "v").join(m.where(F.col("n") < at).select("u", "m"), "u")
    return tried.where("m IS NOT NULL").select("u", "v", "m").unionAll(light.select("u", "v", "m"))


def _large_star(e: DataFrame, rows: int) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _met(both, rows).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(e: DataFrame, rows: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _met(down, rows)
    return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(met.where("v = m").select("u", "v"))


def _are_stars(e: DataFrame) -> bool:
    """Whether every id points to one root and no root points on; one narrow aggregation."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("points"), F.lit(0).alias("root")).unionAll(e.select(F.col("v"), F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("points").alias("points"), F.max("root").alias("root")).where("points > 1 OR points + root > 1").isEmpty()


def join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Changes labels, of each position the least one known to be reachable, by edges between positions i and j."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of edges and of each the smallest id reachable."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = np.arange(len(ids))
    join(label, at[: len(u)], at[len(u) :])
    return ids, ids[label]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``connected_components`` of written edges; at most FEW are collected and settled without a round."""
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    if e.count() > FEW:
        return connected_components(edges, a, b)
    got = e.toArrow()
    ids, roots = labels(got.column("u").to_numpy(), got.column("v").to_numpy())
    return e.sparkSession.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "component": pa.array(roots, pa.int64())}))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in ``edges``: the smallest id reachable. Ids are longs; edges with a null are ignored,
    loops and repeated edges do no harm, an empty table gives an empty result."""
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    loops = e.where("u = v").select("u", "v")
    e = materialize(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    rows = e.count()
    fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": 4 + rows // PART_EDGES}
    with held(e.sparkSession, fixed if rows <= SMALL else {}):
        e = _stars(e, rows, max_rounds)
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots).unionAll(loops.toDF("id", "component")).groupBy("id").agg(F.min("component").alias("component"))


def _stars(e: DataFrame, rows: int, max_rounds: int) -> DataFrame:
    """Of ``rows`` written edges (u, v), u > v, those from each id to the least of its component."""
    for _ in range(max_rounds if rows else 0):
        large = _large_star(e, rows).where("u <> v").distinct()
        large = large if rows < HUB else materialize(large, "stars")
        e, before = materialize(_small_star(large, rows).where("u <> v").distinct(), "stars"), e
        discard(before, large)
        if _are_stars(e):
            return e
    if rows:
        raise RuntimeError("components did not settle")
    return e
