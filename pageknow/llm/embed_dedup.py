"""Embedding near-dedup: spherical k-means cells, blocked cosine products of near cells, one row kept per group.

Equal vectors are one class. Each class lives in the cell of its nearest centroid; near cells share a block of bounded size, a
large cell has several. If the rows of cells c and d lie within angles p and q of their centroids, then rows of the two reach the
cosine of an angle t only where the centroids are at most ``p + q + t`` apart; blocks without such cells do not meet,
nor do other cells inside blocks. So all links are found. A block is one row of a written table; blocks meet in a product of
the table with itself, in which each task reads the blocks that it needs from there, so vectors are shuffled once, not once for each
block that they meet. Pairs of blocks return sums of links and a spanning set of edges, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageknow.llm.common import BATCH_CONF, discard, fill_partitions, held, materialize
from pageknow.llm.graph import components, join
from pageknow.llm.vectors import matrix, sample, spherical_kmeans, unit, valid


#: Components of the vectors of a block, at most, about.
BLOCK_SIZE = 1_000_000
#: Single precision says nothing this near the threshold, nor an angle on its last digits.
UNSURE, SLACK = 1e-4, 1e-6


@dataclass(frozen=True)
class Params:
    cosine: float = 0.9
    sample_rows: int = 16_000  # rows the centroids are fitted on (smallest hash first)
    cells: int = 0  # number of cells; 0: half the root of the number of rows
    max_cells: int = 4_096
    z: float = 2.5  # not used any more, nor is spread: all links are found
    spread: float = 0.995
    block: int = 1_024  # rows on each side of a product; a block has eight times as many at most, about


def _assign(c: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the home cell, the cosine to its centroid, and the vector as bytes, in single precision if that is the same."""
    for b in batches:
        if not b.num_rows:
            continue
        v = matrix(b.column("v"))
        s = unit(v) @ c.T
        home = s.argmax(axis=1)
        with np.errstate(over="ignore"):
            single = v.astype(np.float32)
        short = (single == v).all(axis=1).tolist()
        data = [(x if ok else y).tobytes() for x, y, ok in zip(single, v, short, strict=True)]
        cols = [b.column(k) for k in ("id", "m", "rep")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(home, pa.int32()), pa.array(s[np.arange(len(v)), home]), pa.array(data, pa.binary())], ["id", "m", "rep", "home", "fit", "v"])


def _pack(dim: int, table: pa.Table) -> pa.Table:
    """One block as one row, its rows sorted by cell."""
    table = table.sort_by([("home", "ascending"), ("id", "ascending")])
    v = [np.frombuffer(x, np.float32 if len(x) == 4 * dim else np.float64) for x in table.column("v").to_pylist()]
    v = np.stack(v)  # double if one is
    flat = {"id": table.column("id").to_numpy(), "m": table.column("m").to_numpy(), "home": table.column("home").to_numpy(), "v": v}
    return pa.table({"block": table.column("block").slice(0, 1), **{k: pa.array([x.tobytes()], pa.binary()) for k, x in flat.items()}})


def layout(c: np.ndarray, n: np.ndarray, rows: int) -> list[tuple[np.ndarray, int]]:
    """Cells and the number of their blocks: cells of together at most ``rows`` rows share one, near ones by halving along the axis in
    which centroids differ most; a larger cell has several for itself."""
    out, left = [], [np.flatnonzero(n)]
    while left:
        at = left.pop()
        if not len(at):
            continue
        if len(at) == 1 or n[at].sum() <= rows:
            out.append((at, max(1, -(-int(n[at].sum()) // rows))))
            continue
        x = c[at] - c[at].mean(axis=0)
        at = at[np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")]
        half = np.cumsum(n[at])
        k = min(max(1, int(np.searchsorted(half, half[-1] / 2)) + 1), len(at) - 1)
        left += [at[k:], at[:k]]
    return out


def _near(c: np.ndarray, reach: np.ndarray, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Of cells a and b, whether rows of both can reach the threshold."""
    return np.arccos(np.clip(c[a] @ c[b].T, -1, 1)) <= reach[a][:, None] + reach[b][None, :] + t + SLACK


def _meet(c: np.ndarray, reach: np.ndarray, p: Params, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks to (id, n, root): of rows with links their number there, and what is reachable by the links."""
    t = float(np.arccos(np.clip(p.cosine, -1, 1)))
    for b in batches:
        for row in b.to_pylist():
            same = row["block"] == row["block2"]
            ids, m, home = (np.concatenate([np.frombuffer(row[k], kind), np.frombuffer(row[f"{k}2"], kind)[: 0 if same else None]]) for k, kind in (("id", np.int64), ("m", np.int64), ("home", np.int32)))
            split = len(row["id"]) // 8
            x = np.concatenate([_vectors(row["v"], c.shape[1], split), _vectors(row["v2"], c.shape[1], len(row["id2"]) // 8)[: 0 if same else None]])
            single = x.astype(np.float32)
            right = np.arange(split, len(ids)) if not same else np.arange(split)
            n, label, touched = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.zeros(len(ids), bool)
            cells, start = np.unique(home[:split], return_index=True)
            mates = np.unique(home[right])
            near = _near(c, reach, cells, mates, t)
            for k, (lo, hi) in enumerate(zip(start.tolist(), [*start[1:].tolist(), split], strict=True)):
                some = right if near[k].all() else right[near[k][np.searchsorted(mates, home[right])]]
                for h in range(lo, hi, p.block):
                    for r in range(0, len(some), p.block):
                        i, j = _linked(x, single, np.arange(h, min(hi, h + p.block)), some[r : r + p.block], p.cosine)
                        if len(i):
                            np.add.at(n, i, m[j])
                            if not same:
                                np.add.at(n, j, m[i])
                            touched[i] = touched[j] = True
                            join(label, i, j)
            at = np.flatnonzero(touched)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n[at]), pa.array(ids[label[at]])], ["id", "n", "root"])


def _vectors(data: bytes, dim: int, n: int) -> np.ndarray:
    """The unit vectors of a block of n rows."""
    return unit(np.frombuffer(data, np.float32 if len(data) == 4 * dim * n else np.float64).astype(np.float64).reshape(n, dim))


def _linked(x: np.ndarray, single: np.ndarray, h: np.ndarray, r: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the linked pairs of h and r, but a row with itself."""
    s = single[h] @ single[r].T
    i, j = np.nonzero(s >= cosine - UNSURE)
    s = s[i, j]
    i, j = h[i], r[j]
    ok = i != j
    open_ = np.flatnonzero(ok & (s < cosine + UNSURE))
    for k in range(0, len(open_), 100_000):
        at = open_[k : k + 100_000]
        ok[at] = np.einsum("ij,ij->i", x[i[at]], x[j[at]]) >= cosine
    return i[ok], j[ok]


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", p: Params = Params()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing and are kept; so are rows
    without vec_id. Vectors are compared with those of their own length. Equal rows count
    each other as links. Ties do not arise: the smallest vec_id names and represents a group. Other columns are ignored;
    an empty table gives an empty result.
    """
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[vector].cast(kind).alias("v"))
    ok = valid(F.col("v")) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("ok", ok).withColumn("id", F.when(F.col("ok"), F.xxhash64(F.col("v").cast("array<double>"))))
    good = rows.where("ok")
    classes = materialize(good.groupBy("id").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("rep"), F.first("v").alias("v"), F.first(F.size("v")).alias("dim")), "vector-classes")
    dims = sorted((r.dim, r.n) for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect())
    out = rows.select("vec_id", "id")
    if not dims:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    placed = [_placed(classes.where(F.col("dim") == dim), n, p) for dim, n in dims]
    discard(classes)
    found = reduce(DataFrame.unionAll, [_links(some, c, p) for some, c in placed])
    classes = reduce(DataFrame.unionAll, [some.select("id", "rep", "m") for some, _ in placed])
    comp = components(found, "id", "root")
    named = classes.select("id", "rep", "m").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    info = named.join(names, "component").join(links, "id", "left").select("id", "component_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    done = out.where("id IS NOT NULL").join(materialize(info, "vector-groups"), "id").select("vec_id", "n_links", "component_id")
    rest = out.where("id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionAll(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _placed(classes: DataFrame, n: int, p: Params) -> tuple[DataFrame, np.ndarray]:
    """The classes with their home cells, written, and the centroids."""
    x = unit(sample(classes, "id", p.sample_rows))
    c = spherical_kmeans(x, p.cells or max(1, min(p.max_cells, round(n**0.5 / 2))))
    placed = fill_partitions(classes.select("id", "m", "rep", "v")).mapInArrow(lambda it: _assign(c, it), "id long, m long, rep long, home int, fit double, v binary")
    return materialize(placed, "vector-cells"), c


def _links(placed: DataFrame, c: np.ndarray, p: Params) -> DataFrame:
    """(id, n, root), written."""
    spark, k, dim = placed.sparkSession, len(c), c.shape[1]
    n, fit = np.zeros(k, np.int64), np.ones(k)
    for r in placed.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.min("fit").alias("fit")).collect():  # at most max_cells rows
        n[r.home], fit[r.home] = r.n, r.fit
    reach = np.arccos(np.clip(fit, -1, 1))
    packs = layout(c, n, max(p.block, min(8 * p.block, BLOCK_SIZE // dim)))
    first = np.cumsum([0] + [b for _, b in packs])
    of = np.zeros(k, np.int64)
    for i, (at, _) in enumerate(packs):
        of[at] = i
    cells = pa.table({"home": pa.array(np.arange(k), pa.int32()), "first": pa.array(first[of], pa.int32()), "parts": pa.array(np.array([b for _, b in packs])[of], pa.int32())})
    each = placed.join(F.broadcast(spark.createDataFrame(cells)), "home")
    each = each.select((F.col("first") + F.pmod(F.xxhash64("id"), "parts")).cast("int").alias("block"), "id", "m", "home", "v")
    each = each.repartition(int(first[-1]), "block")
    blocks = materialize(each.groupBy("block").applyInArrow(lambda t: _pack(dim, t), "block int, id binary, m binary, home binary, v binary"), "vector-blocks")
    # of each block those at or behind it that it meets
    t = float(np.arccos(np.clip(p.cosine, -1, 1)))
    mates = []
    for i, (at, b) in enumerate(packs):
        met = np.unique(of[_near(c, reach, at, np.arange(k), t).any(axis=0) & (n > 0)])
        met = np.concatenate([np.arange(first[j], first[j + 1]) for j in met])
        mates += [met[met >= first[i] + o].tolist() for o in range(b)]
    mates = pa.table({"block": pa.array(np.arange(len(mates)), pa.int32()), "mates": pa.array(mates, pa.list_(pa.int32()))})
    left = blocks.join(F.broadcast(spark.createDataFrame(mates)), "block")
    right = blocks.select(*[F.col(x).alias(f"{x}2") for x in blocks.columns])
    pairs = left.join(right, F.array_contains("mates", F.col("block2"))).drop("mates")
    with held(spark, {BATCH_CONF: 2}):
        found = materialize(pairs.mapInArrow(lambda it: _meet(c, reach, p, it), "id long, n long, root long"), "vector-links")
    discard(blocks)
    return found
