"""Approximate nearest neighbours by balanced posting lists.

Largest inner product becomes least distance by one more component, sqrt(M^2 - |x|^2) with M the largest norm, 0 for
queries. Balanced k-means (fitted on a bounded sample) gives the centroids; every row goes to the list of its nearest
centroid and, near a border, to further lists too. A query walks a graph of the centroids held in memory, from near to
farther ones, and takes the lists whose distance is within a ratio of the nearest. The ratio is calibrated: for a bounded
sample of queries the true neighbours are found by comparing with all rows, and the ratio is set so that the lists taken
hold the wanted share of them. Each list is scored for its own queries in blocks of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageknow.llm.common import fill_partitions, materialize
from pageknow.llm.vectors import balanced_kmeans, matrix, sample, valid


@dataclass(frozen=True)
class Params:
    k: int = 20
    sample_rows: int = 16_000  # rows the centroids are fitted on (smallest hash first)
    max_lists: int = 2_048
    copies: int = 3  # most lists of a row
    border: float = 0.04  # a further list is at most so much farther than the nearest
    probe_sample: int = 128  # queries the ratio is calibrated on
    recall: float = 0.98  # share of their true neighbours in the lists taken
    degree: int = 16  # neighbours of a centroid in the graph
    block: int = 32_768  # rows of a list compared at once
    query_block: int = 2_048


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T))


def centroid_graph(c: np.ndarray, degree: int) -> list[np.ndarray]:
    """Nearest centroids of each, both ways, and a ring so that all are reached."""
    d = _distances(c, c)
    near = [set(np.argsort(r, kind="stable")[1 : degree + 1].tolist()) for r in d]
    for i, s in enumerate(list(map(set, near))):
        for j in s:
            near[j].add(i)
        near[i].add((i + 1) % len(c))
        near[(i + 1) % len(c)].add(i)
    return [np.array(sorted(s - {i}), dtype=int) for i, s in enumerate(near)]


def walk(q: np.ndarray, c: np.ndarray, graph: list[np.ndarray], ratio: float) -> list[int]:
    """Lists within ``ratio`` of the nearest centroid found, by best-first search from the first centroid."""
    def dist(at: np.ndarray) -> np.ndarray:
        return np.sqrt(((c[at] - q) ** 2).sum(1))

    seen = np.zeros(len(c), dtype=bool)
    seen[0] = True
    heap = [(float(dist(np.array([0]))[0]), 0)]
    best, got = heap[0][0], []
    # past the ratio a little more of the graph is looked at, so that a ridge does not stop the walk
    while heap and (heap[0][0] <= best * ratio * 1.05 or len(got) < 8):
        d, i = heapq.heappop(heap)
        best = min(best, d)
        got.append((d, i))
        new = graph[i][~seen[graph[i]]]
        if len(new):
            seen[new] = True
            for e, j in zip(dist(new).tolist(), new.tolist(), strict=True):
                heapq.heappush(heap, (e, j))
    return [i for d, i in sorted(got) if d <= best * ratio] or [min(got)[1]]


def _lists(c: np.ndarray, top: float, p: Params, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        v = matrix(b.column("v"))
        x = np.column_stack([v, np.sqrt(np.maximum(0, top * top - (v * v).sum(1)))])
        d = _distances(x, c)
        first = np.argsort(d, axis=1, kind="stable")[:, : p.copies]
        lists = [[int(j) for j in r if d[i, j] <= d[i, r[0]] * (1 + p.border)] for i, r in enumerate(first)]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(lists, pa.list_(pa.int32()))], ["id", "v", "lists"])


def _probes(c: np.ndarray, graph: list[np.ndarray], ratio: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = [walk(np.append(v, 0.0), c, graph, ratio) for v in (matrix(b.column("v")) if b.num_rows else ())]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(lists, pa.list_(pa.int32()))], ["id", "v", "lists"])


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest, ties to the smaller id; all that tie with the last are looked at."""
    if len(s) > k:
        cut = np.partition(s, len(s) - k)[len(s) - k]
        at = np.flatnonzero(s >= cut)
    else:
        at = np.arange(len(s))
    return at[np.lexsort((ids[at], -s[at]))[:k]]


def _score_all(queries: np.ndarray, ids: np.ndarray, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample queries against every row: the best of each batch."""
    for b in batches:
        if not b.num_rows:
            continue
        at, v = b.column("id").to_numpy(), matrix(b.column("v"))
        s = queries @ v.T
        out = []
        for i, q in enumerate(ids.tolist()):
            row = np.where(at == q, -np.inf, s[i])
            out += [(i, int(at[j]), float(row[j]), b.column("lists")[int(j)].as_py()) for j in _best(row, at, k).tolist() if at[j] != q]
        yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], t) for n, t in enumerate((pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.int32())))], ["q", "id", "score", "lists"])


def inner(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of ``q`` with each row, summed from the first component to the last: a pair has one score in every block."""
    out = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        out += rows[:, j] * q[j]
    return out


def _search(k: int, table: pa.Table) -> pa.Table:
    """Queries against the rows of a block of lists: the best k rows of each query among the lists it takes, each row once.

    The block products only choose: all rows within their rounding of a list's k-th score are scored again by ``inner``.
    """
    kind = table.column("query").to_numpy()
    ids = table.column("id").to_numpy()
    x = matrix(table.column("v"))
    lists = table.column("lists").to_pylist()
    qs, rows = np.flatnonzero(kind), np.flatnonzero(~kind)
    by: dict[int, list[int]] = {}
    for r in rows.tolist():
        for name in lists[r]:
            by.setdefault(name, []).append(r)
    found: dict[int, list[np.ndarray]] = {q: [] for q in qs.tolist()}
    asks: dict[int, list[int]] = {}
    for q in qs.tolist():
        for name in lists[q]:
            asks.setdefault(name, []).append(q)
    norms = np.sqrt((x * x).sum(1))
    for name, members in by.items():
        asking = asks.get(name)
        if not asking:
            continue
        at = np.array(members)
        s = x[asking] @ x[at].T
        slack = 4 * x.shape[1] * np.finfo(float).eps * norms[at].max()
        for i, q in enumerate(asking):
            row = np.where(ids[at] == ids[q], -np.inf, s[i])
            cut = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            found[q].append(at[(row >= cut - slack * norms[q]) & (row != -np.inf)])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, f in found.items():
        at = np.unique(np.concatenate(f)) if f else np.zeros(0, np.int64)
        s = inner(x[q], x[at])
        keep = _best(s, ids[at], k)
        out.append((np.full(len(keep), ids[q]), ids[at[keep]], s[keep]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)})


def search(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", p: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query row the k rows found with the largest inner product, its own left out.

    ``is_query``: a condition on the column vec_id. Null, empty, zero and non-finite vectors and rows without vec_id take no
    part. A repeated vec_id counts once, with the smallest of its vectors; queries meet the vectors of their own length. Ties
    go to the smaller vec_id. Fewer candidates than k give fewer rows; an empty table gives an empty result.
    """
    rows = vectors.select(vectors[vec_id].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("v")).where(valid(F.col("v")) & F.col("id").isNotNull())
    rows = materialize(rows.groupBy("id").agg(F.min("v").alias("v")), "ann-rows")
    found = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():  # one row a length
        found = found.unionAll(_found(rows.where(F.size("v") == r.dim), r.n, is_query, p))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # a row of several lists is found in each
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


def _found(rows: DataFrame, n: int, is_query: Column, p: Params) -> DataFrame:
    """(query_id, vec_id, score) of the best rows of each list that a query takes. A list meets its own queries only, both in
    blocks of bounded size."""
    top = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    s = sample(rows, "id", p.sample_rows)
    c = balanced_kmeans(np.column_stack([s, np.sqrt(np.maximum(0, top * top - (s * s).sum(1)))]), max(1, min(p.max_lists, round(n**0.5 / 2))))
    placed = materialize(fill_partitions(rows).mapInArrow(lambda it: _lists(c, top, p, it), "id long, v array<double>, lists array<int>"), "ann-lists")
    asked = materialize(rows.withColumnRenamed("id", "vec_id").where(is_query).withColumnRenamed("vec_id", "id"), "ann-queries")
    graph = centroid_graph(c, p.degree)
    ratio = _calibrate(placed, asked, c, p)
    if ratio is None:
        return rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    probes = materialize(fill_partitions(asked).mapInArrow(lambda it: _probes(c, graph, ratio, it), "id long, v array<double>, lists array<int>"), "ann-probes")
    member, ask = (x.select("id", "v", F.explode("lists").alias("l")) for x in (placed, probes))
    blocks = lambda x, size, name: x.groupBy("l").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    size = materialize(blocks(member, p.block, "vb").join(blocks(ask, p.query_block, "qb"), "l"), "ann-blocks")  # one row a list
    h = F.xxhash64("id")
    right = member.join(F.broadcast(size), "l").select("l", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), F.pmod(h, "vb").cast("int").alias("b"), F.lit(False).alias("query"), "id", "v", F.array("l").alias("lists"))
    left = ask.join(F.broadcast(size), "l").select("l", F.pmod(h, "qb").cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("vb") - 1)).alias("b"), F.lit(True).alias("query"), "id", "v", F.array("l").alias("lists"))
    k = p.k
    return left.unionAll(right).groupBy("l", "q", "b").applyInArrow(lambda t: _search(k, t), "query_id long, vec_id long, score double")


def _calibrate(placed: DataFrame, asked: DataFrame, c: np.ndarray, p: Params) -> float | None:
    """Ratio of distances that reaches the wanted share of the true neighbours of the sample queries; None without queries."""
    got = asked.orderBy(F.xxhash64("id"), "id").limit(p.probe_sample).toArrow()
    if not got.num_rows:
        return None
    ids, q = got.column("id").to_numpy(), matrix(got.column("v"))
    k = p.k
    best = placed.mapInArrow(lambda it: _score_all(q, ids, k, it), "q int, id long, score double, lists array<int>")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), "id"))
    true = best.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "lists").collect()  # at most probe_sample * k rows
    d = _distances(np.column_stack([q, np.zeros(len(q))]), c)
    need = sorted(min(d[r.q, j] for j in r.lists) / max(1e-12, d[r.q].min()) for r in true)
    return float(need[min(len(need) - 1, int(p.recall * len(need)))]) + 1e-9 if need else 1.0
