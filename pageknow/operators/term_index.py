"""A stored term index and top-k search over it with a MaxScore cut.

The index has a row a chunk: its terms with their weights and the length of its vector, in order of that length, so that a
block of neighbouring rows has terms of like impact, and by term the number of chunks. A search reads the index once, in
blocks. In a block each query takes its rare terms first; from the largest impacts of the block it knows what its other terms
can add at most, and looks them up only for rows that can still reach its k-th best score so far. No pair of a query and
a chunk leaves a task but the best k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageknow.functions.lexicon import HIGH_VALUE_TERMS, SEARCH_STOPWORDS
from pageknow.functions.text import terms as terms_of
from pageknow.sources.commits import append, current, publish, read

#: A task's first block has so many rows; each later one has twice as many, up to MOST_ROWS and CELLS.
FIRST_ROWS, MOST_ROWS, CELLS = 32, 2_048, 4_000_000
#: Query terms that meet the index in one pass; larger query sets are dealt into blocks.
QUERY_TERMS = 500_000
#: Scores are kept as whole millionths.
MICRO = 1_000_000


def write_rows(rows: DataFrame, root: str) -> int:
    """Write (keys .., terms, weights, norm, bonus, a_0 ..) and the chunks a term occurs in as the next version of an index. Rows of
    one length are spread by their terms, so a length that many share is no hot task."""
    spark = rows.sparkSession
    n = publish(rows.repartitionByRange("norm", F.xxhash64("terms")).sortWithinPartitions("norm"), f"{root}/rows")
    stored = current(spark, f"{root}/rows", version=n)
    df = stored.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    parts = publish(df, f"{root}/terms")
    return publish(spark.createDataFrame([(n, parts)], "rows int, terms int"), f"{root}/about")


def write_cosine(index: DataFrame, root: str, keys: list[str]) -> int:
    """Store a sparse index (keys, term, tf, norm); see ``retrieval.sparse_index``."""
    held = F.sort_array(F.collect_list(F.struct("term", "tf")))
    rows = index.groupBy(*keys).agg(held.alias("x"), F.max("norm").alias("norm"))
    return write_rows(rows.select(*keys, F.col("x.term").alias("terms"), F.col("x.tf").cast("array<double>").alias("weights"), "norm", F.lit(0.0).alias("bonus")), root)


def write_keywords(chunks: DataFrame, root: str, keys: list[str], attributes: tuple[str, ...] = (), text: str = "text") -> int:
    """Store the distinct search terms of chunks (keys, text[, page_type, attributes]); a page type adds its bonus to each score."""
    page = F.when(F.col("page_type") == "faq_cleaned", 0.6).when(F.col("page_type") == "faq", 0.3).otherwise(0.0) if "page_type" in chunks.columns else F.lit(0.0)
    t = F.array_sort(F.array_distinct(terms_of(F.col(text), SEARCH_STOPWORDS)))
    rows = chunks.select(*keys, t.alias("terms"), page.alias("bonus"), *[F.lower(F.col(a)).alias(f"a_{i}") for i, a in enumerate(attributes)])
    ones = F.transform("terms", lambda _: F.lit(1.0))
    return write_rows(rows.where(F.size("terms") > 0).withColumns({"weights": ones, "norm": F.lit(1.0)}), root)


class _Queries:
    """A block of queries as arrays; the terms of a query from the rarest to the commonest."""

    def __init__(self, rows: list, attributes: list[float]):
        self.ids = [r.id for r in rows]
        words = sorted({t for r in rows for t in r.terms})
        number = {t: i for i, t in enumerate(words)}
        self.words = pa.array(words, pa.string())
        self.terms, self.weights = [], []
        for r in rows:
            order = np.lexsort((np.arange(len(r.terms)), np.array(r.df)))
            self.terms.append(np.array([number[r.terms[i]] for i in order]))
            self.weights.append(np.array([r.weights[i] for i in order], dtype=float))
        self.norm = np.array([r.norm for r in rows])
        self.wanted = [[r.wanted[i] for r in rows] for i in range(len(attributes))]
        self.attributes = attributes


class _Search:
    def __init__(self, q: _Queries, keys: list[str], k: int, least: float, scored: Accumulator | None):
        self.q, self.keys, self.k, self.least, self.scored = q, keys, k, int(np.ceil(least * MICRO - 1e-6)), scored
        self.best: list[list[tuple]] = [[] for _ in q.ids]  # (-millionths, keys, matched), at most k, sorted
        self.n_scored = 0

    def floor(self, i: int) -> int:
        """Millionths that a row of query i must have to matter."""
        return max(self.least, -self.best[i][-1][0]) if len(self.best[i]) == self.k else self.least

    def block(self, b: pa.RecordBatch) -> None:
        lists, norm = b.column("terms"), b.column("norm").to_numpy()
        at = pc.index_in(lists.flatten(), value_set=self.q.words)
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        known = at.is_valid().to_numpy(zero_copy_only=False)
        term, row = at.drop_null().to_numpy(), row[known]
        weight = b.column("weights").flatten().to_numpy()[known]
        here, local = np.unique(term, return_inverse=True)
        place = np.full(len(self.q.words), -1)
        place[here] = np.arange(len(here))
        w = np.zeros((b.num_rows, len(here)))
        w[row, local] = weight
        most = np.zeros(len(here))
        np.maximum.at(most, local, weight / norm[row])
        keys = [b.column(c).to_pylist() for c in self.keys]
        bonus = b.column("bonus").to_numpy()
        attributes = [np.array(b.column(f"a_{i}").to_pylist(), dtype=object) for i in range(len(self.q.attributes))]
        for i in range(len(self.q.ids)):
            self.one(i, w, place, most, norm, bonus, attributes, keys)

    def one(self, i: int, w: np.ndarray, place: np.ndarray, most: np.ndarray, norm: np.ndarray, bonus: np.ndarray, attributes: list[np.ndarray], keys: list[list]) -> None:
        q, cols = self.q, place[self.q.terms[i]]
        weights = q.weights[i][cols >= 0]
        cols = cols[cols >= 0]
        if not len(cols):
            return
        extra = bonus
        for n, add in enumerate(q.attributes):
            if q.wanted[n][i] is not None:
                extra = extra + np.where(attributes[n] == q.wanted[n][i], add, 0.0)
        floor = self.floor(i) / MICRO - 1e-6
        adds = weights * most[cols] / q.norm[i]
        after = np.append(np.cumsum(adds[::-1])[::-1][1:], 0.0)  # what the later terms can add at most
        top = float(extra.max(initial=0.0))
        n = min(len(cols), int((after + top >= floor).sum()) + 1)  # a row without any of these can't reach the floor
        dot = w[:, cols[:n]] @ weights[:n]
        if n == len(cols) or after[n - 1] + top >= floor:
            n, dot = len(cols), w[:, cols] @ weights
        rows = np.flatnonzero((dot > 0) & (dot / (q.norm[i] * norm) + extra + after[n - 1] >= floor))
        dot, step = dot[rows], max(1, n)
        while n < len(cols) and len(rows):
            m = min(len(cols), n + step)
            dot = dot + w[np.ix_(rows, cols[n:m])] @ weights[n:m]
            stay = dot / (q.norm[i] * norm[rows]) + extra[rows] + after[m - 1] >= floor
            rows, dot, n, step = rows[stay], dot[stay], m, 2 * step
        self.n_scored += len(rows)
        micro = np.floor((dot / (q.norm[i] * norm[rows]) + extra[rows]) * MICRO + 0.5).astype(np.int64)
        good = micro >= max(self.floor(i), 1)
        rows, micro = rows[good], micro[good]
        if len(rows) > self.k:
            kth = np.partition(micro, len(micro) - self.k)[len(micro) - self.k]
            rows, micro = rows[micro >= kth], micro[micro >= kth]
        if len(rows):
            matched = (w[np.ix_(rows, cols)] > 0).sum(axis=1).tolist()
            new = [(-m, tuple(c[r] for c in keys), n) for m, r, n in zip(micro.tolist(), rows.tolist(), matched, strict=True)]
            self.best[i] = sorted(self.best[i] + new)[: self.k]

    def run(self, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        size = FIRST_ROWS
        for b in batches:
            at = 0
            while at < b.num_rows:
                self.block(b.slice(at, size))
                at, size = at + size, min(2 * size, MOST_ROWS, max(FIRST_ROWS, CELLS // max(1, len(self.q.words))))
        if self.scored is not None:
            self.scored.add(self.n_scored)
        rows = [(self.q.ids[i], -m, n, *k) for i, found in enumerate(self.best) for m, k, n in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)


def search(spark: SparkSession, root: str, queries: DataFrame, keys: list[str], k: int = 5, least: float = 0.0, attributes: tuple[float, ...] = (), work: str | None = None, scored: Accumulator | None = None) -> DataFrame:
    """(id, rank, keys, score, matched): for each query (id, terms, weights, norm, wanted: array of attribute values) the ``k`` rows of the
    largest score: the product of weights over shared terms, by both lengths, plus bonuses: the row's own, and ``attributes``
    where the row's attribute is the wanted one. Scores are rounded to 6 places and at least ``least``; ties go to the smaller keys.
    A row that shares no term is never found, a query without terms finds nothing. Query sets of more than QUERY_TERMS terms are dealt into blocks, whose
    results are written under ``work``. ``scored`` counts the pairs whose terms were all looked up."""
    about = current(spark, f"{root}/about")
    if about is None:
        raise ValueError(f"no index in {root}")
    v = about.first()
    index = current(spark, f"{root}/rows", version=v.rows)
    df = current(spark, f"{root}/terms", version=v.terms)
    each = queries.select("id", F.explode(F.arrays_zip("terms", "weights")).alias("x")).select("id", "x.terms", "x.weights")
    known = each.join(df, each["terms"] == df["term"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "weights", "df"))).alias("x"))
    q = queries.select("id", "norm", "wanted").join(known, "id").select("id", "norm", "wanted", F.col("x.term").alias("terms"), F.col("x.weights").alias("weights"), F.col("x.df").alias("df"))
    total = q.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // QUERY_TERMS))
    named = ["id", "micro", "matched", *keys]
    kinds = [f"`{c}` {index.schema[c].dataType.simpleString()}" for c in keys]
    ddl = ", ".join([f"id {queries.schema['id'].dataType.simpleString()}", "micro long", "matched long", *kinds])
    schema = pa.schema([pa.field(c, t) for c, t in zip(named, [_arrow(queries, "id"), pa.int64(), pa.int64(), *[_arrow(index, c) for c in keys]], strict=True)])

    def found(block: DataFrame) -> DataFrame:
        held = _Queries(block.collect(), list(attributes))  # bounded by QUERY_TERMS
        near = index.mapInArrow(lambda it: _Search(held, keys, k, least, scored).run(it, schema), ddl)
        order = W.partitionBy("id").orderBy(F.col("micro").desc(), *keys)
        best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return best.select("id", "rank", *keys, (F.col("micro") / F.lit(float(MICRO))).alias("score"), "matched")

    if blocks == 1:
        return found(q)
    if work is None:
        raise ValueError("so many queries need a folder for the results of their blocks")
    for n in range(blocks):
        append(found(q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n)), work, n)
    return read(spark, work)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def cosine_queries(query_index: DataFrame, key: str) -> DataFrame:
    """Queries for ``search`` from a sparse index of them."""
    x = query_index.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("x"), F.max("norm").alias("norm"))
    return x.select("id", F.col("x.term").alias("terms"), F.col("x.tf").cast("array<double>").alias("weights"), "norm", F.array().cast("array<string>").alias("wanted"))


def keyword_queries(queries: DataFrame, key: str = "query_id", wanted: tuple[str, ...] = (), high: tuple[str, ...] = HIGH_VALUE_TERMS) -> DataFrame:
    """Queries for ``search`` from (key, terms, attribute columns): a term counts 1, one of high value 1.4."""
    def weight(t: Column) -> Column:
        return F.when(t.isin(*high), 1.4).otherwise(1.0)

    want = F.array(*[F.lower(F.col(w).cast("string")) for w in wanted]) if wanted else F.array().cast("array<string>")
    return queries.select(F.col(key).alias("id"), F.array_distinct("terms").alias("terms"), F.transform(F.array_distinct("terms"), weight).alias("weights"), F.lit(1.0).alias("norm"), want.alias("wanted"))


__all__ = ["cosine_queries", "keyword_queries", "search", "write_cosine", "write_keywords", "write_rows"]
