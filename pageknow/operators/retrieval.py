"""Retrieval for batches of queries: keyword scores, sparse-term cosine, hashed and dense vectors, all joined by term or in blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageknow.functions.lexicon import HIGH_VALUE_TERMS, INDEX_STOPWORDS, QUERY_EXPANSIONS, SEARCH_STOPWORDS
from pageknow.functions.text import terms, text_or_empty
from pageknow.operators.words import find
from pageknow.sources.commits import append, read, scratch, written


#: A dictionary of at most so many keys is looked for key by key; a larger one by ``words.find``.
FEW_KEYS = 1_000


def expand_queries(queries: DataFrame, dictionary: DataFrame | None = None, phrases: tuple[str, ...] = (), text: str = "text", few_keys: int = FEW_KEYS) -> DataFrame:
    """``queries`` + terms: distinct search terms of the text, of the expansions of every dictionary key it contains and of
    the fixed phrases. ``dictionary``: (key, expansion), of any size; without one the fixed word list is used."""
    if dictionary is None:
        dictionary = queries.sparkSession.createDataFrame([(k, " ".join(v)) for k, v in QUERY_EXPANSIONS.items()], "key string, expansion string")
    low = F.lower(text_or_empty(F.col(text)))
    base = [c for c in queries.columns if c != "terms"]
    none = F.array().cast("array<string>")
    more = F.flatten(F.array(*[F.when(F.contains(low, F.lit(p)), F.array(*[F.lit(x) for x in p.split()])).otherwise(none) for p in phrases])) if phrases else none
    told = dictionary.select(F.lower("key").alias("k"), terms(F.col("expansion"), SEARCH_STOPWORDS).alias("t"))
    if dictionary.limit(few_keys + 1).count() <= few_keys:
        words = told.groupBy().agg(F.sort_array(F.collect_list(F.struct("k", "t"))).alias("__d"))
        out = queries.crossJoin(F.broadcast(words))  # one row
        extra = F.flatten(F.transform(F.filter("__d", lambda d: F.contains(low, d["k"])), lambda d: d["t"]))
    else:
        texts = find(queries.select(low.alias("__low")).distinct(), told, "__low", "k")
        met = texts.select("__low", F.explode("found").alias("k")).join(told.select("k", F.explode("t").alias("x")), "k")
        met = met.groupBy("__low").agg(F.collect_set("x").alias("__x"))
        out = queries.join(met, low == met["__low"], "left")
        extra = F.coalesce("__x", none)
    return out.withColumn("terms", F.array_sort(F.array_distinct(F.concat(terms(F.col(text), SEARCH_STOPWORDS), extra, more)))).select(*base, "terms")


#: Query terms that are sent to all tasks; more of them are joined by term.
TASK_TERMS = 500_000
#: One of so many chunks is scored first, for what the k-th score of a query is at least.
FIRST_OF = 64


def _sent(query_terms: DataFrame) -> DataFrame:
    """The terms of a stated query set; up to TASK_TERMS of them go to all tasks, where chunks meet them in place."""
    return F.broadcast(query_terms) if query_terms.limit(TASK_TERMS + 1).count() <= TASK_TERMS else query_terms


def _best(q: DataFrame, rows: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame], query: str, keys: list[str], k: int, part: str | None) -> DataFrame:
    """(query, rank, ..): the ``k`` rows of ``score(q, rows)`` of the largest score, ties by keys. With ``part``, a column of ``rows``, the
    rows of some of its values are scored first: a query's k-th score among them is one that the others must reach, so only few
    pairs are sorted and shuffled."""
    order = W.partitionBy(query).orderBy(F.col("score").desc(), *keys)

    def top(scored: DataFrame) -> DataFrame:
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    got = score(_sent(q), rows)
    if part is not None:
        some = score(_sent(q), rows.where(F.pmod(F.xxhash64(part), F.lit(FIRST_OF)) == 0))
        least = written(top(some).where(F.col("rank") == k).select(query, F.col("score").alias("least")), "least")
        got = got.join(F.broadcast(least), query, "left").where(F.col("least").isNull() | (F.col("score") >= F.col("least")))
    return top(got)


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int = 5, min_score: float = 1.0, filters: dict[str, tuple[str, float]] | None = None, part: str | None = None) -> DataFrame:
    """(query_id, rank, chunk_key, chunk_index, score, matched): distinct shared terms, bonuses for equal metadata
    (``filters``: query column -> (chunk column, bonus)), 0.4 per high-value term, bonus by page type.

    ``queries``: (query_id, terms array, filter columns); ``chunks``: (chunk_key, chunk_index, text[, page_type, filter
    columns]). Ties: smaller chunk_index, then chunk_key. ``part``: a column of ``chunks`` that follows from chunk_key; chunks dealt
    by it are scored where they are. See also ``_best``.
    """
    filters, held = filters or {}, ["chunk_key", "chunk_index", *([part] if part else [])]
    q = queries.select("query_id", F.explode("terms").alias("term"), *[F.lower(a).alias(f"q_{a}") for a in filters])
    page = F.when(F.col("page_type") == "faq_cleaned", 0.6).when(F.col("page_type") == "faq", 0.3).otherwise(0.0) if "page_type" in chunks.columns else F.lit(0.0)

    def score(q: DataFrame, rows: DataFrame) -> DataFrame:
        c = rows.select(*held, page.alias("page"), *[F.lower(b).alias(f"c_{a}") for a, (b, _) in filters.items()], F.explode(F.array_distinct(terms(F.col("text"), SEARCH_STOPWORDS))).alias("term"))
        more = sum((F.when(F.col(f"q_{a}") == F.col(f"c_{a}"), bonus).otherwise(0.0) for a, (_, bonus) in filters.items()), F.col("page"))
        base = F.count(F.lit(1)) + 0.4 * F.count_if(F.col("term").isin(*HIGH_VALUE_TERMS))
        got = c.join(q, "term").groupBy("query_id", *held).agg(F.count(F.lit(1)).alias("matched"), F.round(base.cast("double") + F.max(more), 6).alias("score"))
        return got.where(F.col("score") >= min_score)

    return _best(q, chunks, score, "query_id", ["chunk_index", "chunk_key"], k, part).select("query_id", "rank", "chunk_key", "chunk_index", "score", "matched")


def sparse_index(chunks: DataFrame, keys: list[str], text: str = "text", max_terms: int = 80) -> DataFrame:
    """(keys, term, tf, r, norm) of the ``max_terms`` commonest terms of each chunk; equal counts by first place; norm is the
    length of the chunk's vector, got in the same pass."""
    t = F.posexplode(terms(F.col(text), INDEX_STOPWORDS, digits=False)).alias("pos", "term")
    tf = chunks.select(*keys, t).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("pos"))
    w = W.partitionBy(*keys).orderBy(F.col("tf").desc(), "pos")
    few = tf.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_terms)
    return few.select(*keys, "term", "tf", "r", F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(W.partitionBy(*keys))).alias("norm"))


def sparse_vectors(index: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vector map, token_count) from the inverted form."""
    return index.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "tf")))).alias("vector"), F.sum("tf").alias("token_count"))


def cosine_topk(query_index: DataFrame, index: DataFrame, query_key: str, keys: list[str], k: int = 5) -> DataFrame:
    """(query, rank, keys, score): k chunks of the largest cosine over shared terms, score above 0, rounded to 6 places; ties
    by keys. An index that is dealt by one of its keys is scored where it is."""
    def score(q: DataFrame, rows: DataFrame) -> DataFrame:
        c = rows.select(*keys, "term", F.col("tf").alias("tc"), F.col("norm").alias("nc"))
        dot = c.join(q, "term").groupBy(query_key, *keys).agg(F.sum(F.col("tq") * F.col("tc")).alias("dot"), F.max("nq").alias("nq"), F.max("nc").alias("nc"))
        return dot.withColumn("score", F.round(F.col("dot") / (F.col("nq") * F.col("nc")), 6)).where("score > 0")

    q = query_index.select(query_key, "term", F.col("tf").alias("tq"), F.col("norm").alias("nq"))
    return _best(q, index, score, query_key, keys, k, keys[0]).select(query_key, "rank", *keys, "score")


def term_slot(term: Column, dimensions: int) -> Column:
    """A slot that is the same in every process: the first 32 bits of the md5 digest."""
    return F.pmod(F.conv(F.left(F.md5(term), F.lit(8)), 16, 10).cast("long"), F.lit(dimensions)).cast("int")


def hash_embed(docs: DataFrame, keys: list[str], text: str = "text", dimensions: int = 64) -> DataFrame:
    """(keys, slot, weight): hashed word counts, L2-normalised, in coordinate form."""
    t = docs.select(*keys, F.explode(terms(F.col(text), INDEX_STOPWORDS, digits=False)).alias("term"))
    each = t.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    n = each.groupBy(*keys, term_slot(F.col("term"), dimensions).alias("slot")).agg(F.sum("n").alias("n"))
    size = F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy(*keys)))
    return n.select(*keys, "slot", (F.col("n") / size).alias("weight"))


def dense_vectors(slots: DataFrame, keys: list[str], dimensions: int = 64) -> DataFrame:
    m = slots.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("slot", "weight"))).alias("m"))
    return m.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vector"))


#: Most queries that meet all rows at once, about.
MAX_QUERY_ROWS = 20_000


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, id_: str = "vec_id", vector: str = "embedding", match: str | None = None) -> DataFrame:
    """(query_id, rank, id, score) by exact squared distance d, score 1 / (1 + d) rounded to 6 places; with ``match`` only rows
    whose column equals the query's. The stated query set is counted; beyond MAX_QUERY_ROWS it is dealt by hash into blocks
    of about half as many; each block meets all rows, and its result is written, so the plan does not grow with the queries."""
    n = queries.count()
    q = queries.select(F.col(id_).alias("query_id"), F.col(vector).alias("q"), *([F.col(match).alias("m")] if match else []))
    on = F.col(match) == F.col("m") if match else F.lit(True)
    d = F.aggregate(F.zip_with(vector, "q", lambda a, b: (a.cast("double") - b.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), id_)

    def best(block: DataFrame) -> DataFrame:
        met = vectors.join(F.broadcast(block), on & (F.col(id_) != F.col("query_id"))).select("query_id", F.col(id_), F.round(1 / (1 + d), 6).alias("score"))
        return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    if n <= MAX_QUERY_ROWS:
        return best(q)
    blocks, root = -(-2 * n // MAX_QUERY_ROWS), scratch(vectors.sparkSession, "dense-topk")
    for i in range(blocks):
        append(best(q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)), root, i)
    return read(vectors.sparkSession, root)


def with_fallback(first: DataFrame, second: DataFrame, query: str = "query_id") -> DataFrame:
    """Hits of the first search; for queries that have none, those of the second. + origin."""
    missing = second.join(first.select(query).distinct(), query, "left_anti")
    return first.withColumn("origin", F.lit("semantic")).unionByName(missing.withColumn("origin", F.lit("keyword")))
