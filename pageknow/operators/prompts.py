"""Citations and grounded prompts, one per query, for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageknow.functions.lexicon import SOURCE_MARKERS
from pageknow.functions.text import contains_any, squeeze, text_or_empty, truncate

RULE = "Answer from the evidence only and cite it by number."


def citations(hits: DataFrame, query: str, order: str, url: str, n: int = 6) -> DataFrame:
    """(query, urls): the first n distinct urls that are not empty, in order."""
    first = hits.where(text_or_empty(F.col(url)) != "").groupBy(query, url).agg(F.min(order).alias("__o"))
    return first.groupBy(query).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("__o", url))), lambda s: s[url]), 1, n).alias("urls"))


def all_citations(sources: list[DataFrame], query: str, n: int = 6) -> DataFrame:
    """(query, urls): the first n distinct urls over several tables (query, ord, urls), the tables in the order given: tasks,
    risks, evidence. ``urls`` may hold several, parted by ``|``."""
    every = None
    for i, x in enumerate(sources):
        one = x.select(query, F.posexplode(F.split(text_or_empty(F.col("urls")), "[|]")).alias("__k", "url"), F.col("ord").cast("long").alias("ord"))
        one = one.select(query, F.struct(F.lit(i).alias("table"), "ord", F.col("__k").alias("k")).alias("place"), F.trim("url").alias("url"))
        every = one if every is None else every.unionByName(one)
    return citations(every, query, "place", "url", n)


def ensure_cited(answers: DataFrame, cited: DataFrame, query: str, answer: str) -> DataFrame:
    """``answers`` with a source list appended to those that show no source."""
    joined = answers.join(cited, query, "left")
    add = F.concat(F.rtrim(F.col(answer)), F.lit("\n\nSources:\n- "), F.array_join("urls", "\n- "))
    return joined.withColumn(answer, F.when(contains_any(F.col(answer), SOURCE_MARKERS) | F.col("urls").isNull() | (F.size("urls") == 0), F.col(answer)).otherwise(add)).drop("urls")


def assemble(queries: DataFrame, evidence: DataFrame, query: str, text: str, rank: str, label: str, body: str, n: int = 10, chars: int = 900, lists: dict[str, tuple[DataFrame, int]] | None = None) -> DataFrame:
    """(query, prompt): the question, the first lines of further ``lists`` (title: (query, rank, line) and how many; tasks and
    risks, say) and up to n numbered pieces of evidence, each cut to ``chars``."""
    def block_of(rows: DataFrame, line: Column, most: int, name: str) -> DataFrame:
        some = rows.where(F.col(rank) <= most).groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("b")))).alias("__l"))
        return some.select(query, F.array_join(F.transform("__l", lambda s: s["b"]), "\n").alias(name))

    piece = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] ("), text_or_empty(F.col(label)), F.lit(") "), truncate(F.col(body), chars))
    out = queries.join(block_of(evidence, piece, n, "__e"), query, "left")
    parts = []
    for i, (title, (rows, most)) in enumerate((lists or {}).items()):
        out = out.join(block_of(rows, F.concat(F.lit("- "), text_or_empty(F.col("line"))), most, f"__l{i}"), query, "left")
        parts += [F.lit(f"\n{title}:\n"), F.coalesce(f"__l{i}", F.lit("(none)"))]
    prompt = F.concat(F.lit("Question: "), squeeze(text_or_empty(F.col(text))), *parts, F.lit("\nEvidence:\n"), F.coalesce("__e", F.lit("(none)")), F.lit("\n" + RULE))
    return out.select(query, prompt.alias("prompt"))
