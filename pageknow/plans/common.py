"""Helpers of the registered queries: table reader and SQL spellings of the text functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from pageknow.functions.lexicon import INDEX_STOPWORDS, SEARCH_STOPWORDS
from pageknow.functions.text import LINE_BREAK, NOT_WORD, WS
from pageknow.sources.commits import scratch

__all__ = ["dealt", "documents", "quoted", "scratch", "sql_chunks", "sql_contains", "sql_found", "sql_hits", "sql_index_terms", "sql_key", "sql_lines", "sql_split", "sql_squeeze", "sql_strip", "sql_terms", "sql_truncate", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Documents of one partition, about: what is derived from so many fits a task's memory.
PART_ROWS = 1_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents dealt by ``doc_id``, however few files or row groups hold them: all cores work on the texts, and grouping what
    is derived from a document needs no further shuffle. The count reads footers only."""
    return dealt(table(spark, sf_dir, "documents"), "doc_id", PART_ROWS)


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` dealt by ``key`` into parts of about ``rows`` rows, at least one a core."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), key)


def quoted(words: Iterable[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_split(x: str) -> str:
    return f"string_split_regex({x}, '{LINE_BREAK}')"


def sql_lines(x: str) -> str:
    return f"list_filter(list_transform({sql_split(x)}, lambda z: {sql_strip('z')}), lambda z: z <> '')"


def sql_truncate(x: str, n: int) -> str:
    s = sql_squeeze(x)
    return f"CASE WHEN length({s}) <= {n} THEN {s} ELSE rtrim(left({s}, {n - 3})) || '...' END"


def sql_key(x: str) -> str:
    return f"regexp_replace(lower({x}), '{NOT_WORD}', '', 'g')"


def sql_contains(x: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted([w])})" for w in words) + ")"


def sql_hits(x: str, words: Iterable[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {quoted([w])}) AS INT)" for w in words) + ")"


def sql_found(x: str, words: Iterable[str]) -> str:
    return f"list_filter([{quoted(words)}], lambda w: contains({x}, w))"


def sql_terms(x: str, stop: Iterable[str] = SEARCH_STOPWORDS, digits: bool = True) -> str:
    more = "" if digits else " AND NOT regexp_full_match(z, '[0-9]+')"
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda z: length(z) >= 2 AND z NOT IN ({quoted(stop)}){more})"


def sql_index_terms(x: str) -> str:
    return sql_terms(x, INDEX_STOPWORDS, digits=False)


#: Chunks of a text as a recursive walk over its paragraphs: (key, chunk_index, text). ``{key}`` and ``{source}`` are filled in.
def sql_chunks(source: str, key: str = "doc_id", size: int = 900, overlap: int = 120) -> str:
    """CTEs ``cp`` (paragraphs), ``cw`` (walk) and ``chunks``; to stand after WITH RECURSIVE."""
    return f"""
    cp AS (SELECT {key} AS k, {sql_lines('text')} AS ps FROM {source} WHERE text IS NOT NULL),
    cw AS (
      SELECT k, ps, 0 AS i, CAST([] AS VARCHAR[]) AS o, '' AS cur FROM cp
      UNION ALL
      SELECT k, ps, i + 1,
        CASE WHEN length(CASE WHEN cur = '' THEN ps[i + 1] ELSE cur || chr(10) || ps[i + 1] END) <= {size} THEN o
             WHEN cur <> '' THEN list_append(o, cur) ELSE list_append(o, left(ps[i + 1], {size})) END,
        CASE WHEN length(CASE WHEN cur = '' THEN ps[i + 1] ELSE cur || chr(10) || ps[i + 1] END) <= {size}
             THEN CASE WHEN cur = '' THEN ps[i + 1] ELSE cur || chr(10) || ps[i + 1] END
             WHEN cur <> '' THEN regexp_replace(right(cur, {overlap}) || chr(10) || ps[i + 1], '^{WS}+', '')
             ELSE substr(ps[i + 1], {size - overlap + 1}) END
      FROM cw WHERE i < len(ps)
    ),
    chunks AS (
      SELECT k, unnest(range(0, len(l))) AS chunk_index, unnest(l) AS text
      FROM (SELECT k, CASE WHEN cur <> '' THEN list_append(o, cur) ELSE o END AS l FROM cw WHERE i = len(ps))
    )"""
