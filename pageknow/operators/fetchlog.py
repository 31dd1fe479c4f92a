"""Fetch-log analytics: latest and latest usable attempt per source, attention reasons, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageknow.functions.text import text_or_empty

OK = ("success", "success_dynamic", "skipped_exists")


def time_order(at: Column, seq: Column) -> Column:
    """Order of attempts: a time that cannot be read counts as the newest; equal times by sequence."""
    return F.struct(at.isNull().cast("int"), at, seq)


def aggregates(fields: list[str], ok: Column, order: Column) -> list[Column]:
    """Latest and usable values, attempts and successes of a group; one pass, no window, combined map-side."""
    latest = F.max_by(F.struct(*fields), order).alias("latest")
    usable = F.max_by(F.struct(*fields), F.when(ok, order)).alias("usable")
    return [latest, usable, F.count(F.lit(1)).alias("attempt_count"), F.count_if(ok).alias("success_count")]


def latest_status(sources: DataFrame, log: DataFrame, keys: list[str], fields: list[str], status: str, at: str, seq: str, ok: tuple[str, ...] = OK) -> DataFrame:
    """Every source with its latest and usable attempt; a source that was never tried is ``not_crawled``."""
    g = log.groupBy(*keys).agg(*aggregates(fields, F.col(status).isin(*ok), time_order(F.col(at), F.col(seq))))
    j = sources.join(g, keys, "left")
    out = j.select(*sources.columns, *[F.col(f"latest.{f}").alias(f"latest_{f}") for f in fields], *[F.col(f"usable.{f}").alias(f"usable_{f}") for f in fields], F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"), F.coalesce("success_count", F.lit(0)).alias("success_count"))
    return out.withColumn(f"latest_{status}", F.coalesce(f"latest_{status}", F.lit("not_crawled")))


def attention(status: Column, successes: Column, has_file: Column, chars: Column, title: Column, url: Column, ok: tuple[str, ...] = OK) -> Column:
    """The first reason that applies, or empty."""
    bad = F.contains(F.lower(text_or_empty(title)), F.lit("page not found")) | F.contains(text_or_empty(title), F.lit("404")) | F.contains(F.lower(text_or_empty(url)), F.lit("/error/404"))
    failed = ~status.isin(*ok)
    return F.when(failed & (successes > 0), "latest_attempt_failed_previous_success_available").when(failed, status).when(~has_file, "raw_file_missing").when(F.coalesce(chars, F.lit(0)) < 100, "content_too_short").when(bad, "possible_404_page").otherwise("")


def coverage(page_type: Column, stage: Column, status: Column, has_file: Column, chars: Column, chunks: Column, tasks: Column, faqs: Column, ok: tuple[str, ...] = OK) -> tuple[Column, Column]:
    """(level, note): blocker, weak or ok, by the first rule that applies."""
    rules = [
        (~status.isin(*ok), "blocker", F.concat(F.lit("latest crawl status is "), status)), (~has_file, "blocker", F.lit("raw text file is missing")), (chars < 100, "blocker", F.lit("raw text is too short")),
        (chunks == 0, "weak", F.lit("no retrieval chunks generated")), (chars < 800, "weak", F.lit("source text is short")), ((page_type != "faq") & (stage != "general") & (tasks == 0), "weak", F.lit("no task mapped to this source")),
        ((page_type == "faq") & (faqs == 0), "weak", F.lit("FAQ page has no extracted candidates")),
    ]
    return F.coalesce(*[F.when(c, F.lit(v)) for c, v, _ in rules], F.lit("ok")), F.coalesce(*[F.when(c, n) for c, _, n in rules], F.lit(""))


def with_counts(sources: DataFrame, counts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """``sources`` + a count column for each (table, key): the table is counted by key, then joined; no rows: 0."""
    out = sources
    for name, (df, keys) in counts.items():
        out = out.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out
