"""Source divergence audit: how the sources of a language differ in their use of terms, over an iceberg of kept terms.

Most distinct terms of a corpus occur in one or two documents. To find those in at least ``least`` documents without counting
each term, term prefixes of ``first`` bytes are counted by distinct documents, those below the threshold are discarded with
all terms under them, and the others are extended to twice the length, until only complete terms remain.

Documents are first folded into blocks. A block holds of each (lang, term) at most ``least`` of its documents: to know whether
a prefix reaches the threshold, more are never needed, as a block with a shortened list reaches it alone. It also holds the
occurrences of the term in each of its sources.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageknow.llm.common import BROADCAST_ROWS, checked_semi, fill_partitions, materialize, slices

#: Runs of ASCII letters and of bytes of other than ASCII characters.
TERM = re.compile(rb"[a-z\x80-\xff]+")
NO_TERM = re.compile(rb"[^a-z\x80-\xff]")
#: Bytes of a text that are split into terms at once.
SLICE = 1 << 20
#: A block ends after so many words, or distinct terms.
BLOCK_WORDS, BLOCK_TERMS = 8_000_000, 600_000
#: Rows of a batch that leaves a block.
OUT_ROWS = 50_000
BLOCKS = "block long, lang string, term binary, docs array<int>, groups array<int>, counts array<long>"
NAMES = ["block", "lang", "term", "docs", "groups", "counts"]


@dataclass(frozen=True)
class Params:
    least: int = 3  # documents of a language that hold a kept term
    first: int = 2  # bytes of the first prefixes
    top: int = 200  # ranks of the terms of a group
    scale: int = 1_000_000_000


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in slices that end between terms."""
    text, at = text.lower(), 0
    while at < len(text):
        cut = NO_TERM.search(text, at + SLICE)
        stop = cut.start() if cut else len(text)
        yield TERM.findall(text, at, stop)
        at = stop


class _Terms(dict):
    """term -> number in order of arrival."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


class _Block:
    """Documents of one language: the numbers of their terms, and by document its group."""

    def __init__(self) -> None:
        self.terms, self.ids, self.sizes, self.groups = _Terms(), [], [], []

    def add(self, group: int, text: bytes) -> int:
        got = [np.fromiter(map(self.terms.__getitem__, words), np.int32, len(words)) for words in term_lists(text)]
        n = sum(map(len, got))
        if n:
            self.ids += got
            self.sizes.append(n)
            self.groups.append(group)
        return n

    def rows(self, block: int, lang: str, least: int) -> Iterator[pa.RecordBatch]:
        if not self.sizes:
            return
        ids, n = np.concatenate(self.ids), len(self.terms)
        docs = _first_docs(ids, np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes), n, least)
        names, at = np.unique(self.groups, return_inverse=True)
        held, counts = _pairs(ids.astype(np.int64) * len(names) + np.repeat(at, self.sizes), n * len(names))
        ends = np.searchsorted(held // len(names), np.arange(n + 1))
        cols = [
            pa.array(list(self.terms), pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((docs >= 0).sum(axis=1))).astype(np.int32)), pa.array(docs[docs >= 0])),
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(names[held % len(names)].astype(np.int32))),
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(counts.astype(np.int64))),
        ]
        whole = pa.RecordBatch.from_arrays([pa.array(np.full(len(self.terms), block)), pa.array([lang] * len(self.terms)), *cols], NAMES)
        for k in range(0, whole.num_rows, OUT_ROWS):
            yield whole.slice(k, OUT_ROWS)


def _first_docs(ids: np.ndarray, docs: np.ndarray, n: int, least: int) -> np.ndarray:
    """(n, least): of each term its first documents, then -1. Documents stand in rising order."""
    out = np.full((n, least), -1, dtype=np.int32)
    for k in range(least):
        out[ids[::-1], k] = docs[::-1]  # the last one written is the first of the term
        left = docs != out[ids, k]
        ids, docs = ids[left], docs[left]
    return out


def _pairs(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below n, in order, and how often they occur."""
    if n > 4 * len(keys) + 1_000_000:
        return np.unique(keys, return_counts=True)
    counts = np.bincount(keys, minlength=n)
    held = np.flatnonzero(counts)
    return held, counts[held]


def _blocks(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, words, by_lang = TaskContext.get().partitionId() << 32, 0, {}
    for b in slices(batches):
        for lang, group, text in zip(b.column("lang").to_pylist(), b.column("number").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            words += by_lang.setdefault(lang, _Block()).add(group, text)
        if words >= BLOCK_WORDS or sum(len(x.terms) for x in by_lang.values()) >= BLOCK_TERMS:
            for lang, block in by_lang.items():
                yield from block.rows(at, lang, least)
            at, words, by_lang = at + 1, 0, {}
    for lang, block in by_lang.items():
        yield from block.rows(at, lang, least)


def kept_terms(blocks: DataFrame, p: Params = Params()) -> DataFrame:
    """(lang, term): terms in at least ``least`` documents of the language. ``blocks``: (block, lang, term, docs), docs being
    numbers of documents of the language in the block, all or ``least`` of them."""
    found, length, live = None, p.first, blocks.select("block", "lang", "term", "docs")
    # a term with enough documents in a block counts for all of them at once
    each = F.explode(F.when(F.size("docs") >= p.least, F.array(F.lit(-1))).otherwise(F.col("docs"))).alias("doc")
    while True:
        met = live.select("lang", F.substring("term", 1, length).alias("prefix"), (F.octet_length("term") <= length).alias("complete"), "block", each)
        counted = met.distinct().groupBy("lang", "prefix", "complete").agg(F.sum(F.when(F.col("doc") < 0, p.least).otherwise(1)).alias("docs")).where(F.col("docs") >= p.least)
        counted = materialize(counted.select("lang", "prefix", "complete"), "prefixes")
        terms = counted.where("complete").select("lang", F.col("prefix").alias("term"))
        found = terms if found is None else found.unionAll(terms)
        longer = counted.where("NOT complete").select("lang", "prefix")
        n = longer.count()
        if not n:
            return materialize(found, "kept-terms")
        live = blocks.where(F.octet_length("term") > length).withColumn("prefix", F.substring("term", 1, length))
        live = checked_semi(live, longer, ["lang", "prefix"], n).drop("prefix")
        length *= 2


def share(n: Column, total: Column, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / total), exactly."""
    return F.call_function("div", F.lit(scale).cast("decimal(20,0)") * (n + 1).cast("decimal(18,0)"), total.cast("decimal(18,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are at most about a thousand million, so this is exact in longs."""
    return F.call_function("div", (p - q) * (p - q), q)


def _small(df: DataFrame) -> DataFrame:
    """Statistics by group of a language: broadcast if they are few, which is counted."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def pair_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language: the sum of ``gap`` over all kept terms.

    A term that both hold counts in full; the terms that one or none of them holds enter by their number: a group's terms
    with n occurrences all have the same share, and the other's share of a term it lacks is always the same. So only
    terms that both hold are met term by term. ``counts``: (lang, term, held: array of (source, n, p, p0)), ``groups``: (lang,
    source, p0, v, n_terms)."""
    x, y = F.col("x"), F.col("y")
    met = counts.select("lang", "held", F.posexplode("held").alias("at", "x")).select("lang", "x", F.explode(F.slice("held", F.col("at") + 2, F.size("held"))).alias("y"))
    more = lambda a, b: gap(a["p"], b["p"]) - gap(a["p"], b["p0"]) - gap(a["p0"], b["p"]) + gap(a["p0"], b["p0"])
    each = met.groupBy("lang", x["source"].alias("s"), y["source"].alias("t")).agg(F.sum(more(x, y)).alias("st"), F.sum(more(y, x)).alias("ts"))
    both = each.select("lang", F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item"), F.col("st").alias("value")), F.struct(F.col("t").alias("source"), F.col("s").alias("item"), F.col("ts").alias("value")))).alias("e")).select("lang", "e.*")
    same = counts.select("lang", F.explode("held").alias("x")).groupBy("lang", x["source"].alias("source"), x["p"].alias("p")).agg(F.count(F.lit(1)).alias("k"))
    other = groups.select("lang", F.col("source").alias("item"), "p0")
    one = materialize(same, "shares").join(_small(other), "lang").where("source <> item")
    first = one.select("lang", "source", "item", (F.col("k") * gap(F.col("p"), F.col("p0"))).alias("value"))
    second = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("k") * gap(F.col("p0"), F.col("p"))).alias("value"))
    two = groups.select("lang", "source", "p0", "v", "n_terms").join(_small(other.join(groups.select("lang", F.col("source").alias("item"), F.col("n_terms").alias("n_other")), ["lang", "item"]).withColumnRenamed("p0", "q0")), "lang")
    none = (F.col("v") - F.col("n_terms") - F.col("n_other")) * gap(F.col("p0"), F.col("q0"))
    rest = two.where("source <> item").select("lang", "source", "item", F.coalesce(none, F.lit(0).cast("long")).alias("value"))
    return both.unionAll(first).unionAll(second).unionAll(rest).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(lang, source, part, item, value, rank) of the rows of ``docs`` (text, lang, source; other columns are ignored).

    Each row is a document, repeated ones too. Null texts, languages and sources are read as empty; a group without terms has
    its pairs, and no terms. A language with one source has no pairs, one without kept terms has pairs of value 0. Equal
    values are ranked by the bytes of the item. Very long texts are split into terms by slices; an empty table gives an empty
    result. Counts up to 10^18 and sums of shares are exact.
    """
    none, zero = F.lit(""), F.lit(0).cast("long")
    named = docs.select(F.coalesce(docs["lang"].cast("string"), none).alias("lang"), F.coalesce(docs["source"].cast("string"), none).alias("source"), F.coalesce(docs["text"].cast("string"), none).alias("text"))
    numbers = named.select("lang", "source").distinct().withColumn("number", F.row_number().over(W.orderBy("lang", "source")))
    numbers = materialize(numbers, "term-numbers")
    numbered = named.join(_small(numbers), ["lang", "source"]).select("lang", "number", "text")
    blocks = materialize(fill_partitions(numbered).mapInArrow(lambda it: _blocks(p.least, it), BLOCKS), "term-blocks")
    kept = kept_terms(blocks, p)
    counts = checked_semi(blocks.select("lang", "term", "groups", "counts"), kept, ["lang", "term"], kept.count())
    counts = counts.select("lang", "term", F.explode(F.arrays_zip("groups", "counts")).alias("x")).groupBy("lang", "term", F.col("x.groups").alias("number")).agg(F.sum("x.counts").alias("n"))
    counts = materialize(counts.join(_small(numbers.select("number", "source")), "number").select("lang", "source", "term", "n"), "term-counts")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_terms"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = numbers.select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("n_terms", zero).alias("n_terms"), F.coalesce("v", zero).alias("v"))
    groups = groups.withColumn("total", F.nullif(F.col("n") + F.col("v"), zero)).withColumn("p0", share(zero, F.col("total"), p.scale))
    groups = materialize(groups, "term-groups")
    whole = groups.groupBy("lang").agg(F.nullif(F.sum("n") + F.max("v"), zero).alias("all"))
    shared = counts.join(_small(groups.select("lang", "source", "total", "p0")), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), p.scale))
    by_term = shared.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.collect_list(F.struct("source", "n", "p", "p0")).alias("held"))  # at most one a source
    by_term = materialize(by_term.join(_small(whole), "lang").withColumn("q", share(F.col("n"), F.col("all"), p.scale)).select("lang", "term", "q", "held"), "terms")
    by = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_values(by_term, groups).withColumn("rank", F.row_number().over(by))
    terms = by_term.select("lang", "term", "q", F.explode("held").alias("h")).where("h.p > q")
    terms = terms.select("lang", F.col("h.source").alias("source"), F.col("term").alias("item"), gap(F.col("h.p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= p.top)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*out).unionAll(terms.withColumn("part", F.lit("term")).withColumn("item", F.col("item").cast("string")).select(*out))
