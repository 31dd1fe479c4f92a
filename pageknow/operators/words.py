"""Which of many words are in a text, for word lists of any size.

A word is in a text only if each of its runs of three characters is. Of each word the run that fewest texts of a sample hold
is its anchor; texts are met with anchors, and the few words whose anchor is there are looked for in the text. A list of up to
TASK_WORDS words is given to the tasks that read the texts; a longer one is joined by anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageknow.functions.text import text_or_empty
from pageknow.sources.commits import written

#: A list of at most so many words goes to the tasks.
TASK_WORDS = 300_000
#: Runs are counted in one text of so many, where the texts are, and of these at most RUNS, the commonest, reach the driver; a task
#: holds about TASK_RUNS. Decides what the work costs only.
ONE_OF, RUNS, TASK_RUNS = 16, 200_000, 1_000_000


def runs(text: str, lengths: tuple[int, ...] = (3,)) -> np.ndarray:
    """The distinct runs of so many characters, as numbers of three times 21 bits."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    got = [np.sum([c[i : len(c) - n + 1 + i] << (21 * i) for i in range(n)], axis=0) for n in lengths if len(c) >= n]
    return np.unique(np.concatenate(got)) if got else np.zeros(0, np.int64)


def anchors(words: list[str], seen: dict[int, int]) -> np.ndarray:
    """Of each word the run that ``seen`` (run to number of texts) has least of; 0 of an empty word."""
    def least(w: str) -> int:
        return min(runs(w, (min(3, len(w)),)).tolist(), key=lambda r: (seen.get(r, 0), r)) if w else 0

    return np.array([least(w) for w in words], dtype=np.int64)


def _run_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, n): in how many texts a run is; a run that is put out early comes again."""
    r, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        for k in range(0, b.num_rows, 256):
            new = np.concatenate([runs(t, (1, 2, 3)) for t in b.column("text").slice(k, 256).to_pylist()])
            r, at = np.unique(np.concatenate([r, new]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, np.ones(len(new), np.int64)]), len(r)).astype(np.int64)
            if len(r) > TASK_RUNS:
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(n)], ["run", "n"])
                r, n = r[:0], n[:0]
    yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(n)], ["run", "n"])


def _sampled(texts: DataFrame) -> dict[int, int]:
    """The commonest runs of a sample of texts and in how many of them they are. No text reaches the driver."""
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(ONE_OF)) == 0).select(F.left("text", F.lit(20_000)).alias("text"))
    few = some.coalesce(some.sparkSession.sparkContext.defaultParallelism)  # their runs are much the same
    got = few.mapInArrow(_run_counts, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    got = got.orderBy(F.col("n").desc(), "run").limit(RUNS).toArrow()  # the best of a task are shuffled, not sent to the driver
    return dict(zip(got.column("run").to_pylist(), got.column("n").to_pylist(), strict=True))


class _List:
    """Words by anchor."""

    def __init__(self, words: list[str], at: np.ndarray):
        order = np.argsort(at, kind="stable")
        self.words = [words[i] for i in order]
        self.runs, self.first = np.unique(at[order], return_index=True)
        self.stop = np.append(self.first[1:], len(words))
        self.lengths = tuple(sorted({min(3, len(w)) for w in words if w}))

    def found(self, text: str) -> list[str]:
        own = np.append(runs(text, self.lengths), 0)
        met = np.searchsorted(self.runs, own)
        near = met < len(self.runs)
        near[near] = self.runs[met[near]] == own[near]
        return [w for m in met[near].tolist() for w in self.words[self.first[m] : self.stop[m]] if w in text]


def _find(words: _List, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            found = [sorted(words.found(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(found, pa.list_(pa.string()))], [*keep, "found"])


def _runs_of(lengths: tuple[int, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 64):
            part = b.slice(k, 64)
            got = [runs(t, lengths) for t in part.column("text").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got]))
            yield pa.RecordBatch.from_arrays([part.column("key").take(at), pa.array(np.concatenate(got) if got else np.zeros(0, np.int64))], ["key", "run"])


def _word_anchors(seen: dict[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(anchors(b.column("word").to_pylist(), seen))], ["word", "run"])


def find(texts: DataFrame, words: DataFrame, text: str = "text", word: str = "word", task_words: int = TASK_WORDS) -> DataFrame:
    """``texts`` + found: the sorted distinct words that are in the text, character by character (lower-case both beforehand to
    ignore case). A null text is empty, a null word is none; an empty word is in every text. Repeated words count once."""
    lists = words.where(F.col(word).isNotNull()).select(F.col(word).cast("string").alias("word")).distinct()
    rest = [c for c in texts.columns if c != "found"]
    held = {c: f"c{i}" for i, c in enumerate(rest)}
    base = texts.select(*[texts[c].alias(h) for c, h in held.items()], text_or_empty(texts[text]).alias("text"))
    seen = _sampled(base.select("text"))
    n = lists.limit(task_words + 1).count()
    if n <= task_words:
        got = [r.word for r in lists.collect()]
        listed = _List(got, anchors(got, seen))
        kinds = "".join(f"{h} {base.schema[h].dataType.simpleString()}, " for h in held.values())
        out = base.mapInArrow(lambda it: _find(listed, list(held.values()), it), f"{kinds}found array<string>")
        return out.select(*[F.col(h).alias(c) for c, h in held.items()], "found")
    anchored = written(lists.mapInArrow(lambda it: _word_anchors(seen, it), "word string, run long"), "anchors")
    lengths = tuple(sorted(r.n for r in anchored.where("word <> ''").select(F.least(F.length("word"), F.lit(3)).alias("n")).distinct().collect()))
    keyed = base.withColumn("key", F.sha2("text", 256))
    few = keyed.select("key", "text").dropDuplicates(["key"])
    met = few.mapInArrow(lambda it: _runs_of(lengths, it), "key string, run long").join(anchored, "run").select("key", "word")
    near = met.groupBy("key").agg(F.collect_set("word").alias("near"))  # words whose anchor is in one text
    always = F.array(F.lit("")) if not anchored.where("word = ''").isEmpty() else F.array().cast("array<string>")
    out = keyed.join(near, "key", "left").withColumn("near", F.concat(always, F.coalesce("near", F.array().cast("array<string>"))))
    out = out.withColumn("found", F.array_sort(F.filter("near", lambda w: F.contains(F.col("text"), w)))).drop("text")
    return out.select(*[F.col(h).alias(c) for c, h in held.items()], "found")


def label_hits(texts: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "text", task_words: int = TASK_WORDS) -> DataFrame:
    """(keys, label, hits, first): how many words of each label of ``lexicon`` (label, word[, seq]) are in the text, and the smallest
    ``seq`` among them (null without that column). Labels without a hit have no row. From this follow the label with the most
    words (``max_by``) and the first one in a fixed order (``min_by`` on ``first``). ``keys`` name a text."""
    seq = F.col("seq") if "seq" in lexicon.columns else F.lit(None).cast("int")
    lex = lexicon.where(F.col("word").isNotNull()).groupBy("label", "word").agg(F.min(seq).alias("seq"))
    got = find(texts.select(*keys, text), lex, text, "word", task_words).select(*keys, F.explode("found").alias("word"))
    return got.join(lex, "word").groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("hits"), F.min("seq").alias("first"))
