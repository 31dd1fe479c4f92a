"""Toxicity: a counterfactual-regularised linear classifier over the words present in a text.

Features are the distinct lower-case words of a text and their first letters. Feature counts by class are taken over the
labelled rows by Spark; the features that separate best are kept (bounded number), and a logistic model is fitted on a
bounded sample of labelled rows. Sentences that name a group give counterfactuals: the group term is swapped for the
others of its list, and the squared change of the logit is penalised, so that naming a group does not itself raise the
score. Terms to swap also come from the data: words that toxic rows hold more often than others, though most rows that
hold them are not toxic, are swapped for words of like frequency that both classes use alike. The bias stays at or below
the log odds of the base rate, so what the penalty takes from a term does not come back for every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageknow.llm.common import discard, fill_partitions, materialize, slices

#: Lists of terms that may stand for each other; the first of each is neutral. Fixed values.
IDENTITY_TERMS = (
    ("people", "women", "men", "girls", "boys", "gays", "lesbians", "muslims", "christians", "jews", "hindus", "immigrants", "refugees", "blacks", "whites", "asians"),
    ("person", "woman", "man", "girl", "boy", "gay", "lesbian", "muslim", "christian", "jew", "hindu", "immigrant", "refugee", "black", "white", "asian"),
    ("leute", "frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge"),
    ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés"),
    ("gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados"),
)
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7, 8)


@dataclass(frozen=True)
class Params:
    max_train_rows: int = 20_000  # labelled rows the model is fitted on (smallest hash of doc_id first)
    max_features: int = 4_000  # features the model may use
    min_rows: int = 3  # rows of the sample that a feature must be in
    l2: float = 0.02
    counterfactual: float = 10.0
    steps: int = 300
    groups: tuple = field(default=IDENTITY_TERMS)
    mined_terms: int = 64  # terms to swap that are found in the data, at most
    mined_rows: int = 20  # rows of the sample that hold such a term, at least
    mined_share: float = 0.3  # of them less than this share is toxic
    max_swaps: int = 5_000  # different changes of features by swaps that are penalised, the most frequent ones


def features_of(word: str) -> tuple[str, ...]:
    return (word, *[word[:n] + "*" for n in PREFIXES if len(word) >= n])


def text_features(text: str | None) -> set[str]:
    return {f for w in set(WORD.findall((text or "").lower())) for f in features_of(w)}


def swaps_of(groups: tuple) -> dict[str, tuple[str, ...]]:
    """Of each term the others of its list."""
    return {t: tuple(u for u in g if u != t) for g in groups for t in g}


def counterfactual_pairs(text: str | None, others: dict[str, tuple[str, ...]]) -> list[tuple[set[str], set[str]]]:
    """(features lost, features gained) by swapping a term, for each sentence that holds one and each other term."""
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n", (text or "").lower()):
        words = set(WORD.findall(sentence))
        for t in sorted(words & others.keys()):
            own = {f for w in words for f in features_of(w)}
            for u in others[t]:
                new = {f for w in (words - {t}) | {u} for f in features_of(w)}
                out.append((own - new, new - own))
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    n_swaps: int = 0  # sentences and swaps that were penalised


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        for row, (text, y) in enumerate(zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True)):
            f = sorted(text_features(text))
            if f:
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array([y] * len(f), pa.int32())], ["feature", "y"])


def _present(index: dict[str, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        fs = [sorted(index[f] for f in text_features(t) & index.keys()) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(fs, pa.list_(pa.int32()))], ["y", "f"])


def _swapped(index: dict[str, int], others: dict[str, tuple[str, ...]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = lambda fs: sorted(index[f] for f in fs & index.keys())
    for b in slices(batches, rows=64):
        pairs = [(at(a), at(c)) for t in b.column("text").to_pylist() for a, c in counterfactual_pairs(t, others)]
        pairs = [(a, c) for a, c in pairs if a or c]
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], kind), pa.array([c for _, c in pairs], kind)], ["lost", "gained"])


def mined_swaps(counts: DataFrame, p: Params) -> dict[str, tuple[str, ...]]:
    """Swaps found in the data, from (feature, a, k, z): of words that are toxic above chance but mostly in rows that are
    not, the three nearest in frequency of the words that both classes use alike. Bounded by ``mined_terms``."""
    words = counts.where((F.col("k") >= p.mined_rows) & ~F.col("feature").endswith("*"))
    found = words.where((F.col("z") >= 3) & (F.col("a") < p.mined_share * F.col("k"))).orderBy(F.col("z").desc(), "feature").limit(p.mined_terms).collect()
    alike = words.where(F.abs("z") < 1).orderBy(F.col("k").desc(), "feature").limit(4 * p.mined_terms).collect()
    return {t.feature: tuple(u.feature for u in sorted(alike, key=lambda u: (abs(u.k - t.k), u.feature))[:3]) for t in found}


def train(labelled: DataFrame, p: Params = Params()) -> Model:
    """Fit on (doc_id, text, y), a bounded sample; rows without a label are left out, an empty table gives a score of 0.5 everywhere."""
    rows = labelled.where(F.col("y").isNotNull()).select("doc_id", "text", F.col("y").cast("int").alias("y"))
    rows = materialize(rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism), "toxicity-sample")
    total = rows.agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    if not total.n or total.pos in (0, total.n):
        discard(rows)
        return Model({}, 0.0)
    pos, neg = total.pos, total.n - total.pos
    counts = rows.mapInArrow(_emit, "feature string, y int").groupBy("feature").agg(F.sum("y").alias("a"), F.count("y").alias("k"))
    # two-proportion z score with one added row on each side
    pa_, pb = (F.col("a") + 0.5) / (pos + 1), (F.col("k") - F.col("a") + 0.5) / (neg + 1)
    z = (pa_ - pb) / F.sqrt(pa_ * (1 - pa_) / pos + pb * (1 - pb) / neg)
    counts = materialize(counts.where(F.col("k") >= p.min_rows).select("feature", "a", "k", z.alias("z")), "toxicity-counts")
    best = counts.where(F.abs("z") >= 3).orderBy(F.abs("z").desc(), "feature").limit(p.max_features)
    index = {r.feature: i for i, r in enumerate(best.collect())}
    prior = float(np.log(pos / neg))
    if not index:
        discard(rows, counts)
        return Model({}, prior)
    others = mined_swaps(counts, p) | swaps_of(p.groups)
    got = rows.mapInArrow(lambda it: _present(index, it), "y int, f array<int>").toArrow()
    i, j = _coordinates(got.column("f"))
    swaps = rows.mapInArrow(lambda it: _swapped(index, others, it), "lost array<int>, gained array<int>").groupBy("lost", "gained").agg(F.count(F.lit(1)).alias("n"))
    swaps = swaps.orderBy(F.col("n").desc(), "lost", "gained").limit(p.max_swaps).toArrow()
    lost, gained = _coordinates(swaps.column("lost")), _coordinates(swaps.column("gained"))
    discard(rows, counts)
    often = swaps.column("n").to_numpy().astype(float)
    w, b = fit(i, j, got.column("y").to_numpy().astype(float), len(index), prior, lost, gained, often, p)
    return Model({k: float(w[n]) for k, n in index.items() if abs(w[n]) > 1e-4}, float(b), int(often.sum()))


def _coordinates(rows: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, features) of the lists of features of some rows."""
    each = rows.combine_chunks()
    n = np.diff(each.offsets.to_numpy())
    return np.repeat(np.arange(len(n)), n), each.flatten().to_numpy().astype(np.int64)


def fit(i: np.ndarray, j: np.ndarray, y: np.ndarray, width: int, prior: float, lost: tuple, gained: tuple, often: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """Weights and bias by logistic loss + L2 + mean squared logit change over the swaps (each so often), by Adam on full
    gradients; the bias is held at or below ``prior``."""
    w, b, n, k = np.zeros(width), prior, len(y), len(often)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    share = often / max(1.0, often.sum())
    for t in range(1, p.steps + 1):
        s = np.bincount(i, w[j], minlength=n) + b
        e = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - y
        g = np.append(np.bincount(j, e[i], minlength=width) / n + p.l2 * w / 100, e.mean())
        if k:
            d = share * (np.bincount(lost[0], w[lost[1]], minlength=k) - np.bincount(gained[0], w[gained[1]], minlength=k))
            g[:-1] += 2 * p.counterfactual * (np.bincount(lost[1], d[lost[0]], minlength=width) - np.bincount(gained[1], d[gained[0]], minlength=width))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], min(prior, b - step[-1])
    return w, b


class _Memo(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.known = model.weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        got = tuple(f for f in features_of(word) if f in self.known)
        if len(self) > 150_000:
            self.clear()
        self[word] = got
        return got


def _score(model: Model, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo, known = _Memo(model), model.weights
    for batch in slices(batches):
        out = []
        for text in batch.column("__text").to_pylist():
            found: set[str] = set()
            for w in set(WORD.findall((text or "").lower())):
                if f := memo[w]:
                    found.update(f)
            out.append(1 / (1 + np.exp(-max(-30.0, min(30.0, model.bias + sum(known[f] for f in sorted(found)))))))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.float64())], [*keep, "score"])


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) and score in 0..1. Null and empty texts get the score of a text without words;
    very long texts are scored whole; repeated rows repeat; a column named score is replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    held = [f"k{i}" for i in range(len(keep))]
    base = fill_partitions(docs.select(*[docs[c].alias(h) for c, h in zip(keep, held, strict=True)], docs[text].cast("string").alias("__text")))
    kinds = ", ".join([f"{h} {base.schema[h].dataType.simpleString()}" for h in held] + ["score double"])
    return base.mapInArrow(lambda it: _score(model, held, it), kinds).select(*[F.col(h).alias(c) for c, h in zip(keep, held, strict=True)], "score")


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(of))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, of: int, held: int, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``max_rows`` labelled documents outside the held-out fold, those with the smallest
    hash of doc_id. The choice is made on the narrow labels, so documents are only filtered by a bounded broadcast."""
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), of) != held)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")
