"""Quality by Bradley-Terry ranking.

Each text becomes a short vector of shape statistics (capitals, symbols, repeats, separators, word lengths, ...), each cut
into bins at the sample's quantiles. From pairs of one document labelled good and one labelled bad, a weight per bin is
learned by logistic loss on the difference of the two bin vectors, so that the good one gets the higher score. A second,
one-dimensional logistic fit puts the score on a scale of 0 to 1; documents are then also marked by a quantile of the
scores of the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageknow.llm.common import fill_partitions, materialize, slices

FEATURES = (
    "log_chars", "log_words", "upper", "digit", "symbol", "mark", "pipe", "space", "newline", "repeat_next",
    "distinct", "mean_word", "long_word", "one_char", "upper_words", "repeat_second", "end_marks", "other",
)
_KIND = np.full(256, 7, dtype=np.int64)  # other
for _c, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0), (b"0123456789", 1), (b"#$%&*@^~<>=+_\\/{}[]", 2), (b"!?", 3), (b"|", 4), (b" \t", 5), (b"\r\n", 6), (b"abcdefghijklmnopqrstuvwxyz", 8), (b".,;:", 9)):
    _KIND[list(_c)] = _k
_KIND[0x80:] = 10


@dataclass(frozen=True)
class Params:
    max_train_rows: int = 20_000  # labelled rows used (smallest hash of doc_id first)
    max_pairs: int = 60_000  # preference pairs drawn from them
    bins: int = 12
    l2: float = 1e-4
    steps: int = 400
    drop_share: float = 0.1  # documents below this quantile of the corpus are marked as not kept


@dataclass(frozen=True)
class Model:
    cuts: np.ndarray  # (features, bins - 1)
    weights: np.ndarray  # (features, bins)
    scale: float
    shift: float


def shape(text: bytes | None) -> list[float]:
    text = text or b""
    n = max(1, len(text))
    c = np.bincount(_KIND[np.frombuffer(text, dtype=np.uint8)], minlength=11) / n
    words = text.split()
    m = max(1, len(words))
    after = sum(map(eq, words, words[1:])) / m
    second = sum(map(eq, words, words[2:])) / m
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ups = sum(map(bytes.isupper, words)) / m
    return [
        np.log1p(len(text)), np.log1p(len(words)), c[0], c[1], c[2], c[3], c[4], c[5], c[6], after,
        len(set(words)) / m / max(1.0, 4.0 / np.log1p(m)), float(lengths.mean()) if len(words) else 0.0, float((lengths > 15).mean()) if len(words) else 0.0,
        float((lengths == 1).mean()) if len(words) else 0.0, ups, second, c[9], c[7],
    ]


def _vectors(text: str, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        v = [shape(t) for t in b.column(text).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(v, pa.list_(pa.float64()))], [*keep, "v"])


def bin_of(cuts: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(rows, features) -> bin numbers."""
    return np.stack([np.searchsorted(cuts[k], v[:, k], side="right") for k in range(v.shape[1])], axis=1) if len(v) else np.zeros((0, len(cuts)), dtype=int)


def train(labelled: DataFrame, p: Params = Params()) -> Model:
    """Fit on (doc_id, text, y), a bounded sample. Without labels of both kinds every text scores the share of good ones (0.5 if none)."""
    rows = labelled.where(F.col("y").isNotNull()).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("y").cast("int").alias("y"))
    got = fill_partitions(rows).mapInArrow(lambda it: _vectors("text", ["doc_id", "y"], it), "doc_id long, y int, v array<double>").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    y = got["y"].to_numpy() if len(got) else np.zeros(0, dtype=int)
    v = np.stack(got["v"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES)))
    blank = Model(np.zeros((len(FEATURES), 0)), np.zeros((len(FEATURES), 1)), 0.0, 0.0)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Model(blank.cuts, blank.weights, 0.0, float(np.log(share / (1 - share))))
    # half of the cuts from each class, so that rare bad values get bins of their own
    qs = np.linspace(0, 1, p.bins // 2 + 2)[1:-1]
    cuts = np.stack([np.sort(np.concatenate([np.quantile(v[y == k, f], qs) for k in (0, 1)])) for f in range(v.shape[1])])
    bins = bin_of(cuts, v) + np.arange(v.shape[1]) * (cuts.shape[1] + 1)
    width = v.shape[1] * (cuts.shape[1] + 1)
    rng = np.random.default_rng(11)
    n = min(p.max_pairs, 40 * len(y))
    good, bad = rng.choice(np.flatnonzero(y == 1), n), rng.choice(np.flatnonzero(y == 0), n)
    w, m, s = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, p.steps + 1):
        margin = w[bins[good]].sum(1) - w[bins[bad]].sum(1)
        e = -1 / (1 + np.exp(np.clip(margin, -30, 30))) / n
        g = np.bincount(bins[good].ravel(), np.repeat(e, v.shape[1]), minlength=width) - np.bincount(bins[bad].ravel(), np.repeat(e, v.shape[1]), minlength=width) + p.l2 * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-10)
    scale, shift = _platt(w[bins].sum(1), y)
    return Model(cuts, w.reshape(v.shape[1], -1), scale, shift)


def _platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps of a two-parameter logistic fit, lightly damped."""
    x, c = np.stack([s, np.ones(len(s))], axis=1), np.zeros(2)
    goal = (y * (y.sum() + 1) / (y.sum() + 2)) + (1 - y) / (len(y) - y.sum() + 2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        d = np.linalg.solve(h, x.T @ (q - goal) + 1e-3 * c)
        c -= d * min(1.0, 2.0 / max(1e-9, np.abs(d).max()))
    return float(c[0]), float(c[1])


def _score(model: Model, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        v = np.array([shape(t) for t in b.column("__text").cast(pa.binary()).to_pylist()]).reshape(-1, len(FEATURES))
        k = bin_of(model.cuts, v)
        s = model.weights[np.arange(len(FEATURES)), k].sum(1) if len(v) else np.zeros(0)
        out = 1 / (1 + np.exp(-np.clip(model.scale * s + model.shift, -30, 30)))
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(out, pa.float64())], [*keep, "score"])


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) and score in 0..1, higher for better texts. A null text scores as the empty one;
    texts are read whole; repeated rows repeat; a column named score is replaced; an empty table stays empty."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    held = [f"k{i}" for i in range(len(keep))]
    base = fill_partitions(docs.select(*[docs[c].alias(h) for c, h in zip(keep, held, strict=True)], F.coalesce(docs[text].cast("string"), F.lit("")).alias("__text")))
    kinds = ", ".join([f"{h} {base.schema[h].dataType.simpleString()}" for h in held] + ["score double"])
    return base.mapInArrow(lambda it: _score(model, held, it), kinds).select(*[F.col(h).alias(c) for c, h in zip(keep, held, strict=True)], "score")


def mark_by_quantile(scored: DataFrame, p: Params = Params()) -> DataFrame:
    """+ above_quantile: whether the score reaches the ``drop_share`` quantile over all documents."""
    scored = materialize(scored, "quality-scores")
    cut = scored.agg(F.percentile_approx("score", p.drop_share, 10_000).alias("cut"))
    return scored.crossJoin(F.broadcast(cut)).withColumn("above_quantile", F.col("score") >= F.col("cut")).drop("cut")
