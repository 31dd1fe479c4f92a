"""Rule lists: ordered first match, additive scores with notes, arg-max of labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageknow.functions.lexicon import Lexicon
from pageknow.functions.text import contains_any, hits


def first_label(text: Column, lexicon: Lexicon, default: str) -> Column:
    """The first label of which a word is in the text."""
    return F.coalesce(*[F.when(contains_any(text, words), F.lit(label)) for label, words in lexicon.items()], F.lit(default))


def best_label(text: Column, lexicon: Lexicon, boost: dict[str, Column] | None = None, rank: dict[str, int] | None = None) -> Column:
    """Struct (score, rank, label) of the label with most words in the text (plus its boost); ties by ``rank`` (by label where
    there is none). Score 0 means that no label applies."""
    parts = [
        F.struct((hits(text, words) + (boost or {}).get(label, F.lit(0))).alias("score"), F.lit((rank or {}).get(label, 0)).alias("rank"), F.lit(label).alias("label"))
        for label, words in lexicon.items()
    ]
    return F.array_max(F.array(*parts))


def scored(base: int, rules: list[tuple[Column, int, str]]) -> tuple[Column, Column]:
    """(score, notes): every rule that holds adds its delta and, if it has one, its note, in order; a note stands once."""
    score = F.lit(base)
    for cond, delta, _ in rules:
        score = score + F.when(cond, delta).otherwise(0)
    notes = F.array_distinct(F.array_compact(F.array(*[F.when(cond, F.lit(note)) for cond, _, note in rules if note])))
    return score, notes


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
