"""Messages to intents, entities, completion flags and profiles, as column expressions over a table of messages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageknow.functions import lexicon as L
from pageknow.functions.text import bind, contains_any, found, hits, squeeze, text_or_empty


def entity(message: Column, aliases: L.Lexicon = L.SCHOOL_ALIASES, default: Column | None = None) -> Column:
    """The entity one of whose aliases (or its own name) is in the message, longer names first; ASCII aliases must stand alone
    as words. Else the default."""
    low = F.lower(text_or_empty(message))

    def said(word: str) -> Column:
        w = word.lower()
        return low.rlike(f"(^|[^a-z0-9]){re.escape(w)}([^a-z0-9]|$)") if re.fullmatch("[a-z0-9 ]+", w) else F.contains(low, F.lit(w))

    names = sorted(aliases.items(), key=lambda kv: -len(kv[0]))
    cases = []
    for name, words in names:
        test = said(name)
        for w in words:
            test = test | said(w)
        cases.append(F.when(test, F.lit(name)))
    return F.coalesce(*cases, text_or_empty(default) if default is not None else F.lit(""))


def _quote(words: tuple[str, ...]) -> str:
    """Alternation of literal words, in the syntax shared by Java and RE2."""
    return "|".join(re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", w) for w in dict.fromkeys(words))


def pending_pattern(words: tuple[str, ...], actions: tuple[str, ...], pending: tuple[str, ...] = L.PENDING_WORDS) -> str:
    """Not yet .. word, or word .. not yet .. action."""
    w, p, a = _quote(tuple(x.lower() for x in words)), _quote(pending), _quote(actions)
    return f"(?:{p}).{{0,10}}(?:{w})|(?:{w}).{{0,4}}(?:{p}).{{0,10}}(?:{a})"


def stage_scores(text: Column, stages: L.Lexicon = L.STAGE_WORDS, actions: L.Lexicon = L.PENDING_ACTIONS, boost: int = 4, pending: tuple[str, ...] = L.PENDING_WORDS) -> Column:
    """Struct (score, priority, stage) of the best stage; earlier stages of the list win ties; null if no stage scores."""
    parts = []
    for i, (stage, words) in enumerate(stages.items()):
        own = hits(text, words) + F.when(text.rlike(pending_pattern(words, actions.get(stage, ("完成",)), pending)), boost).otherwise(0)
        parts.append(F.when(own > 0, F.struct(own.alias("score"), F.lit(len(stages) - i).alias("priority"), F.lit(stage).alias("stage"))))
    return F.array_max(F.array(*parts))


def route(messages: DataFrame, text: str = "text", aliases: L.Lexicon = L.SCHOOL_ALIASES, stages: L.Lexicon = L.STAGE_WORDS, actions: L.Lexicon = L.PENDING_ACTIONS, plan: tuple[str, ...] = L.PLAN_WORDS, risk: tuple[str, ...] = L.RISK_WORDS,
          default: str | None = None, pending: tuple[str, ...] = L.PENDING_WORDS, page_types: L.Lexicon = L.STAGE_PAGE_TYPES) -> DataFrame:
    """``messages`` + school, stage, page_types, intent, confidence, matched (words, then ``pending:stage`` for what is said to
    be open): risk and plan words outrank the stage."""
    x = messages.withColumn("__t", F.lower(squeeze(text_or_empty(F.col(text)))))
    t = F.col("__t")
    x = x.withColumns({"school": entity(t, aliases, F.col(default) if default else None), "__b": stage_scores(t, stages, actions, pending=pending), "__plan": contains_any(t, plan), "__risk": contains_any(t, risk)})
    stage = F.coalesce("__b.stage", F.lit(""))
    intent = F.when(F.col("__risk"), "risk_check").when(F.col("__plan"), "task_plan").when(stage == "faq", "faq").when(stage != "", "question_answering").otherwise("general_guidance")
    conf = 0.25 + F.least(F.lit(0.4), F.coalesce("__b.score", F.lit(0)) * 0.12) + F.when(F.col("school") != "", 0.15).otherwise(0.0) + F.when(F.col("__plan"), 0.1).otherwise(0.0) + F.when(F.col("__risk"), 0.1).otherwise(0.0)
    open_ = [F.when(t.rlike(pending_pattern(w, actions.get(g, ("完成",)), pending)), F.array(F.lit(f"pending:{g}"))).otherwise(F.array().cast("array<string>")) for g, w in stages.items()]
    words = F.array_distinct(F.flatten(F.array(*[found(t, w) for w in stages.values()], *open_)))
    types = F.coalesce(*[F.when(stage == k, F.array(*[F.lit(v) for v in vs])) for k, vs in page_types.items()], F.array().cast("array<string>"))
    return x.withColumns({"stage": stage, "page_types": types, "intent": intent, "confidence": F.round(F.least(conf, F.lit(0.95)), 2), "matched": F.array_join(words, "; ")}).drop("__t", "__b", "__plan", "__risk")


def completion_flags(message: Column, patterns: L.Lexicon = L.COMPLETION) -> Column:
    """Array of the flags one of whose patterns is found, any case."""
    def flags(t: Column) -> Column:
        return F.array_compact(F.array(*[F.when(t.rlike("(?i)" + "|".join(f"(?:{p})" for p in ps)), F.lit(flag)) for flag, ps in patterns.items()]))

    return bind(F.lower(squeeze(text_or_empty(message))), flags)


def tri_state(positive: Column, negative: Column) -> Column:
    """True, false or null; both at once raise when the row is read."""
    return F.when(positive & negative, F.raise_error(F.lit("conflicting condition flags")).cast("boolean")).when(positive, True).when(negative, False)


def build_profiles(messages: DataFrame, text: str = "text", school: str = "school", given: dict[str, Column] | None = None, positive: Column | None = None, negative: Column | None = None,
                   patterns: L.Lexicon = L.COMPLETION, conditional: tuple[str, ...] = ("conditional", "条件")) -> DataFrame:
    """``messages`` + completed_flags (found in the text or ``given`` as true) and has_conditional_offer: as stated by
    ``positive`` or ``negative``, else true if the text has one of the words, else null."""
    none = F.array().cast("array<string>")
    said = [F.when(F.coalesce(c, F.lit(False)), F.array(F.lit(k))).otherwise(none) for k, c in (given or {}).items()]
    flags = F.array_sort(F.array_distinct(F.concat(completion_flags(F.col(text), patterns), *said)))
    no = F.lit(False)
    stated = tri_state(F.coalesce(positive, no) if positive is not None else no, F.coalesce(negative, no) if negative is not None else no)
    hinted = F.when(contains_any(F.lower(text_or_empty(F.col(text))), conditional), True)
    return messages.withColumns({"completed_flags": flags, "has_conditional_offer": F.coalesce(stated, hinted), school: text_or_empty(F.col(school))})


def merge_profiles(stored: DataFrame, current: DataFrame, key: str, texts: list[str], flags: str = "completed_flags", tri: str = "has_conditional_offer") -> DataFrame:
    """Every profile of either side: current values where they are not empty, flags of both, a current tri-state that is not null."""
    s, c = stored.alias("s"), current.alias("c")
    none = F.array().cast("array<string>")
    j = s.join(c, F.col(f"s.{key}") == F.col(f"c.{key}"), "full_outer")
    return j.select(
        F.coalesce(f"c.{key}", f"s.{key}").alias(key), *[F.coalesce(F.nullif(F.col(f"c.{t}"), F.lit("")), text_or_empty(F.col(f"s.{t}"))).alias(t) for t in texts],
        F.array_sort(F.array_union(F.coalesce(f"s.{flags}", none), F.coalesce(f"c.{flags}", none))).alias(flags), F.coalesce(f"c.{tri}", f"s.{tri}").alias(tri),
    )


def latest_profile(log: DataFrame, key: str, seq: str) -> DataFrame:
    """Profile upsert: the last row of each user."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("p")).select(key, "p.*")
