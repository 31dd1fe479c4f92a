"""Question/answer pairs: extraction from lines, cleaning, scoring, keep / review / reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageknow.functions import lexicon as L
from pageknow.functions.text import bind, comparison_key, contains_any, lines, squeeze, text_or_empty
from pageknow.operators.rules import clamp, first_label, scored


def strip_prefix(line: Column) -> Column:
    """A question line without ``Q:`` or a number before it, squeezed."""
    x = F.regexp_replace(line, r"(?i)^\s*(q|question|問|问)\s*[:：.)-]\s*", "")
    return squeeze(F.regexp_replace(x, r"^\s*[0-9]{1,2}[.)]\s*", ""))


def is_question(line: Column, starters: tuple[str, ...] = L.QUESTION_STARTERS, starters_zh: tuple[str, ...] = L.QUESTION_STARTERS_ZH, least: int = 5, most: int = 240) -> Column:
    def test(x: Column) -> Column:
        low = F.lower(x)
        opens = low.rlike("^(" + "|".join(starters) + ") ")
        numbered = low.rlike(r"^[0-9]{1,2}[.)]\s+(" + "|".join(starters) + ") ")
        yes = low.rlike("^(q|question|問|问)\\s*[:：.)-]") | x.endswith("?") | x.endswith("？")
        zh = x.rlike("^(" + "|".join(starters_zh) + ")")
        return (F.length(x) >= least) & (F.length(x) <= most) & (yes | (~low.startswith("if ") & (opens | zh | numbered)))

    return bind(strip_prefix(line), test)


def is_navigation(line: Column, terms: tuple[str, ...] = L.NAVIGATION_LINES, headings: tuple[str, ...] = L.SECTION_HEADINGS) -> Column:
    return F.lower(line).isin(*terms) | F.lower(squeeze(line)).isin(*headings) | (F.length(line) <= 2)


def extract_pairs(docs: DataFrame, key: str, text: str = "text", least: int = 30, max_lines: int = 14, max_chars: int = 1400, answer_chars: int = 1600, **question) -> DataFrame:  # noqa: ANN003
    """(key, pos, question, answer): each question line and the lines up to the next, without navigation, until 14 lines or
    1,400 characters are reached; the answer is cut at 1,600 (stated limits of the rule)."""
    x = docs.select(key, F.posexplode(lines(F.col(text))).alias("pos", "line")).withColumn("q", is_question(F.col("line"), **question))
    by = W.partitionBy(key).orderBy("pos")
    x = x.withColumn("grp", F.sum(F.col("q").cast("int")).over(by)).where("grp > 0")
    x = x.withColumn("use", ~F.col("q") & ~is_navigation(F.col("line")))
    prior = W.partitionBy(key, "grp").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    n = F.coalesce(F.sum(F.col("use").cast("int")).over(prior), F.lit(0))
    chars = F.coalesce(F.sum(F.when(F.col("use"), F.length("line") + 1).otherwise(0)).over(prior), F.lit(0)) - 1
    x = x.withColumns({"n": n, "chars": chars})
    got = x.groupBy(key, "grp").agg(
        F.min(F.when(F.col("q"), F.col("pos"))).alias("pos"), F.min(F.when(F.col("q"), strip_prefix(F.col("line")))).alias("question"),
        F.array_sort(F.collect_list(F.when(F.col("use") & (F.col("n") < max_lines) & (F.col("chars") < max_chars), F.struct("pos", "line")))).alias("a"),
    )
    answer = F.left(squeeze(F.array_join(F.transform("a", lambda s: s["line"]), " ")), F.lit(answer_chars))
    return got.select(key, "pos", "question", answer.alias("answer")).where((F.length("answer") >= least) & (F.length("question") >= 5))


def first_of_key(pairs: DataFrame, owner: str, order: list[str], question: str = "question") -> DataFrame:
    """The first pair of each (owner, question compared by its letters and digits)."""
    w = W.partitionBy(owner, comparison_key(F.col(question))).orderBy(*order)
    return pairs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def faq_items(pages: DataFrame, key: str, owner: str, include_all: bool = False, owners: list[str] | None = None, lexicon: L.Lexicon = L.CATEGORIES, **pairs) -> DataFrame:  # noqa: ANN003
    """(key, pos, question, answer, owner, stage, category, risk_level, source_url) of pages (key, owner, page_type, stage,
    source_url, final_url, text): of FAQ pages, or of all, and of the owners asked for in lower case. Of each owner, whatever its case, a
    question counts once, where it stands first. The stage is the page's, else its type, and the category if no word tells."""
    some = pages if include_all else pages.where(F.col("page_type") == "faq")
    if owners is not None:
        some = some.where(F.lower(text_or_empty(F.col(owner))).isin([o.lower() for o in owners]))
    filled = lambda a, b: F.coalesce(F.nullif(text_or_empty(F.col(a)), F.lit("")), text_or_empty(F.col(b)))
    about = some.select(key, F.col(owner).alias("owner"), F.lower(text_or_empty(F.col(owner))).alias("__o"), filled("stage", "page_type").alias("stage"), filled("source_url", "final_url").alias("source_url"))
    got = first_of_key(extract_pairs(some.select(key, "text"), key, **pairs).join(about, key), "__o", [key, "pos"])
    told = F.coalesce(F.nullif(category(F.col("question"), F.col("answer"), lexicon, ""), F.lit("")), F.col("stage"))
    return got.withColumn("category", told).withColumn("risk_level", risk_level(F.col("question"), F.col("answer"), F.col("category"))).select(key, "pos", "question", "answer", F.col("owner").alias(owner), "stage", "category", "risk_level", "source_url")


def category(question: Column, answer: Column, lexicon: L.Lexicon = L.CATEGORIES, default: str = "general") -> Column:
    return first_label(F.lower(F.concat_ws(" ", text_or_empty(question), text_or_empty(answer))), lexicon, default)


def risk_level(question: Column, answer: Column, cat: Column, words: tuple[str, ...] = L.HIGH_RISK_WORDS, high: tuple[str, ...] = L.HIGH_RISK_CATEGORIES, medium: tuple[str, ...] = L.MEDIUM_RISK_CATEGORIES) -> Column:
    text = F.lower(F.concat_ws(" ", text_or_empty(question), text_or_empty(answer)))
    return F.when(cat.isin(*high) | contains_any(text, words), "high").when(cat.isin(*medium), "medium").otherwise("low")


def clean_question(q: Column) -> Column:
    x = squeeze(text_or_empty(q))
    x = F.regexp_replace(x, r"(?i)^(q|question|問|问)\s*[0-9]{0,3}\s*[:：.)-]\s*", "")
    x = F.regexp_replace(F.regexp_replace(x, r"^[A-Z][0-9]{1,2}[.)]\s*", ""), r"^[0-9]{1,2}[.)]\s*", "")
    return F.trim(F.regexp_replace(x, r"(?i)\s*\(https?://[^)]+\)\s*$", ""))


def clean_answer(a: Column) -> Column:
    return F.trim(F.regexp_replace(squeeze(text_or_empty(a)), r"(?i)\s+(Back to top|Previous|Next)\s*$", ""))


def looks_like_question(q: Column) -> Column:
    return q.endswith("?") | q.endswith("？") | F.lower(q).rlike("^(" + "|".join(L.MORE_QUESTION_STARTERS) + ") ") | q.rlike("^(" + "|".join(L.QUESTION_STARTERS_ZH) + ")")


def looks_like_fragment(q: Column) -> Column:
    opens = F.lower(q).rlike("^(" + "|".join(L.FRAGMENT_STARTERS) + ")")
    ends = q.rlike("(" + "|".join(L.FRAGMENT_ENDS) + ")$")
    return F.when(opens, ~(q.endswith("?") | q.endswith("？"))).otherwise(ends)


def mostly_navigation(a: Column) -> Column:
    """A navigation term, or a short text with three of them; only terms of one word can be counted."""
    low = F.lower(F.trim(a))
    words = F.regexp_extract_all(low, F.lit("[a-z]+"), 0)
    single = F.array(*[F.lit(t) for t in L.NAVIGATION_TERMS])
    return low.isin(*L.NAVIGATION_TERMS) | ((F.size(words) <= 12) & (F.size(F.filter(words, lambda w: F.array_contains(single, w))) >= 3))


def score_pairs(pairs: DataFrame, owner: str, order: list[str], min_score: int = 65) -> DataFrame:
    """``pairs`` + cleaned_question, cleaned_answer, quality_score, decision, quality_notes. A later pair of the same owner and
    question is rejected and scores at most 40, even if the first one was itself rejected; below ``min_score`` a pair that
    would be kept is put up for review. The decision uses the score before it is clamped to 0..100."""
    x = pairs.withColumns({"cleaned_question": clean_question(F.col("question")), "cleaned_answer": clean_answer(F.col("answer"))})
    q, a = F.col("cleaned_question"), F.col("cleaned_answer")
    nq, na = F.length(q), F.length(a)
    noise = contains_any(F.lower(q), L.TEMPLATE_NOISE) | contains_any(F.lower(a), L.TEMPLATE_NOISE)
    broad = F.regexp_replace(F.lower(q), "^[ ?]+|[ ?]+$", "").isin(*L.BROAD_QUESTIONS)
    url = text_or_empty(F.col("source_url")) if "source_url" in pairs.columns else F.lit("")
    fragment = looks_like_fragment(q)
    raw, notes = scored(100, [
        (nq < 10, -45, "question_too_short"), (nq > 220, -20, "question_very_long"), (na < 45, -40, "answer_too_short"), ((na >= 45) & (na < 80), -15, "answer_short"),
        (na > 1400, -5, "answer_long"), (~looks_like_question(q), -35, "question_shape_suspicious"), (fragment, -45, "question_fragment"), (noise, -55, "template_or_navigation_noise"),
        (mostly_navigation(a), -60, "answer_looks_like_navigation"), (broad, -60, "broad_navigation_question"), (~url.startswith("http"), -10, "missing_source_url"),
    ])
    x = x.withColumns({"__raw": raw, "__notes": notes})
    bad = F.arrays_overlap("__notes", F.array(*[F.lit(n) for n in ("template_or_navigation_noise", "question_fragment", "broad_navigation_question")]))
    w = W.partitionBy(F.lower(F.trim(text_or_empty(F.col(owner)))), comparison_key(q)).orderBy(*order)
    x = x.withColumn("__again", F.row_number().over(w) > 1)
    score = clamp(F.col("__raw"))
    score = F.when(F.col("__again"), F.least(score, F.lit(40))).otherwise(score)
    decision = F.when(F.col("__again") | (F.col("__raw") < 50) | bad, "reject").when(score < min_score, "review").otherwise("keep")
    notes = F.when(F.col("__again"), F.array_append("__notes", F.lit("duplicate_question_for_school"))).otherwise(F.col("__notes"))
    return x.select(*pairs.columns, "cleaned_question", "cleaned_answer", score.cast("int").alias("quality_score"), decision.alias("decision"), F.array_join(notes, "; ").alias("quality_notes"))


def kept(report: DataFrame) -> DataFrame:
    """The kept pairs, cleaned."""
    out = report.where("decision = 'keep'")
    return out.withColumns({"question": F.col("cleaned_question"), "answer": F.col("cleaned_answer")}).drop("cleaned_question", "cleaned_answer", "quality_score", "decision", "quality_notes")
