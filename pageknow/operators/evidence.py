"""Typed evidence from question/answer pairs, and its audit against a source catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageknow.functions import lexicon as L
from pageknow.functions.text import bind, comparison_key, contains_any, found, hits, squeeze, text_or_empty
from pageknow.operators.rules import best_label, clamp
from pageknow.sources.commits import written

URL = r"(?i)https?://[^\s),;]+"
FEE = r"(?i)(?:^|[^A-Za-z0-9_])((?:HK\$|HKD\s*)[0-9,]+(?:\.[0-9]+)?)"
CONFIDENCE = ("low", "medium", "high")


def sentences(text: Column, least: int = 12) -> Column:
    """Array of sentences: cut after . ! ? before a capital, digit or quote; shorter ones are left out."""
    cut = F.split(F.regexp_replace(squeeze(text_or_empty(text)), r"([.!?]) ([A-Z0-9\"“])", "$1\u0001$2"), "\u0001")
    return F.transform(F.filter(cut, lambda s: F.length(F.trim(s)) >= least), lambda s: F.regexp_replace(s, "^[ ;]+|[ ;]+$", ""))


def urls(text: Column) -> Column:
    """Distinct urls in order, without a dot at the end."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text_or_empty(text), F.lit(URL), 0), lambda u: F.regexp_replace(u, "[.]+$", "")))


def fees(text: Column, pattern: str = FEE) -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(pattern), 1)


def task_of(question: Column, answer: Column, category: Column, tasks: dict = L.TASKS, excluded: tuple[str, tuple[str, ...]] | None = ("application fee", ("deposit", "tuition"))) -> Column:
    """Struct (task_code, stage, confidence) of the task with most words, +2 where the category is its stage; ties go to the
    last code in alphabetical order. A text with the excluded phrase and none of its exceptions has no task."""
    def pick(text: Column) -> Column:
        best = best_label(text, {c: w for c, (_, w) in tasks.items()}, {c: F.when(category == s, 2).otherwise(0) for c, (s, _) in tasks.items()})
        out = F.contains(text, F.lit(excluded[0])) & ~contains_any(text, excluded[1]) if excluded else F.lit(False)
        stage = F.create_map(*[x for c, (s, _) in tasks.items() for x in (F.lit(c), F.lit(s))])
        none = F.struct(F.lit("").alias("task_code"), F.lit("").alias("stage"), F.lit("low").alias("confidence"))
        some = lambda b: F.struct(b["label"].alias("task_code"), F.element_at(stage, b["label"]).alias("stage"), F.when(b["score"] >= 4, "high").when(b["score"] >= 2, "medium").otherwise("low").alias("confidence"))
        return F.when(out, none).otherwise(bind(best, lambda b: F.when(b["score"] == 0, none).otherwise(some(b))))

    return bind(F.lower(F.concat_ws(" ", text_or_empty(question), text_or_empty(answer))), pick)


def document_hint(sentence: Column, words: tuple[str, ...] = L.DOCUMENT_WORDS) -> Column:
    return bind(F.array_join(found(F.lower(sentence), words), "; "), lambda h: F.when(h != "", h).otherwise(sentence))


def candidates(question: Column, answer: Column, task_code: Column, deadline: tuple[str, ...] = L.DEADLINE_WORDS, document: tuple[str, ...] = L.DOCUMENT_WORDS, action: tuple[str, ...] = L.ACTION_WORDS, fee: str = FEE) -> Column:
    """Array of (evidence_type, evidence_text, normalized_value, confidence): urls, fees, then sentence by sentence deadline,
    document and action; the pair itself as source_context if there is nothing else."""
    def item(kind: str, text: Column, value: Column, confidence: str) -> Column:
        return F.struct(F.lit(kind).alias("evidence_type"), text.alias("evidence_text"), value.alias("normalized_value"), F.lit(confidence).alias("confidence"))

    def of_sentence(s: Column) -> Column:
        low = F.lower(s)
        acts = contains_any(low, action) & ~((task_code == "pay_tuition") & F.contains(low, F.lit("application fee")))
        return F.array_compact(F.array(F.when(contains_any(low, deadline), item("deadline", s, s, "medium")), F.when(contains_any(low, document), item("required_document", s, document_hint(s, document), "medium")), F.when(acts, item("action_instruction", s, s, "medium"))))

    every = F.concat(
        F.transform(urls(answer), lambda u: item("action_url", u, u, "high")), F.transform(fees(answer, fee), lambda f: item("fee_amount", f, F.replace(f, F.lit(","), F.lit("")), "medium")),
        F.flatten(F.transform(sentences(answer), of_sentence)),
    )
    context = item("source_context", F.concat(F.lit("Q: "), text_or_empty(question), F.lit(" A: "), F.left(text_or_empty(answer), F.lit(500))), F.lit(""), "low")
    return bind(every, lambda c: F.when((F.size(c) == 0) & (text_or_empty(answer) != ""), F.array(context)).otherwise(c))


def weaker(a: Column, b: Column) -> Column:
    """The lower of two confidences."""
    rank = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in CONFIDENCE]), c), F.lit(0)), F.lit(1)).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in CONFIDENCE]), F.least(rank(a), rank(b)))


def in_sequence(rows: DataFrame, pair: list[str], position: str, group: list[str], key: str, most: int) -> DataFrame:
    """(pair, position) of the rows that are taken if pairs are gone through in order, and the rows of a pair by position: a
    row is passed over if one with its key was taken before in its group, and a pair ends with its ``most``-th taken row, so
    what comes after counts neither as taken nor as met.

    Rounds: of the rows that are not behind an end the first of each key is new; new rows set the ends; ends that moved may let
    in a row of a later pair. The first pairs of a group are settled first, the others after them; a round works on the groups
    in which an end moved in the one before, and is written. Keys are met by an aggregation, so a key of a third of all rows is no
    hot task."""
    place = F.struct(*pair, position)
    within = W.partitionBy(*group, *pair).orderBy(position)
    before = F.coalesce(F.sum("new").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    todo = written(rows.select(*group, *pair, position, key, F.lit(False).alias("over")), "sequence")
    done = None
    while True:
        first = todo.where("NOT over").groupBy(*group, key).agg(F.min(place).alias("at")).select(*[F.col(g).alias(f"__{g}") for g in group], *[F.col(f"at.{c}").alias(f"__{c}") for c in (*pair, position)])
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*group, *pair, position)]
        met = todo.join(first.withColumn("new", F.lit(1)), same, "left").select(*todo.columns, F.coalesce("new", F.lit(0)).alias("new"))
        now = met.withColumn("before", before).withColumn("ends", F.col("before") >= most)
        moved = F.max((F.col("ends") != F.col("over")).cast("int")).over(W.partitionBy(*group))
        now = written(now.select(*group, *pair, position, key, F.col("ends").alias("over"), ((F.col("new") == 1) & ~F.col("ends")).alias("taken"), moved.alias("moved")), "sequence")
        settled = now.where("moved = 0 AND taken").select(*pair, position)
        done = settled if done is None else done.unionAll(settled)
        todo = now.where("moved = 1").select(*group, *pair, position, key, "over")
        if todo.isEmpty():
            return done


def extract(pairs: DataFrame, owner: str, order: list[str], per_question: int = 8, tasks: dict = L.TASKS, excluded: tuple | None = ("application fee", ("deposit", "tuition")), **words) -> DataFrame:  # noqa: ANN003
    """Evidence rows of ``pairs`` (question, answer, category, source_url, owner, order columns, which number the pairs).

    Pair by pair in order, a candidate equal to one taken before (owner, task, type, value and text compared by letters and
    digits) is passed over, and a pair ends with its ``per_question``-th row; see ``in_sequence``. The id is a hash of the content.
    """
    t = task_of(F.col("question"), F.col("answer"), F.col("category"), tasks, excluded)
    x = pairs.withColumn("__t", t).where("__t.task_code <> ''")
    x = x.select(*pairs.columns, "__t", F.posexplode(candidates(F.col("question"), F.col("answer"), F.col("__t.task_code"), **words)).alias("__n", "__c"))
    key = comparison_key(F.col("__c.evidence_text"))
    same = F.sha2(F.concat_ws("\u0000", "__c.evidence_type", "__c.normalized_value", key), 256)
    ident = F.concat_ws("__", F.lower(F.col(owner).cast("string")), "__t.task_code", "__c.evidence_type", F.left(F.sha1(F.concat_ws("|", "__c.normalized_value", key)), F.lit(12)))
    x = written(x.select(
        *order, F.col(owner), ident.alias("evidence_id"), F.col("__t.task_code").alias("task_code"), F.col("__t.stage").alias("stage"), "__c.evidence_type", "__c.evidence_text", "__c.normalized_value",
        F.col("question").alias("source_question"), "source_url", weaker(F.col("__t.confidence"), F.col("__c.confidence")).alias("confidence"), F.col("__n").alias("candidate"), same.alias("__same"),
    ), "evidence")
    taken = in_sequence(x, order, "candidate", [owner, "task_code"], "__same", per_question)
    return x.drop("__same").join(taken, [*order, "candidate"], "left_semi")


def source_catalog(registry: DataFrame, owner: str, url: str, page_type: str, stage: str) -> DataFrame:
    """(owner in lower case, url, page_types, stages): sorted sets; rows without an owner or url are left out."""
    x = registry.where((text_or_empty(F.col(owner)) != "") & (text_or_empty(F.col(url)) != ""))
    return x.groupBy(F.lower(F.col(owner).cast("string")).alias("owner"), F.col(url).alias("url")).agg(
        F.sort_array(F.collect_set(text_or_empty(F.col(page_type)))).alias("page_types"), F.sort_array(F.collect_set(text_or_empty(F.col(stage)))).alias("stages"))


def audit(evidence: DataFrame, catalog: DataFrame, owner: str, task_words: L.Lexicon = L.AUDIT_TASK_WORDS, field_words: L.Lexicon = L.AUDIT_FIELD_WORDS, noise: tuple[str, ...] = L.AUDIT_NOISE, page_types: L.Lexicon = L.AUDIT_PAGE_TYPES) -> DataFrame:
    """``evidence`` + counts, source match, flags, quality_score, quality_decision. The decision uses the unclamped score."""
    e = evidence.alias("e").join(catalog.alias("c"), (F.lower(F.col(f"e.{owner}").cast("string")) == F.col("c.owner")) & (F.col("e.source_url") == F.col("c.url")), "left")
    x = e.select("e.*", F.coalesce("c.page_types", F.array().cast("array<string>")).alias("__p"), F.coalesce("c.stages", F.array().cast("array<string>")).alias("__s"))
    text = F.lower(F.concat_ws(" ", text_or_empty(F.col("evidence_text")), text_or_empty(F.col("normalized_value")), text_or_empty(F.col("source_question"))))
    x = x.withColumn("__text", text)
    by_label = lambda column, lexicon: F.coalesce(*[F.when(F.col(column) == k, hits(F.col("__text"), w)) for k, w in lexicon.items()], F.lit(0))
    expected = F.coalesce(*[F.when(F.col("task_code") == k, F.array(*[F.lit(t) for t in v])) for k, v in page_types.items()], F.array().cast("array<string>"))
    yes = F.arrays_overlap("__p", expected) | ((F.col("stage") != "") & F.array_contains("__s", F.col("stage")))
    match = F.when(yes, "yes").when(F.array_contains("__p", F.lit("faq")) | ((F.size("__p") == 0) & (F.size("__s") == 0)), "partial").otherwise("no")
    x = x.withColumns({"task_keyword_hit_count": by_label("task_code", task_words), "field_keyword_hit_count": by_label("evidence_type", field_words), "source_stage_match": match, "text_char_count": F.length("evidence_text"), "confidence": F.lower("confidence")})
    kind, n, conf = F.col("evidence_type"), F.col("text_char_count"), F.col("confidence")
    th, fh, m = F.col("task_keyword_hit_count") > 0, F.col("field_keyword_hit_count") > 0, F.col("source_stage_match")
    value = F.trim(text_or_empty(F.col("normalized_value"))) != ""
    noisy = contains_any(F.col("__text"), noise)
    navigation = F.col("__text").rlike("(^|[^a-z0-9_])(home|menu|search|share|cookie|subscribe)([^a-z0-9_]|$)") & (F.length("__text") > 500)
    rules = [
        (conf == "high", 30, ""), (conf == "medium", 20, ""), (th, 25, ""), (fh, 15, ""), (m == "yes", 15, ""), (m == "partial", 5, ""), (text_or_empty(F.col("source_url")) != "", 10, ""), (value, 5, ""), (conf == "low", -30, ""),
        (noisy, -10, "admission_noise"), (navigation, -10, "navigation_noise"), (kind == "source_context", -50, "source_context_only"), (~th & ~kind.isin("action_url", "fee_amount"), -25, "task_keyword_mismatch"),
        (~fh & kind.isin(*field_words), -10, "field_keyword_weak"), (m == "no", -20, "source_stage_or_page_type_mismatch"), (n < 30, -20, "text_too_short"), (n > 900, -10, "text_too_long"),
    ]
    from pageknow.operators.rules import scored

    score, flags = scored(0, rules)
    x = x.withColumns({"__score": score, "__flags": flags})
    s = F.col("__score")
    decision = (F.when(F.array_contains("__flags", F.lit("source_context_only")), "reject").when(F.array_contains("__flags", F.lit("admission_noise")) | ((conf == "low") & ~kind.isin("action_url", "fee_amount")), F.when(s < 70, "reject").otherwise("review"))
                .when(s >= 70, "keep").when(s >= 45, "review").otherwise("reject"))
    return x.select(*evidence.columns, "text_char_count", "task_keyword_hit_count", "field_keyword_hit_count", "source_stage_match", F.array_join("__p", ";").alias("source_page_type"), F.when(value, "yes").otherwise("no").alias("normalized_value_present"),
                    F.array_join("__flags", "; ").alias("low_quality_flags"), clamp(s).alias("quality_score"), decision.alias("quality_decision"))
