"""Queries: question/answer pairs, evidence, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageknow.functions import lexicon as L
from pageknow.functions.text import found, lines
from pageknow.operators import evidence as E
from pageknow.operators import qa as Q
from pageknow.plans.common import documents, quoted, sql_contains, sql_found, sql_hits, sql_key, sql_lines, sql_squeeze, table
from pageknow.plans.retrieval import QA, _qa

#: Word lists drawn from the prose of the driver tables, in the roles of the domain lists.
STARTERS = ("the", "of", "and", "to", "un", "la", "der", "die")
CATEGORIES: L.Lexicon = {"visa": ("erth", "anti"), "offer_acceptance": ("ción", "que "), "housing": ("heit", "und "), "payment": ("eau", "ment"), "registration": ("the ",)}
TASKS = {
    "apply_student_visa": ("visa", ("erth", "anti", "onwh", "erst")),
    "pay_deposit": ("offer_acceptance", ("ción", "que ", "mente", "ado")),
    "apply_accommodation": ("housing", ("heit", "und ", "lich", "ung")),
    "pay_tuition": ("payment", ("eau", "ment", "elle", "ier")),
    "complete_registration": ("registration", ("the ", "that ", "tion", "ing ")),
}
DEADLINES, DOCUMENTS, ACTIONS = ("by ", "from ", "con "), ("license", "anwh", "erre", "pfsch"), ("with ", "avec ", "auf ", "para ")
FEE = r"(?:^|[^A-Za-z0-9_])((?:[0-9]{3}-)[0-9]{4})"
NOISE = ("worthless", "license", "token")
FIELD_WORDS: L.Lexicon = {"deadline": ("by ",), "required_document": ("anwh", "erre"), "action_instruction": ("with ", "avec "), "action_url": ("http://", "https://"), "fee_amount": ("-",)}
PAGE_TYPES: L.Lexicon = {"apply_student_visa": ("src1", "src2"), "pay_deposit": ("src3",), "apply_accommodation": ("src4", "src5"), "pay_tuition": ("src6",), "complete_registration": ("src7", "src8", "faq")}


def question_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    return x.where(Q.is_question(F.col("line"), STARTERS, ("ción",), most=120)).select("doc_id", "pos", F.md5(Q.strip_prefix(F.col("line"))).alias("question_md5"))


def faq_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    pairs = Q.extract_pairs(d, "doc_id", starters=STARTERS, starters_zh=("ción",), most=120).join(d.select("doc_id", "source"), "doc_id")
    return Q.first_of_key(pairs, "source", ["doc_id", "pos"]).select("doc_id", "pos", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"), F.length("answer").alias("n_chars"))


def faq_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of the documents of four sources that count as FAQ pages, by their language."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")).alias("source"), F.when(F.col("lang") == "en", "faq").otherwise("page").alias("page_type"), F.lit("").alias("stage"), F.lit("").alias("source_url"), F.concat(F.lit("https://f.example/"), "doc_id").alias("final_url"), "text")
    got = Q.faq_items(d, "doc_id", "source", owners=["src1", "SRC2", "src3", "src4"], lexicon={k: (*v, *L.CATEGORIES[k]) for k, v in CATEGORIES.items()}, starters=STARTERS, starters_zh=("ción",), most=120)
    return got.select("doc_id", "pos", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"), "source", "stage", "category", "source_url")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _qa(spark, sf_dir).withColumns({"owner": (F.col("conv_id") % 5).cast("string"), "source_url": F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("https://c.example/"), F.col("conv_id").cast("string"))).otherwise("")})
    p = p.withColumn("question", F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("Q1: "), "question", F.lit("?"))).otherwise(F.col("question")))
    return Q.score_pairs(p, "owner", ["conv_id", "turn"])


def qa_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select("conv_id", "turn", F.md5("cleaned_question").alias("q_md5"), F.md5("cleaned_answer").alias("a_md5"), "quality_score", "decision", "quality_notes")


def qa_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).groupBy("owner", "decision").agg(F.count(F.lit(1)).alias("n"), F.min("quality_score").alias("least"), F.max("quality_score").alias("most"))


def keyword_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    c = Q.category(F.substring_index("text", "\n", 1), F.col("text"), {k: (*v, *L.CATEGORIES[k]) for k, v in CATEGORIES.items()})
    x = d.select("doc_id", "text", c.alias("category"))
    return x.select("doc_id", "category", Q.risk_level(F.lit(""), F.col("text"), F.col("category"), ("worthless", "deadline"), ("visa",), ("housing", "payment")).alias("risk_level"))


def argmax_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = E.task_of(F.lit(""), F.col("text"), F.when(F.col("lang") == "en", "registration").when(F.col("lang") == "fr", "payment").otherwise(""), TASKS, ("license", ("that",)))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", "t.task_code", "t.stage", "t.confidence")


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(E.sentences(F.col("text"))).alias("pos", "sentence"))
    return x.select("doc_id", "pos", F.md5("sentence").alias("sentence_md5"))


def pattern_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._]+@[A-Za-z0-9.]+"), 0))
    return documents(spark, sf_dir).select("doc_id", F.array_join(E.urls(F.col("text")), " ").alias("urls"), F.array_join(E.fees(F.col("text"), FEE), " ").alias("numbers"), F.array_join(mail, " ").alias("mails"))


def sentence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(E.sentences(F.col("text"))).alias("pos", "s")).withColumn("low", F.lower("s"))
    flags = {"deadline": DEADLINES, "document": DOCUMENTS, "action": ACTIONS}
    x = x.select("doc_id", "pos", *[(F.size(found(F.col("low"), w)) > 0).alias(k) for k, w in flags.items()], F.md5(E.document_hint(F.col("s"), DOCUMENTS)).alias("hint_md5"))
    return x.where("deadline OR document OR action")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    cat = F.when(F.col("lang") == "en", "registration").when(F.col("lang") == "fr", "payment").otherwise("")
    return d.select("doc_id", F.col("source").alias("owner"), F.substring_index("text", "\n", 1).alias("question"), F.col("text").alias("answer"), cat.alias("category"), F.concat(F.lit("https://docs.example/"), F.col("source")).alias("source_url"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.extract(_pairs(spark, sf_dir), "owner", ["doc_id"], 8, TASKS, ("license", ("that",)), deadline=DEADLINES, document=DOCUMENTS, action=ACTIONS, fee=FEE)


def evidence_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("doc_id", "evidence_id", "task_code", "stage", "evidence_type", F.md5("normalized_value").alias("value_md5"), "confidence", "candidate")


def source_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), F.concat(F.lit("u"), (F.col("event_id") % 7).cast("string")).alias("url"), "event_type", F.date_format("ts", "yyyy-MM").alias("month"))
    c = E.source_catalog(e, "user", "url", "event_type", "month")
    return c.select("owner", "url", F.array_join("page_types", ";").alias("page_types"), F.array_join("stages", ";").alias("stages"))


def evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = table(spark, sf_dir, "documents").where("lang <> 'fr'").select("source", F.concat(F.lit("https://docs.example/"), F.col("source")).alias("url"), F.when(F.col("lang") == "de", "faq").otherwise(F.col("source")).alias("page_type"), F.when(F.col("lang") == "es", "offer_acceptance").otherwise("general").alias("stage"))
    words = {k: w for k, (_, w) in TASKS.items()}
    a = E.audit(_evidence(spark, sf_dir), E.source_catalog(reg, "source", "url", "page_type", "stage"), "owner", words, FIELD_WORDS, NOISE, PAGE_TYPES)
    return a.select("doc_id", "evidence_id", "task_keyword_hit_count", "field_keyword_hit_count", "source_stage_match", "source_page_type", "low_quality_flags", "quality_score", "quality_decision")


QUERIES = {f.__name__: f for f in (question_lines, faq_extract, faq_items, qa_quality, qa_quality_counts, keyword_category, argmax_label, sentence_split, pattern_extract, sentence_flags, evidence_extract, source_catalog, evidence_audit)}


def _prefix(x: str) -> str:
    a = f"regexp_replace({x}, '(?i)^\\s*(q|question|問|问)\\s*[:：.)-]\\s*', '')"
    return sql_squeeze(f"regexp_replace({a}, '^\\s*[0-9]{{1,2}}[.)]\\s*', '')")


_S = "|".join(STARTERS)
ISQ = f"""(length(s) BETWEEN 5 AND 120 AND (regexp_matches(lower(s), '^(q|question|問|问)\\s*[:：.)-]') OR ends_with(s, '?') OR ends_with(s, '？')
  OR (NOT starts_with(lower(s), 'if ') AND (regexp_matches(lower(s), '^({_S}) ') OR starts_with(s, 'ción') OR regexp_matches(lower(s), '^[0-9]{{1,2}}[.)]\\s+({_S}) ')))))"""
LINES = f"x AS (SELECT doc_id, source, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, source, {sql_lines('text')} AS l FROM documents)), y AS (SELECT *, {_prefix('line')} AS s FROM x), z AS (SELECT *, {ISQ} AS q FROM y)"
NAV = f"(lower(line) IN ({quoted(L.NAVIGATION_LINES)}) OR lower({sql_squeeze('line')}) IN ({quoted(L.SECTION_HEADINGS)}) OR length(line) <= 2)"
CQ = sql_squeeze("question")
CQ = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({CQ}, '(?i)^(q|question|問|问)\\s*[0-9]{{0,3}}\\s*[:：.)-]\\s*', ''), '^[A-Z][0-9]{{1,2}}[.)]\\s*', ''), '^[0-9]{{1,2}}[.)]\\s*', ''), '(?i)\\s*\\(https?://[^)]+\\)\\s*$', ''))"
CA = f"trim(regexp_replace({sql_squeeze('answer')}, '(?i)\\s+(Back to top|Previous|Next)\\s*$', ''))"
_RULES = (
    ("length(q) < 10", 45, "question_too_short"), ("length(q) > 220", 20, "question_very_long"), ("length(a) < 45", 40, "answer_too_short"), ("length(a) BETWEEN 45 AND 79", 15, "answer_short"), ("length(a) > 1400", 5, "answer_long"),
    (f"NOT (ends_with(q, '?') OR ends_with(q, '？') OR regexp_matches(lower(q), '^({'|'.join(L.MORE_QUESTION_STARTERS)}) ') OR regexp_matches(q, '^({'|'.join(L.QUESTION_STARTERS_ZH)})'))", 35, "question_shape_suspicious"),
    (f"CASE WHEN regexp_matches(lower(q), '^({'|'.join(L.FRAGMENT_STARTERS)})') THEN NOT (ends_with(q, '?') OR ends_with(q, '？')) ELSE regexp_matches(q, '({'|'.join(L.FRAGMENT_ENDS)})$') END", 45, "question_fragment"),
    (f"{sql_contains('lower(q)', L.TEMPLATE_NOISE)} OR {sql_contains('lower(a)', L.TEMPLATE_NOISE)}", 55, "template_or_navigation_noise"),
    (f"lower(trim(a)) IN ({quoted(L.NAVIGATION_TERMS)}) OR (len(regexp_extract_all(lower(trim(a)), '[a-z]+')) <= 12 AND len(list_filter(regexp_extract_all(lower(trim(a)), '[a-z]+'), lambda w: w IN ({quoted(L.NAVIGATION_TERMS)}))) >= 3)", 60, "answer_looks_like_navigation"),
    (f"trim(lower(q), ' ?') IN ({quoted(L.BROAD_QUESTIONS)})", 60, "broad_navigation_question"), ("NOT starts_with(source_url, 'http')", 10, "missing_source_url"),
)
REPORT = f"""{QA}, p AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'Q1: ' || question || '?' ELSE question END AS question, answer, CAST(conv_id % 5 AS VARCHAR) AS owner, CASE WHEN conv_id % 3 > 0 THEN 'https://c.example/' || conv_id ELSE '' END AS source_url FROM qa),
  c AS (SELECT *, {CQ} AS q, {CA} AS a FROM p),
  r AS (SELECT *, 100 {' '.join(f'- CASE WHEN {c} THEN {d} ELSE 0 END' for c, d, _ in _RULES)} AS raw, list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for c, _, n in _RULES)}], lambda x: x IS NOT NULL) AS notes, row_number() OVER (PARTITION BY owner, {sql_key('q')} ORDER BY conv_id, turn) > 1 AS again FROM c),
  k AS (SELECT *, CASE WHEN again THEN least(greatest(0, least(100, raw)), 40) ELSE greatest(0, least(100, raw)) END AS score FROM r),
  rep AS (SELECT *, CASE WHEN again OR raw < 50 OR list_has_any(notes, ['template_or_navigation_noise', 'question_fragment', 'broad_navigation_question']) THEN 'reject' WHEN score < 65 THEN 'review' ELSE 'keep' END AS decision FROM k)"""
SENT = f"list_transform(list_filter(string_split(regexp_replace({sql_squeeze('text')}, '([.!?]) ([A-Z0-9\"“])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: length(trim(s)) >= 12), lambda s: trim(s, ' ;'))"


def _task(text: str, cat: str) -> str:
    """max of (score, code) as a struct; label ''. The text is lower-cased by the caller."""
    parts = ", ".join(f"{{'s': {sql_hits(text, w)} + CASE WHEN {cat} = '{s}' THEN 2 ELSE 0 END, 'c': '{c}'}}" for c, (s, w) in TASKS.items())
    return f"CASE WHEN contains({text}, 'license') AND NOT contains({text}, 'that') THEN {{'s': 0, 'c': ''}} ELSE list_sort([{parts}])[-1] END"


STAGE = "CASE t.c " + " ".join(f"WHEN '{c}' THEN '{s}'" for c, (s, _) in TASKS.items()) + " ELSE '' END"
CATCASE = "CASE lang WHEN 'en' THEN 'registration' WHEN 'fr' THEN 'payment' ELSE '' END"
LEVEL = "CASE WHEN t.s >= 4 THEN 3 WHEN t.s >= 2 THEN 2 ELSE 1 END"
_HINT = f"coalesce(nullif(array_to_string({sql_found('lower(s)', DOCUMENTS)}, '; '), ''), s)"
EVIDENCE = f"""
  ep AS (SELECT doc_id, source AS owner, split_part(text, chr(10), 1) AS question, text, {CATCASE} AS category, 'https://docs.example/' || source AS source_url FROM documents),
  et AS (SELECT *, {_task("lower(question || ' ' || text)", 'category')} AS t FROM ep),
  eu AS (SELECT * FROM et WHERE t.s > 0),
  el AS (SELECT *, list_concat(
      list_transform(list_distinct_ordered, lambda u: {{'k': 'action_url', 'x': u, 'v': u, 'f': 3}}),
      list_transform(regexp_extract_all(text, '{FEE}', 1), lambda u: {{'k': 'fee_amount', 'x': u, 'v': replace(u, ',', ''), 'f': 2}}),
      flatten(list_transform({SENT}, lambda s: list_filter([
        CASE WHEN {sql_contains('lower(s)', DEADLINES)} THEN {{'k': 'deadline', 'x': s, 'v': s, 'f': 2}} END,
        CASE WHEN {sql_contains('lower(s)', DOCUMENTS)} THEN {{'k': 'required_document', 'x': s, 'v': {_HINT}, 'f': 2}} END,
        CASE WHEN {sql_contains('lower(s)', ACTIONS)} AND NOT (t.c = 'pay_tuition' AND contains(lower(s), 'application fee')) THEN {{'k': 'action_instruction', 'x': s, 'v': s, 'f': 2}} END], lambda z: z IS NOT NULL)))) AS l
    FROM (SELECT *, list_transform(regexp_extract_all(text, '(?i)https?://[^\\s),;]+'), lambda u: regexp_replace(u, '[.]+$', '')) AS list_distinct_ordered FROM eu)),
  em AS (SELECT *, CASE WHEN len(l) = 0 AND text <> '' THEN [{{'k': 'source_context', 'x': 'Q: ' || question || ' A: ' || left(text, 500), 'v': '', 'f': 1}}] ELSE l END AS m FROM el),
  ex AS (SELECT doc_id, owner, question, source_url, t, unnest(range(0, len(m))) AS n, unnest(m) AS c FROM em),
  ef AS (SELECT *, {sql_key('c.x')} AS key, t.c AS tc, md5(c.k || chr(1) || c.v || chr(1) || {sql_key('c.x')}) AS h, row_number() OVER (PARTITION BY owner, t.c ORDER BY doc_id, n) AS i FROM ex),
  wk AS (
    SELECT owner, tc, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS BIGINT) AS d, CAST(0 AS BIGINT) AS k, false AS taken FROM ef GROUP BY ALL
    UNION ALL
    SELECT owner, tc, i, CASE WHEN ok THEN list_append(seen, h) ELSE seen END, doc_id, CASE WHEN ok THEN k + 1 ELSE k END, ok FROM (
      SELECT *, k < 8 AND NOT list_contains(seen, h) AS ok FROM (
        SELECT wk.owner, wk.tc, ef.i, wk.seen, ef.doc_id, ef.h, CASE WHEN wk.d = ef.doc_id THEN wk.k ELSE 0 END AS k FROM wk JOIN ef ON ef.owner IS NOT DISTINCT FROM wk.owner AND ef.tc = wk.tc AND ef.i = wk.i + 1))
  ),
  ek AS (SELECT ef.* FROM ef JOIN wk ON ef.owner IS NOT DISTINCT FROM wk.owner AND ef.tc = wk.tc AND ef.i = wk.i WHERE taken),
  ev AS (SELECT doc_id, owner, lower(owner) || '__' || t.c || '__' || c.k || '__' || left(sha1(c.v || '|' || key), 12) AS evidence_id, t.c AS task_code, {STAGE} AS stage, c.k AS evidence_type, c.x AS evidence_text, c.v AS normalized_value, question AS source_question, source_url, ['low', 'medium', 'high'][least({LEVEL}, c.f)] AS confidence, n AS candidate FROM ek)"""
_TH = "CASE task_code " + " ".join(f"WHEN '{c}' THEN {sql_hits('tx', w)}" for c, (_, w) in TASKS.items()) + " ELSE 0 END"
_FH = "CASE evidence_type " + " ".join(f"WHEN '{c}' THEN {sql_hits('tx', w)}" for c, w in FIELD_WORDS.items()) + " ELSE 0 END"
_PT = "CASE task_code " + " ".join(f"WHEN '{c}' THEN [{quoted(w)}]" for c, w in PAGE_TYPES.items()) + " ELSE [] END"
_AF = (
    (f"{sql_contains('tx', NOISE)}", 10, "admission_noise"), ("regexp_matches(tx, '(^|[^a-z0-9_])(home|menu|search|share|cookie|subscribe)([^a-z0-9_]|$)') AND length(tx) > 500", 10, "navigation_noise"), ("evidence_type = 'source_context'", 50, "source_context_only"),
    ("th = 0 AND evidence_type NOT IN ('action_url', 'fee_amount')", 25, "task_keyword_mismatch"), (f"fh = 0 AND evidence_type IN ({quoted(FIELD_WORDS)})", 10, "field_keyword_weak"), ("mt = 'no'", 20, "source_stage_or_page_type_mismatch"),
    ("length(evidence_text) < 30", 20, "text_too_short"), ("length(evidence_text) > 900", 10, "text_too_long"),
)

ORACLES = {
    "question_lines": f"WITH {LINES} SELECT doc_id, CAST(pos AS INT) AS pos, md5(s) AS question_md5 FROM z WHERE q",
    "faq_extract": f"""WITH {LINES}, g AS (SELECT *, sum(CAST(q AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS grp, NOT q AND NOT {NAV} AS u FROM z),
        h AS (SELECT *, coalesce(sum(CAST(u AS INT)) OVER w, 0) AS n, coalesce(sum(CASE WHEN u THEN length(line) + 1 ELSE 0 END) OVER w, 0) - 1 AS ch FROM g WHERE grp > 0 WINDOW w AS (PARTITION BY doc_id, grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        b AS (SELECT doc_id, any_value(source) AS source, min(pos) FILTER (q) AS pos, min(s) FILTER (q) AS question, string_agg(line, ' ' ORDER BY pos) FILTER (u AND n < 14 AND ch < 1400) AS a FROM h GROUP BY doc_id, grp),
        c AS (SELECT doc_id, source, pos, question, left({sql_squeeze("coalesce(a, '')")}, 1600) AS answer FROM b),
        d AS (SELECT * FROM c WHERE length(answer) >= 30 AND length(question) >= 5 QUALIFY row_number() OVER (PARTITION BY source, {sql_key('question')} ORDER BY doc_id, pos) = 1)
        SELECT doc_id, CAST(pos AS INT) AS pos, md5(question) AS question_md5, md5(answer) AS answer_md5, CAST(length(answer) AS INT) AS n_chars FROM d""",
    "faq_items": f"""WITH {LINES.replace("source, unnest(range", "CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS source, unnest(range").replace("AS l FROM documents)", "AS l FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3', 'src4'))")}, g AS (SELECT *, sum(CAST(q AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS grp, NOT q AND NOT {NAV} AS u FROM z),
        h AS (SELECT *, coalesce(sum(CAST(u AS INT)) OVER w, 0) AS n, coalesce(sum(CASE WHEN u THEN length(line) + 1 ELSE 0 END) OVER w, 0) - 1 AS ch FROM g WHERE grp > 0 WINDOW w AS (PARTITION BY doc_id, grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        b AS (SELECT doc_id, any_value(source) AS source, min(pos) FILTER (q) AS pos, min(s) FILTER (q) AS question, string_agg(line, ' ' ORDER BY pos) FILTER (u AND n < 14 AND ch < 1400) AS a FROM h GROUP BY doc_id, grp),
        c AS (SELECT doc_id, source, pos, question, left({sql_squeeze("coalesce(a, '')")}, 1600) AS answer FROM b),
        d AS (SELECT *, lower(question || ' ' || answer) AS t FROM c WHERE length(answer) >= 30 AND length(question) >= 5 QUALIFY row_number() OVER (PARTITION BY lower(source), {sql_key('question')} ORDER BY doc_id, pos) = 1)
        SELECT doc_id, CAST(pos AS INT) AS pos, md5(question) AS question_md5, md5(answer) AS answer_md5, source, 'faq' AS stage, CASE {' '.join(f"WHEN {sql_contains('t', (*v, *L.CATEGORIES[k]))} THEN '{k}'" for k, v in CATEGORIES.items())} ELSE 'faq' END AS category, 'https://f.example/' || doc_id AS source_url FROM d""",
    "qa_quality": f"WITH {REPORT} SELECT conv_id, turn, md5(q) AS q_md5, md5(a) AS a_md5, CAST(score AS INT) AS quality_score, decision, array_to_string(CASE WHEN again THEN list_append(notes, 'duplicate_question_for_school') ELSE notes END, '; ') AS quality_notes FROM rep",
    "qa_quality_counts": f"WITH {REPORT} SELECT owner, decision, count(*) AS n, CAST(min(score) AS INT) AS least, CAST(max(score) AS INT) AS most FROM rep GROUP BY ALL",
    "keyword_category": f"""WITH x AS (SELECT doc_id, lower(split_part(text, chr(10), 1) || ' ' || text) AS t, lower(' ' || text) AS u FROM documents), c AS (SELECT doc_id, u, CASE {' '.join(f"WHEN {sql_contains('t', (*v, *L.CATEGORIES[k]))} THEN '{k}'" for k, v in CATEGORIES.items())} ELSE 'general' END AS category FROM x)
        SELECT doc_id, category, CASE WHEN category = 'visa' OR {sql_contains('u', ('worthless', 'deadline'))} THEN 'high' WHEN category IN ('housing', 'payment') THEN 'medium' ELSE 'low' END AS risk_level FROM c""",
    "argmax_label": f"""WITH x AS (SELECT doc_id, {_task("lower(' ' || text)", CATCASE)} AS t FROM documents)
        SELECT doc_id, CASE WHEN t.s = 0 THEN '' ELSE t.c END AS task_code, CASE WHEN t.s = 0 THEN '' ELSE {STAGE} END AS stage, CASE WHEN t.s >= 4 THEN 'high' WHEN t.s >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM x""",
    "sentence_split": f"SELECT doc_id, CAST(unnest(range(0, len(l))) AS INT) AS pos, md5(unnest(l)) AS sentence_md5 FROM (SELECT doc_id, {SENT} AS l FROM documents)",
    "pattern_extract": f"""WITH d AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '(?i)https?://[^\\s),;]+'), lambda u: regexp_replace(u, '[.]+$', '')) AS u, regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') AS m FROM documents)
        SELECT doc_id, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ' ') AS urls, array_to_string(regexp_extract_all(text, '{FEE}', 1), ' ') AS numbers, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ' ') AS mails FROM d""",
    "sentence_flags": f"""WITH x AS (SELECT doc_id, CAST(unnest(range(0, len(l))) AS INT) AS pos, unnest(l) AS s FROM (SELECT doc_id, {SENT} AS l FROM documents)),
        f AS (SELECT doc_id, pos, {sql_contains('lower(s)', DEADLINES)} AS deadline, {sql_contains('lower(s)', DOCUMENTS)} AS document, {sql_contains('lower(s)', ACTIONS)} AS action, md5({_HINT}) AS hint_md5 FROM x) SELECT * FROM f WHERE deadline OR document OR action""",
    "evidence_extract": f"WITH RECURSIVE {EVIDENCE} SELECT doc_id, evidence_id, task_code, stage, evidence_type, md5(normalized_value) AS value_md5, confidence, CAST(candidate AS INT) AS candidate FROM ev",
    "source_catalog": "SELECT CAST(user_id AS VARCHAR) AS owner, 'u' || (event_id % 7) AS url, array_to_string(list_sort(list(DISTINCT event_type)), ';') AS page_types, array_to_string(list_sort(list(DISTINCT strftime(ts, '%Y-%m'))), ';') AS stages FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2",
    "evidence_audit": f"""WITH RECURSIVE {EVIDENCE},
        cat AS (SELECT lower(source) AS o, 'https://docs.example/' || source AS url, list_sort(list(DISTINCT CASE WHEN lang = 'de' THEN 'faq' ELSE source END)) AS p, list_sort(list(DISTINCT CASE WHEN lang = 'es' THEN 'offer_acceptance' ELSE 'general' END)) AS st FROM documents WHERE lang <> 'fr' GROUP BY ALL),
        a AS (SELECT ev.*, coalesce(p, []) AS p, coalesce(st, []) AS st, lower(evidence_text || ' ' || normalized_value || ' ' || source_question) AS tx FROM ev LEFT JOIN cat ON lower(ev.owner) = cat.o AND ev.source_url = cat.url),
        b AS (SELECT *, {_TH} AS th, {_FH} AS fh, CASE WHEN list_has_any(p, {_PT}) OR (stage <> '' AND list_contains(st, stage)) THEN 'yes' WHEN list_contains(p, 'faq') OR (len(p) = 0 AND len(st) = 0) THEN 'partial' ELSE 'no' END AS mt FROM a),
        f AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for c, _, n in _AF)}], lambda x: x IS NOT NULL) AS flags,
          CASE confidence WHEN 'high' THEN 30 WHEN 'medium' THEN 20 ELSE -30 END + CASE WHEN th > 0 THEN 25 ELSE 0 END + CASE WHEN fh > 0 THEN 15 ELSE 0 END + CASE mt WHEN 'yes' THEN 15 WHEN 'partial' THEN 5 ELSE 0 END + 10 + CASE WHEN trim(normalized_value) <> '' THEN 5 ELSE 0 END
          {' '.join(f'- CASE WHEN {c} THEN {d} ELSE 0 END' for c, d, _ in _AF)} AS sc FROM b)
        SELECT doc_id, evidence_id, th AS task_keyword_hit_count, fh AS field_keyword_hit_count, mt AS source_stage_match, array_to_string(p, ';') AS source_page_type, array_to_string(flags, '; ') AS low_quality_flags, greatest(0, least(100, sc)) AS quality_score,
          CASE WHEN list_contains(flags, 'source_context_only') THEN 'reject' WHEN list_contains(flags, 'admission_noise') OR (confidence = 'low' AND evidence_type NOT IN ('action_url', 'fee_amount')) THEN CASE WHEN sc < 70 THEN 'reject' ELSE 'review' END WHEN sc >= 70 THEN 'keep' WHEN sc >= 45 THEN 'review' ELSE 'reject' END AS quality_decision FROM f""",
}
