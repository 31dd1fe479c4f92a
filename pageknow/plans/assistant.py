"""Queries: profiles, plan rows, visible states, owners, citations and prompts over several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageknow.functions import lexicon as L
from pageknow.operators import intent as I
from pageknow.operators import planning as PL
from pageknow.operators import prompts as P
from pageknow.operators import retrieval as RT
from pageknow.operators import review as R
from pageknow.operators import state as S
from pageknow.plans import workflow as WF
from pageknow.plans.common import quoted, sql_squeeze, sql_terms, table

WORDS = tuple(L.QUERY_EXPANSIONS)


def query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in Chinese about each key of the fixed dictionary, as English search terms."""
    key = F.element_at(F.array(*[F.lit(k) for k in WORDS]), (F.col("conv_id") % len(WORDS) + 1).cast("int"))
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("请问 "), key, F.lit(" "), "role").alias("text"))
    return RT.expand_queries(q).select("conv_id", "turn", F.array_join("terms", " ").alias("terms"))


def profile_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    return I.latest_profile(e.select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


def profile_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "conversations").withColumn("school", I.entity(F.col("text"), WF.ALIASES, F.col("role")))
    p = I.build_profiles(m, given={"registered": F.col("role") == "user"}, positive=F.col("turn") % 5 == 0, negative=F.col("turn") % 5 == 1, patterns=WF.FLAGS, conditional=("anti", "erst"))
    return p.select("conv_id", "turn", "school", F.array_join("completed_flags", ";").alias("flags"), "has_conditional_offer")


def plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = WF._enriched(spark, sf_dir).withColumns({"reason": F.lit("usual_order"), "evidence_count": F.col("candidate_evidence_count").cast("string")})
    return PL.plan_rows(t).select("task_key", "reason", "action_url", "source_url", "risk_level", "evidence_count", "usable_evidence_count")


def visible_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.visible(WF._states(spark, sf_dir), statuses=["in_progress", "not_started"]).select("user_id", "task_id", "task_code", "status", "seq")


def owner_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    states = e.select("user_id", F.col("event_id").alias("seq"), F.when(F.col("value") > 90, F.col("event_type")).otherwise(" ").alias("owner"))
    return S.inferred_owner(states, "owner", profiles=table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("owner")))


def _sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    o, e = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    urls = F.concat(F.lit("https://t.example/"), "o_orderstatus", F.lit(" | https://p.example/"), F.left("o_orderpriority", F.lit(1)))
    return [o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("ord"), urls.alias("urls")), e.select("user_id", F.col("event_id").alias("ord"), F.concat(F.lit("https://e.example/"), "event_type").alias("urls"))]


def citations_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.all_citations(_sources(spark, sf_dir), "user_id", 6).select("user_id", F.array_join("urls", " ").alias("urls"))


def prompt_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    o, e = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    tasks = o.select(F.col("o_custkey").alias("user_id"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"), F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("line"))
    risks = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"), F.concat(F.lit("late: "), F.col("o_orderkey").cast("string")).alias("line"))
    ev = e.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("rank"), "event_type", F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("body"))
    p = P.assemble(c, ev, "user_id", "c_name", "rank", "event_type", "body", 10, 900, {"Tasks": (tasks, 8), "Risks": (risks, 8)})
    return p.select("user_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("n_chars"))


def review_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pending(WF._owned(spark, sf_dir), WF._decisions(spark, sf_dir), "task_key", owner="owner", only="building").select("task_key", "owner", "review_priority", "priority_rank")


QUERIES = {f.__name__: f for f in (query_words, profile_latest, profile_build, plan_rows, visible_states, owner_inferred, citations_all, prompt_tasks, review_owner)}

_DICT = ", ".join(f"('{k}', '{' '.join(v)}')" for k, v in L.QUERY_EXPANSIONS.items())
ORACLES = {
    "query_words": f"""WITH d(key, expansion) AS (VALUES {_DICT}), q AS (SELECT conv_id, turn, '请问 ' || [{quoted(WORDS)}][conv_id % {len(WORDS)} + 1] || ' ' || role AS text FROM conversations)
        SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_concat({sql_terms('q.text')}, coalesce((SELECT flatten(list({sql_terms('expansion')})) FROM d WHERE contains(lower(q.text), lower(d.key))), [])))), ' ') AS terms FROM q""",
    "profile_latest": "SELECT user_id, event_id, event_type, value FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "profile_build": f"""SELECT conv_id, turn, {WF._ENTITY} role END AS school, array_to_string(list_sort(list_distinct(list_concat(list_filter([{', '.join(WF._flag_case(k, ps) for k, ps in WF.FLAGS.items())}], lambda z: z IS NOT NULL), CASE WHEN role = 'user' THEN ['registered'] ELSE [] END))), ';') AS flags,
        CASE WHEN turn % 5 = 0 THEN true WHEN turn % 5 = 1 THEN false WHEN contains(t, 'anti') OR contains(t, 'erst') THEN true END AS has_conditional_offer FROM (SELECT *, lower({sql_squeeze('text')}) AS t FROM conversations)""",
    "plan_rows": f"""WITH {WF.ENRICHED}, u AS (SELECT *, trim(split_part(official_action_urls, '|', 1)) AS url, candidate_evidence_count AS c, usable_evidence_count AS k, review_evidence_count AS w, rejected_evidence_count AS x FROM en)
        SELECT task_key, concat_ws('；', 'usual_order', CASE WHEN c > 0 THEN c || ' pieces of evidence' END, CASE WHEN w > 0 OR x > 0 THEN 'audit: ' || k || ' usable, ' || w || ' open, ' || x || ' rejected' WHEN enrichment_status <> '' THEN 'status: ' || enrichment_status END) AS reason,
          url AS action_url, url AS source_url, 'medium' AS risk_level, CAST(c AS INT) AS evidence_count, CAST(k AS INT) AS usable_evidence_count FROM u""",
    "visible_states": f"WITH {WF.UPDATES} SELECT user_id, task_id, task_code, status, seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id, coalesce(nullif(task_id, ''), task_code) ORDER BY seq) AS r FROM st) WHERE r = 1 AND status IN ('in_progress', 'not_started')",
    "owner_inferred": """WITH f AS (SELECT user_id, arg_min(event_type, event_id) AS owner FROM events WHERE user_id IS NOT NULL AND value > 90 GROUP BY 1)
        SELECT * FROM f UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE trim(coalesce(c_mktsegment, '')) <> '' AND c_custkey NOT IN (SELECT user_id FROM f)""",
    "citations_all": """WITH u AS (SELECT o_custkey AS user_id, 0 AS t, o_orderkey AS ord, unnest([0, 1]) AS k, unnest(['https://t.example/' || o_orderstatus, 'https://p.example/' || left(o_orderpriority, 1)]) AS url FROM orders
          UNION ALL SELECT user_id, 1, event_id, 0, 'https://e.example/' || event_type FROM events WHERE user_id IS NOT NULL),
        m AS (SELECT user_id, url, row_number() OVER (PARTITION BY user_id ORDER BY t, ord, k) AS p FROM u WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, url ORDER BY t, ord, k) = 1)
        SELECT user_id, array_to_string(list(url ORDER BY p)[1:6], ' ') AS urls FROM m GROUP BY user_id""",
    "prompt_tasks": f"""WITH t AS (SELECT o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, o_orderkey || ' ' || o_orderpriority AS line FROM orders), k AS (SELECT o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, 'late: ' || o_orderkey AS line FROM orders WHERE o_orderstatus = 'F'),
        e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, event_type, event_id FROM events WHERE user_id IS NOT NULL),
        ta AS (SELECT user_id, string_agg('- ' || line, chr(10) ORDER BY r) AS x FROM t WHERE r <= 8 GROUP BY 1), ka AS (SELECT user_id, string_agg('- ' || line, chr(10) ORDER BY r) AS x FROM k WHERE r <= 8 GROUP BY 1),
        ea AS (SELECT user_id, string_agg('[' || r || '] (' || coalesce(event_type, '') || ') event ' || event_id, chr(10) ORDER BY r) AS x FROM e WHERE r <= 10 GROUP BY 1),
        p AS (SELECT c_custkey AS user_id, 'Question: ' || {sql_squeeze('c_name')} || chr(10) || 'Tasks:' || chr(10) || coalesce(ta.x, '(none)') || chr(10) || 'Risks:' || chr(10) || coalesce(ka.x, '(none)') || chr(10) || 'Evidence:' || chr(10) || coalesce(ea.x, '(none)') || chr(10) || 'Answer from the evidence only and cite it by number.' AS prompt
          FROM customer LEFT JOIN ta ON ta.user_id = c_custkey LEFT JOIN ka ON ka.user_id = c_custkey LEFT JOIN ea ON ea.user_id = c_custkey)
        SELECT user_id, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INT) AS n_chars FROM p""",
    "review_owner": f"WITH {WF.QUEUE}, {WF.DEC} SELECT task_key, owner, review_priority, CASE review_priority WHEN 'high' THEN 0 ELSE 1 END AS priority_rank FROM qu JOIN de USING (task_key) WHERE dec = '' AND owner = 'BUILDING'",
}
assert QUERIES.keys() == ORACLES.keys(), quoted(QUERIES.keys() ^ ORACLES.keys())
