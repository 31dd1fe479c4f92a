"""Tasks for users: seeds, eligibility, scores, personal states, ranked plans, risks — for all users at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageknow.functions.text import text_or_empty, to_int

RISK_BASE = {"high": 50.0, "medium": 30.0, "low": 15.0}
LEVELS = ("high", "medium", "low")
MAX_TEMPLATES = 1_000


@dataclass(frozen=True)
class Template:
    code: str
    stage: str
    name: str
    risk: str
    done_by: tuple[str, ...]
    url_keys: tuple[str, ...] = ()
    description: str = ""
    trigger_condition: str = ""
    deadline: str = ""
    required_documents: str = ""


def template_table(like: DataFrame, templates: list[Template]) -> DataFrame:
    """Templates as a table with their position; a small list by nature, its length is checked because it is broadcast."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    rows = [(i, t.code, t.stage, t.name, t.risk, list(t.done_by), list(t.url_keys), t.description, t.trigger_condition, t.deadline, t.required_documents) for i, t in enumerate(templates)]
    kinds = "template_pos int, task_code string, stage string, task_name string, risk_level string, done_by array<string>, url_keys array<string>"
    return like.sparkSession.createDataFrame(rows, f"{kinds}, description string, trigger_condition string, deadline string, required_documents string")


def seed_tasks(entities: DataFrame, key: str, templates: list[Template], urls: str | None = None) -> DataFrame:
    """One task per entity and template, with id ``entity-code`` and the first url that the entity's map has for the template."""
    t = F.broadcast(template_table(entities, templates))
    out = entities.crossJoin(t).withColumn("task_id", F.concat_ws("-", F.lower(F.col(key).cast("string")), "task_code"))
    if urls is None:
        return out
    have = F.filter(F.transform("url_keys", lambda k: F.element_at(F.col(urls), k)), lambda u: text_or_empty(u) != "")
    return out.withColumn("action_url", F.coalesce(F.get(have, F.lit(0)), F.lit("")))


def eligible(tasks: DataFrame, flags: str = "completed_flags", conditional: str = "submit_conditions", tri: str = "has_conditional_offer", unknown: bool = True) -> DataFrame:
    """Tasks none of whose completion flags is set; the conditional task by the tri-state, ``unknown`` deciding for null."""
    open_ = ~F.arrays_overlap(F.coalesce(flags, F.array().cast("array<string>")), F.col("done_by"))
    wanted = F.when(F.col("task_code") == conditional, F.coalesce(F.col(tri), F.lit(unknown))).otherwise(True)
    return tasks.where(open_ & wanted)


def priority(stage_order: dict[str, int], asked_stage: str = "asked_stage", boosts: list[tuple[Column, float, str]] | None = None) -> tuple[Column, Column]:
    """(score, reasons): risk base, earlier stages first, +35 for the stage asked about, then the boosts that hold."""
    level = F.coalesce(*[F.when(F.col("risk_level") == k, F.lit(v)) for k, v in RISK_BASE.items()], F.lit(20.0))
    order = F.coalesce(*[F.when(F.col("stage") == k, F.lit(v)) for k, v in stage_order.items()], F.lit(99))
    asked = F.col(asked_stage) == F.col("stage")
    rules = [(F.col("risk_level") == "high", 0.0, "high_risk"), (asked, 35.0, "asked_about"), *(boosts or [])]
    score = level + F.greatest(F.lit(0.0), 25.0 - order / 4)
    for c, d, _ in rules:
        score = score + F.when(c, d).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, _, n in rules]))
    return F.round(score, 2), F.when(F.size(reasons) == 0, F.array(F.lit("usual_order"))).otherwise(reasons)


def overlay(tasks: DataFrame, states: DataFrame, user: str) -> DataFrame:
    """Personal states on tasks, by task_id else by code; done and skipped tasks go, a deadline adds 8 to the score.
    ``states``: (user, key, status, deadline_at, and any of the zone, reminder and note columns), one row per user and key;
    each comes as ``user_`` column."""
    fields = [c for c in ("status", "deadline_at", "deadline_timezone", "reminder_at", "reminder_timezone", "reminder_status", "notes") if c in states.columns]
    by = lambda n: states.select(F.col(user), F.col("key").alias(f"__k{n}"), F.struct(*fields).alias(f"__s{n}"))
    j = tasks.join(by(1).withColumnRenamed(user, "__u1"), (F.col(user) == F.col("__u1")) & (F.col("task_id") == F.col("__k1")), "left")
    j = j.join(by(2).withColumnRenamed(user, "__u2"), (F.col(user) == F.col("__u2")) & (F.col("task_code") == F.col("__k2")), "left")
    j = j.withColumn("__s", F.coalesce("__s1", "__s2")).where(~F.coalesce(F.col("__s.status").isin("done", "skipped"), F.lit(False)))
    late = text_or_empty(F.col("__s.deadline_at")) != ""
    return j.withColumns({**{f"user_{c}": text_or_empty(F.col(f"__s.{c}")) for c in fields}, "priority_score": F.round(F.col("priority_score") + F.when(late, 8.0).otherwise(0.0), 2)}).drop("__s", "__s1", "__s2", "__k1", "__k2", "__u1", "__u2")


def top_plan(tasks: DataFrame, user: str, stage_order: dict[str, int], n: int = 6) -> DataFrame:
    """The n best tasks of each user: score, then stage, then place in the template list."""
    order = F.coalesce(*[F.when(F.col("stage") == k, F.lit(v)) for k, v in stage_order.items()], F.lit(99))
    w = W.partitionBy(user).orderBy(F.col("priority_score").desc(), order, "template_pos")
    return tasks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def note_counts(reason: Column, found: Column, usable: Column, review: Column, rejected: Column, status: Column) -> Column:
    """The reasons with what the evidence of a table task is worth."""
    more = F.when((review > 0) | (rejected > 0), F.format_string("audit: %d usable, %d open, %d rejected", usable, review, rejected)).when(status != "", F.concat(F.lit("status: "), status))
    return F.concat_ws("；", reason, F.when(found > 0, F.format_string("%d pieces of evidence", found)), more)


def plan_rows(tasks: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows of a task table as rows of a plan: counts as integers (0 if they are none; the usable ones default to all found),
    the reason with what the evidence is worth, the first of the official urls where the task has none, and as source the
    task's own, else that url. Missing columns count as empty."""
    have = lambda c: text_or_empty(F.col(c).cast("string")) if c in tasks.columns else F.lit("")
    count = lambda c, d: F.when(F.trim(have(c)) == "", d).otherwise(to_int(have(c)))
    out = tasks.withColumn("evidence_count", count("evidence_count", F.lit(0)))
    n = F.col("evidence_count")
    out = out.withColumns({f"{k}_evidence_count": count(f"{k}_evidence_count", n if k in ("candidate", "usable") else F.lit(0)) for k in ("candidate", "usable", "review", "rejected")})
    url = F.coalesce(F.nullif(have("action_url"), F.lit("")), F.trim(F.element_at(F.split(have("official_action_urls"), "[|]"), 1)))
    out = out.withColumns({"action_url": url, "risk_level": F.coalesce(F.nullif(have("risk_level"), F.lit("")), F.lit("medium")), reason: note_counts(F.col(reason), n, F.col("usable_evidence_count"), F.col("review_evidence_count"), F.col("rejected_evidence_count"), have("enrichment_status"))})
    return out.withColumn("source_url", F.coalesce(F.nullif(have("source_url"), F.lit("")), F.col("action_url")))


def first_source(tasks: DataFrame, evidence: DataFrame, user: str) -> DataFrame:
    """(user, sources map stage -> url): of each stage the first url, tasks before evidence. Both: (user, stage, url, ord)."""
    every = tasks.select(user, "stage", "url", F.struct(F.lit(0), F.col("ord").cast("long")).alias("o")).unionAll(evidence.select(user, "stage", "url", F.struct(F.lit(1), F.col("ord").cast("long")).alias("o")))
    one = every.groupBy(user, "stage").agg(F.min_by("url", "o").alias("url"))
    return one.groupBy(user).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "url")))).alias("sources"))


def risks(profiles: DataFrame, user: str, flags: str = "completed_flags", sources: str | None = None) -> DataFrame:
    """(user, rule_no, level, risk, stage, source_url), most serious first in rank. ``profiles``: flags, has_conditional_offer,
    origin, asked_stage, n_evidence."""
    done = lambda f: F.array_contains(F.coalesce(flags, F.array().cast("array<string>")), F.lit(f))
    rules = [
        (~done("accepted_offer"), "high", "offer_not_accepted", F.lit("offer_acceptance")), (~done("paid_deposit"), "high", "deposit_not_confirmed", F.lit("offer_acceptance")),
        (F.coalesce(F.col("has_conditional_offer"), F.lit(False)) & ~done("conditions_cleared"), "high", "conditions_open", F.lit("offer_acceptance")),
        (F.lower(text_or_empty(F.col("origin"))).startswith("mainland") & ~done("visa_submitted") & ~done("visa_approved"), "high", "visa_not_submitted", F.lit("visa")),
        (done("visa_submitted") & ~done("visa_approved"), "medium", "visa_not_approved", F.lit("visa")), (~done("registered"), "medium", "not_registered", F.lit("registration")),
        ((text_or_empty(F.col("asked_stage")) != "") & (F.coalesce(F.col("n_evidence"), F.lit(0)) == 0), "medium", "no_evidence_found", text_or_empty(F.col("asked_stage"))),
    ]
    hit = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(LEVELS.index(v)).alias("l"), F.lit(i).alias("rule_no"), F.lit(v).alias("level"), F.lit(n).alias("risk"), s.alias("stage"))) for i, (c, v, n, s) in enumerate(rules, 1)]))
    x = profiles.select(user, *([sources] if sources else []), F.posexplode(F.array_sort(hit)).alias("rank", "r"))
    url = F.coalesce(F.element_at(F.col(sources), F.col("r.stage")), F.lit("")) if sources else F.lit("")
    return x.select(user, (F.col("rank") + 1).alias("rank"), "r.rule_no", "r.level", "r.risk", "r.stage", url.alias("source_url"))
