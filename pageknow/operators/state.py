"""Personal task states: replay of an update log with two alternative keys, lookup, visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageknow.functions.text import text_or_empty

STATUSES = ("", "not_started", "in_progress", "waiting", "blocked", "done", "skipped")


def with_ids(log: DataFrame, status: str = "status") -> DataFrame:
    """Trimmed keys; rows without user or without both keys are left out; an unknown status raises when the row is read."""
    t = lambda c: F.trim(text_or_empty(F.col(c)))
    checked = F.when(text_or_empty(F.col(status)).isin(*STATUSES), text_or_empty(F.col(status))).otherwise(F.raise_error(F.concat(F.lit("invalid status: "), F.col(status))))
    out = log.withColumns({"task_id": t("task_id"), "task_code": t("task_code"), status: checked})
    return out.where((text_or_empty(F.col("user_id").cast("string")) != "") & ((F.col("task_id") != "") | (F.col("task_code") != "")))


def replay(log: DataFrame, user: str = "user_id", seq: str = "seq") -> DataFrame:
    """State table after all updates in order of ``seq``: an update removes every row of its user with the same task_id or the
    same task_code (those that are not empty). So a row survives if no later one shares either key."""
    def later(key: str) -> Column:
        nxt = F.lead(seq).over(W.partitionBy(user, key).orderBy(seq))
        return F.when(F.col(key) != "", nxt)

    x = log.withColumns({"__i": later("task_id"), "__c": later("task_code")})
    return x.where(F.col("__i").isNull() & F.col("__c").isNull()).drop("__i", "__c")


def upsert(state: DataFrame, batch: DataFrame, user: str = "user_id", seq: str = "seq") -> DataFrame:
    """State after one batch of updates: two anti-joins and a union."""
    new = replay(batch, user, seq)
    ids, codes = (batch.where(F.col(k) != "").select(user, k).distinct() for k in ("task_id", "task_code"))
    return state.join(ids, [user, "task_id"], "left_anti").join(codes, [user, "task_code"], "left_anti").select(*state.columns).unionByName(new.select(*state.columns))


def lookup(states: DataFrame, fields: list[str], user: str = "user_id", seq: str = "seq") -> DataFrame:
    """(user, key, fields): the last row of each task_id and the first of each task_code, the id before the code."""
    row = F.struct(*fields).alias("r")
    by_id = states.where("task_id <> ''").groupBy(user, F.col("task_id").alias("key")).agg(F.max_by(row, seq).alias("r")).withColumn("level", F.lit(0))
    by_code = states.where("task_code <> ''").groupBy(user, F.col("task_code").alias("key")).agg(F.min_by(row, seq).alias("r")).withColumn("level", F.lit(1))
    return by_id.unionByName(by_code).groupBy(user, "key").agg(F.min_by("r", "level").alias("r")).select(user, "key", "r.*")


def visible(states: DataFrame, completed: bool = False, statuses: list[str] | None = None, user: str = "user_id", seq: str = "seq", order: bool = False) -> DataFrame:
    """States that are shown: of each key (the task_id, else the code) the first; done and skipped ones on request only, and
    only the statuses asked for. ``order``: sorted by the deadline, else the reminder, those without either last."""
    key = F.coalesce(F.nullif(F.col("task_id"), F.lit("")), F.col("task_code"))
    rest = [c for c in states.columns if c != user]
    out = states.withColumn("__key", key).where(text_or_empty(F.col("__key")) != "").groupBy(user, "__key").agg(F.min_by(F.struct(*rest), seq).alias("__s"))
    out = out.select(user, "__s.*").select(*states.columns)
    out = out if completed else out.where(~F.col("status").isin("done", "skipped"))
    out = out.where(F.col("status").isin(statuses)) if statuses else out
    return out.orderBy(*shown_order()) if order else out


def shown_order() -> list[Column]:
    """Deadline, else reminder, the blank ones last; then task_id and code."""
    at = F.nullif(F.coalesce(F.nullif(F.col("deadline_at"), F.lit("")), F.col("reminder_at")), F.lit(""))
    return [at.asc_nulls_last(), F.col("task_id"), F.col("task_code")]


def inferred_owner(states: DataFrame, owner: str, user: str = "user_id", seq: str = "seq", profiles: DataFrame | None = None) -> DataFrame:
    """(user, owner): of the first state that has one; for other users that of their profile (user, owner), if it has one."""
    named = lambda x: x.where(F.trim(text_or_empty(F.col(owner))) != "")
    first = named(states).groupBy(user).agg(F.min_by(owner, seq).alias(owner))
    if profiles is None:
        return first
    return first.unionByName(named(profiles).select(user, owner).join(first, user, "left_anti"))
