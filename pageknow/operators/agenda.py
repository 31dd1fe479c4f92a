"""Reminders and agenda: schedule points with zones, anchors, buckets, counts per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageknow.functions.text import text_or_empty

HINTS = {"no_states": "no personal task states yet", "no_reminders": "no deadline or reminder set", "no_agenda": "nothing is due"}


def schedule_point(value: Column, zone: Column, agenda_zone: str, deadline: bool) -> Column:
    """Local time in the agenda's zone. A bare date means the end of the day for a deadline and nine in the morning for a
    reminder, in the row's own zone (else the agenda's); an offset in the text counts; what cannot be read is null."""
    v = F.replace(F.trim(text_or_empty(value)), F.lit("Z"), F.lit("+00:00"))
    full = F.when(v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat(v, F.lit("T23:59:59" if deadline else "T09:00:00"))).otherwise(F.replace(v, F.lit(" "), F.lit("T")))
    own = F.coalesce(F.nullif(F.trim(text_or_empty(zone)), F.lit("")), F.lit(agenda_zone))
    offset = F.regexp_extract(full, "([+-][0-9]{2}:[0-9]{2})$", 1)
    local = F.try_to_timestamp(F.regexp_replace(full, "[+-][0-9]{2}:[0-9]{2}$", ""))
    utc = F.when(offset != "", F.to_utc_timestamp(local, F.nullif(offset, F.lit("")))).otherwise(F.to_utc_timestamp(local, own))
    return F.when(v != "", F.from_utc_timestamp(utc, agenda_zone))


def anchor(reminder: Column, deadline: Column, reminder_status: Column) -> tuple[Column, Column]:
    """(kind, time): the earlier of a live reminder and the deadline, the reminder on a tie."""
    live = F.when(~text_or_empty(reminder_status).isin("dismissed", "disabled"), reminder)
    first = live.isNotNull() & (deadline.isNull() | (live <= deadline))
    return F.when(first, "reminder").when(deadline.isNotNull(), "deadline").otherwise(""), F.when(first, live).otherwise(deadline)


def agenda(states: DataFrame, reference: str, days: int = 7, zone: str = "UTC") -> DataFrame:
    """``states`` that have an anchor, + anchor_kind, anchor_at, bucket (overdue, today, upcoming, later)."""
    r = schedule_point(F.col("reminder_at"), F.col("reminder_timezone"), zone, False)
    d = schedule_point(F.col("deadline_at"), F.col("deadline_timezone"), zone, True)
    x = states.withColumns({"__r": r, "__d": d})
    kind, at = anchor(F.col("__r"), F.col("__d"), F.col("reminder_status"))
    x = x.withColumns({"anchor_kind": kind, "anchor_at": at}).where("anchor_at IS NOT NULL")
    n = F.datediff(F.to_date("anchor_at"), F.to_date(F.lit(reference)))
    return x.withColumn("bucket", F.when(n < 0, "overdue").when(n == 0, "today").when(n <= days, "upcoming").otherwise("later")).drop("__r", "__d")


def reminders(states: DataFrame, tasks: DataFrame, user: str = "user_id") -> DataFrame:
    """States with a deadline or reminder and the name of their task, by id, else by code. ``tasks``: (user, task_id, task_code, task_name)."""
    x = states.where((text_or_empty(F.col("deadline_at")) != "") | (text_or_empty(F.col("reminder_at")) != "")).alias("s")
    by_id = tasks.groupBy(user, "task_id").agg(F.min("task_name").alias("n1")).alias("i")
    by_code = tasks.groupBy(user, "task_code").agg(F.min("task_name").alias("n2")).alias("c")
    j = x.join(by_id, (F.col(f"s.{user}") == F.col(f"i.{user}")) & (F.col("s.task_id") == F.col("i.task_id")), "left").join(by_code, (F.col(f"s.{user}") == F.col(f"c.{user}")) & (F.col("s.task_code") == F.col("c.task_code")), "left")
    return j.select("s.*", F.coalesce("n1", "n2", F.nullif(F.col("s.task_code"), F.lit("")), F.col("s.task_id")).alias("task_name"))


def summary(states: DataFrame, agenda_rows: DataFrame, user: str = "user_id", users: DataFrame | None = None) -> DataFrame:
    """Counts per user: states, completed, with reminder, and agenda rows by bucket; hints where there is nothing. With
    ``users`` (user) each of these has a row, also without a state."""
    s = states.groupBy(user).agg(F.count(F.lit(1)).alias("state_count"), F.count_if(F.col("status").isin("done", "skipped")).alias("completed_count"), F.count_if((text_or_empty(F.col("reminder_at")) != "") | (text_or_empty(F.col("deadline_at")) != "")).alias("reminder_count"))
    buckets = ("overdue", "today", "upcoming", "later")
    a = agenda_rows.groupBy(user).agg(*[F.count_if(F.col("bucket") == b).alias(f"{b}_count") for b in buckets])
    if users is not None:
        s = s.join(users.select(user).where(F.col(user).isNotNull()).distinct(), user, "full")
    out = s.join(a, user, "left").na.fill(0, ["state_count", "completed_count", "reminder_count", *[f"{b}_count" for b in buckets]])
    due = F.col("overdue_count") + F.col("today_count") + F.col("upcoming_count") + F.col("later_count")
    hints = F.array_compact(F.array(F.when(F.col("state_count") == 0, F.lit("no_states")), F.when(F.col("reminder_count") == 0, F.lit("no_reminders")), F.when(due == 0, F.lit("no_agenda"))))
    return out.withColumn("hints", F.array_join(hints, "; "))
