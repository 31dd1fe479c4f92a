"""The human-review loop: who needs review and why, decisions, the reviewed table, what is pending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageknow.functions.text import text_or_empty, to_int

PRIORITY = {"none": 0, "low": 1, "medium": 2, "high": 3}
DECISIONS = ("", "approve", "approve_with_edits", "reject")
#: field of the task -> field of the decision.
REVIEWED = {"official_deadline_evidence": "reviewed_deadline_evidence", "official_document_evidence": "reviewed_document_evidence", "official_action_evidence": "reviewed_action_evidence", "official_action_urls": "reviewed_action_urls", "official_fee_evidence": "reviewed_fee_evidence"}


def assess(always: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """(priority, reasons, suggested action): the highest priority of the rules that hold, all their reasons, the first action."""
    n = {k: to_int(F.col(f"{k}_evidence_count").cast("string")) for k in ("candidate", "usable", "review", "rejected")}
    rules = [
        (F.col("task_code").isin(*always) & (n["candidate"] > 0), "high", F.lit("task_type_mixes_with_general_questions"), "compare_with_original_source"),
        ((F.col("evidence_quality_status") == "not_audited") & (n["candidate"] > 0), "high", F.lit("evidence_not_audited"), "run_evidence_audit"),
        ((n["candidate"] > 0) & (n["usable"] == 0), "high", F.lit("no_usable_evidence"), "pick_evidence_by_hand"),
        (n["review"] > 0, "medium", F.concat(n["review"].cast("string"), F.lit("_rows_undecided")), "decide_open_rows"),
        ((n["rejected"] > 0) & (n["usable"] > 0), "medium", F.concat(n["usable"].cast("string"), F.lit("_kept_and_"), n["rejected"].cast("string"), F.lit("_rejected")), "check_for_mixed_questions"),
        (F.col("enrichment_status") == "evidence_needs_review", "medium", F.lit("marked_for_review"), "review_before_use"),
    ]
    hit = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(PRIORITY[p]).alias("p"), r.alias("r"), F.lit(a).alias("a"))) for c, p, r, a in rules]))
    rank = F.coalesce(F.array_max(F.transform(hit, lambda h: h["p"])), F.lit(0))
    name = F.element_at(F.array(*[F.lit(k) for k in PRIORITY]), rank + 1)
    return name, F.array_join(F.transform(hit, lambda h: h["r"]), "；"), F.coalesce(F.get(hit, F.lit(0))["a"], F.lit(""))


def queue(enriched: DataFrame, always: tuple[str, ...], order: list[str] | None = None) -> DataFrame:
    """Tasks that need review, with review_priority, review_reason and suggested_action. ``high`` sorts before ``medium``."""
    p, r, a = assess(always)
    out = enriched.withColumns({"review_priority": p, "review_reason": r, "suggested_action": a}).where("review_priority <> 'none'")
    return out.orderBy("review_priority", *order) if order else out


def _last(decisions: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Of a key given twice the last row by ``order``, a column that the decisions must have."""
    x = decisions.where(F.trim(text_or_empty(F.col(key).cast("string"))) != "")
    return x.groupBy(key).agg(F.max_by(F.struct(*[c for c in x.columns if c != key]), order).alias("d"))


def decision_rows(queue_: DataFrame, existing: DataFrame, key: str, pending_only: bool = False) -> DataFrame:
    """The decision table: what was decided before where it is not empty, else the candidate. A new table; the old one is left
    as it is. ``pending_only``: rows without a decision."""
    j = queue_.join(_last(existing, key), key, "left")
    old = lambda c: text_or_empty(F.col(f"d.{c}"))
    if pending_only:
        j = j.where(F.lower(F.trim(old("reviewer_decision"))) == "")
    return j.select(key, "review_priority", "review_reason", old("reviewer_decision").alias("reviewer_decision"), *[F.coalesce(F.nullif(old(d), F.lit("")), text_or_empty(F.col(t))).alias(d) for t, d in REVIEWED.items()], old("reviewer_notes").alias("reviewer_notes"), old("reviewed_at").alias("reviewed_at"))


def apply_decisions(enriched: DataFrame, queue_: DataFrame | None, decisions: DataFrame, key: str, as_of: str = "", always: tuple[str, ...] = ()) -> DataFrame:
    """The reviewed table. Approved rows take the edits, rejected and undecided ones lose their evidence, rows that need no
    review stay. An unknown decision raises when the row is read. Without a queue each row is assessed where it is (see
    ``queue``), so the enriched table is read once."""
    if queue_ is None:
        p, r, _ = assess(always)
        j = enriched.withColumns({"__p": F.nullif(p, F.lit("none")), "__r": r}).withColumn("__r", F.when(F.col("__p").isNotNull(), F.col("__r")))
    else:
        j = enriched.join(queue_.select(key, F.col("review_priority").alias("__p"), F.col("review_reason").alias("__r")), key, "left")
    j = j.join(_last(decisions, key), key, "left")
    given = F.lower(F.trim(text_or_empty(F.col("d.reviewer_decision"))))
    checked = F.when(given.isin(*DECISIONS), given).otherwise(F.raise_error(F.concat(F.lit("invalid reviewer_decision: "), given)))
    j = j.withColumns({"review_priority": text_or_empty(F.col("__p")), "review_reason": text_or_empty(F.col("__r")), "review_decision": checked, "review_notes": F.trim(text_or_empty(F.col("d.reviewer_notes")))})
    needs = F.col("review_priority") != ""
    yes, no = F.col("review_decision").startswith("approve"), F.col("review_decision") == "reject"
    blank = needs & ~yes
    fields = {t: F.when(blank, "").when(needs & yes, F.coalesce(F.nullif(F.trim(text_or_empty(F.col(f"d.{d}"))), F.lit("")), F.col(t))).otherwise(F.col(t)) for t, d in REVIEWED.items()}
    status = F.when(~needs, "not_required").when(F.col("review_decision") == "approve", "review_approved").when(yes, "review_approved_with_edits").when(no, "review_rejected").otherwise("review_pending")
    at = F.when(F.col("review_decision") == "", "").otherwise(F.coalesce(F.nullif(F.trim(text_or_empty(F.col("d.reviewed_at"))), F.lit("")), F.lit(as_of)))
    note = F.coalesce(F.nullif(F.when(yes | no, F.col("review_notes")), F.lit("")), F.nullif(F.col("review_reason"), F.lit("")), F.lit("reviewed"))
    out = j.withColumns({**fields, "human_review_status": status, "reviewed_at": at, "usable_evidence_count": F.when(blank, 0).otherwise(F.col("usable_evidence_count")), "evidence_types": F.when(blank, "").otherwise(F.col("evidence_types")),
                         "enrichment_status": F.when(needs, status).otherwise(F.col("enrichment_status")), "evidence_quality_notes": F.when(needs, note).otherwise(F.col("evidence_quality_notes")),
                         "evidence_quality_status": F.when(~needs, F.col("evidence_quality_status")).when(yes, "human_reviewed").when(no, "human_reviewed_rejected").otherwise("review_pending")})
    return out.drop("__p", "__r", "d")


def pending_summary(queue_: DataFrame, decisions: DataFrame, key: str, owner: str, only: str | None = None) -> DataFrame:
    """Counts by owner and priority: all, pending, approved, approved with edits, rejected. ``only``: one owner, any case."""
    q = queue_ if only is None else queue_.where(F.upper(owner) == only.upper())
    d = F.lower(F.trim(text_or_empty(F.col("d.reviewer_decision"))))
    n = {"approved_count": "approve", "approved_with_edits_count": "approve_with_edits", "rejected_count": "reject"}
    return q.join(_last(decisions, key), key, "left").groupBy(owner, "review_priority").agg(F.count(F.lit(1)).alias("total_review_rows"), F.count_if(~d.isin(*n.values())).alias("pending_count"), *[F.count_if(d == v).alias(k) for k, v in n.items()])


def pending(queue_: DataFrame, decisions: DataFrame, key: str, order: list[str] | None = None, owner: str = "owner", only: str | None = None) -> DataFrame:
    """Rows of the queue without a decision, with the notes made so far, sorted by priority. ``only``: one owner, any case."""
    q = queue_ if only is None else queue_.where(F.upper(owner) == only.upper())
    j = q.join(_last(decisions, key), key, "left").where(F.lower(F.trim(text_or_empty(F.col("d.reviewer_decision")))) == "")
    out = j.withColumn("reviewer_notes", text_or_empty(F.col("d.reviewer_notes"))).drop("d")
    rank = F.when(F.col("review_priority") == "high", 0).when(F.col("review_priority") == "medium", 1).when(F.col("review_priority") == "low", 2).when(F.col("review_priority") == "", 9).otherwise(8)
    out = out.withColumn("priority_rank", rank)
    return out.orderBy(*order) if order else out
