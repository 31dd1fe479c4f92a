"""Task enrichment: evidence aggregated first, then joined to every task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageknow.functions.text import text_or_empty, truncate

#: evidence type -> column of the enriched task.
FIELDS = {"deadline": "official_deadline_evidence", "required_document": "official_document_evidence", "action_instruction": "official_action_evidence", "action_url": "official_action_urls", "fee_amount": "official_fee_evidence"}


def decided(evidence: DataFrame, quality: DataFrame | None, key: str = "evidence_id", order: str = "seq") -> DataFrame:
    """``evidence`` + decision: keep without an audit, ``missing`` for an id the audit lacks. Decisions count without case and
    outer blanks. Of an id given twice the last row by ``order`` counts; rows with a blank id count for none."""
    if quality is None:
        return evidence.withColumn("decision", F.lit("keep"))
    h = F.xxhash64(F.col(key).cast("string"))  # sorted by a number first, and once: ids are dealt before they are met
    rows = quality.where(F.trim(text_or_empty(F.col(key).cast("string"))) != "").select(h.alias("__h"), key, F.lower(F.trim("quality_decision")).alias("__d"), order)
    last = rows.repartition("__h", key).groupBy("__h", key).agg(F.max_by("__d", order).alias("__d"))
    return evidence.withColumn("__h", h).join(last, ["__h", key], "left").select(*evidence.columns, F.coalesce("__d", F.lit("missing")).alias("decision"))


def ordered_top(rows: DataFrame, keys: list[str], kind: str, value: Column, order: list[Column], n: int = 3, sep: str = " | ", chars: int = 360) -> DataFrame:
    """(keys, kind, joined): the first n values of each kind that differ in lower case, each cut to ``chars``, in order."""
    x = rows.select(*keys, kind, truncate(value, chars).alias("__v"), F.struct(*order).alias("__o")).where(F.col("__v") != "")
    x = x.groupBy(*keys, kind, F.lower("__v").alias("__l")).agg(F.min(F.struct("__o", "__v")).alias("__m"))
    w = W.partitionBy(*keys, kind).orderBy("__m")
    x = x.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    return x.groupBy(*keys, kind).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__m.__v"))), lambda s: s["__v"]), sep).alias("joined"))


def enrich(tasks: DataFrame, evidence: DataFrame, keys: list[str], quality: DataFrame | None = None, n: int = 3, chars: int = 360) -> DataFrame:
    """Every task with counts, evidence types and the first n values of each field of its usable evidence.

    ``evidence``: (keys, evidence_id, evidence_type, evidence_text, normalized_value, confidence, updated_at); rows of type
    source_context do not count. Both sides are keyed alike, so the evidence is aggregated before the one join; it is dealt by
    task once, for counts and values alike (see ``ordered_top``).
    """
    e = decided(evidence.where("evidence_type <> 'source_context'"), quality)
    rank = F.coalesce(F.element_at(F.create_map(*[x for p in (("high", 0), ("medium", 1), ("low", 2)) for x in (F.lit(p[0]), F.lit(p[1]))]), F.col("confidence")), F.lit(3))
    value = F.when(F.col("evidence_type") == "action_url", F.coalesce(F.nullif(text_or_empty(F.col("normalized_value")), F.lit("")), F.col("evidence_text"))).otherwise(F.col("evidence_text"))
    x = e.select(*keys, "evidence_type", "decision", F.nullif(F.when(F.col("decision") == "keep", truncate(value, chars)), F.lit("")).alias("__v"), F.struct(rank.alias("a"), F.col("updated_at"), F.col("evidence_id")).alias("__o"))
    x = x.repartition(*[F.col(k) for k in keys]).groupBy(*keys, "evidence_type", "decision", F.lower("__v").alias("__l")).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct("__o", "__v")).alias("__m"))
    x = x.withColumn("__r", F.row_number().over(W.partitionBy(*keys, "evidence_type").orderBy(F.col("__l").isNull(), "__m")))
    keep = F.col("decision") == "keep"

    def first(kind: str) -> Column:
        some = F.when((F.col("evidence_type") == kind) & F.col("__l").isNotNull() & (F.col("__r") <= n), F.struct("__r", F.col("__m.__v").alias("v")))
        return F.array_join(F.transform(F.array_sort(F.collect_list(some)), lambda s: s["v"]), " | ")

    per_task = x.groupBy(*keys).agg(
        F.sum("__n").alias("candidate_evidence_count"), F.sum(F.when(keep, F.col("__n")).otherwise(0)).alias("usable_evidence_count"), F.sum(F.when(F.col("decision") == "reject", F.col("__n")).otherwise(0)).alias("rejected_evidence_count"),
        F.array_join(F.sort_array(F.collect_set(F.when(keep, F.col("evidence_type")))), ", ").alias("evidence_types"), *[first(k).alias(v) for k, v in FIELDS.items()],
    )
    out = tasks.join(per_task, keys, "left")
    nums = ("candidate_evidence_count", "usable_evidence_count", "rejected_evidence_count")
    out = out.na.fill(0, list(nums)).na.fill("", ["evidence_types", *FIELDS.values()])
    c, u, r = (F.col(x) for x in nums)
    out = out.withColumn("review_evidence_count", c - u - r)
    note = F.concat_ws("; ", F.when(u > 0, F.concat(u.cast("string"), F.lit(" keep"))), F.when(F.col("review_evidence_count") > 0, F.concat(F.col("review_evidence_count").cast("string"), F.lit(" review/missing"))), F.when(r > 0, F.concat(r.cast("string"), F.lit(" reject"))))
    audited = F.lit(quality is not None)
    return out.withColumns({
        "evidence_quality_status": F.when(c == 0, "no_evidence").when(audited, "audited").otherwise("not_audited"),
        "evidence_quality_notes": F.when((c > 0) & audited, note).otherwise(""),
        "enrichment_status": F.when(u > 0, "evidence_found").when((c > 0) & audited, "evidence_needs_review").when(c > 0, "evidence_found").otherwise("no_evidence"),
    })


def code_of(task_id: Column, name: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """The part of the id after its first dash, else the first label with a word in the name, else empty."""
    from pageknow.operators.rules import first_label

    i = text_or_empty(task_id)
    return F.when(F.contains(i, F.lit("-")), F.substring(i, F.instr(i, "-") + 1, F.length(i))).otherwise(first_label(F.lower(text_or_empty(name)), words, ""))


def trace(parts: dict[str, Column], n: int = 3, chars: int = 90) -> Column:
    """``label: value`` of the first n parts that are not empty."""
    got = F.array_compact(F.array(*[F.when(F.trim(text_or_empty(c)) != "", F.concat(F.lit(f"{k}: "), truncate(c, chars))) for k, c in parts.items()]))
    return F.array_join(F.slice(got, 1, n), " ; ")
