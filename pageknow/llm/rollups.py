"""Token counts as delta-maintained rollups.

Changes of documents (inserts, deletes, revised counts) become signed rows, are summed by source, language and tokenizer
version, and are written as the delta of one batch, each attempt into a folder of its own. A batch is committed by a
marker that names the attempt, written after its delta. A batch that is committed is never written again, and an attempt
that no marker names counts for nothing, so a replay, a retry or a crash at any point changes nothing and readers never see
half a batch. Totals are the sum of committed deltas; compaction folds them into one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
MARKER = "batch long, attempt string"


def signed(inserted: DataFrame | None = None, deleted: DataFrame | None = None, revised: DataFrame | None = None) -> DataFrame:
    """Signed rows (source, lang, tokenizer, docs, tokens). ``inserted`` and ``deleted``: (source, lang, tokenizer, tokens);
    ``revised``: the same and old_source, old_lang, old_tokenizer, old_tokens. Null tokens count 0; null keys are keys."""
    def rows(df: DataFrame, sign: int, old: str = "") -> DataFrame:
        return df.select(*[F.col(old + k).cast("string").alias(k) for k in KEYS], F.lit(sign).cast("long").alias("docs"), (F.coalesce(F.col(old + "tokens"), F.lit(0)).cast("long") * sign).alias("tokens"))

    parts = [rows(d, s, o) for d, s, o in ((inserted, 1, ""), (deleted, -1, ""), (revised, -1, "old_"), (revised, 1, "")) if d is not None]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out


def _markers(spark: SparkSession, root: str) -> DataFrame:
    """(batch, attempt) of what is committed; of a batch with several markers the smallest attempt. One row a batch."""
    spark.createDataFrame([], MARKER).write.mode("ignore").parquet(f"{root}/commits")  # the folder may not be there yet
    return spark.read.schema(MARKER).parquet(f"{root}/commits").groupBy("batch").agg(F.min("attempt").alias("attempt"))


def commit(changes: DataFrame, root: str, batch: int) -> None:
    """Write the batch's delta, then its marker; does nothing for a batch that is committed. Columns other than those of
    ``signed`` are ignored; a batch without rows is committed as well. Usable in ``foreachBatch`` with the batch's number."""
    spark = changes.sparkSession
    if not _markers(spark, root).where(F.col("batch") == int(batch)).isEmpty():
        return
    attempt = uuid.uuid4().hex
    delta = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    delta.write.parquet(f"{root}/deltas/batch={int(batch)}/attempt={attempt}")
    spark.createDataFrame([(int(batch), attempt)], MARKER).coalesce(1).write.mode("append").parquet(f"{root}/commits")


def totals(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """(source, lang, tokenizer, docs, tokens) over the committed batches, or those up to a number; keys whose documents are all
    gone have no row."""
    done = _markers(spark, root)
    done = done if upto is None else done.where(F.col("batch") <= int(upto))
    if done.isEmpty():
        return spark.createDataFrame([], DELTA)
    deltas = spark.read.schema(DELTA + ", batch long, attempt string").option("basePath", f"{root}/deltas").parquet(f"{root}/deltas")
    sums = deltas.join(done, ["batch", "attempt"], "left_semi").groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return sums.where("docs <> 0 OR tokens <> 0")


def compact(spark: SparkSession, root: str, new_root: str, upto: int) -> None:
    """Fold the deltas of the batches committed up to ``upto`` into one of another folder, under the last one's number. The
    numbers of all of them are committed there, so a batch of them that is played again on the new folder changes nothing,
    and later ones go on. The markers are written at once and last; a compaction that died before counts for nothing."""
    folded = [r.batch for r in _markers(spark, root).where(F.col("batch") <= int(upto)).select("batch").collect()]  # one number a batch
    if not folded or not _markers(spark, new_root).where(F.col("batch").isin(folded)).isEmpty():
        return
    last, attempt = max(folded), uuid.uuid4().hex
    totals(spark, root, upto).write.parquet(f"{new_root}/deltas/batch={last}/attempt={attempt}")
    spark.createDataFrame([(n, attempt if n == last else "folded") for n in sorted(folded)], MARKER).coalesce(1).write.mode("append").parquet(f"{new_root}/commits")
