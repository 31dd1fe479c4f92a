"""Results kept current by Structured Streaming: latest status per source, personal task states.

Each micro-batch writes only what it changes, under its own number (see ``sources.commits``), so a batch that runs again after a
failure changes nothing and readers never meet half of one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pageknow.operators.fetchlog import OK, aggregates, time_order
from pageknow.operators.state import replay, upsert
from pageknow.sources import commits
from pageknow.sources.commits import scratch

#: Parts into which states are dealt by user.
BUCKETS = 64


def stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


def run(query_writer, checkpoint: str) -> None:  # noqa: ANN001
    """Work through what is there now and stop."""
    q = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def without_repeats(log: DataFrame, root: str, checkpoint: str, ident: list[str], at: str, delay: str = "7 days") -> StructType:
    """Append log rows to the batches of ``root``, each once: a row whose ``ident`` came before, at most ``delay`` of the time ``at``
    earlier, is left out, also if it comes with another file. Rows later than that, or without a time, are left out as well. The
    schema of what is written."""
    once = log.withWatermark(at, delay).dropDuplicatesWithinWatermark(ident)
    run(once.writeStream.outputMode("append").foreachBatch(lambda df, n: commits.append(df, root, n)), checkpoint)
    return log.schema


def latest_status(log: DataFrame, out: str, checkpoint: str, keys: list[str], fields: list[str], status: str, at: str, seq: str, ok: tuple[str, ...] = OK) -> DataFrame:
    """Latest and usable attempt per source. The state store keeps the aggregates; a micro-batch writes the sources it changed
    and nothing else. Equal to the batch form."""
    g = log.groupBy(*keys).agg(*aggregates(fields, F.col(status).isin(*ok), time_order(F.col(at), F.col(seq))))
    run(g.writeStream.outputMode("update").foreachBatch(lambda df, n: commits.append(df.withColumn("batch", F.lit(n).cast("long")), out, n)), checkpoint)
    return current_status(log.sparkSession, out, keys)


def current_status(spark: SparkSession, out: str, keys: list[str]) -> DataFrame | None:
    """Of each source what the last batch that changed it wrote; one aggregation that combines before it shuffles."""
    rows = commits.read(spark, out)
    if rows is None:
        return None
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def _manifest(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """The last batch and, by bucket, the folder that holds it."""
    done = commits.commits(spark, root)
    return (max(done), json.loads(done[max(done)])) if done else (-1, {})


def current_states(spark: SparkSession, root: str, schema: StructType, buckets: list[int] | None = None) -> DataFrame:
    """The states of all users, or of some buckets."""
    held = _manifest(spark, root)[1]
    paths = [f"{root}/attempts/{p}" for b, p in held.items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def put_states(batch: DataFrame, number: int, root: str, user: str = "user_id", seq: str = "seq", buckets: int = BUCKETS) -> bool:
    """Upsert a batch of updates: the buckets of its users are read, rewritten into a new folder, and named by the next manifest;
    the others stay where they are. False if the batch, or a later one, is committed."""
    spark, schema = batch.sparkSession, batch.schema
    last, held = _manifest(spark, root)
    if number <= last:
        return False
    of = F.pmod(F.xxhash64(F.col(user)), F.lit(buckets))
    touched = sorted(r.b for r in batch.select(of.alias("b")).distinct().collect())  # at most ``buckets``
    after = upsert(current_states(spark, root, schema, touched), batch, user, seq).withColumn("bucket", of)
    attempt = f"{number:020d}-{uuid.uuid4().hex}"
    if touched:
        after.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/attempts/{attempt}")
    for b in touched:
        path = f"{attempt}/bucket={b}"
        if commits.exists(spark, f"{root}/attempts/{path}"):
            held[str(b)] = path
        else:
            held.pop(str(b), None)
    return commits.create_once(spark, f"{root}/commits/{number:020d}", json.dumps(held))


def collect_old_states(spark: SparkSession, root: str) -> list[str]:
    """Delete attempts of which the last manifest names nothing; where no reader or writer is at work."""
    return commits.collect_garbage(spark, root, {p.split("/")[0] for p in _manifest(spark, root)[1].values()})


def state_upsert(log: DataFrame, root: str, checkpoint: str, user: str = "user_id", seq: str = "seq", buckets: int = BUCKETS) -> DataFrame:
    """State table after a stream of updates, kept in buckets of users."""
    columns = log.columns
    run(log.writeStream.foreachBatch(lambda df, n: put_states(df.select(*columns), n, root, user, seq, buckets)), checkpoint)
    return current_states(log.sparkSession, root, log.schema)


__all__ = ["BUCKETS", "collect_old_states", "current_states", "current_status", "latest_status", "put_states", "replay", "run", "scratch", "state_upsert", "stream", "without_repeats"]
