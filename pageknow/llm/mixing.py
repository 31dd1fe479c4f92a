"""Mixing sources to target weights by entropy balancing.

Every word starts with the same weight, so a document's base weight is its size. Among all reweightings that give each
source its target number of words, entropy balancing picks the one nearest to the base (least relative entropy); its
solution tilts each base weight exponentially, rate = exp(lambda_source). The convex dual
``sum_s size_s * exp(lambda_s) - lambda_s * target_s`` is solved by damped Newton steps, each source's gradient and
second derivative coming from distributed sums over its documents. Rates are then rounded into whole copies by
systematic sampling along an order of falling size, which keeps the words taken within about one document of the target.

All steps are DataFrame operations. The only work not spread by document is the table of sources (one row each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageknow.llm.common import materialize

#: Weights of the sources in order of code point, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source, and no document, is taken more often than this.
MAX_REPEATS = 3
NEWTON_STEPS = 60
#: Starting points of the systematic sampling that are tried for each source.
STARTS = 32
#: Each level of size in a source is dealt into so many cells, so that no task ranks a whole source.
SALTS = 64


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> + target: shares of the total by weight, stopped at ``repeats`` times the size, the excess
    shared again by weight. That is min(cap, level * weight), the level being the largest of the candidates got by
    capping sources in order of cap / weight."""
    total = W.partitionBy()
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(repeats))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    x = x.withColumn("level", level).withColumn("level", F.max("level").over(total))
    return x.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def newton_rate(base: Column, target: Column, steps: int = NEWTON_STEPS) -> Column:
    """exp(lambda) at the optimum of ``base * exp(lambda) - lambda * target``; steps are held within 1 for global convergence."""
    def step(lam: Column, _: Column) -> Column:
        mass = base * F.exp(lam)
        return lam - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (mass - target) / mass))

    solved = F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step))
    return F.when((base > 0) & (target > 0), F.round(solved, 12)).otherwise(F.lit(0.0))


def mix(docs: DataFrame, source: str = "source", size: Column | None = None, weights: tuple[float, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies (0 to ``repeats``).

    Null or empty texts have size 0 (taken as often as others, to no effect on words); a null source is a source of its
    own, last in order. Repeated rows count each; equal rows may swap their copies. Empty tables give empty results.
    Columns of ``docs`` with the new names are replaced. The same input gives the same copies at every run.
    """
    new = ("size", "source_size", "target", "rate", "copies")
    size = word_count(F.col("text")) if size is None else size
    rest = [c for c in docs.columns if c not in new]
    rows = docs.select(
        F.struct(*rest).alias("__row"), docs[source].alias("__s"), size.alias("__n"),
        F.xxhash64(*[F.col(c) for c in rest if c != "embedding"]).alias("__h"),
    ).withColumns({"__level": F.when(F.col("__n") > 0, F.floor(F.log(F.col("__n").cast("double")) * 8)).otherwise(F.lit(-1)).cast("int"), "__salt": F.pmod("__h", F.lit(SALTS)).cast("int")})
    cell = ["__s", "__level", "__salt"]
    cells = materialize(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("__k"), F.sum("__n").alias("__words")), "mix-cells")
    sources = source_targets(cells.groupBy(F.col("__s").alias("source")).agg(F.sum("__words").alias("source_size")), weights, repeats)
    sources = sources.withColumn("rate", newton_rate(F.col("source_size").cast("double"), F.col("target")))
    order = W.partitionBy("__s").orderBy(F.col("__level").desc(), "__salt").rowsBetween(W.unboundedPreceding, -1)
    placed = cells.withColumn("__from", F.coalesce(F.sum("__k").over(order), F.lit(0)))
    placed = materialize(placed.join(sources, placed["__s"].eqNullSafe(sources["source"])).select(*cell, "__from", "source_size", "target", "rate"), "mix-rates")

    ranked = rows.withColumn("__rank", F.row_number().over(W.partitionBy(*cell).orderBy("__h", "__n")))
    r, p = ranked.alias("r"), placed.alias("p")
    on = F.col("r.__s").eqNullSafe(F.col("p.__s")) & (F.col("r.__level") == F.col("p.__level")) & (F.col("r.__salt") == F.col("p.__salt"))
    at = r.join(p, on).select("r.__row", "r.__s", "r.__n", "source_size", "target", "rate", (F.col("p.__from") + F.col("r.__rank")).alias("__at"))
    narrow = materialize(at.drop("__row", "source_size"), "mix-places")

    def copies(start: Column) -> Column:
        x, rate = F.col("__at").cast("double"), F.col("rate")
        return F.least(F.floor(start + rate * x) - F.floor(start + rate * (x - 1)), F.lit(repeats)).cast("int")

    starts = [k / STARTS for k in range(STARTS)]
    tried = narrow.groupBy("__s").agg(F.first("target").alias("t"), *[F.sum(copies(F.lit(x)) * F.col("__n")).alias(f"a{k}") for k, x in enumerate(starts)])
    off = F.array_min(F.array(*[F.struct(F.abs(F.col(f"a{k}") - F.col("t")), F.lit(x).alias("start"), (F.col(f"a{k}") - F.col("t")).alias("over")) for k, x in enumerate(starts)]))
    best = materialize(tried.select(F.col("__s").alias("__b"), off["start"].alias("__start"), off["over"].alias("__over")), "mix-starts")

    def choose(rows_: DataFrame) -> DataFrame:
        return rows_.join(best, rows_["__s"].eqNullSafe(best["__b"])).withColumn("copies", copies(F.col("__start"))).drop("__b")

    # What is still over or short in a source is made up by one document more or less, the one whose size fits best.
    left = F.abs(F.col("__over")) - F.abs(F.abs(F.col("__over")) - F.col("__n"))
    able = F.when(F.col("__over") > 0, F.col("copies") > 0).otherwise((F.col("copies") < repeats) & (F.col("target") > 0))
    fix = choose(narrow).where(able & (left > 0)).groupBy("__s").agg(F.max_by(F.struct("__at", F.signum("__over").cast("int").alias("d")), F.struct(left, "__at")).alias("f"))
    fix = materialize(fix.select(F.col("__s").alias("__fs"), F.col("f.__at").alias("__fa"), F.col("f.d").alias("__fd")), "mix-fix")
    out = choose(at).join(fix, F.col("__s").eqNullSafe(F.col("__fs")) & (F.col("__at") == F.col("__fa")), "left")
    return out.select(*[F.col("__row")[c].alias(c) for c in rest], F.col("__n").alias("size"), "source_size", "target", "rate", (F.col("copies") - F.coalesce(F.col("__fd"), F.lit(0))).alias("copies"))


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as its copies say."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("__copy")).select(*columns)
