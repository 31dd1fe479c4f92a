"""Table scans and sinks: lenient and strict schemas, registry checks, layered sources, catalogues, stage tables and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from pageknow.functions.text import text_or_empty, to_int
from pageknow.sources.commits import written


def conform(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns asked for, as strings, in order; one that is missing is empty, and so is a null."""
    return df.select(*[text_or_empty(F.col(c)).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def scan_lenient(spark: SparkSession, path: str, columns: list[str], format: str = "csv") -> DataFrame:  # noqa: A002
    """A stage table as strings; a path that does not exist is an empty table."""
    try:
        reader = spark.read.format(format)
        df = reader.options(header=True, multiLine=True, escape='"', encoding="UTF-8").load(path) if format == "csv" else reader.load(path)
        df.columns  # noqa: B018  resolves the path
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], StructType().add("_", StringType())).select(*[F.lit("").alias(c) for c in columns]).limit(0)
    return conform(df, columns)


def require(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    """Strict scan: the columns asked for, or an error that lists those that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} missing required columns: {', '.join(missing)}")
    return df.select(*columns)


def validate_registry(df: DataFrame, url: str = "url", priority: str = "priority", flag: str = "need_dynamic") -> DataFrame:
    """Trimmed text columns, ``priority`` as int (3 if it does not parse), ``flag`` in lower case, and valid_url."""
    out = df.withColumns({c: F.trim(text_or_empty(F.col(c))) for c, t in df.dtypes if t == "string" and c != priority})
    return out.withColumns({priority: to_int(F.col(priority).cast("string"), 3), flag: F.lower(text_or_empty(F.col(flag))), "valid_url": F.col(url).rlike("(?i)^https?://")})


def select_sources(registry: DataFrame, max_priority: int | None = None, values: dict[str, list[str]] | None = None, dynamic_only: bool = False, only: DataFrame | None = None, key: str = "url", first: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Registry rows by priority, case-insensitive value lists, dynamic flag and membership of ``only`` (a semi-join), sorted;
    ``first`` keeps so many of them (the feature, not a guard)."""
    out = registry
    if max_priority is not None:
        out = out.where(F.col("priority") <= max_priority)
    for c, v in (values or {}).items():
        out = out.where(F.lower(F.col(c)).isin([x.lower() for x in v]))
    if dynamic_only:
        out = out.where(F.col("need_dynamic").isin("yes", "true", "1"))
    if only is not None:
        out = out.join(only.select(key).distinct(), key, "left_semi")
    if order:
        out = out.orderBy(*order)
    return out.limit(first) if first else out


def layered(key: list[str], layers: list[tuple[str, DataFrame]], columns: list[str]) -> DataFrame:
    """Rows of the first layer that has the key, with requested and effective layer. ``layers``: best first; the last is complete."""
    out = layers[-1][1].select(*key, F.struct(*columns).alias(f"l{len(layers) - 1}"))
    for n, (_, df) in enumerate(layers[:-1]):
        out = out.join(df.select(*key, F.struct(*columns).alias(f"l{n}")), key, "left")
    best = F.coalesce(*[F.col(f"l{n}") for n in range(len(layers))])
    name = F.coalesce(*[F.when(F.col(f"l{n}").isNotNull(), F.lit(layer)) for n, (layer, _) in enumerate(layers)])
    return out.select(*key, *[best[c].alias(c) for c in columns], F.lit(layers[0][0]).alias("requested_layer"), name.alias("effective_layer"))


def url_catalog(wide: DataFrame, key: str, kinds: list[str], registry: DataFrame) -> DataFrame:
    """(key, kind, url). The wide table comes first, an empty value there blocks too; of the registry, the last row of a page
    type and the first of a stage count. ``registry``: (key, page_type, stage, url, seq)."""
    base = wide.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), text_or_empty(F.col(k)).alias("url")) for k in kinds])).alias("x")).select(key, "x.kind", "x.url", F.lit(0).alias("level"))
    pages = registry.groupBy(key, F.col("page_type").alias("kind")).agg(F.max_by("url", "seq").alias("url")).withColumn("level", F.lit(1))
    stages = registry.groupBy(key, F.col("stage").alias("kind")).agg(F.min_by("url", "seq").alias("url")).withColumn("level", F.lit(2))
    every = base.unionByName(pages).unionByName(stages)
    return every.groupBy(key, "kind").agg(F.min_by("url", "level").alias("url"))


def canonical(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """+ canonical: the name an alias stands for (compared trimmed and in lower case), else the trimmed input.
    ``aliases``: (alias, canonical); one that is given twice stands for its smallest name."""
    a = aliases.groupBy(F.lower(F.trim("alias")).alias("__a")).agg(F.min("canonical").alias("__n"))
    out = df.join(a, F.lower(F.trim(text_or_empty(F.col(column)))) == F.col("__a"), "left")
    return out.withColumn("canonical", F.coalesce("__n", F.trim(text_or_empty(F.col(column))))).drop("__a", "__n")


def match_captures(captures: DataFrame, registry: DataFrame) -> DataFrame:
    """Captured pages and their registry row: (capture_id, matches, url, error). Exactly one row must match by school and page
    type, and by url where the capture names one. The registry is counted by its keys first, so each capture meets one row."""
    keyed = registry.select(F.lower("school").alias("__s"), F.lower("page_type").alias("__p"), "url")
    pages = keyed.groupBy("__s", "__p").agg(F.count("url").alias("n"), F.min("url").alias("u"))
    exact = keyed.groupBy("__s", "__p", F.col("url").alias("__u")).agg(F.count("url").alias("k"))
    c = captures.select("capture_id", F.lower("school").alias("__s"), F.lower("page_type").alias("__p"), text_or_empty(F.col("url")).alias("__u"))
    got = c.join(pages, ["__s", "__p"], "left").join(exact, ["__s", "__p", "__u"], "left")
    got = got.withColumn("matches", F.coalesce(F.when(F.col("__u") == "", F.col("n")).otherwise(F.col("k")), F.lit(0).cast("long")))
    error = F.when(F.col("matches") == 0, "no_source").when(F.col("matches") > 1, "several_sources").otherwise("")
    url = F.when(F.col("matches") == 1, F.when(F.col("__u") == "", F.col("u")).otherwise(F.col("__u"))).otherwise("")
    return got.select("capture_id", "matches", url.alias("url"), error.alias("error"))


def import_captures(captures: DataFrame, registry: DataFrame, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, log, rejects) of captured pages (capture_id, school, page_type, url, title, text). Pages: the registry's school,
    page type, stage and url, a title, and the text repaired; log: a row a page as a fetch writes it; rejects: (capture_id, error) of
    captures that match no registry row or several. ``registry``: (school, page_type, stage, url)."""
    from pageknow.operators.pages import raw_filename, repair_pasted

    matched = match_captures(captures, registry)
    rejects = matched.where("error <> ''").select("capture_id", "error")
    rows = registry.select(F.lower("school").alias("__s"), F.lower("page_type").alias("__p"), F.col("url").alias("__u"), F.col("school").alias("r_school"), F.col("page_type").alias("r_type"), F.col("stage").alias("r_stage"))
    c = captures.select("capture_id", F.lower("school").alias("__s"), F.lower("page_type").alias("__p"), "title", "text").join(matched.where("error = ''").select("capture_id", F.col("url").alias("__u")), "capture_id")
    j = c.join(rows, ["__s", "__p", "__u"])
    title = F.coalesce(F.nullif(F.trim(text_or_empty(F.col("title"))), F.lit("")), F.concat_ws(" ", "r_school", "r_type", F.lit("manual capture")))
    pages = j.select("capture_id", F.col("r_school").alias("school"), F.col("r_type").alias("page_type"), F.col("r_stage").alias("stage"), F.col("__u").alias("source_url"), title.alias("title"), repair_pasted(F.col("text")).alias("text"))
    log = pages.select("school", "page_type", "stage", "source_url", F.col("source_url").alias("final_url"), F.lit("success").alias("status"), "title", F.lit(at).alias("crawled_at"), raw_filename(F.col("school"), F.col("page_type"), F.col("source_url")).alias("raw_file"),
                       F.lit("text/plain").alias("content_type"), F.length("text").alias("char_count"), F.concat(F.lit("manual_capture_from="), F.col("capture_id").cast("string")).alias("error"))
    return pages, log, rejects


def scan_rescued(spark: SparkSession, path: str, schema: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of CSV files: rows that fit the schema, and (file, line) of those that do not, which are kept
    as they stand. Quoted values may not span lines, as a damaged quote would then swallow the rows after it."""
    whole = spark.read.schema(f"{schema}, __line string").options(header=header, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="__line").csv(path)
    read = written(whole.withColumn("__file", F.col("_metadata.file_path")), "scan")  # parsed once, for both
    return read.where("__line IS NULL").drop("__line", "__file"), read.where("__line IS NOT NULL").select(F.col("__file").alias("file"), F.col("__line").alias("line"))


def write_stage(df: DataFrame, path: str, columns: list[str], format: str = "parquet") -> None:  # noqa: A002
    """Overwrite a stage table with the columns in their fixed order."""
    w = df.select(*columns).write.mode("overwrite").format(format)
    (w.option("header", True) if format == "csv" else w).save(path)


def append_log(log: DataFrame, new: DataFrame) -> DataFrame:
    """Log and new rows, columns aligned, gaps null."""
    return log.unionByName(new, allowMissingColumns=True)


def schema_dictionary(tables: dict[str, DataFrame], required: dict[str, set[str]] | None = None, described: dict[str, str] | None = None) -> DataFrame:
    """(dataset, column, position, type, required, description): one row per column, small by nature. ``described``: texts by
    column name; else the comment of the column, if it has one."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(n, f.name, i, f.dataType.simpleString(), "yes" if f.name in (required or {}).get(n, set()) else "no", (described or {}).get(f.name, f.metadata.get("comment", ""))) for n, df in sorted(tables.items()) for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "dataset string, column string, position int, type string, required string, description string")


def manifest(tables: dict[str, DataFrame | None]) -> DataFrame:
    """(dataset, exists, row_count, file_count, newest): counts by Spark, files and their newest change from the file
    metadata; a dataset given as None does not exist and counts nothing."""
    spark = next(df for df in tables.values() if df is not None).sparkSession
    out = None
    for n, df in sorted(tables.items()):
        m = F.col("_metadata")
        if df is None:
            one = spark.range(1).select(F.lit(0).cast("long").alias("row_count"), F.lit(0).cast("long").alias("file_count"), F.lit(None).cast("timestamp").alias("newest"))
        else:
            one = df.select(m["file_path"].alias("f"), m["file_modification_time"].alias("t")).agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("f").alias("file_count"), F.max("t").alias("newest"))
        one = one.select(F.lit(n).alias("dataset"), F.lit(df is not None).alias("exists"), "row_count", "file_count", "newest")
        out = one if out is None else out.unionByName(one)
    return out


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
