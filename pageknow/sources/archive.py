"""Page archive: one text per page, ``key: value`` lines, a line ``---``, then the body.

An archive is a folder with a file a page, or, where pages are many, one of bundles: text files of many records each, which end
with a control character, the page's name in the first line of a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageknow.functions.lexicon import BLOCK_MARKERS
from pageknow.functions.text import LINE_BREAK, bind, first_hit, strip, text_or_empty

MARK = "\n---\n"
#: Ends a record of a bundle; inside a record it is written as ESCAPE and "r", ESCAPE itself as ESCAPE and "p".
RECORD, ESCAPE = "\x1e", "\x10"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(raw_file, raw) of a folder of archived pages, one file a row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("raw_file"), F.col("value").alias("raw"))


def write_bundles(pages: DataFrame, path: str) -> None:
    """Pages (raw_file, raw) as bundles, a file for each partition of ``pages``. A null text is an empty one; of a name only the
    first line counts."""
    coded = lambda c: F.replace(F.replace(text_or_empty(c), F.lit(ESCAPE), F.lit(ESCAPE + "p")), F.lit(RECORD), F.lit(ESCAPE + "r"))
    name = F.substring_index(coded(F.col("raw_file")), "\n", 1)
    pages.select(F.concat(name, F.lit("\n"), coded(F.col("raw"))).alias("value")).write.option("lineSep", RECORD).text(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(raw_file, raw) of a folder of bundles; large ones are read in parts."""
    plain = lambda c: F.replace(F.replace(c, F.lit(ESCAPE + "r"), F.lit(RECORD)), F.lit(ESCAPE + "p"), F.lit(ESCAPE))
    x, at = spark.read.option("lineSep", RECORD).text(path), F.instr("value", "\n")
    return x.where(at > 0).select(plain(F.left("value", at - 1)).alias("raw_file"), plain(F.substring(F.col("value"), at + 1, F.length("value"))).alias("raw"))


def parsed(archive: DataFrame, fields: list[str]) -> DataFrame:
    """(raw_file, fields .., body, error) of archived pages (raw_file, raw); an error, else empty, names a missing header or
    the fields that lack."""
    header, body = parse(F.col("raw"))
    x = archive.withColumns({"__h": header, "body": body})
    lacking = F.array_compact(F.array(*[F.when(F.element_at("__h", f).isNull(), F.lit(f)) for f in fields]))
    error = F.when(F.size("__h") == 0, "no_header").when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", "))).otherwise("")
    return x.select("raw_file", *[F.element_at("__h", f).alias(f) for f in fields], "body", error.alias("error"))


def read_parsed(spark: SparkSession, path: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pages, rejects) of a folder of archived pages: (raw_file, fields .., body), and (raw_file, error) of files without a
    header or without one of the fields."""
    x = parsed(read_archive(spark, path), fields)
    return x.where("error = ''").drop("error"), x.where("error <> ''").select("raw_file", "error")


def to_archive(header: dict[str, Column], body: Column) -> Column:
    """The archive text of a page."""
    lines = [F.concat(F.lit(f"{k}: "), F.regexp_replace(text_or_empty(c), LINE_BREAK, " ")) for k, c in header.items()]
    return F.concat(F.concat_ws("\n", *lines), F.lit(MARK), text_or_empty(body))


def parse(raw: Column) -> tuple[Column, Column]:
    """(header map, body). Without a mark there is no header; of a key given twice the last value counts."""
    def header(r: Column) -> Column:
        return bind(F.instr(r, MARK), lambda at: F.when(at > 0, F.left(r, at - 1)).otherwise(F.lit("")))

    def body(r: Column) -> Column:
        return bind(F.instr(r, MARK), lambda at: F.when(at > 0, F.substring(r, at + len(MARK), F.length(r))).otherwise(r))

    def last(entry: Column) -> Column:
        later = lambda e, i: F.filter(F.slice(entry, i + 2, F.greatest(F.size(entry), F.lit(1))), lambda o: o["k"] == e["k"])
        return F.filter(entry, lambda e, i: F.size(later(e, i)) == 0)

    pairs = F.filter(F.split(bind(text_or_empty(raw), header), LINE_BREAK), lambda x: F.contains(x, F.lit(":")))
    entry = F.transform(pairs, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    return F.map_from_entries(bind(entry, last)), bind(text_or_empty(raw), body)


def index(pages: DataFrame, fields: list[str], raw: str = "raw") -> DataFrame:
    """``pages`` with the header fields and body characters, total bytes and lines."""
    header, body = parse(F.col(raw))
    out = pages.withColumns({"__h": header, "__b": body})
    return out.select(*[c for c in pages.columns if c != raw], *[F.coalesce(F.element_at("__h", f), F.lit("")).alias(f) for f in fields], F.length("__b").alias("body_char_count"),
                      F.octet_length(raw).alias("total_byte_count"), F.when(F.length("__b") == 0, 0).otherwise(F.size(F.split("__b", LINE_BREAK))).alias("line_count"))


def validate(expected: DataFrame, archive: DataFrame, key: str, fields: list[str], min_chars: int = 100, markers: tuple[str, ...] = BLOCK_MARKERS) -> DataFrame:
    """(key, status, detail): the first of missing, mismatch, soft_blocked, empty_content that applies, else skipped_exists.
    ``archive``: (key, raw)."""
    header, body = parse(F.col("raw"))
    a = archive.withColumns({"__h": header, "__b": body, "__m": first_hit(F.lower(F.left("raw", F.lit(200_000))), markers)})
    j = expected.join(a, key, "left")
    def differs(f: str) -> Column:
        cached, want = F.coalesce(F.element_at("__h", f), F.lit("")), text_or_empty(F.col(f))
        return F.when((cached != "") & (want != "") & (cached != want), F.concat(F.lit(f"{f}: cached="), cached, F.lit(" expected="), want))

    wrong = F.array_join(F.array_compact(F.array(*[differs(f) for f in fields])), "; ")
    missing = F.col("raw").isNull()
    short = F.length(strip(F.col("__b"))) < min_chars
    status = F.when(missing, "missing_cached_raw").when(wrong != "", "stale_cached_mismatch").when(F.col("__m") != "", "stale_cached_soft_blocked").when(short, "stale_cached_empty_content").otherwise("skipped_exists")
    detail = F.when(missing, "").when(wrong != "", wrong).when(F.col("__m") != "", F.col("__m")).otherwise("")
    return j.select(key, status.alias("status"), detail.alias("detail"))
