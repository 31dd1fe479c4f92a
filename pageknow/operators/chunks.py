"""Chunking: paragraphs packed to a size with overlap, chunk tables from pages and from question/answer pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageknow.functions.text import SPACES, bind, lines, text_or_empty

#: Paragraphs that are folded at a time: the chunks closed before are copied once for so many.
SLICE = 64


def pack(text: Column, size: int = 900, overlap: int = 120, bounded: bool = False) -> Column:
    """Array of chunks. A paragraph joins the current chunk while both fit in ``size``; else the chunk closes and the next
    one starts with its last ``overlap`` characters. A paragraph met with nothing open is cut once at ``size``, and one met
    after an open chunk stays whole, so a chunk can be longer than ``size``; ``bounded`` cuts those further."""
    def step(s: Column, p: Column) -> Column:
        cur, out = s["cur"], s["out"]
        both = F.when(cur == "", p).otherwise(F.concat(cur, F.lit("\n"), p))
        tail = F.ltrim(F.concat(F.right(cur, F.lit(overlap)) if overlap else F.lit(""), F.lit("\n"), p), F.lit(SPACES))
        fits = F.length(both) <= size
        new_out = F.when(fits, out).when(cur != "", F.array_append(out, cur)).otherwise(F.array_append(out, F.left(p, F.lit(size))))
        new_cur = F.when(fits, both).when(cur != "", tail).otherwise(F.substring(p, size - overlap + 1, 1 << 30))
        return F.struct(new_out.alias("out"), new_cur.alias("cur"))

    none = F.array().cast("array<string>")

    def fold(s: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(none.alias("out"), s["cur"].alias("cur")), step)
        return bind(done, lambda d: F.struct(F.when(F.size(d["out"]) > 0, F.array_append(s["out"], d["out"])).otherwise(s["out"]).alias("out"), d["cur"].alias("cur")))

    def slices(ps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(ps) - 1), F.lit(SLICE)), lambda i: F.slice(ps, i + 1, F.lit(SLICE)))

    def finish(s: Column) -> Column:
        return bind(F.flatten(s["out"]), lambda out: F.when(s["cur"] != "", F.array_append(out, s["cur"])).otherwise(out))

    zero = F.struct(F.array().cast("array<array<string>>").alias("out"), F.lit("").alias("cur"))
    packed = F.aggregate(bind(lines(text), slices), zero, fold, finish)
    if not bounded:
        return packed
    stride = size - overlap
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(c) - size) / stride)).cast("int")), lambda i: F.substring(c, i * stride + 1, F.lit(size)))
    return F.flatten(F.transform(packed, cut))


def chunk_table(docs: DataFrame, text: str = "text", size: int = 900, overlap: int = 120, bounded: bool = False) -> DataFrame:
    """One row per chunk: the other columns of ``docs``, chunk_index, text. Texts without a line give no chunk."""
    rest = [c for c in docs.columns if c not in (text, "chunk_index", "text")]
    return docs.select(*rest, F.posexplode(pack(F.col(text), size, overlap, bounded)).alias("chunk_index", "text"))


def chunk_id(*parts: Column, index: Column) -> Column:
    """Slugs of the parts and a padded number."""
    slug = [F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(p)), "[^a-z0-9]+", "_"), "^_+|_+$", "") for p in parts]
    return F.concat_ws("__", *slug, F.lpad(index.cast("string"), 4, "0"))


def qa_chunks(pairs: DataFrame) -> DataFrame:
    """(chunk_id, page_type, text, ...) from (question, answer, key columns): ``Question: ..`` and ``Answer: ..`` in one chunk.
    Pairs without a question or an answer are left out."""
    q, a = F.trim(text_or_empty(F.col("question"))), F.trim(text_or_empty(F.col("answer")))
    rest = [c for c in pairs.columns if c not in ("question", "answer", "chunk_id", "page_type", "chunk_index", "text")]
    key = F.left(F.sha1(F.concat_ws("|", *[text_or_empty(F.col(c)) for c in rest], q)), F.lit(12))
    return pairs.where((q != "") & (a != "")).select(
        *rest, F.concat(F.lit("qa__"), key).alias("chunk_id"), F.lit("faq_cleaned").alias("page_type"), F.lit(0).alias("chunk_index"),
        F.concat(F.lit("Question: "), q, F.lit("\nAnswer: "), a).alias("text"),
    )
