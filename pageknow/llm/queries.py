"""Registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageknow.llm.common import materialize, table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageknow.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pageknow.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageknow.llm import quality
    from pageknow.llm.toxicity import fold, training_rows

    docs, labels, p = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality.Params()
    model = quality.train(training_rows(docs, labels, "quality", 5, 0, p.max_train_rows), p)
    scored = quality.mark_by_quantile(quality.score(docs, model, keep=["doc_id"]), p)
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "above_quantile")


def op4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageknow.llm.paragraphs import dedup_paragraphs

    out = dedup_paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_removed", "removed_words", "kept_doc_ids", F.length("text").alias("n_chars_left"), "text")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageknow.llm.mixing import mix, word_count

    docs = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words")), "mix-sizes")
    mixed = mix(docs, size=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageknow.llm import toxicity

    docs, labels, p = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.Params()
    model = toxicity.train(toxicity.training_rows(docs, labels, "toxic", 3, 1, p.max_train_rows), p)
    held = F.coalesce(toxicity.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageknow.llm.embed_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageknow.llm.ngram_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op9_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch 1 inserts every document, counted by tokenizer 1; batch 2 counts the English ones again with tokenizer 2;
    batch 3 deletes those labelled toxic; batch 2 is then played again, which changes nothing."""
    from pageknow.llm.common import scratch_path
    from pageknow.llm.rollups import commit, signed, totals

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    english = F.col("lang") == "en"
    one = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    two = F.coalesce(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]")), F.lit(0))
    counted = materialize(docs.select("doc_id", "source", "lang", one.alias("one"), F.when(english, two).alias("two")), "rollup-counts")
    old = F.struct("source", "lang", F.lit("words-1").alias("tokenizer"), F.col("one").alias("tokens")).alias("o")
    new = F.struct("source", "lang", F.lit("words-marks-2").alias("tokenizer"), F.col("two").alias("tokens")).alias("n")
    inserted = counted.select(old).select("o.*")
    revised = counted.where(english).select(old, new).select("n.*", *[F.col(f"o.{c}").alias(f"old_{c}") for c in ("source", "lang", "tokenizer", "tokens")])
    gone = labels.where("toxic = 1").select("doc_id").distinct()
    now = F.when(english, F.struct("n.*")).otherwise(F.struct("o.*"))
    deleted = counted.join(gone, "doc_id", "left_semi").select("lang", old, new).select(now.alias("x")).select("x.*")
    root = scratch_path(spark, "rollups")
    commit(signed(inserted=inserted), root, 1)
    commit(signed(revised=revised), root, 2)
    commit(signed(deleted=deleted), root, 3)
    commit(signed(revised=revised), root, 2)
    return totals(spark, root)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageknow.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pageknow.llm.packing import CRC32, pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id",), payload=CRC32)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageknow.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageknow.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_html": op1_html, "op2_bpe": op2_bpe, "op3_quality": op3_quality, "op4_paragraphs": op4_paragraphs, "op5_mixing": op5_mixing, "op6_toxicity": op6_toxicity, "op7_embeddings": op7_embeddings, "op8_ngram_join": op8_ngram_join, "op9_rollups": op9_rollups, "op10_ann": op10_ann}
QUERIES |= {"op11_packing": op11_packing, "op12_divergence": op12_divergence, "op13_whitening": op13_whitening}

OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g
  FROM (SELECT doc_id, coalesce(ws, []) AS ws FROM w)
), e AS (SELECT doc_id, unnest(g) AS g FROM s),
n AS (SELECT doc_id, len(g) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, d.b FROM r JOIN d ON r.v = d.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.v) AS component_id FROM n JOIN r ON r.u = n.doc_id GROUP BY 1, 2
"""

OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.b FROM r JOIN l ON r.v = l.a),
c AS (SELECT u AS vec_id, min(v) AS component_id FROM r GROUP BY u),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

OP9_SQL = r"""
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens FROM (
  SELECT source, lang, CASE WHEN lang = 'en' THEN 'words-marks-2' ELSE 'words-1' END AS tokenizer,
    CASE WHEN lang = 'en' THEN len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]')) ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS tokens
  FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)
) GROUP BY ALL
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), e AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM e GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM e JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
m AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (
  SELECT m.lang, m.source, k.term, coalesce(n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1) // (total + v) AS p
  FROM m JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term
), q AS (
  SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (sum(n) + 1) // (max(total) + max(v)) AS q
  FROM c JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY 1) USING (lang) JOIN v USING (lang) GROUP BY 1, 2
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS f
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3
  ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= 200
"""

ORACLES: dict[str, str] = {"op7_embeddings": OP7_SQL, "op8_ngram_join": OP8_SQL, "op9_rollups": OP9_SQL, "op12_divergence": OP12_SQL}
