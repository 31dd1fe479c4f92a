"""Queries: chunking and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageknow.functions.lexicon import INDEX_STOPWORDS, SEARCH_STOPWORDS
from pageknow.functions.text import terms
from pageknow.operators import chunks as C
from pageknow.operators import dense_index as D
from pageknow.operators import prompts as P
from pageknow.operators import retrieval as R
from pageknow.operators import term_index as T
from pageknow.operators import words as W_
from pageknow.plans.common import documents, quoted, scratch, sql_chunks, sql_index_terms, sql_squeeze, sql_terms, sql_truncate, table
from pageknow.sources.commits import written

KEY = ["doc_id", "chunk_index"]
#: A dictionary of search expansions drawn from the prose of the driver tables.
DICTIONARY = (("the ", "thing other"), ("que ", "which that"), ("und ", "and also"), ("erth", "earth ground"), ("ción", "tion action"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_table(documents(spark, sf_dir).select("doc_id", "lang", "source", "text"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame(DICTIONARY, "key string, expansion string")
    return R.expand_queries(table(spark, sf_dir, "benchmark"), d, ("entry permit",)).withColumnRenamed("item_id", "query_id")


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = documents(spark, sf_dir).select("doc_id", terms(F.col("text"), SEARCH_STOPWORDS).alias("a"), terms(F.col("text"), INDEX_STOPWORDS, digits=False).alias("b"))
    return t.select("doc_id", F.size("a").alias("n_search"), F.size(F.array_distinct("a")).alias("n_distinct"), F.size("b").alias("n_index"), F.md5(F.array_join("a", " ")).alias("terms_md5"))


def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark, sf_dir).select("query_id", F.array_join("terms", " ").alias("terms"))


def _keyed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).withColumn("chunk_key", F.concat_ws("_", F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lpad(F.col("chunk_index").cast("string"), 6, "0"))).withColumn("page_type", F.when(F.col("lang") == "en", "faq").otherwise("page"))


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _keyed_chunks(spark, sf_dir)
    q = _queries(spark, sf_dir).withColumn("want", F.concat(F.lit("SRC"), (F.col("query_id") % 20).cast("string")))
    return R.keyword_search(q, c, k=5, min_score=2.0, filters={"want": ("source", 4.0)}, part="doc_id")


def sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = R.sparse_index(_chunks(spark, sf_dir), KEY)
    return x.select(*KEY, "term", "tf")


def sparse_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = R.sparse_index(_chunks(spark, sf_dir), KEY)
    q = R.sparse_index(table(spark, sf_dir, "benchmark"), ["item_id"])
    return R.cosine_topk(q, index, "item_id", KEY, 5)


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hash_embed(documents(spark, sf_dir), ["doc_id"]).select("doc_id", "slot", F.round("weight", 6).alias("weight"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return R.dense_topk(v, v.where("vec_id % 50 = 0"), 5, match="label")


def dense_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of the same label, by the stored hash index."""
    v, root = table(spark, sf_dir, "embeddings"), scratch(spark, "dense-index")
    D.build(v, root, metadata=("label",))
    return D.search(spark, root, v.where("vec_id % 50 = 0"), 5, match="label")


def term_index_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``sparse_cosine_topk``, by the stored index."""
    root = scratch(spark, "cosine-index")
    T.write_cosine(R.sparse_index(_chunks(spark, sf_dir), KEY), root, KEY)
    q = T.cosine_queries(R.sparse_index(table(spark, sf_dir, "benchmark"), ["item_id"]), "item_id")
    return T.search(spark, root, q, KEY, 5, 1e-6).select(F.col("id").alias("item_id"), "rank", *KEY, "score")


def term_index_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``keyword_search``, by the stored index."""
    root, key = scratch(spark, "keyword-index"), ["chunk_index", "chunk_key"]
    T.write_keywords(_keyed_chunks(spark, sf_dir), root, key, ("source",))
    q = _queries(spark, sf_dir).withColumn("want", F.concat(F.lit("SRC"), (F.col("query_id") % 20).cast("string")))
    got = T.search(spark, root, T.keyword_queries(q, wanted=("want",)), key, 5, 2.0, (4.0,))
    return got.select(F.col("id").alias("query_id"), "rank", "chunk_key", "chunk_index", "score", "matched")


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark passages, labelled by their first letter, numbered in alphabetical order."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(terms(F.col("text"), SEARCH_STOPWORDS)).alias("word")).distinct()
    return w.select(F.left("word", F.lit(1)).alias("label"), "word", F.conv(F.hex(F.left("word", F.lit(2))), 16, 10).cast("int").alias("seq"))


def word_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the lexicon that are in each document."""
    d = documents(spark, sf_dir).select("doc_id", F.lower("text").alias("text"))
    got = W_.find(d, _lexicon(spark, sf_dir))
    return got.select("doc_id", F.size("found").alias("n_words"), F.md5(F.array_join("found", " ")).alias("words_md5"))


def word_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label with the most words in each document, and the first one."""
    d = documents(spark, sf_dir).select("doc_id", F.lower("text").alias("text"))
    h = W_.label_hits(d, _lexicon(spark, sf_dir), ["doc_id"])
    return h.groupBy("doc_id").agg(F.max(F.struct("hits", "label")).alias("m"), F.min(F.struct("first", "label")).alias("f"), F.sum("hits").alias("hits")).select("doc_id", F.col("m.label").alias("label"), F.col("m.hits").alias("label_hits"), F.col("f.label").alias("first_label"), "hits")


def query_expand_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with a dictionary of all part and customer words, of any size: a key is in the text or not."""
    parts = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("key"))
    keys = parts.unionAll(_lexicon(spark, sf_dir).select("word")).distinct().where("length(key) > 2")
    d = keys.select("key", F.concat(F.lit("x"), F.left(F.md5("key"), F.lit(6))).alias("expansion"))
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    got = R.expand_queries(q, d, few_keys=0)
    return got.select("conv_id", "turn", F.size("terms").alias("n_terms"), F.md5(F.array_join("terms", " ")).alias("terms_md5"))


def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic hits of at least 0.2, with keyword hits for the passages that have none."""
    hits = written(sparse_cosine_topk(spark, sf_dir), "hits")  # used twice
    first = hits.where("score >= 0.2").select(F.col("item_id").alias("query_id"), "rank", F.concat_ws("_", F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lpad(F.col("chunk_index").cast("string"), 6, "0")).alias("chunk_key"), "score")
    return R.with_fallback(first, keyword_search(spark, sf_dir).select("query_id", "rank", "chunk_key", "score"))


def _qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    nxt = c.withColumns({"answer": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    return nxt.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def chunk_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.qa_chunks(_qa(spark, sf_dir)).select("conv_id", "turn", "chunk_id", "page_type", F.md5("text").alias("text_md5"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = sparse_cosine_topk(spark, sf_dir)
    src = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("https://docs.example/"), "source", F.lit("/"), "lang").alias("url"))
    return P.citations(hits.join(src, "doc_id"), "item_id", "rank", "url", 6).select("item_id", F.array_join("urls", " ").alias("urls"))


def prompt_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = written(sparse_cosine_topk(spark, sf_dir), "hits")
    d = documents(spark, sf_dir).select("doc_id", "source", "text").join(best.select("doc_id").distinct(), "doc_id", "left_semi")  # only these are cut again
    hits = best.join(C.chunk_table(d), KEY)
    q = table(spark, sf_dir, "benchmark")
    return P.assemble(q, hits.withColumnRenamed("text", "chunk"), "item_id", "text", "rank", "source", "chunk", 10, 900).select("item_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("n_chars"))


QUERIES = {f.__name__: f for f in (chunk_documents, tokenize_terms, query_expand, keyword_search, sparse_index, sparse_cosine_topk, hash_embed, dense_topk, dense_index_topk, term_index_cosine, term_index_keyword, word_find, word_labels, query_expand_large, hybrid_retrieve, chunk_qa, citations, prompt_assemble)}

CHUNKS = "WITH RECURSIVE " + sql_chunks("documents")
INDEX = f"""
  pos AS (SELECT k, chunk_index, unnest(range(0, len(t))) AS pos, unnest(t) AS term FROM (SELECT k, chunk_index, {sql_index_terms('text')} AS t FROM chunks)),
  tf AS (SELECT k, chunk_index, term, count(*) AS tf, min(pos) AS pos FROM pos GROUP BY ALL),
  ix AS (SELECT k AS doc_id, chunk_index, term, tf FROM tf QUALIFY row_number() OVER (PARTITION BY k, chunk_index ORDER BY tf DESC, pos) <= 80),
  qp AS (SELECT item_id, unnest(range(0, len(t))) AS pos, unnest(t) AS term FROM (SELECT item_id, {sql_index_terms('text')} AS t FROM benchmark)),
  qf AS (SELECT item_id, term, count(*) AS tf, min(pos) AS pos FROM qp GROUP BY ALL),
  qx AS (SELECT item_id, term, tf FROM qf QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY tf DESC, pos) <= 80),
  dot AS (SELECT item_id, doc_id, chunk_index, sum(q.tf * c.tf) AS d FROM qx q JOIN ix c USING (term) GROUP BY ALL),
  nq AS (SELECT item_id, sqrt(sum(tf * tf)) AS n FROM qx GROUP BY ALL), nc AS (SELECT doc_id, chunk_index, sqrt(sum(tf * tf)) AS n FROM ix GROUP BY ALL),
  cosine AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(d / (nq.n * nc.n), 6) DESC, doc_id, chunk_index) AS INT) AS rank, doc_id, CAST(chunk_index AS INT) AS chunk_index, round(d / (nq.n * nc.n), 6) AS score
    FROM dot JOIN nq USING (item_id) JOIN nc USING (doc_id, chunk_index) QUALIFY rank <= 5
  )"""
EXPAND = f"""
  dict(key, expansion) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in DICTIONARY)}),
  qe AS (
    SELECT item_id AS query_id, list_sort(list_distinct(list_concat({sql_terms('b.text')}, coalesce((SELECT flatten(list({sql_terms('expansion')})) FROM dict d WHERE contains(lower(b.text), lower(d.key))), []),
      CASE WHEN contains(lower(b.text), 'entry permit') THEN ['entry', 'permit'] ELSE [] END))) AS terms FROM benchmark b
  )"""
KEYWORD = f"""
  kc AS (SELECT lpad(CAST(k AS VARCHAR), 12, '0') || '_' || lpad(CAST(chunk_index AS VARCHAR), 6, '0') AS chunk_key, CAST(chunk_index AS INT) AS chunk_index, lang, source, unnest(list_distinct({sql_terms('c.text')})) AS term FROM chunks c JOIN documents d ON d.doc_id = c.k),
  kq AS (SELECT query_id, 'SRC' || (query_id % 20) AS want, unnest(terms) AS term FROM qe),
  kg AS (SELECT query_id, chunk_key, chunk_index, count(*) AS matched, count(*) FILTER (term IN ('visa', 'permit', 'deposit', 'tuition', 'registration', 'housing')) AS high, any_value(lang) AS lang, any_value(lower(source) = lower(want)) AS same FROM kc JOIN kq USING (term) GROUP BY ALL),
  ks AS (SELECT *, round(matched + 0.4 * high + CASE WHEN same THEN 4 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.3 ELSE 0 END, 6) AS score FROM kg),
  kr AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index, chunk_key) AS INT) AS rank, chunk_key, chunk_index, CAST(score AS DOUBLE) AS score, matched FROM ks WHERE score >= 2 QUALIFY rank <= 5)"""
QA = "qa AS (SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) WHERE role = 'user' AND nr = 'assistant')"

def _dense_index_sql(most_bits: int = 13) -> str:
    """The index search in SQL, with the planes as literals: of ``most_bits`` a table, which are enough for 500,000 rows."""
    p = D.Params()
    planes = [[[int(x) for x in plane] for plane in table_] for table_ in D.plane_signs(p.tables, most_bits, 64)]
    return f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        n AS (SELECT greatest({D.LEAST_BITS}, CAST(floor(log2(greatest(count(*) // {p.bucket_rows}, 1))) AS INT)) AS bits FROM v),
        pl AS (SELECT t, unnest(ps) AS plane, unnest(range(0, {most_bits})) AS j FROM (SELECT unnest(range(0, {p.tables})) AS t, unnest(CAST({planes} AS DOUBLE[][][])) AS ps)),
        sd AS (SELECT vec_id, label, t, list(list_dot_product(v, plane) ORDER BY j) AS s FROM v, pl, n WHERE j < bits GROUP BY vec_id, label, t),
        c AS (SELECT *, CAST(list_sum(list_transform(s, lambda x, i: CASE WHEN x >= 0 THEN 1 << (i - 1) ELSE 0 END)) AS BIGINT) AS code FROM sd),
        near AS (SELECT *, list_sort(list_transform(s, lambda x, i: {{'a': abs(x), 'j': i - 1}}))[1:{D.CROSSED}] AS o FROM c WHERE vec_id % 50 = 0),
        sub AS (SELECT vec_id, label, t, code, list_filter(list_transform(o, lambda e, i: CASE WHEN (m >> (i - 1)) & 1 = 1 THEN e END), lambda e: e IS NOT NULL) AS f, m FROM near, range(0, {1 << D.CROSSED}) r(m) WHERE m < 1 << len(o)),
        pr AS (SELECT vec_id AS query_id, label, t, code + coalesce(CAST(list_sum(list_transform(f, lambda e: CASE WHEN (code >> e.j) & 1 = 1 THEN -(1 << e.j) ELSE 1 << e.j END)) AS BIGINT), 0) AS code FROM sub
          QUALIFY row_number() OVER (PARTITION BY vec_id, label, t ORDER BY coalesce(list_sum(list_transform(f, lambda e: e.a * e.a)), 0), m) <= {p.probes}),
        k AS (SELECT DISTINCT query_id, c.vec_id FROM pr JOIN c USING (t, code) WHERE pr.label = c.label AND c.vec_id <> query_id),
        s AS (SELECT query_id, k.vec_id, round(1 / (1 + list_sum(list_transform(list_zip(x.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS score FROM k JOIN v x ON x.vec_id = k.vec_id JOIN v q ON q.vec_id = query_id)
        SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 5"""


LEXICON = f"""lx AS (SELECT DISTINCT unnest({sql_terms('text')}) AS word FROM benchmark), lb AS (SELECT left(word, 1) AS label, word, CAST('0x' || hex(left(word, 2)) AS INT) AS seq FROM lx)"""

ORACLES = {
    "word_find": f"WITH {LEXICON}, h AS (SELECT doc_id, list(word ORDER BY word) AS l FROM documents JOIN lb ON contains(lower(text), word) GROUP BY doc_id) SELECT doc_id, CAST(coalesce(len(l), 0) AS INT) AS n_words, md5(coalesce(array_to_string(l, ' '), '')) AS words_md5 FROM documents LEFT JOIN h USING (doc_id)",
    "word_labels": f"""WITH {LEXICON}, h AS (SELECT doc_id, label, count(*) AS n, min(seq) AS f FROM documents JOIN lb ON contains(lower(text), word) GROUP BY ALL)
        SELECT doc_id, max({{'n': n, 'l': label}}).l AS label, max({{'n': n, 'l': label}}).n AS label_hits, min({{'f': f, 'l': label}}).l AS first_label, CAST(sum(n) AS BIGINT) AS hits FROM h GROUP BY doc_id""",
    "query_expand_large": f"""WITH {LEXICON}, k AS (SELECT DISTINCT key FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS key FROM part UNION ALL SELECT word FROM lx) WHERE length(key) > 2),
        h AS (SELECT conv_id, turn, text, list('x' || left(md5(key), 6)) FILTER (key IS NOT NULL) AS x FROM conversations LEFT JOIN k ON contains(lower(text), key) GROUP BY ALL),
        e AS (SELECT conv_id, turn, list_sort(list_distinct(list_concat({sql_terms('text')}, coalesce(x, [])))) AS t FROM h) SELECT conv_id, turn, CAST(len(t) AS INT) AS n_terms, md5(array_to_string(t, ' ')) AS terms_md5 FROM e""",
    "dense_index_topk": _dense_index_sql(),
    "term_index_cosine": f"{CHUNKS}, {INDEX} SELECT * FROM cosine",
    "term_index_keyword": f"{CHUNKS}, {EXPAND}, {KEYWORD} SELECT * FROM kr",
    "chunk_documents": f"{CHUNKS} SELECT k AS doc_id, CAST(chunk_index AS INT) AS chunk_index, CAST(length(text) AS INT) AS n_chars, md5(text) AS text_md5 FROM chunks",
    "tokenize_terms": f"SELECT doc_id, CAST(len(a) AS INT) AS n_search, CAST(len(list_distinct(a)) AS INT) AS n_distinct, CAST(len(b) AS INT) AS n_index, md5(array_to_string(a, ' ')) AS terms_md5 FROM (SELECT doc_id, {sql_terms('text')} AS a, {sql_index_terms('text')} AS b FROM documents)",
    "query_expand": f"WITH {EXPAND} SELECT query_id, array_to_string(terms, ' ') AS terms FROM qe",
    "keyword_search": f"{CHUNKS}, {EXPAND}, {KEYWORD} SELECT * FROM kr",
    "sparse_index": f"{CHUNKS}, {INDEX} SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, term, tf FROM ix",
    "sparse_cosine_topk": f"{CHUNKS}, {INDEX} SELECT * FROM cosine",
    "hash_embed": f"""WITH t AS (SELECT doc_id, unnest({sql_index_terms('text')}) AS term FROM documents), n AS (SELECT doc_id, CAST(CAST('0x' || left(md5(term), 8) AS BIGINT) % 64 AS INT) AS slot, count(*) AS n FROM t GROUP BY ALL)
        SELECT doc_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM n""",
    "dense_topk": """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q, label FROM embeddings WHERE vec_id % 50 = 0),
        s AS (SELECT query_id, vec_id, round(1 / (1 + list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS score FROM embeddings e JOIN q ON e.label = q.label AND e.vec_id <> q.query_id)
        SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 5""",
    "hybrid_retrieve": f"""{CHUNKS}, {INDEX}, {EXPAND}, {KEYWORD},
        f AS (SELECT item_id AS query_id, rank, lpad(CAST(doc_id AS VARCHAR), 12, '0') || '_' || lpad(CAST(chunk_index AS VARCHAR), 6, '0') AS chunk_key, score FROM cosine WHERE score >= 0.2)
        SELECT *, 'semantic' AS origin FROM f UNION ALL SELECT query_id, rank, chunk_key, score, 'keyword' FROM kr WHERE query_id NOT IN (SELECT query_id FROM f)""",
    "chunk_qa": f"""WITH {QA} SELECT conv_id, turn, 'qa__' || left(sha1(conv_id || '|' || turn || '|' || trim(question)), 12) AS chunk_id, 'faq_cleaned' AS page_type, md5('Question: ' || trim(question) || chr(10) || 'Answer: ' || trim(answer)) AS text_md5 FROM qa WHERE trim(question) <> '' AND trim(answer) <> ''""",
    "citations": f"""{CHUNKS}, {INDEX}, u AS (SELECT item_id, 'https://docs.example/' || source || '/' || lang AS url, min(rank) AS r FROM cosine JOIN documents USING (doc_id) GROUP BY ALL)
        SELECT item_id, array_to_string(list(url ORDER BY r)[1:6], ' ') AS urls FROM u GROUP BY item_id""",
    "prompt_assemble": f"""{CHUNKS}, {INDEX}, b AS (SELECT item_id, rank, '[' || rank || '] (' || source || ') ' || {sql_truncate('c.text', 900)} AS block FROM cosine JOIN chunks c ON c.k = doc_id AND c.chunk_index = cosine.chunk_index JOIN documents USING (doc_id)),
        p AS (SELECT item_id, 'Question: ' || {sql_squeeze('q.text')} || chr(10) || 'Evidence:' || chr(10) || coalesce((SELECT string_agg(block, chr(10) ORDER BY rank) FROM b WHERE b.item_id = q.item_id), '(none)') || chr(10) || 'Answer from the evidence only and cite it by number.' AS prompt FROM benchmark q)
        SELECT item_id, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INT) AS n_chars FROM p""",
}
assert QUERIES.keys() == ORACLES.keys(), quoted(QUERIES.keys() ^ ORACLES.keys())
