"""Steps that must not put much data in one task or shuffle what is derived from a text."""

import re

from pyspark.sql import functions as F

from pageknow.functions.text import SPACES, WS, strip
from pageknow.operators import retrieval as R
from pageknow.operators import term_index as T
from pageknow.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def keys_of_exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))


def test_index_rows_of_one_length_are_spread(spark, tmp_path):
    chunks = spark.range(4_000).select(F.col("id").alias("doc"), F.concat(F.lit("word number "), F.hex("id"), F.lit("xx")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        T.write_keywords(chunks, str(tmp_path), ["doc"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = [r["count"] for r in spark.read.parquet(f"{tmp_path}/rows/attempts/*").groupBy(F.input_file_name()).count().collect()]
    assert sum(n) == 4_000 and max(n) < 2_000


def test_terms_of_documents_are_counted_where_they_are(spark):
    assert [k.split("#")[0] for k in keys_of_exchanges(QUERIES["sparse_index"](spark, SF))] == ["doc_id"]


def test_chunks_are_scored_where_they_are(spark):
    for name in ("sparse_cosine_topk", "keyword_search"):
        keys = keys_of_exchanges(QUERIES[name](spark, SF))
        assert not any(k.startswith(("term#", "chunk_key#")) or ("doc_id#" in k and "," in k.rsplit(", ", 1)[0]) for k in keys), keys


def test_first_scores_only_save_work(spark):
    """With and without the chunks that are scored first, also where those hold fewer than k hits."""
    q = spark.createDataFrame([(1, ["aa", "bb", "cc"]), (2, ["zz"])], "query_id long, terms array<string>")
    words = ["aa bb cc", "aa bb", "aa", "zz", "none"]
    rows = [(f"d{i // 2}", f"d{i // 2}_{i % 2}", i % 2, words[i * 7 % 5] if i % 9 else "zz aa") for i in range(800)]
    c = spark.createDataFrame(rows, "doc string, chunk_key string, chunk_index int, text string")
    for k in (3, 100, 900):
        want = R.keyword_search(q, c, k).collect()
        assert len(want) > k or k == 900
        assert sorted(R.keyword_search(q, c, k, part="doc").collect()) == sorted(want)


def test_strip_takes_off_what_the_class_of_white_space_takes_off(spark):
    df = spark.createDataFrame([(chr(i) + "a b" + chr(i),) for i in range(1, 0x3100)] + [(SPACES + "a" + SPACES,), ("",), (None,)], "x string")
    assert df.where(~strip(F.col("x")).eqNullSafe(F.regexp_replace("x", f"^{WS}+|{WS}+$", ""))).count() == 0


def test_evidence_is_read_once_for_counts_and_values(spark):
    """Once for the evidence and once for the decisions."""
    assert plan(QUERIES["enrich_entities"](spark, SF)).count("l_orderkey#") > 0
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan(QUERIES["enrich_entities"](spark, SF)))) == 2


def test_texts_are_dealt_before_they_are_searched(spark):
    for name in ("pattern_extract", "word_find", "word_labels"):
        assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, SF)), name


def test_archived_pages_are_kept_in_bundles(spark, tmp_path):
    """A file for many pages, whatever characters a page holds."""
    from pageknow.sources import archive as A

    raw = ["", None, "url: u\n---\nbody", "a\x1eb\x10c\x10r\x10p\n\n", "\r\nx\r", "\x1e", "\x10", "no mark", "ü  \n"]
    rows = [(f"p{i}\x1e", raw[i % len(raw)]) for i in range(3_000)]
    A.write_bundles(spark.createDataFrame(rows, "raw_file string, raw string").repartition(4), f"{tmp_path}/b")
    assert len([p for p in (tmp_path / "b").iterdir() if p.suffix == ".txt"]) == 4
    assert sorted(map(tuple, A.read_bundles(spark, f"{tmp_path}/b").collect())) == sorted((n, r or "") for n, r in rows)


def test_archive_read_writes_no_folder_a_page(spark):
    files = QUERIES["archive_read"](spark, SF).inputFiles()
    assert files and not any("page_id=" in f for f in files)


def test_users_are_dealt_before_they_become_tasks(spark):
    """Tasks of users are grouped in parts of bounded size, so no exchange stands between the users and their tasks' groups."""
    found = plan(QUERIES["reminders"](spark, SF))
    assert "REPARTITION_BY_NUM" in found
    assert not any(re.search(r"task_(id|code)#", k) and "c_custkey" in k for k in keys_of_exchanges(QUERIES["reminders"](spark, SF)))


def sent_to_driver(spark, group, run):
    """Bytes of results that the tasks of ``run`` sent to the driver."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).resultSize() for s in stages)


def many_texts(spark):
    """2,000 texts of about 10 KB in eight parts."""
    words = F.transform(F.sequence(F.lit(0), F.lit(1_200)), lambda i: F.concat(F.lit("w"), F.pmod(F.col("id") * 31 + i * i, F.lit(4_000)).cast("string"), F.lit("xx")))
    return spark.range(0, 2_000, 1, 8).select("id", F.array_join(words, " ").alias("text"))


def test_texts_that_are_searched_do_not_reach_the_driver(spark):
    from pageknow.operators import words as W

    texts = many_texts(spark)
    lexicon = spark.range(0, 4_000, 7).select(F.concat(F.lit(" w"), F.col("id").cast("string"), F.lit("xx")).alias("word"))
    for most in (300_000, 10):
        out = []
        sent = sent_to_driver(spark, f"find-{most}", lambda most=most, out=out: out.append(W.find(texts, lexicon, task_words=most)))
        assert sent < 2_000_000, sent
        r = out[0].where("id = 17").first()
        assert r.found == sorted({f" w{(17 * 31 + i * i) % 4_000}xx" for i in range(1, 1_201) if (17 * 31 + i * i) % 4_000 % 7 == 0})


def test_texts_that_are_labelled_do_not_reach_the_driver(spark):
    from pageknow.operators import words as W

    lexicon = spark.range(0, 4_000, 7).select(F.concat(F.lit("l"), F.pmod("id", F.lit(3)).cast("string")).alias("label"), F.concat(F.lit(" w"), F.col("id").cast("string"), F.lit("xx")).alias("word"), F.col("id").cast("int").alias("seq"))
    out = []
    sent = sent_to_driver(spark, "labels", lambda: out.append(W.label_hits(many_texts(spark), lexicon, ["id"])))
    assert sent < 2_000_000, sent
    held = {(17 * 31 + i * i) % 4_000 for i in range(1, 1_201)}
    of = {f"l{k}": [w for w in held if w % 7 == 0 and w % 3 == k] for k in range(3)}
    assert {(r.label, r.hits, r.first) for r in out[0].where("id = 17").collect()} == {(k, len(v), min(v)) for k, v in of.items() if v}
