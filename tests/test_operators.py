"""Operators on the literal fixtures of the survey, and twins in plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pageknow.functions import lexicon as L
from pageknow.functions import text as X
from pageknow.operators import agenda, chunks, enrich, evidence, fetchlog, intent, pages, planning, qa, retrieval, review, state
from pageknow.operators import prompts
from pageknow.sources import archive, tables
from pageknow.streaming import incremental


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) and not isinstance(v, bool) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_clean_html(spark):
    html = "<html><head><title> A  page </title></head><body><nav>Menu</nav><script>x</script><main><h1>Hi</h1><p>Hi</p><p>Visa &amp; more</p></main><footer>f</footer></body></html>"
    assert one(spark, pages.clean_html(F.col("h")), h=html) == "Hi\nVisa & more"
    assert one(spark, pages.page_title(F.col("h")), h=html) == "A page"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<div class='cookie-bar'><p>c</p></div><p>a<b>b</b>")], "page_id int, html string")
    assert [r.text for r in pages.clean_html_exact(df).collect()] == ["Hi\nVisa & more", "", "a\nb"]


def test_links(spark):
    html = "<main>See <a href='/visa/documents'>here</a> or <a href='#collapse-24'>What is it?</a> or <a href='mailto:a@b'>mail</a></main>"
    got = one(spark, pages.html_with_links(F.col("h"), F.lit("https://example.edu.hk/faq")), h=html)
    assert "here (https://example.edu.hk/visa/documents)" in got and "#collapse-24" not in got and "mailto" not in got and "What is it?" in got
    for href, want in (("x.html", "https://e.hk/a/x.html"), ("//h/x", "https://h/x"), ("?q=1", "https://e.hk/a/b?q=1"), ("http://o/", "http://o/")):
        assert one(spark, pages.resolve(F.col("h"), F.lit("https://e.hk/a/b")), h=href) == want


def test_pasted_text_and_blocks(spark):
    assert one(spark, pages.repair_pasted(F.col("t")), t="whatâ€™s next?\n\n\nAnswer\nAnswer\n\n") == "what’s next?\n\nAnswer"
    assert one(spark, pages.block_marker(F.col("t")), t="<title>Just a moment...</title>") == "just a moment..."
    assert one(spark, pages.fetch_outcome(F.col("t"), F.lit("https://a/x.PDF")), t="") == "pdf"
    assert one(spark, pages.raw_filename(F.lit("HKU"), F.lit("Visa page"), F.col("u")), u="https://a").startswith("hku__visa_page__")


def test_archive(spark):
    raw = "school: HKUST\nschool: HKU\nnote: a: b\n---\nOne sentence on visas."
    h, b = archive.parse(F.col("r"))
    assert one(spark, h, r=raw) == {"school": "HKU", "note": "a: b"} and one(spark, b, r=raw) == "One sentence on visas."
    assert one(spark, archive.parse(F.col("r"))[1], r="no header") == "no header"


def test_strict_and_lenient_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    with pytest.raises(ValueError, match="missing required columns: z"):
        tables.require(df, ["x", "z"])
    assert tables.conform(df, ["y", "z"]).first().asDict() == {"y": "", "z": ""}
    assert tables.scan_lenient(spark, str(tmp_path / "none"), ["a", "b"]).count() == 0
    tables.write_stage(df, str(tmp_path / "t"), ["x", "y"], "csv")
    assert tables.scan_lenient(spark, str(tmp_path / "t"), ["x", "q"]).first().asDict() == {"x": "a", "q": ""}
    reg = spark.createDataFrame([(" https://a ", "2", "YES"), ("ftp://b", "", None)], "url string, priority string, need_dynamic string")
    assert [tuple(r) for r in tables.validate_registry(reg).collect()] == [("https://a", 2, "yes", True), ("ftp://b", 3, "", False)]


def split_plain(text, size=900, overlap=120):
    out, cur = [], ""
    for p in [x.strip() for x in text.splitlines() if x.strip()]:
        both = f"{cur}\n{p}".strip() if cur else p
        if len(both) <= size:
            cur = both
        elif cur:
            out.append(cur)
            cur = f"{cur[-overlap:] if overlap else ''}\n{p}".strip()
        else:
            out.append(p[:size])
            cur = p[size - overlap :]
    return out + ([cur] if cur else [])


def test_chunks_twin(spark):
    rng = random.Random(1)
    texts = [None, "", " \n ", *["\n".join("w" * rng.randrange(1, 90) for _ in range(rng.randrange(40))) for _ in range(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.c for r in df.select("i", chunks.pack(F.col("text"), 100, 20).alias("c")).collect()}
    assert got == {i: split_plain(t or "", 100, 20) for i, t in enumerate(texts)}
    most = df.select(F.explode(chunks.pack(F.col("text"), 100, 20, bounded=True)).alias("c")).agg(F.max(F.length("c"))).first()[0]
    assert most <= 100


def test_question_pairs(spark):
    text = "Who needs a student visa?\nAll non-local students need one before arrival.\nSupporting Documents\nApply early, please.\nHow can I apply for accommodation?\nUse the online form of the housing office."
    got = qa.extract_pairs(spark.createDataFrame([(1, text)], "d int, text string"), "d").orderBy("pos").collect()
    assert [(r.question, r.answer) for r in got] == [("Who needs a student visa?", "All non-local students need one before arrival. Apply early, please."), ("How can I apply for accommodation?", "Use the online form of the housing office.")]
    long = "What is this?\n" + "\n".join(f"line number {i} of the answer" for i in range(40))
    assert one(spark, F.size(F.split("a", "line number")), a=qa.extract_pairs(spark.createDataFrame([(1, long)], "d int, text string"), "d").first().answer) - 1 == 14


def test_pair_quality(spark):
    good = "You can apply online through the admission system after receiving the offer letter from us. Fill in every field."
    rows = [("Q1: How can I apply?", good, "HKU", 1), ("How can I apply?", good, "hku", 2), ("where bachelor's degree holders may apply for", good, "HKU", 3), ("Why HKBU (https://a.hk)", good, "HKBU", 4), ("如何申请？", good, "HKU", 5), ("是否需要？", good, "HKU", 6)]
    df = spark.createDataFrame([(*r, "https://a") for r in rows], "question string, answer string, school string, n int, source_url string")
    got = {r.n: r for r in qa.score_pairs(df, "school", ["n"]).collect()}
    assert got[1].decision == "keep" and got[2].decision == "reject" and got[2].quality_score == 40 and "duplicate_question_for_school" in got[2].quality_notes
    assert got[3].decision == "reject" and "question_fragment" in got[3].quality_notes and got[4].decision == "reject"
    assert "duplicate" not in got[6].quality_notes
    assert qa.kept(qa.score_pairs(df, "school", ["n"])).first().question == "How can I apply?"


def test_evidence(spark):
    rows = [
        (1, "When should I apply for the visa?", "Submit the student visa application form no later than mid-July. Prepare passport and bank statement for the entry permit. See https://a.hk/x. Then wait.", "visa", "HKU"),
        (2, "What is the application fee?", "The application fee is HK$600.", "general", "HKU"), (3, "How much is tuition?", "Tuition fee is HK$42,000.50 and you pay it by August.", "payment", "HKU"),
    ]
    df = spark.createDataFrame(rows, "n int, question string, answer string, category string, school string").withColumn("source_url", F.lit("https://a.hk/faq"))
    got = evidence.extract(df, "school", ["n"]).collect()
    kinds = {(r.n, r.evidence_type) for r in got}
    assert {(1, "deadline"), (1, "required_document"), (1, "action_url"), (3, "fee_amount")} <= kinds and not any(n == 2 for n, _ in kinds)
    assert {r.normalized_value for r in got if r.evidence_type == "action_url"} == {"https://a.hk/x"}
    assert {r.normalized_value for r in got if r.evidence_type == "fee_amount"} == {"HK$42000.50"}
    reg = spark.createDataFrame([("HKU", "https://a.hk/faq", "visa", "visa")], "school string, url string, page_type string, stage string")
    a = {(r.n, r.evidence_type): r for r in evidence.audit(evidence.extract(df, "school", ["n"]), evidence.source_catalog(reg, "school", "url", "page_type", "stage"), "school").collect()}
    assert a[1, "deadline"].quality_decision == "keep" and a[1, "deadline"].source_stage_match == "yes"
    context = spark.createDataFrame([(9, "Q?", "Plain words on immigration.", "visa", "HKU", "")], "n int, question string, answer string, category string, school string, source_url string")
    assert evidence.audit(evidence.extract(context, "school", ["n"]), evidence.source_catalog(reg, "school", "url", "page_type", "stage"), "school").first().quality_decision == "reject"


def test_cap_of_evidence_in_sequence(spark):
    """What comes after the last row of a pair does not count as met, so a later pair may still take it."""
    answer = " ".join(f"You must submit visa form number {i} by July." for i in range(12))
    df = spark.createDataFrame([(1, "q", answer, "visa", "A", "u"), (2, "q", answer, "visa", "A", "u")], "n int, question string, answer string, category string, school string, source_url string")
    got = evidence.extract(df, "school", ["n"]).groupBy("n").count().collect()
    assert {r.n: r["count"] for r in got} == {1: 8, 2: 8}


def test_sequence_against_a_loop(spark):
    """Random groups, pairs and keys, null groups too; and a chain in which each pair pushes a row out to the next."""
    rng = np.random.default_rng(11)
    rows = [(None if g == 0 else g, p, n, int(rng.integers(0, 9))) for p in range(120) for g in [int(rng.integers(0, 4))] for n in range(int(rng.integers(0, 9)))]
    rows += [(9, 1000 + p, n, 100 + (p + n) % 40) for p in range(30) for n in range(5)]
    want, seen, count = set(), set(), {}
    for g, p, n, k in sorted(rows, key=lambda r: (r[1], r[2])):
        if count.get(p, 0) < 3 and (g, k) not in seen:
            seen.add((g, k))
            count[p] = count.get(p, 0) + 1
            want.add((p, n))
    df = spark.createDataFrame(rows, "g int, p int, n int, k int")
    assert {tuple(r) for r in evidence.in_sequence(df, ["p"], "n", ["g"], "k", 3).collect()} == want
    assert evidence.in_sequence(df.limit(0), ["p"], "n", ["g"], "k", 3).count() == 0


def test_enrich_and_review(spark):
    tasks = spark.createDataFrame([("A", "apply_student_visa", "A-1"), ("A", "pay_deposit", "A-2"), ("B", "none", "B-1")], "school string, task_code string, task_id string")
    ev = spark.createDataFrame([("A", "apply_student_visa", "k", "deadline", "By July", "", "medium", "1"), ("A", "apply_student_visa", "r", "deadline", "rejected text", "", "high", "1"), ("A", "apply_student_visa", "d", "deadline", "by july", "", "high", "2"), ("A", "pay_deposit", "m", "fee_amount", "HK$1", "", "low", "1")],
                               "school string, task_code string, evidence_id string, evidence_type string, evidence_text string, normalized_value string, confidence string, updated_at string")
    q = spark.createDataFrame([("k", "reject", 1), ("k", " Keep ", 2), (" ", "keep", 9), (None, "keep", 9), ("r", "reject", 3), ("d", "keep", 4)], "evidence_id string, quality_decision string, seq int")
    e = enrich.enrich(tasks, ev, ["school", "task_code"], q)
    got = {r.task_id: r for r in e.collect()}
    assert (got["A-1"].candidate_evidence_count, got["A-1"].usable_evidence_count, got["A-1"].rejected_evidence_count, got["A-1"].official_deadline_evidence) == (3, 2, 1, "by july")
    assert got["A-2"].enrichment_status == "evidence_needs_review" and got["B-1"].evidence_quality_status == "no_evidence"
    queue = review.queue(e, ("pay_deposit",))
    assert {r.task_id: r.review_priority for r in queue.collect()} == {"A-1": "medium", "A-2": "high"}
    dec = spark.createDataFrame([("A-2", "approve_with_edits", "HK$5", "n", "")], "task_id string, reviewer_decision string, reviewed_fee_evidence string, reviewer_notes string, reviewed_at string")
    dec = dec.withColumns({c: F.lit("") for c in review.REVIEWED.values() if c != "reviewed_fee_evidence"}).withColumn("seq", F.lit(2))
    dec = dec.unionByName(dec.withColumns({"reviewer_decision": F.lit("reject"), "seq": F.lit(1)}))  # the later row counts
    out = {r.task_id: r for r in review.apply_decisions(e, queue, dec, "task_id", "2026-07-01").collect()}
    assert out["A-2"].official_fee_evidence == "HK$5" and out["A-2"].human_review_status == "review_approved_with_edits"
    assert out["A-1"].official_deadline_evidence == "" and out["A-1"].usable_evidence_count == 0 and out["B-1"].human_review_status == "not_required"
    assert [r.task_id for r in review.pending(queue, dec, "task_id").collect()] == ["A-1"]
    assert review.decision_rows(queue, dec, "task_id", pending_only=True).count() == 1
    with pytest.raises(Exception, match="invalid reviewer_decision"):
        review.apply_decisions(e, queue, dec.withColumn("reviewer_decision", F.lit("maybe")), "task_id").collect()


def test_latest_status(spark):
    src = spark.createDataFrame([("HKU",), ("CityU",)], "school string")
    log = spark.createDataFrame([("HKU", "success", "2026-01-01", 385, 1), ("HKU", "request_error", "2026-01-02", 0, 2)], "school string, status string, day string, chars int, seq int").withColumn("at", F.try_to_timestamp("day"))
    got = {r.school: r for r in fetchlog.latest_status(src, log, ["school"], ["status", "chars"], "status", "at", "seq").collect()}
    assert (got["HKU"].latest_status, got["HKU"].usable_status, got["HKU"].usable_chars) == ("request_error", "success", 385) and got["CityU"].latest_status == "not_crawled"
    bad = log.withColumn("at", F.when(F.col("seq") == 2, F.col("at")))  # a time that cannot be read counts as newest
    assert fetchlog.latest_status(src, bad, ["school"], ["status"], "status", "at", "seq").where("school = 'HKU'").first().latest_status == "success"
    why = fetchlog.attention(F.col("s"), F.lit(1), F.lit(True), F.lit(500), F.lit("Page Not Found"), F.lit(""))
    assert one(spark, why, s="success") == "possible_404_page" and one(spark, why, s="x") == "latest_attempt_failed_previous_success_available"


def test_search(spark):
    c = spark.createDataFrame([("c1", 0, "Student visa and entry permit for students"), ("c2", 0, "Housing and hostels"), ("c3", 1, "campus map")], "chunk_key string, chunk_index int, text string")
    q = spark.createDataFrame([(1, "student visa entry permit"), (2, "签证 怎么办"), (3, "campus")], "query_id int, text string")
    d = spark.createDataFrame([("签证", "visa entry permit")], "key string, expansion string")
    hits = retrieval.keyword_search(retrieval.expand_queries(q, d, ("entry permit",)), c)
    assert {(r.query_id, r["rank"]): r.chunk_key for r in hits.collect()} == {(1, 1): "c1", (2, 1): "c1", (3, 1): "c3"}
    ix = retrieval.sparse_index(c, ["chunk_key"])
    top = retrieval.cosine_topk(retrieval.sparse_index(q, ["query_id"]), ix, "query_id", ["chunk_key"])
    assert {r.query_id: r.chunk_key for r in top.where("rank = 1").collect()} == {1: "c1", 3: "c3"}
    v = {r.chunk_key: r for r in retrieval.sparse_vectors(ix, ["chunk_key"]).collect()}
    assert v["c3"].vector == {"campus": 1, "map": 1} and v["c3"].token_count == 2
    dense = retrieval.dense_vectors(retrieval.hash_embed(c, ["chunk_key"], dimensions=8), ["chunk_key"], 8).collect()
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-9 and len(r.vector) == 8 for r in dense)


def test_prompts(spark):
    hits = spark.createDataFrame([(1, 1, "https://a"), (1, 2, ""), (1, 3, "https://a"), (1, 4, "https://b")], "q int, r int, url string")
    cited = prompts.citations(hits, "q", "r", "url")
    assert cited.first().urls == ["https://a", "https://b"]
    ans = spark.createDataFrame([(1, "text"), (1, "see https://x")], "q int, a string")
    assert sorted(r.a for r in prompts.ensure_cited(ans, cited, "q", "a").collect()) == ["see https://x", "text\n\nSources:\n- https://a\n- https://b"]


def test_intent(spark):
    rows = [(1, "HKUST 已经交了留位费，还没申请签证，下一步做什么？"), (2, "我已经接受offer，也交了留位费"), (3, "HKU 线上注册怎么完成？"), (4, "hello"), (5, "Is shkux a hall? FAQ")]
    df = spark.createDataFrame(rows, "msg_id int, text string")
    got = {r.msg_id: r for r in intent.route(df).collect()}
    assert (got[1].school, got[1].stage, got[1].intent) == ("HKUST", "visa", "task_plan") and got[3].school == "HKU" and got[3].stage == "registration"
    assert (got[4].intent, got[4].confidence, got[5].school) == ("general_guidance", 0.25, "")
    flags = {r.msg_id: set(r.f) for r in df.select("msg_id", intent.completion_flags(F.col("text")).alias("f")).collect()}
    assert flags[2] == {"accepted_offer", "paid_deposit"} and "registered" not in flags[3]


def test_planning(spark):
    p = spark.createDataFrame([(1, ["accepted_offer"], None, "Mainland", "visa", 0), (2, [], True, "", "", 1)], "user_id int, completed_flags array<string>, has_conditional_offer boolean, origin string, asked_stage string, n_evidence int")
    ts = [planning.Template("accept_offer", "offer_acceptance", "a", "high", ("accepted_offer",)), planning.Template("submit_conditions", "offer_acceptance", "b", "high", ("conditions_cleared",)), planning.Template("apply_student_visa", "visa", "c", "high", ("visa_submitted",))]
    t = planning.eligible(planning.seed_tasks(p, "user_id", ts), unknown=False)
    assert {(r.user_id, r.task_code) for r in t.collect()} == {(1, "apply_student_visa"), (2, "accept_offer"), (2, "submit_conditions"), (2, "apply_student_visa")}
    score, why = planning.priority({"offer_acceptance": 10, "visa": 20})
    t = t.withColumns({"priority_score": score, "why": F.array_join(why, ",")})
    s = spark.createDataFrame([(2, "2-accept_offer", "done", ""), (2, "apply_student_visa", "waiting", "2026-07-27")], "user_id int, key string, status string, deadline_at string")
    plan = planning.top_plan(planning.overlay(t, s, "user_id"), "user_id", {"offer_acceptance": 10, "visa": 20}, 2).collect()
    assert {(r.user_id, r["rank"]): (r.task_code, r.priority_score) for r in plan} == {(1, 1): ("apply_student_visa", 105.0), (2, 1): ("apply_student_visa", 78.0), (2, 2): ("submit_conditions", 72.5)}
    r = {(x.user_id, x.risk) for x in planning.risks(p, "user_id").collect()}
    assert (1, "visa_not_submitted") in r and (1, "no_evidence_found") in r and (2, "conditions_open") in r and (1, "offer_not_accepted") not in r


def updates(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(rng.randrange(4), rng.choice(["", "t1", "t2", "t3", "t4"]), rng.choice(["", "c1", "c2", "c3"]), rng.choice(["done", "waiting"]), i) for i in range(n)]
    return spark.createDataFrame(rows, "user_id int, task_id string, task_code string, status string, seq int"), rows


def test_state_replay_twin(spark, tmp_path):
    df, rows = updates(spark)
    log = state.with_ids(df)
    kept = []
    for r in rows:
        if r[1] or r[2]:
            kept = [k for k in kept if not (k[0] == r[0] and ((r[1] and k[1] == r[1]) or (r[2] and k[2] == r[2])))] + [r]
    assert sorted(map(tuple, state.replay(log).collect())) == sorted(kept)
    half = state.upsert(state.replay(log.where("seq < 200")), log.where("seq >= 200"))
    assert sorted(map(tuple, half.collect())) == sorted(kept)
    path = str(tmp_path / "log")
    for a, b in ((0, 150), (150, 400)):
        log.where((F.col("seq") >= a) & (F.col("seq") < b)).write.mode("append").parquet(path)
        got = incremental.state_upsert(incremental.stream(spark, path, log.schema), str(tmp_path / "states"), str(tmp_path / "cp"))
    assert sorted(map(tuple, got.collect())) == sorted(kept)
    look = {(r.user_id, r.key): r.seq for r in state.lookup(state.replay(log), ["seq"]).collect()}
    for u, i, c, _, n in kept:
        if i:
            assert look[u, i] == n
    with pytest.raises(Exception, match="invalid status"):
        state.with_ids(df.withColumn("status", F.lit("odd"))).collect()


def test_states_in_buckets(spark, tmp_path):
    """A batch of one user rewrites one bucket; a batch played again, or one that died before its manifest, changes nothing."""
    df, _ = updates(spark)
    log, root = state.with_ids(df), f"file://{tmp_path}/states"
    assert incremental.put_states(log.where("seq < 200"), 0, root, buckets=16)
    before = incremental._manifest(spark, root)[1]
    one = log.where("seq >= 200 AND user_id = 2")
    assert incremental.put_states(one, 1, root, buckets=16)
    after = incremental._manifest(spark, root)[1]
    assert sum(before.get(b) != after.get(b) for b in before.keys() | after.keys()) == 1
    want = sorted(map(tuple, state.upsert(state.replay(log.where("seq < 200")), one).collect()))
    assert sorted(map(tuple, incremental.current_states(spark, root, log.schema).collect())) == want
    assert not incremental.put_states(one, 1, root, buckets=16) and not incremental.put_states(log, 0, root, buckets=16)
    one.write.parquet(f"{root}/attempts/{2:020d}-died")
    assert sorted(map(tuple, incremental.current_states(spark, root, log.schema).collect())) == want
    gone = incremental.collect_old_states(spark, root)
    assert f"{2:020d}-died" in gone and sorted(map(tuple, incremental.current_states(spark, root, log.schema).collect())) == want
    assert incremental.put_states(one.limit(0), 3, root, buckets=16) and incremental._manifest(spark, root)[1] == after


def test_status_of_changed_keys(spark, tmp_path):
    """The second batch writes its own sources only; a log row sent twice counts once."""
    kind = "school string, status string, at timestamp, seq long"
    t = lambda h: dt.datetime(2026, 1, 1, h)
    path, once, out = str(tmp_path / "log"), f"file://{tmp_path}/once", f"file://{tmp_path}/out"
    parts = [[("A", "success", t(1), 1), ("B", "error", t(1), 2)], [("B", "success", t(2), 3), ("A", "success", t(1), 1)], [("B", "success", t(2), 3)]]
    sizes = []
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
        schema = incremental.without_repeats(incremental.stream(spark, path, spark.createDataFrame([], kind).schema), once, str(tmp_path / "cp1"), ["seq"], "at")
        got = incremental.latest_status(incremental.stream(spark, f"{tmp_path}/once/attempts/*", schema), out, str(tmp_path / "cp2"), ["school"], ["status"], "status", "at", "seq")
        sizes.append(incremental.commits.read(spark, out).count())
    by = {r.school: (r.latest.status, r.attempt_count, r.success_count) for r in got.collect()}
    assert by == {"A": ("success", 1, 1), "B": ("success", 2, 1)}
    assert sizes == [2, 3, 3]
    # a batch that runs again after its commit writes nothing
    assert not incremental.commits.append(got, out, 0)
    assert incremental.current_status(spark, f"file://{tmp_path}/none", ["school"]) is None


def test_captures(spark):
    reg = spark.createDataFrame([("A", "faq", "visa", "u1"), ("A", "faq", "visa", "u2"), ("B", "page", "housing", "u3"), ("B", "page", "housing", "u3b"), ("C", "page", "x", "u4")], "school string, page_type string, stage string, url string")
    rows = [(1, "a", "FAQ", "", "", "t"), (2, "a", "faq", "u2", "T", " x\u00a0 y \n\n\ny\ny"), (3, "c", "Page", None, "", None), (4, "d", "page", "", "", "t"), (5, "b", "page", "zzz", "", "t"), (6, None, None, None, None, None)]
    cap = spark.createDataFrame(rows, "capture_id int, school string, page_type string, url string, title string, text string")
    pages_, log, rejects = tables.import_captures(cap, reg, "now")
    assert {tuple(r) for r in rejects.collect()} == {(1, "several_sources"), (4, "no_source"), (5, "no_source"), (6, "no_source")}
    got = {r.capture_id: r for r in pages_.collect()}
    assert (got[2].text, got[2].title, got[2].stage, got[2].source_url) == ("x y\n\ny", "T", "visa", "u2") and got[3].title == "C page manual capture" and got[3].text == ""
    assert {(r.source_url, r.char_count, r.error) for r in log.collect()} == {("u2", 6, "manual_capture_from=2"), ("u4", 0, "manual_capture_from=3")}


def test_damaged_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,s\n1,"x ""y"""\noops\n2,z\nq,w\n')
    good, bad = tables.scan_rescued(spark, f"file://{tmp_path}/a.csv", "n int, s string")
    assert sorted(tuple(r) for r in good.collect()) == [(1, 'x "y"'), (2, "z")] and sorted(r.line for r in bad.collect()) == ["oops", "q,w"]
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "1.txt").write_text("a: 1\nb: 2\n---\nbody\n---\nmore")
    (folder / "2.txt").write_text("no header at all")
    (folder / "3.txt").write_text("a: 1\n---\n")
    ok, rejects = archive.read_parsed(spark, f"file://{folder}", ["a", "b"])
    assert [(r.a, r.b, r.body) for r in ok.collect()] == [("1", "2", "body\n---\nmore")]
    assert sorted(r.error for r in rejects.collect()) == ["missing: b", "no_header"]


def test_profiles(spark):
    a = spark.createDataFrame([(1, "x", ["f"], True), (2, "y", None, None)], "u int, o string, completed_flags array<string>, has_conditional_offer boolean")
    b = spark.createDataFrame([(1, "", ["g"], None), (3, "z", [], False)], "u int, o string, completed_flags array<string>, has_conditional_offer boolean")
    got = {r.u: (r.o, r.completed_flags, r.has_conditional_offer) for r in intent.merge_profiles(a, b, "u", ["o"]).collect()}
    assert got == {1: ("x", ["f", "g"], True), 2: ("y", [], None), 3: ("z", [], False)}
    with pytest.raises(Exception, match="conflicting"):
        spark.range(1).select(intent.tri_state(F.lit(True), F.lit(True))).collect()


def test_agenda(spark):
    rows = [("a", "waiting", "2026-07-27", "", "2026-07-24", "", ""), ("b", "waiting", "", "", "2026-07-25T10:00:00", "Asia/Hong_Kong", ""), ("c", "waiting", "2026-07-27", "Asia/Hong_Kong", "2026-07-01", "", "dismissed"), ("d", "waiting", "soon", "", "", "", ""), ("e", "waiting", "2026-07-25T23:30:00Z", "", "", "", "")]
    df = spark.createDataFrame(rows, "task_id string, status string, deadline_at string, deadline_timezone string, reminder_at string, reminder_timezone string, reminder_status string").withColumn("user_id", F.lit(1))
    got = {r.task_id: r for r in agenda.agenda(df, "2026-07-25", 3, "Asia/Hong_Kong").collect()}
    assert {k: v.bucket for k, v in got.items()} == {"a": "overdue", "b": "today", "c": "upcoming", "e": "upcoming"}
    assert got["c"].anchor_at == dt.datetime(2026, 7, 27, 23, 59, 59) and got["a"].anchor_at.hour == 9 and got["e"].anchor_at == dt.datetime(2026, 7, 26, 7, 30)
    s = agenda.summary(df, agenda.agenda(df, "2026-07-25", 3, "Asia/Hong_Kong")).first()
    assert (s.state_count, s.overdue_count, s.today_count, s.upcoming_count, s.hints) == (5, 1, 1, 2, "")


def test_text_functions(spark):
    assert one(spark, X.squeeze(F.col("t")), t="  a　\n b ") == "a b"
    assert one(spark, X.comparison_key(F.col("t")), t="如何 申请 VISA?") == "如何申请visa"
    assert one(spark, X.truncate(F.col("t"), 8), t="abcd efghij") == "abcd..." and one(spark, X.truncate_at_word(F.col("t"), 12), t="one two three four") == "one two..."
    assert one(spark, X.to_int(F.col("t"), 3), t="x") == 3 and one(spark, X.to_int(F.col("t")), t="2.0") == 2
    assert one(spark, X.normalize_lines(F.col("t")), t="a\r\na\n\n b  a") == "a\nb\na"
    assert len(L.QUESTION_STARTERS) == 18 and len(L.MORE_QUESTION_STARTERS) == 20


def test_schema_dictionary_and_manifest(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    m = tables.manifest({"t": df}).first()
    assert m.row_count == 5 and m.file_count >= 1 and m.newest is not None
    d = tables.schema_dictionary({"t": spark.createDataFrame([], StructType([StructField("a", StringType()), StructField("b", LongType())]))}, {"t": {"b"}})
    assert [(r.column, r.required) for r in d.collect()] == [("a", "no"), ("b", "yes")]


def test_dense_topk_in_blocks_of_queries(spark, monkeypatch):
    from pageknow.operators import retrieval

    v = spark.createDataFrame([(i, [float(i * i % 17), float(i % 5)], i % 2) for i in range(40)], "vec_id long, embedding array<double>, m2 int")
    for match in (None, "m2"):
        want = sorted(map(tuple, retrieval.dense_topk(v, v.where("vec_id % 2 = 0"), 3, match=match).collect()))
        with monkeypatch.context() as m:
            m.setattr(retrieval, "MAX_QUERY_ROWS", 8)
            got = sorted(map(tuple, retrieval.dense_topk(v, v.where("vec_id % 2 = 0"), 3, match=match).collect()))
        assert got == want and len(want) == 60


def test_fixed_words(spark):
    q = spark.createDataFrame([(1, "学生签证怎么办理"), (2, "plain words")], "id int, text string")
    terms = {r.id: r.terms for r in retrieval.expand_queries(q).collect()}
    assert {"visa", "entry", "permit", "immigration"} <= set(terms[1]) and terms[2] == ["plain", "words"]
    m = spark.createDataFrame([(1, "the chinese university sent an offer"), (2, "UST science and technology"), (3, "just a question"), (4, "我还没有申请签证")], "id int, text string")
    got = {r.id: r for r in intent.route(m).collect()}
    assert (got[1].school, got[2].school, got[3].school) == ("CUHK", "HKUST", "")
    assert got[4].stage == "visa" and "pending:visa" in got[4].matched and got[4].page_types == ["visa", "faq"] and got[3].page_types == ["faq"]


def test_states_in_buckets(spark, tmp_path):
    """A batch of one user rewrites one bucket; a batch played again, or one that died before its manifest, changes nothing."""
    df, _ = updates(spark)
    log, root = state.with_ids(df), f"file://{tmp_path}/states"
    assert incremental.put_states(log.where("seq < 200"), 0, root, buckets=16)
    before = incremental._manifest(spark, root)[1]
    one = log.where("seq >= 200 AND user_id = 2")
    assert incremental.put_states(one, 1, root, buckets=16)
    after = incremental._manifest(spark, root)[1]
    assert sum(before.get(b) != after.get(b) for b in before.keys() | after.keys()) == 1
    want = sorted(map(tuple, state.upsert(state.replay(log.where("seq < 200")), one).collect()))
    assert sorted(map(tuple, incremental.current_states(spark, root, log.schema).collect())) == want
    assert not incremental.put_states(one, 1, root, buckets=16) and not incremental.put_states(log, 0, root, buckets=16)
    one.write.parquet(f"{root}/attempts/{2:020d}-died")
    assert sorted(map(tuple, incremental.current_states(spark, root, log.schema).collect())) == want
    gone = incremental.collect_old_states(spark, root)
    assert f"{2:020d}-died" in gone and sorted(map(tuple, incremental.current_states(spark, root, log.schema).collect())) == want
    assert incremental.put_states(one.limit(0), 3, root, buckets=16) and incremental._manifest(spark, root)[1] == after


def test_status_of_changed_keys(spark, tmp_path):
    """The second batch writes its own sources only; a log row sent twice counts once."""
    kind = "school string, status string, at timestamp, seq long"
    t = lambda h: dt.datetime(2026, 1, 1, h)
    path, once, out = str(tmp_path / "log"), f"file://{tmp_path}/once", f"file://{tmp_path}/out"
    parts = [[("A", "success", t(1), 1), ("B", "error", t(1), 2)], [("B", "success", t(2), 3), ("A", "success", t(1), 1)], [("B", "success", t(2), 3)]]
    sizes = []
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
        schema = incremental.without_repeats(incremental.stream(spark, path, spark.createDataFrame([], kind).schema), once, str(tmp_path / "cp1"), ["seq"], "at")
        got = incremental.latest_status(incremental.stream(spark, f"{tmp_path}/once/attempts/*", schema), out, str(tmp_path / "cp2"), ["school"], ["status"], "status", "at", "seq")
        sizes.append(incremental.commits.read(spark, out).count())
    by = {r.school: (r.latest.status, r.attempt_count, r.success_count) for r in got.collect()}
    assert by == {"A": ("success", 1, 1), "B": ("success", 2, 1)}
    assert sizes == [2, 3, 3]
    # a batch that runs again after its commit writes nothing
    assert not incremental.commits.append(got, out, 0)
    assert incremental.current_status(spark, f"file://{tmp_path}/none", ["school"]) is None


def test_captures(spark):
    reg = spark.createDataFrame([("A", "faq", "visa", "u1"), ("A", "faq", "visa", "u2"), ("B", "page", "housing", "u3"), ("B", "page", "housing", "u3b"), ("C", "page", "x", "u4")], "school string, page_type string, stage string, url string")
    rows = [(1, "a", "FAQ", "", "", "t"), (2, "a", "faq", "u2", "T", " x\u00a0 y \n\n\ny\ny"), (3, "c", "Page", None, "", None), (4, "d", "page", "", "", "t"), (5, "b", "page", "zzz", "", "t"), (6, None, None, None, None, None)]
    cap = spark.createDataFrame(rows, "capture_id int, school string, page_type string, url string, title string, text string")
    pages_, log, rejects = tables.import_captures(cap, reg, "now")
    assert {tuple(r) for r in rejects.collect()} == {(1, "several_sources"), (4, "no_source"), (5, "no_source"), (6, "no_source")}
    got = {r.capture_id: r for r in pages_.collect()}
    assert (got[2].text, got[2].title, got[2].stage, got[2].source_url) == ("x y\n\ny", "T", "visa", "u2") and got[3].title == "C page manual capture" and got[3].text == ""
    assert {(r.source_url, r.char_count, r.error) for r in log.collect()} == {("u2", 6, "manual_capture_from=2"), ("u4", 0, "manual_capture_from=3")}


def test_damaged_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,s\n1,"x ""y"""\noops\n2,z\nq,w\n')
    good, bad = tables.scan_rescued(spark, f"file://{tmp_path}/a.csv", "n int, s string")
    assert sorted(tuple(r) for r in good.collect()) == [(1, 'x "y"'), (2, "z")] and sorted(r.line for r in bad.collect()) == ["oops", "q,w"]
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "1.txt").write_text("a: 1\nb: 2\n---\nbody\n---\nmore")
    (folder / "2.txt").write_text("no header at all")
    (folder / "3.txt").write_text("a: 1\n---\n")
    ok, rejects = archive.read_parsed(spark, f"file://{folder}", ["a", "b"])
    assert [(r.a, r.b, r.body) for r in ok.collect()] == [("1", "2", "body\n---\nmore")]
    assert sorted(r.error for r in rejects.collect()) == ["missing: b", "no_header"]


def test_profiles(spark):
    m = spark.createDataFrame([(1, "I paid the deposit", "HKU", True, False), (2, "my conditional offer", None, False, False), (3, "conditional", None, False, True), (4, None, None, None, None)], "id int, text string, school string, yes boolean, no boolean")
    got = {r.id: r for r in intent.build_profiles(m, given={"registered": F.col("id") == 2}, positive=F.col("yes"), negative=F.col("no")).collect()}
    assert [(got[i].completed_flags, got[i].has_conditional_offer) for i in (1, 2, 3, 4)] == [(["paid_deposit"], True), (["registered"], True), ([], False), ([], None)]
    with pytest.raises(Exception, match="conflicting"):
        intent.build_profiles(m, positive=F.lit(True), negative=F.lit(True)).collect()


def test_sources_of_all_tables(spark):
    task = spark.createDataFrame([(1, 1, " https://a | |https://b"), (1, 2, None)], "q int, ord int, urls string")
    risk = spark.createDataFrame([(1, 1, "https://b"), (2, 1, "https://r")], "q int, ord int, urls string")
    assert {r.q: r.urls for r in prompts.all_citations([task, risk, risk.limit(0)], "q").collect()} == {1: ["https://a", "https://b"], 2: ["https://r"]}
    ans = spark.createDataFrame([(1, "官方来源 names it"), (2, "none  ")], "q int, a string")
    got = {r.q: r.a for r in prompts.ensure_cited(ans, prompts.all_citations([task, risk], "q"), "q", "a").collect()}
    assert got == {1: "官方来源 names it", 2: "none\n\nSources:\n- https://r"}
    q = spark.createDataFrame([(1, "why"), (2, None)], "q int, t string")
    ev = spark.createDataFrame([(1, 1, "faq", "text")], "q int, rank int, label string, body string")
    lists = {"Tasks": (spark.createDataFrame([(1, k, f"t{k}") for k in range(1, 11)], "q int, rank int, line string"), 8)}
    made = {r.q: r.prompt for r in prompts.assemble(q, ev, "q", "t", "rank", "label", "body", lists=lists).collect()}
    assert "- t8\nEvidence:\n[1] (faq) text" in made[1] and "t9" not in made[1] and "Tasks:\n(none)" in made[2]


def test_plan_rows_and_shown_states(spark):
    t = spark.createDataFrame([("a", "r", "2", "x", "1", "", "https://u | https://v", "found"), ("b", "r", "", "", "", "https://own", "", "none")], "id string, reason string, evidence_count string, review_evidence_count string, rejected_evidence_count string, action_url string, official_action_urls string, enrichment_status string")
    got = {r.id: r for r in planning.plan_rows(t).collect()}
    assert (got["a"].usable_evidence_count, got["a"].review_evidence_count, got["a"].action_url, got["a"].source_url) == (2, 0, "https://u", "https://u")
    assert got["a"].reason == "r；2 pieces of evidence；audit: 2 usable, 0 open, 1 rejected" and got["b"].reason == "r；status: none" and got["b"].action_url == "https://own"
    st = spark.createDataFrame([(1, "t1", "c1", "waiting", "", "", "", 1), (1, "t1", "c2", "blocked", "2026-01-01", "", "", 2), (1, "", "c9", "waiting", "", "2025-01-01", "Ann", 3), (1, "t3", "", "done", "2020-01-01", "", "", 4)],
                               "user_id int, task_id string, task_code string, status string, deadline_at string, reminder_at string, owner string, seq int")
    assert [(r.task_id, r.task_code) for r in state.visible(st, order=True).collect()] == [("", "c9"), ("t1", "c1")]
    assert [r.task_id for r in state.visible(st, completed=True, statuses=["done"], order=True).collect()] == ["t3"]
    pro = spark.createDataFrame([(1, "Bob"), (2, "Cid"), (3, " ")], "user_id int, owner string")
    assert {tuple(r) for r in state.inferred_owner(st, "owner", profiles=pro).collect()} == {(1, "Ann"), (2, "Cid")}
    assert review.pending(spark.createDataFrame([("k", "HKU", "high")], "k string, owner string, review_priority string"), spark.createDataFrame([], "k string, reviewer_decision string, reviewer_notes string, seq int"), "k", only="hku").count() == 1
