"""Every registered query of the core against its SQL, over sf0.001."""

import os

import duckdb
import pytest

from pageknow.plans.oracles import ORACLES
from pageknow.plans.queries import QUERIES
from pageknow.plans.workflow import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str) == want


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


def test_plans_stay_in_the_jvm(spark):
    for name in ("chunk_documents", "sparse_cosine_topk", "html_clean", "evidence_audit", "enrich_entities", "latest_status", "plan_tasks"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "CartesianProduct")), name
