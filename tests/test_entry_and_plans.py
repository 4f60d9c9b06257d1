"""Driver contract, oracle agreement on the smallest tables, plan shape."""

import duckdb
import pytest

from conftest import SF_SMALL
from __spark_entry__ import entry, oracle_sql, queries
from sendero.plans.pipeline import Pipeline
from sendero.sources.tables import BASE_TABLES


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0
    assert {"id_usuario", "rank", "url_sitio", "similitud_vectorial"} <= set(df.columns)


def test_oracle_keys_subset_of_queries():
    assert set(oracle_sql()) <= set(queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", [
    "recommend_direct", "recommend_inverse", "implicit_narrative", "user_context", "place_catalog",
    "prompt_direct", "parse_direct", "config_sweep", "metric_ndcg", "graph_context", "index_new_only",
])
def test_matches_oracle_small(spark, duck, name):
    df = queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = _norm(tuple(r[c] for c in cols) for r in df.collect())
    res = duck.execute(oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    want = _norm(tuple(r[i] for i in idx) for r in res.fetchall())
    assert got == want


def test_picks_use_window_group_limit(spark):
    plan = Pipeline(spark, SF_SMALL).implicit._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_no_row_at_a_time_python_udf(spark):
    p = Pipeline(spark, SF_SMALL)
    for df in (p.user_texts, p.catalog, p.consumed, p.place_vectors):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_stay_in_their_row(spark):
    from sendero.operators.embed import HashedTokenEmbedder

    texts = spark.createDataFrame([("a", "x y x"), ("b", None)], "id string, t string")
    vectors = HashedTokenEmbedder()(texts, "id", "t")
    assert "Exchange" not in _plan(vectors)
    assert [(r.id, sum(r.embedding)) for r in vectors.collect()] == [("a", 3.0)]


def test_retrieval_is_planned_once(spark):
    p = Pipeline(spark, SF_SMALL)
    long = p.topk_places(6)
    assert "CoGroup" not in _plan(long) and "CoGroup" not in _plan(p.topk_places(3))
    assert p.topk_places(3).count() < long.count()


def test_no_sort_aggregate_in_the_preparation(spark):
    p = Pipeline(spark, SF_SMALL)
    for df in (p.selector, p.consumed, p.user_text_rows, p.user_document_vectors):
        assert "SortAggregate" not in _plan(df)
