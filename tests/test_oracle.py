"""Every registered query against its SQL in DuckDB, on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = compare(name, entry.queries()[name](spark, SF), entry.oracle_sql()[name], con)
    assert got.startswith("ok") or got == "EMPTY", got


# fits are timed in the bench and checked for their invariants in test_models
FITS = {"linear_probe_fit", "cv_out_of_fold", "mixed_feature_probe", "ridge_cv_r2", "platt_compare", "temperature_fit_out_of_fold", "variant_scores_retrained"}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - FITS))
def test_query_without_sql_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).limit(1).count() == 1


def test_entry_is_the_manifest(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"class", "train", "test", "total"}
    assert df.count() > 0


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["group_profile", "table_diff", "crosstab_counts", "quantile_bands", "permutation_null", "near_points", "fingerprint_match", "upsert_runs"])
def test_no_cross_join_in_plan(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["pick_one_per_key", "first_n_per_group", "history_tail_full", "capped_sample"])
def test_top_n_is_limited_before_the_shuffle(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
