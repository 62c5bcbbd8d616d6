"""Registered queries against their SQL at the smallest scale (the full set runs with tools/check.py)."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows

FOLDER = "/root/testdata/sf0.001"
SMOKE = ["class_distribution_planted", "best_threshold_planted", "separation_type", "mutual_information",
         "single_feature_tree", "split_audit", "stratified_sample", "standard_scale", "train_twin_rate",
         "balance_shift", "forbidden_content_scan", "score_predictions", "confusion_matrix", "kendall_tau",
         "contention_join", "cost_curve", "polarity", "inject_feature", "display_names", "src_csv"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return c


def test_every_oracle_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SMOKE)
def test_query_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
