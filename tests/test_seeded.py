"""Profiles of many seeds at once against those of one seed after the other, and the queries made of them against SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from labelwatch.operators import importance as im
from labelwatch.operators import seeded
from labelwatch.operators.splitting import seed_halves, stratified_halves
from labelwatch.sources.views import LabelledTable, pooled_long
from tools.check import TABLES, rows

SEEDS = (42, 43, 46)
FOLDER = "/root/testdata/sf0.001"


def made(spark, repeated=False):
    u = lambda tag: F.pmod(F.xxhash64(F.lit(tag), "n"), F.lit(1000)).cast("double")
    frame = spark.range(600).withColumnRenamed("id", "n").withColumns({
        "id": F.col("n") % 150 if repeated else F.col("n"),
        "label": F.when(F.col("n") % 20 > 0, (u("y") > 400).cast("int")),
        "price": u("a") / 100, "third": u("b") / 3, "same": F.lit(7.0),
        "gaps": F.when(F.col("n") % 3 > 0, u("c") + F.col("label")),
        # pairs of values so close to each other that rounding gives some of them one attribution
        "close": (u("d") / 300 + F.col("label") + 1) * (1 + F.col("n") % 2 * 2.0 ** -52)})
    return LabelledTable(frame, ("price", "third", "same", "gaps", "close"), "made")


@pytest.mark.parametrize("repeated", [False, True])
def test_profiles_of_many_seeds_are_those_of_each(spark, repeated):
    t = made(spark, repeated)
    got = {(r["seed"], r["half"], r["feature"]): r for r in seeded.half_profiles(t, SEEDS).collect()}
    keys = ["seed", "half"]
    for seed in SEEDS:
        long_rows = pooled_long([im.with_background(stratified_halves(t, seed), seed)], "half", "drawn").withColumn("seed", F.lit(seed))
        attr = im.attribution_linear(long_rows, im.linear_weights(long_rows, keys, seed), keys)
        want = im.importance_profile(attr, keys, True).collect()
        assert len(want) == 10
        for r in want:
            own = got.pop((seed, r["half"], r["feature"]))
            assert (own["mean_abs"], own["mean_signed"]) == pytest.approx((r["mean_abs"], r["mean_signed"]), rel=1e-9, abs=1e-12)
            assert own["direction"] == pytest.approx(r["direction"], abs=1e-9)
    assert not got


def test_halves_of_many_seeds_come_from_one_pass(spark):
    t = made(spark)
    marked = t.frame.select("id", F.col("id").alias("own"), "label")
    rows_ = seed_halves(LabelledTable(marked, (), "made"), SEEDS)
    for seed in SEEDS:
        want = {r["id"] for r in stratified_halves(t, seed).frame.filter("half = 'a'").collect()}
        assert {r["own"] for r in rows_.filter(F.col(f"a_{seed}")).collect()} == want


@pytest.mark.parametrize("name,size", [("agreement_summary", 4), ("sign_diagnostic", 12)])
def test_all_views_and_seeds_take_part(spark, name, size):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name]).df()
    assert set(got["dataset"]) == {"line_returned", "order_status", "doc_quality", "planted"} and len(got) == size
    assert "n_seeds" not in got or set(got["n_seeds"]) == {5}
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_every_seed_has_its_row_of_all_metrics(spark):
    got = entry.queries()["half_agreement"](spark, FOLDER).collect()
    assert {(r["dataset"], r["seed"]) for r in got} == {
        (w, s) for w in ("line_returned", "order_status", "doc_quality", "planted") for s in range(42, 47)} and len(got) == 20
    assert {"p_value", "p_empirical", "ci_lower", "jaccard_15", "sign_top15", "direction_top15", "directional_15_50"} <= set(got[0].asDict())
