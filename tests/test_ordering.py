"""The bucketed order operators against plain Python, on data with one hot value."""

import random

import pytest
from pyspark.sql import functions as F

from labelwatch.operators.importance import directional_importance, linear_weights, with_background
from labelwatch.operators.ordering import cumulate, hash_cuts, hash_rank, mean_ranks, spearman, spearman_binary
from labelwatch.operators.splitting import stratified_halves, stratified_sample, stratified_split
from labelwatch.sources.views import LabelledTable


def hot_values(n=600, seed=1):
    rng = random.Random(seed)
    return [0.0 if rng.random() < 0.35 else round(rng.gauss(0, 10), 1) for _ in range(n)]


@pytest.mark.parametrize("parts", [None, 1, 7, 50])
def test_cumulate_is_the_running_count(spark, parts):
    values = {"f": hot_values(), "g": [3.0] * 5, None: hot_values(90, 2)}  # a NULL key is a key
    df = spark.createDataFrame([(k, v) for k, own in values.items() for v in own], "k string, v double")
    counts = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    got = cumulate(counts, ["k"], "v", ["n", "s"], parts).collect()
    for k, own in values.items():
        mine = sorted((r for r in got if r["k"] == k), key=lambda r: r["v"])
        distinct = sorted(set(own))
        assert [r["v"] for r in mine] == distinct
        assert [r["n"] for r in mine] == [own.count(v) for v in distinct]
        assert [r["cum_n"] for r in mine] == [sum(x <= v for x in own) for v in distinct]
        assert [r["cum_s"] for r in mine] == pytest.approx([sum(x for x in own if x <= v) for v in distinct], abs=1e-6)
        assert [r["next_value"] for r in mine] == distinct[1:] + [None]
        assert {r["all_n"] for r in mine} == {len(own)}


def test_cumulate_without_keys_and_rows(spark):
    counts = spark.createDataFrame([(float(i), i, "x") for i in range(40)], "v double, n long, _note string")
    got = cumulate(counts, [], "v", ["n"], 5).orderBy("v").collect()
    assert [r["cum_n"] for r in got] == [i * (i + 1) // 2 for i in range(40)] and {r["_note"] for r in got} == {"x"}
    assert cumulate(counts.limit(0), [], "v", ["n"]).collect() == []


def test_a_hot_key_is_scanned_in_many_parts(spark):
    """One key with 19 in 20 rows: each part's window holds about its share, and the parts agree with the whole."""
    counts = spark.range(20_000).selectExpr("if(id % 20 = 0, 'b', 'a') as k", "cast(id as double) as v", "1L as n")
    got = cumulate(counts, ["k"], "v", ["n"], 16)
    rows = [len(p) for p in counts.repartitionByRange(16, "k", "v").groupBy(F.spark_partition_id()).agg(F.collect_list("v")).toPandas().iloc[:, 1]]
    assert max(rows) < 3 * 20_000 / 16
    assert got.agg(F.max("cum_n"), F.sum("cum_n"), F.count("*")).first() == (19_000, 19_000 * 19_001 // 2 + 1000 * 1001 // 2, 20_000)


def test_mean_ranks_average_ties(spark):
    df = spark.createDataFrame([("f", v, n) for v, n in [(1.0, 1), (2.0, 2), (5.0, 1)]], "k string, v double, n long")
    assert {r["v"]: r["mean_rank"] for r in mean_ranks(df, ["k"], "v").collect()} == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}


@pytest.mark.parametrize("parts", [1, 8])
def test_hash_rank_is_a_permutation_and_ignores_partitioning(spark, parts):
    df = spark.range(500).withColumn("g", F.col("id") % 3).repartition(parts)
    got = hash_rank(df, ["g"], "id", 42, total="total").collect()
    for g in range(3):
        mine = sorted(r["rank"] for r in got if r["g"] == g)
        assert mine == list(range(1, len(mine) + 1))
        assert {r["total"] for r in got if r["g"] == g} == {len(mine)}
    again = {r["id"]: r["rank"] for r in hash_rank(df.coalesce(1), ["g"], "id", 42).collect()}
    assert again == {r["id"]: r["rank"] for r in got}


def test_spearman_monotone_reversed_and_constant(spark):
    data = [("up", float(i), float(i**3)) for i in range(20)] + [("down", float(i), float(-i)) for i in range(20)]
    data += [("flat", float(i), 1.0) for i in range(20)]
    rho = {r["k"]: r["rho"] for r in spearman(spark.createDataFrame(data, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert rho["up"] == pytest.approx(1.0) and rho["down"] == pytest.approx(-1.0) and rho["flat"] == 0.0


def test_null_groups_keep_their_rows(spark):
    from labelwatch.operators.ordering import hash_rank

    df = spark.range(100).selectExpr("id", "if(id % 10 = 0, null, cast(id % 2 as int)) as label")
    got = hash_rank(df, ["label"], "id", "t", total="of").collect()
    assert len(got) == 100
    assert sorted(r.rank for r in got if r.label is None) == list(range(1, 11))
    assert {r.of for r in got if r.label is None} == {10}


def test_orders_without_lines_stay(spark):
    from labelwatch.sources.views import order_status

    folder = "/root/testdata/sf0.001"
    t = order_status(spark, folder)
    assert t.frame.count() == spark.read.parquet(f"{folder}/orders.parquet").count()
    assert t.frame.filter("n_lines is null or sum_qty is null").isEmpty()


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_correlation_with_a_binary_side_is_that_of_the_ranks(spark, parts):
    values = hot_values()
    rows = [("mixed", x, int(x + random.Random(i).gauss(0, 8) > 0)) for i, x in enumerate(values)]
    rows += [("constant", 1.0, i % 2) for i in range(6)] + [("one side", float(i), 1) for i in range(6)]
    df = spark.createDataFrame(rows, "k string, x double, y int")
    want = {r.k: r.rho for r in spearman(df, ["k"], "x", "y").collect()}
    gaps = spark.createDataFrame([("mixed", None, 1), ("mixed", 5.0, None)], "k string, x double, y int")  # no part
    got = {r.k: r.rho for r in spearman_binary(df.unionByName(gaps), ["k"], "x", "y", parts=parts).collect()}
    assert got.keys() == want.keys() and got["constant"] == got["one side"] == 0.0
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want) and want["mixed"] > 0.3


def test_binary_correlation_has_no_join(spark):
    df = spark.range(50).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("x"), (F.col("id") % 2).alias("y"))
    assert "Join" not in spearman_binary(df, ["k"], "x", "y")._jdf.queryExecution().toString()


@pytest.mark.parametrize("parts", [1, 8])
def test_cuts_split_rows_as_their_ranks_do(spark, parts):
    """Null classes, a class of one row and one without a test row; no row is shuffled to be split."""
    frame = spark.range(3001).repartition(parts).selectExpr(
        "id", "case when id = 7 then 2 when id % 10 = 0 then null else cast(id % 3 = 0 as int) end as label", "double(id) as x")
    t = LabelledTable(frame, ("x",), "made")
    total = F.col("total").cast("double")
    test, val = F.floor(total * 0.15 + 0.5), F.floor(total * 0.15 + 0.5) * 2
    want = hash_rank(frame, ["label"], "id", 42, total="total").select(
        "id", F.when(F.col("rank") <= test, "test").when(F.col("rank") <= val, "val").otherwise("train")).collect()
    split = stratified_split(t).frame
    assert dict(split.select("id", "split").collect()) == dict(want) and split.columns == [*frame.columns, "split"]
    want = hash_rank(frame, ["label"], "id", "half", 43, total="total").select(
        "id", F.when(F.col("rank") <= F.floor(total * 0.5 + 0.5), "a").otherwise("b")).collect()
    assert dict(stratified_halves(t, 43).frame.select("id", "half").collect()) == dict(want)
    plan = stratified_split(LabelledTable(spark.range(50).selectExpr("id", "id % 2 as label"), (), "made")).frame
    assert not {"Exchange", "Sort", "Window", "Join"} & set(plan._jdf.queryExecution().executedPlan().toString().replace("(", " ").split())


def test_repeated_ids_are_split_by_rank(spark):
    frame = spark.range(400).selectExpr("if(id < 300, null, id) as id", "1 as label")
    t = LabelledTable(frame, (), "made")
    assert hash_cuts(frame, "label", "id", {"a": F.lit(200)}, "half", 42) is None
    assert {r["half"]: r["count"] for r in stratified_halves(t).frame.groupBy("half").count().collect()} == {"a": 200, "b": 200}
    many = spark.range(400).selectExpr("id", "id as label")  # too many classes to look up
    assert hash_cuts(many, "label", "id", {"a": F.lit(1)}, "half", 42) is None
    assert stratified_halves(LabelledTable(many, (), "made")).frame.filter("half = 'a'").count() == 400


def test_direction_of_a_monotone_attribution_is_the_rank_correlation(spark):
    """Signs without ranking; constant sides, rounding that merges values, and null keys as in the general way."""
    rows = [(k, float(i), w * (i - 7.0)) for k, w in (("up", 0.5), ("down", -2.0), ("none", 0.0), (None, 3.0)) for i in range(20)]
    rows += [("one value", 3.0, 1.0)] * 4 + [("merged", x, -(x - 2.0)) for x in (0.0, 1e-20, 5.0, 5.0)]
    rows += [("nan", float("nan"), float("nan")), ("nan", 1.0, float("nan"))]
    attr = spark.createDataFrame([(k, "f", x, y) for k, x, y in rows], "k string, feature string, value double, attribution double")
    want = {r.k: r.direction for r in directional_importance(attr.filter("k is not null"), ["k"]).collect()} | {None: 1.0}
    got = {r.k: r.direction for r in directional_importance(attr, ["k"], monotone=True).collect()}
    assert got == pytest.approx(want) and -1.0 < got["merged"] < -0.9 and got["up"] == 1.0
    assert got["none"] == got["one value"] == got["nan"] == 0.0


def test_rows_may_bring_the_background_draw(spark):
    frame = spark.range(300).selectExpr("id", "cast(id % 3 = 0 as int) as label", "cast(id % 17 as double) as x")
    t = LabelledTable(frame, ("x",), "made")
    carried = with_background(t, 43).long("drawn")
    assert linear_weights(carried, [], 43).collect() == linear_weights(t.long(), [], 43).collect()
    assert carried.filter("drawn").count() not in (0, 300)


def test_sample_is_the_first_ranks_of_each_class(spark):
    frame = spark.range(1000).selectExpr("id", "cast(id % 4 = 0 as int) as label")
    want = {r["id"] for r in hash_rank(frame, ["label"], "id", "sample", 42).collect() if r["rank"] <= (25 if r["label"] else 75)}
    got = stratified_sample(LabelledTable(frame, (), "made"), 100).frame
    assert {r["id"] for r in got.collect()} == want and len(want) == 100
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_curves_are_settled_once(spark):
    """A table of features, not the rows behind it, is what verdicts and joins read."""
    from labelwatch.catalog.verdicts import curves_of

    frame = spark.range(60).selectExpr("id", "cast(id < 30 as int) as label", "double(id) as x", "double(id % 7) as y")
    curve = curves_of([LabelledTable(frame, ("x", "y"), "made")])
    plan = curve._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and curve.orderBy("iteration").first()["top_feature"] == "x"
