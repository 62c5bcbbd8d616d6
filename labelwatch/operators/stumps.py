"""Depth-limited trees on ONE feature each, for all features in one plan.

A tree on a single feature only ever asks for class counts inside intervals of
that feature.  Running class counts over the distinct values answer that for
any interval by subtraction, so one prefix pass serves every round: a round
joins the small node table, scores all cuts and keeps the best per node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwatch.functions.numeric import count_if, d, r6, ratio
from labelwatch.operators.leakage import mutual_information
from labelwatch.operators.ordering import cumulate
from labelwatch.session import stored
from labelwatch.sources.tables import local_table
from labelwatch.sources.views import LabelledTable, pooled_long

MAX_DEPTH = 3
LOW, HIGH = float("-inf"), float("inf")


KEYS = ["dataset", "feature"]


def split_value_counts(tables: Sequence[LabelledTable], split_col: str = "split") -> DataFrame:
    """Class counts per (dataset, feature, value), separately for fitting and test rows."""
    test, pos = F.col(split_col) == "test", F.col("label") == 1
    return pooled_long(tables, split_col).groupBy(*KEYS, "value").agg(
        count_if(~test & ~pos).alias("n0"), count_if(~test & pos).alias("n1"),
        count_if(test & ~pos).alias("s0"), count_if(test & pos).alias("s1"))


def _purity(neg: Column, pos: Column) -> Column:
    """Weighted Gini up to constants: larger is purer."""
    return (neg * neg + pos * pos) / (neg + pos)


NODE = ("dataset string, feature string, node int, first double, last double, above double, upto double, "
        "base0 bigint, base1 bigint, n0 bigint, n1 bigint")


def _best_cuts(run: DataFrame, nodes: DataFrame) -> list:
    """The purest cut of every open node; equal purity goes to the smallest value."""
    # at most features x 2**depth nodes
    cand = run.select(*KEYS, "value", "next_value", "cum_n0", "cum_n1").join(
        F.broadcast(nodes), KEYS).filter(
        (F.col("value") > F.col("first")) & (F.col("value") <= F.col("last")))
    l0, l1 = d(F.col("cum_n0") - F.col("base0")), d(F.col("cum_n1") - F.col("base1"))
    r0, r1 = d("n0") - l0, d("n1") - l1
    return cand.filter(r0 + r1 > 0).groupBy(*KEYS, "node").agg(F.max(F.struct(
        (_purity(l0, l1) + _purity(r0, r1)).alias("score"), (-F.col("value")).alias("neg"),
        "next_value", "cum_n0", "cum_n1")).alias("b")).select(*KEYS, "node", "b.*").collect()


def _halves(node: dict, cut) -> list[dict]:
    """The two children of a node at a chosen cut; the threshold lies midway between fitting values."""
    value, middle = -cut["neg"], (-cut["neg"] + cut["next_value"]) / 2.0
    low = dict(node, node=2 * node["node"], last=value, upto=middle,
               n0=cut["cum_n0"] - node["base0"], n1=cut["cum_n1"] - node["base1"])
    high = dict(node, node=2 * node["node"] + 1, first=value, above=middle,
                base0=cut["cum_n0"], base1=cut["cum_n1"],
                n0=node["n0"] - low["n0"], n1=node["n1"] - low["n1"])
    return [low, high]


def grow(counts: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Leaves (feature, node, above, upto, n0, n1): intervals ``above < x <= upto``.

    One job per level over the stored prefix table; between levels only the
    model itself, features x 2**depth intervals, is on the driver.
    """
    spark = counts.sparkSession
    fit = counts.filter("n0 + n1 > 0").select(*KEYS, "value", "n0", "n1")
    run = cumulate(fit, KEYS, "value", ["n0", "n1"]).persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        roots = run.groupBy(*KEYS).agg(F.max("all_n0").alias("n0"), F.max("all_n1").alias("n1")).collect()
        level = [dict(dataset=r["dataset"], feature=r["feature"], node=1, first=LOW, last=HIGH, above=LOW, upto=HIGH,
                      base0=0, base1=0, n0=r["n0"], n1=r["n1"]) for r in roots]
        leaves: list[dict] = []
        for _ in range(depth):
            mixed = [n for n in level if n["n0"] and n["n1"]]
            leaves += [n for n in level if not (n["n0"] and n["n1"])]
            cuts = {(c["dataset"], c["feature"], c["node"]): c
                    for c in (_best_cuts(run, local_table(spark, mixed, NODE)) if mixed else [])}
            level = []
            for n in mixed:
                cut = cuts.get((n["dataset"], n["feature"], n["node"]))
                if cut is None:
                    leaves.append(n)
                else:
                    level += _halves(n, cut)
        leaves += level
    finally:
        run.unpersist()
    return local_table(spark, leaves, NODE).select(
        *KEYS, "node", "above", "upto", "n0", "n1",
        (F.col("n1") > F.col("n0")).cast("int").alias("prediction"))


def single_feature_tree(tables: Sequence[LabelledTable], split_col: str = "split",
                        depth: int = MAX_DEPTH) -> DataFrame:
    """Test scores of a depth-limited tree grown on each feature of each table alone."""
    counts = stored(split_value_counts(tables, split_col))  # read to grow and to score
    return _test_scores(counts, grow(counts, depth))


def _test_scores(counts: DataFrame, leaves: DataFrame) -> DataFrame:
    hits = counts.filter("s0 + s1 > 0").join(
        F.broadcast(leaves.select(*KEYS, "above", "upto", "prediction")), KEYS).filter(
        (F.col("value") > F.col("above")) & (F.col("value") <= F.col("upto")))
    yes = F.col("prediction") == 1
    conf = hits.groupBy(*KEYS).agg(
        F.sum(F.when(yes, F.col("s1")).otherwise(0)).alias("tp"),
        F.sum(F.when(yes, F.col("s0")).otherwise(0)).alias("fp"),
        F.sum(F.when(yes, 0).otherwise(F.col("s1"))).alias("fn"),
        F.sum(F.when(yes, 0).otherwise(F.col("s0"))).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return conf.select(
        *KEYS, n.alias("n_test"), r6(ratio(F.col("tp") + F.col("tn"), n)).alias("accuracy"),
        r6(ratio("tp", F.col("tp") + F.col("fp"))).alias("precision"),
        r6(ratio("tp", F.col("tp") + F.col("fn"))).alias("recall"),
        r6(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def targeted_investigation(table: LabelledTable, feature: str, split_col: str = "split",
                           depth: int = MAX_DEPTH) -> DataFrame:
    """One suspect: tree scores, information about the label and the learned rule."""
    suspect = table.only([feature])
    counts = split_value_counts([suspect], split_col)
    leaves = grow(counts, depth)
    fitting = suspect.where(F.col(split_col) != "test")
    # at most 2**depth leaves
    rule = leaves.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_leaves"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("upto", "prediction"))),
            lambda s: F.concat(F.lit("x <= "), F.format_string("%.4f", s["upto"]), F.lit(": "),
                               s["prediction"].cast("string"))), "; ").alias("rule"))
    return _test_scores(counts, leaves).join(mutual_information(fitting), "feature").join(rule, "feature")
