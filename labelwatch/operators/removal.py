"""Removal curves and the verdicts read off them.

A curve has one row per (dataset, iteration): the features left, the accuracy
reached with them and the feature to remove next.  At most sixteen rows per
dataset, so the windows here run over model-sized tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelwatch.functions.numeric import count_if, d, r6
from labelwatch.operators.leakage import NEAR_ORACLE_ACCURACY, pooled_thresholds
from labelwatch.sources.views import LabelledTable

# Fixed values of the audit protocol.
TARGET_ACCURACY = 0.99
MAX_REMOVED = 15
VERDICT_THRESHOLDS = (0.97, 0.98, 0.99, 0.995)
USABLE_VERDICTS = ("clean", "repairable")
COLLAPSE, USABLE_LOW, USABLE_HIGH = 0.80, 0.95, 0.98
VARIANT_MARK = "__"


def threshold_name(t: float) -> str:
    return f"verdict_at_{t}".replace(".", "_")


def _stop(rows: DataFrame, target: float, max_removed: int) -> DataFrame:
    """Keep a curve up to and including the first row below target, within the removal budget."""
    earlier = Window.partitionBy("dataset").orderBy("iteration").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.filter((F.col("iteration") <= max_removed) & (F.col("n_features") >= 2))
                .withColumn("_low", F.min("accuracy").over(earlier))
                .filter(F.col("_low").isNull() | (F.col("_low") >= target)).drop("_low"))


def progressive_removal_single(tables: Sequence[LabelledTable], target: float = TARGET_ACCURACY,
                               max_removed: int = MAX_REMOVED) -> DataFrame:
    """The greedy loop with single-cut rules instead of a model, without a loop.

    With rules that never change when others go, the feature removed at step i
    is simply the i-th best, so one ranking replaces max_removed fits.
    """
    order = Window.partitionBy("dataset").orderBy(F.desc("balanced_accuracy"), "feature")
    whole = Window.partitionBy("dataset")
    # one row per (dataset, feature)
    rows = pooled_thresholds(tables).withColumn("iteration", F.row_number().over(order) - 1).select(
        "dataset", "iteration", (F.count(F.lit(1)).over(whole) - F.col("iteration")).cast("int").alias("n_features"),
        F.col("feature").alias("top_feature"), "accuracy", "balanced_accuracy", "f1")
    return removed_marks(_stop(rows, target, max_removed), target, max_removed)


def removed_marks(curve: DataFrame, target: float = TARGET_ACCURACY, max_removed: int = MAX_REMOVED) -> DataFrame:
    """``removed_feature``: the top feature, or empty on the row where the loop stops."""
    stops = (F.col("accuracy") < target) | (F.col("iteration") >= max_removed)
    return curve.withColumn("removed_feature", F.when(stops, "").otherwise(F.col("top_feature")))


def curve_lead(curve: DataFrame) -> DataFrame:
    """Adds the feature that leads once this row's feature is gone."""
    nxt = F.lead("top_feature").over(Window.partitionBy("dataset").orderBy("iteration"))
    return curve.select("dataset", "iteration", F.col("top_feature").alias("top_feature_before"),
                        F.coalesce(nxt, F.lit("")).alias("top_feature_after"))


def feature_set_at_iteration(features: DataFrame, curve: DataFrame) -> DataFrame:
    """Features still present at each iteration, rebuilt from the removals before it, and checked."""
    steps = curve.select("dataset", F.col("iteration").alias("at"), "n_features")
    gone = curve.filter("removed_feature <> ''").select(
        "dataset", F.col("removed_feature").alias("feature"), "iteration")
    left = features.join(steps, "dataset").alias("f").join(
        gone.alias("g"), (F.col("f.dataset") == F.col("g.dataset")) & (F.col("f.feature") == F.col("g.feature"))
        & (F.col("g.iteration") < F.col("f.at")), "left_anti")
    sizes = left.groupBy("dataset", "at").agg(F.count(F.lit(1)).alias("n_left"))
    return left.join(sizes, ["dataset", "at"]).select(
        "dataset", F.col("at").alias("iteration"), "feature",
        (F.col("n_left") == F.col("n_features")).alias("count_matches"))


def removal_outcome(curve: DataFrame, target: float = TARGET_ACCURACY) -> DataFrame:
    """What removing features achieved, from the last row of each curve."""
    last = curve.groupBy("dataset").agg(
        F.max("iteration").alias("n_removed"),
        F.max(F.struct("iteration", "accuracy"))["accuracy"].alias("final_accuracy"),
        F.min(F.struct("iteration", "accuracy"))["accuracy"].alias("full_accuracy"))
    acc = F.col("final_accuracy")
    kind = (F.when(acc >= target, "not_deleaked").when(acc < COLLAPSE, "accuracy_collapse")
             .when((acc >= USABLE_LOW) & (acc <= USABLE_HIGH), "usable_variant").otherwise("between"))
    return last.select("dataset", "n_removed", "full_accuracy", "final_accuracy",
                       r6(F.col("full_accuracy") - acc).alias("drop"), kind.alias("outcome"))


def verdict_at(curve: DataFrame, thresholds: Sequence[float] = VERDICT_THRESHOLDS,
               max_removed: int = MAX_REMOVED) -> DataFrame:
    """(dataset, threshold, verdict), derived from one stored curve per dataset.

    A curve that stopped before reaching a lower threshold cannot answer for it
    and says so: ``undetermined``.
    """
    each = curve.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    got = each.groupBy("dataset", "threshold").agg(
        F.max(F.when(F.col("iteration") == 0, F.col("accuracy"))).alias("full"),
        F.min(F.when(F.col("accuracy") < F.col("threshold"), F.col("iteration"))).alias("below"),
        F.max("iteration").alias("last"))
    verdict = (F.when(F.col("full") < F.col("threshold"), "clean")
                .when(F.col("below") <= max_removed, "repairable")
                .when(F.col("below").isNotNull(), "unrepairable")
                .when(F.col("last") >= max_removed, "unrepairable").otherwise("undetermined"))
    return got.select("dataset", "threshold", verdict.alias("verdict"))


def verdict_sensitivity(verdicts: DataFrame, thresholds: Sequence[float] = VERDICT_THRESHOLDS) -> DataFrame:
    """Thresholds side by side and whether the (determined) verdict moves with them."""
    return verdicts.groupBy("dataset").agg(
        *[F.max(F.when(F.col("threshold") == float(t), F.col("verdict"))).alias(threshold_name(t)) for t in thresholds],
        (F.countDistinct(F.when(F.col("verdict") != "undetermined", F.col("verdict"))) > 1).alias("verdict_changes"))


def screen_rows(curve: DataFrame, target: float = TARGET_ACCURACY, max_removed: int = MAX_REMOVED) -> DataFrame:
    """One row per dataset: verdict, removals and the minimal leaking set."""
    got = curve.groupBy("dataset").agg(
        F.max(F.when(F.col("iteration") == 0, F.col("accuracy"))).alias("full_accuracy"),
        F.max(F.struct("iteration", "accuracy"))["accuracy"].alias("final_accuracy"),
        count_if(F.col("removed_feature") != "").alias("n_removed"),
        F.max("iteration").alias("_last"),
        # bounded: at most max_removed names
        F.array_sort(F.collect_list(F.when(F.col("removed_feature") != "", F.struct(
            "iteration", F.col("removed_feature").alias("f"))))).alias("_removed"))
    verdict = (F.when(F.col("full_accuracy") < target, "clean").when(F.col("final_accuracy") < target, "repairable")
                .when(F.col("_last") >= max_removed, "unrepairable").otherwise("exhausted_features"))
    names = F.array_join(F.transform("_removed", lambda s: s["f"]), "; ")
    return got.withColumn("verdict", verdict).select(
        "dataset", "full_accuracy", "final_accuracy", "n_removed", "verdict",
        F.when(F.col("verdict") == "repairable", names).otherwise("").alias("minimal_leaking_set"))


def population_table(scores: DataFrame, curve: DataFrame) -> DataFrame:
    """All screened tables side by side, led by the count of near-oracle features."""
    above = F.col("accuracy") > NEAR_ORACLE_ACCURACY
    # larger accuracy first, then the smaller name: min over (-accuracy, name)
    single = scores.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_features"), count_if(above).alias("n_features_above_95"),
        F.min(F.struct((-F.col("accuracy")).alias("neg"), "feature")).alias("best"))
    wide = verdict_sensitivity(verdict_at(curve))
    return (single.join(screen_rows(curve), "dataset").join(wide, "dataset").select(
        "dataset", (~F.col("dataset").contains(VARIANT_MARK)).alias("is_independent"),
        "n_features_above_95", F.when(F.col("n_features_above_95") > 0, "leaky").otherwise("clean").alias("contrast"),
        F.col("best.feature").alias("best_single_feature"), (-F.col("best.neg")).alias("best_single_feature_accuracy"),
        "verdict", "full_accuracy", "n_removed", "final_accuracy", "n_features", "minimal_leaking_set",
        *[threshold_name(t) for t in VERDICT_THRESHOLDS], "verdict_changes")
        .orderBy(F.desc("n_features_above_95"), "dataset"))


def label_policy_sensitivity(screened: DataFrame) -> DataFrame:
    """Each policy variant (``stem__policy``) next to its primary table."""
    stem = F.split("dataset", VARIANT_MARK)[0]
    variant = screened.filter(F.col("dataset").contains(VARIANT_MARK)).select(
        stem.alias("stem"), F.col("dataset").alias("variant"), F.col("verdict").alias("variant_verdict"),
        F.col("full_accuracy").alias("variant_accuracy"))
    primary = screened.filter(~F.col("dataset").contains(VARIANT_MARK)).select(
        F.col("dataset").alias("stem"), F.col("verdict").alias("primary_verdict"),
        F.col("full_accuracy").alias("primary_accuracy"))
    return variant.join(primary, "stem").withColumn(
        "stable", F.col("variant_verdict") == F.col("primary_verdict"))


def screen_gate(screened: DataFrame) -> DataFrame:
    """Tables usable as partners: acceptable verdict, not a policy variant."""
    return screened.filter(F.col("verdict").isin(*USABLE_VERDICTS)
                           & ~F.col("dataset").contains(VARIANT_MARK)).select("dataset", "verdict")


def validate_verdicts(screened: DataFrame, expected: DataFrame) -> DataFrame:
    """Reproduce the verdicts that are known before trusting the screen on anything new."""
    return expected.join(screened.select("dataset", "verdict"), "dataset", "left").withColumn(
        "passed", F.coalesce(F.col("verdict") == F.col("expected"), F.lit(False)))


def regime_reconciliation(static: DataFrame, retuned: DataFrame, target: float = TARGET_ACCURACY) -> DataFrame:
    """One feature set, two parameter regimes: the gap and whether it straddles the target."""
    return static.join(retuned, "feature_set").select(
        "feature_set", "accuracy_static", "accuracy_retuned",
        r6(d("accuracy_retuned") - d("accuracy_static")).alias("difference"),
        ((F.col("accuracy_static") < target) != (F.col("accuracy_retuned") < target)).alias("crosses_target"))
