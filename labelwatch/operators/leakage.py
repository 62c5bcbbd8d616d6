"""Does a single feature give the label away?

Everything here starts from one table, ``class_value_counts``: per feature and
distinct value, the rows of each class.  Repeated values collapse before the
shuffle, so a value that fills a third of the table travels as one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwatch.functions.numeric import count_if, d, r6, ratio
from labelwatch.operators.ordering import cumulate
from labelwatch.sources.views import LabelledTable, pooled_long

# Fixed values of the audit protocol.
NEAR_ORACLE_ACCURACY = 0.95
TOP_VALUES = 10
SHARED_EXAMPLES = 10
MI_BINS = 32
HISTOGRAM_BINS = 60

POSITIVE_BELOW = "positive if x <= t"
POSITIVE_ABOVE = "positive if x > t"


def class_value_counts(table: LabelledTable, keys: Sequence[str] = ()) -> DataFrame:
    """(feature, value) with the number of negative (n0) and positive (n1) rows."""
    return table.long(*keys).groupBy(*keys, "feature", "value").agg(
        count_if(F.col("label") == 0).alias("n0"), count_if(F.col("label") == 1).alias("n1"))


def per_class(counts: DataFrame) -> DataFrame:
    """(feature, label, value, n) from the two-column form."""
    return counts.select(
        "feature", "value",
        F.inline(F.array(F.struct(F.lit(0).alias("label"), F.col("n0").alias("n")),
                         F.struct(F.lit(1).alias("label"), F.col("n1").alias("n"))))
    ).filter("n > 0")


def quantile_columns(value: str, n: str, probs: dict[str, float]) -> list[Column]:
    """Exact linear-interpolated quantiles as aggregates over a ``cumulate`` result."""
    last = (F.col(f"all_{n}") - 1).cast("double")
    low, high = F.col(f"cum_{n}") - F.col(n), F.col(f"cum_{n}")

    def at(position: Column) -> Column:
        return F.max(F.when((low <= position) & (position < high), F.col(value)))

    out = []
    for name, p in probs.items():
        at_p = last * F.lit(p)
        below = F.floor(at_p)
        v0, v1 = at(below), at(F.least(below + 1, F.col(f"all_{n}") - 1))
        out.append((v0 + (v1 - v0) * F.max(at_p - below)).alias(name))
    return out


def class_distribution(table: LabelledTable) -> DataFrame:
    """Per (feature, class): size, range, moments, median, distinct values and mode."""
    moments = table.long().groupBy("feature", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"), F.avg("value").alias("mean_value"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std_value"))
    counts = per_class(class_value_counts(table))
    keys = ["feature", "label"]
    run = cumulate(counts, keys, "value", ["n"])
    shape = run.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.max(F.struct(F.col("n"), (-F.col("value")).alias("neg"))).alias("top"),
        *quantile_columns("value", "n", {"median_value": 0.5}))
    return moments.join(shape, keys).select(
        "feature", "label", "n", "min_value", "max_value",
        F.round("mean_value", 4).alias("mean_value"), F.round("median_value", 4).alias("median_value"),
        F.round("std_value", 4).alias("std_value"), "n_distinct",
        (F.col("n_distinct") == 1).alias("constant_in_class"),
        (-F.col("top.neg") + 0.0).alias("mode_value"), F.col("top.n").alias("mode_count"),
        r6(ratio("top.n", "n")).alias("mode_share"))


def class_top_values(table: LabelledTable, k: int = TOP_VALUES) -> DataFrame:
    """The k commonest values per (feature, class); ties go to the smaller value.

    The ``rank <= k`` filter lets Spark keep only k rows per group before the
    shuffle, whatever the number of distinct values.
    """
    counts = per_class(class_value_counts(table))
    order = Window.partitionBy("feature", "label").orderBy(F.desc("n"), "value")
    sizes = counts.groupBy("feature", "label").agg(F.sum("n").alias("n_class"))
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(F.broadcast(sizes), ["feature", "label"]).select(
        "feature", "label", "rank", "value", "n",
        r6(100.0 * d("n") / d("n_class")).alias("percent_of_class"))


def class_top_values_text(table: LabelledTable, k: int = TOP_VALUES) -> DataFrame:
    """The same list as one compact cell per (feature, class)."""
    cell = F.format_string("%.2f:%d(%.2f%%)", "value", "n", "percent_of_class")
    return class_top_values(table, k).groupBy("feature", "label").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", cell.alias("cell")))),
            lambda s: s["cell"]), "; ").alias("top_values"))


def _run(counts: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    return cumulate(counts, keys, "value", ["n0", "n1"])


def threshold_columns(keys: Sequence[str], run: DataFrame) -> DataFrame:
    """Per key the cut with the highest balanced accuracy over both directions."""
    c0, c1, a0, a1 = (d(c) for c in ("cum_n0", "cum_n1", "all_n0", "all_n1"))
    below = F.lit(0.5) * (c1 / a1 + (a0 - c0) / a0)
    above = F.lit(0.5) * ((a1 - c1) / a1 + c0 / a0)

    def best(score: Column) -> Column:
        return F.max(F.struct(score.alias("score"), (-F.col("value")).alias("neg"),
                              F.col("cum_n0").alias("c0"), F.col("cum_n1").alias("c1")))

    got = run.filter("all_n0 > 0 and all_n1 > 0").groupBy(*keys).agg(
        best(below).alias("le"), best(above).alias("gt"),
        F.max("all_n0").alias("a0"), F.max("all_n1").alias("a1"))
    use_le = F.col("le.score") >= F.col("gt.score")
    win = F.when(use_le, F.col("le")).otherwise(F.col("gt"))
    flat = got.select(*keys, "a0", "a1", use_le.alias("use_le"), win.alias("w"))
    tp = F.when(F.col("use_le"), F.col("w.c1")).otherwise(F.col("a1") - F.col("w.c1"))
    fp = F.when(F.col("use_le"), F.col("w.c0")).otherwise(F.col("a0") - F.col("w.c0"))
    flat = flat.select(
        *keys, (-F.col("w.neg") + 0.0).alias("threshold"), F.col("use_le"),
        F.col("w.score").alias("balanced_accuracy"), tp.alias("tp"), fp.alias("fp"),
        (F.col("a1") - tp).alias("fn"), (F.col("a0") - fp).alias("tn"))
    n = d(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return flat.select(
        *keys, "threshold",
        F.when(F.col("use_le"), POSITIVE_BELOW).otherwise(POSITIVE_ABOVE).alias("direction"),
        r6("balanced_accuracy").alias("balanced_accuracy"),
        r6(d(F.col("tp") + F.col("tn")) / n).alias("accuracy"),
        r6(ratio("tp", F.col("tp") + F.col("fp"))).alias("precision"),
        r6(ratio("tp", F.col("tp") + F.col("fn"))).alias("recall"),
        r6(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"),
        F.col("fp").alias("negatives_on_positive_side"),
        F.col("fn").alias("positives_on_negative_side"))


def pooled_thresholds(tables: Sequence[LabelledTable]) -> DataFrame:
    """``best_threshold`` of several tables in one plan, keyed by (dataset, feature)."""
    keys = ["dataset", "feature"]
    counts = pooled_long(tables).groupBy(*keys, "value").agg(
        count_if(F.col("label") == 0).alias("n0"), count_if(F.col("label") == 1).alias("n1"))
    return threshold_columns(keys, _run(counts, keys))


def best_threshold(table: LabelledTable) -> DataFrame:
    """Single cut per feature maximising balanced accuracy.

    Ties prefer the ``<=`` direction, then the smallest cut.
    """
    return threshold_columns(["feature"], _run(class_value_counts(table)))


def separation_type(table: LabelledTable) -> DataFrame:
    """How the two classes overlap on each feature, joined to its best cut."""
    counts = class_value_counts(table)
    cuts = threshold_columns(["feature"], _run(counts))
    pos, neg = F.col("n1") > 0, F.col("n0") > 0
    shape = counts.groupBy("feature").agg(
        F.min(F.when(pos, F.col("value"))).alias("positive_min"),
        F.max(F.when(pos, F.col("value"))).alias("positive_max"),
        F.min(F.when(neg, F.col("value"))).alias("negative_min"),
        F.max(F.when(neg, F.col("value"))).alias("negative_max"),
        count_if(pos).alias("n_distinct_positive"), count_if(neg).alias("n_distinct_negative"),
        count_if(pos & neg).alias("n_shared_values"),
        F.coalesce(F.sum(F.when(pos & neg, F.col("n0") + F.col("n1"))), F.lit(0)).alias("n_rows_at_shared_values"))
    first = Window.partitionBy("feature").orderBy("value")
    examples = (counts.filter(pos & neg).withColumn("rn", F.row_number().over(first))
                .filter(F.col("rn") <= SHARED_EXAMPLES)
                .groupBy("feature").agg(F.array_join(F.transform(
                    F.array_sort(F.collect_list("value")),
                    lambda v: F.format_string("%.4f", v)), "; ").alias("shared_value_examples")))
    pure = (F.col("negatives_on_positive_side") == 0) | (F.col("positives_on_negative_side") == 0)
    one_constant = (F.col("n_distinct_positive") == 1) | (F.col("n_distinct_negative") == 1)
    kind = (F.when(F.col("n_shared_values") == 0, "disjoint")
             .when((F.col("n_shared_values") == 1) & one_constant & pure, "degenerate_point_mass")
             .when(pure, "one_sided_pure").otherwise("genuine_overlap"))
    return (cuts.join(shape, "feature").join(examples, "feature", "left")
            .withColumn("separation_type", kind)
            .withColumn("classes_disjoint", F.col("n_shared_values") == 0)
            .fillna({"shared_value_examples": ""}))


def class_histogram(table: LabelledTable, bins: int = HISTOGRAM_BINS,
                    clip: tuple[float, float] | None = None) -> DataFrame:
    """Per-class counts on bins shared by both classes.

    Bins are equal-width over the feature's range, or over the range between
    two quantiles with everything outside left out.
    """
    counts = class_value_counts(table).withColumn("n", F.col("n0") + F.col("n1"))
    if clip:
        run = cumulate(counts, ["feature"], "value", ["n"])
        span = run.groupBy("feature").agg(*quantile_columns("value", "n", {"lo": clip[0], "hi": clip[1]}))
    else:
        span = counts.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # A constant feature gets a unit range around its value.
    flat = F.col("hi") == F.col("lo")
    span = span.select("feature", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                       F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    place = F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    return (counts.join(F.broadcast(span), "feature")
            .filter((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
            .withColumn("bin", place)
            .groupBy("feature", "bin").agg(F.sum("n0").alias("n_negative"), F.sum("n1").alias("n_positive")))


def mutual_information(table: LabelledTable, bins: int = MI_BINS) -> DataFrame:
    """Plug-in MI(feature; label) in nats: exact values if few, else quantile bins."""
    counts = class_value_counts(table).withColumn("n", F.col("n0") + F.col("n1")).withColumn("one", F.lit(1))
    run = cumulate(counts, ["feature"], "value", ["n", "one"])
    slot = F.when(F.col("all_one") <= bins, F.col("cum_one")).otherwise(
        F.floor(d(F.col("cum_n") - F.col("n")) * bins / d("all_n")))
    binned = run.withColumn("bin", slot.cast("bigint")).groupBy("feature", "bin").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # features x bins rows from here on
    whole = Window.partitionBy("feature")
    t0, t1 = F.sum("n0").over(whole), F.sum("n1").over(whole)
    cells = binned.select("feature", d("n0").alias("n0"), d("n1").alias("n1"),
                          d(t0).alias("t0"), d(t1).alias("t1"))
    n = F.col("t0") + F.col("t1")
    nb = F.col("n0") + F.col("n1")

    def term(c: str, t: str) -> Column:
        x = F.col(c)
        return F.when(x > 0, x / n * F.ln(x * n / (nb * F.col(t)))).otherwise(0.0)

    return cells.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_bins"),
        r6(F.greatest(F.sum(term("n0", "t0") + term("n1", "t1")), F.lit(0.0))).alias("mi_nats"))


def near_oracle_count(scores: DataFrame, bar: float = NEAR_ORACLE_ACCURACY,
                      keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """How many features alone score above the bar, and which."""
    above = F.col("accuracy") > bar
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_features"), count_if(above).alias("n_above_bar"),
        F.array_join(F.array_sort(F.collect_list(F.when(above, F.col("feature")))), "; ").alias("features_above_bar"))


def constant_rule_score(table: LabelledTable, feature: str, cut: float) -> DataFrame:
    """Score ``feature < cut -> positive`` on all rows, with the value behind most errors."""
    counts = class_value_counts(table.only([feature]))
    says = F.col("value") < F.lit(cut)
    wrong = F.when(says, F.col("n0")).otherwise(F.col("n1"))
    return counts.agg(
        F.sum(F.when(says, F.col("n1")).otherwise(0)).alias("tp"),
        F.sum(F.when(says, F.col("n0")).otherwise(0)).alias("fp"),
        F.sum(F.when(says, 0).otherwise(F.col("n1"))).alias("fn"),
        F.sum(F.when(says, 0).otherwise(F.col("n0"))).alias("tn"),
        F.max(F.struct(wrong.alias("n"), (-F.col("value")).alias("neg"))).alias("worst"),
    ).select(
        F.lit(feature).alias("feature"), "tp", "fp", "fn", "tn",
        r6(d(F.col("tp") + F.col("tn")) / d(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"),
        (-F.col("worst.neg") + 0.0).alias("worst_value"), F.col("worst.n").alias("errors_at_worst_value"),
        r6(ratio("worst.n", F.col("fp") + F.col("fn"))).alias("share_of_errors"))
