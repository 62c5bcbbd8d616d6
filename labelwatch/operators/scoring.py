"""Scoring predictions, keyed by any set of columns, in aggregations only."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwatch.functions.numeric import count_if, d, r6, ratio, steady
from labelwatch.operators.ordering import cumulate
from labelwatch.sources.views import LabelledTable

METRICS = ("accuracy", "precision", "recall", "f1", "mcc", "roc_auc")
FLOOR_ACCURACY = 0.90
CLIP = 1e-15


@dataclass(frozen=True)
class LinearScorer:
    """score(x) = sum of weight * (x - centre) / spread.  A closed-form fit, hence checkable in SQL."""

    weights: dict[str, float]
    centres: dict[str, float]
    spreads: dict[str, float]

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(sorted(self.weights))

    def part(self, feature: str, value: Column | None = None) -> Column:
        x = d(feature) if value is None else value
        return F.lit(self.weights[feature]) * (x - F.lit(self.centres[feature])) / F.lit(self.spreads[feature])

    def score(self, only: Sequence[str] | None = None) -> Column:
        """The score; features outside ``only`` stay at their centre and add nothing."""
        return reduce(add, [self.part(f) for f in (only or self.features)])


@dataclass(frozen=True)
class CrossFitted:
    """Scorers of rows that took no part in their fit: ``by`` names the column that holds a row's key."""

    by: str
    scorers: Mapping[str, LinearScorer]

    def _own(self, expression: Callable[[LinearScorer], Column]) -> Column:
        return F.coalesce(*[F.when(F.col(self.by) == key, expression(s)) for key, s in self.scorers.items()])

    def part(self, feature: str, value: Column | None = None) -> Column:
        return self._own(lambda s: s.part(feature, value))

    def score(self) -> Column:
        return self._own(lambda s: s.score())


def cross_fit(table: LabelledTable, by: str = "half", pair: tuple[str, str] = ("a", "b")) -> CrossFitted:
    """Each half's rows are scored by the fit on the other half, so every row is scored and none by its own fit."""
    return CrossFitted(by, {mine: fit_linear(table.where(F.col(by) == other)) for mine, other in (pair, pair[::-1])})


def fit_linear(table: LabelledTable) -> LinearScorer:
    """Weight (mean1 - mean0) / std per feature, from one aggregation of the training rows.

    What reaches the driver is three numbers per feature.
    """
    frame = table.frame.filter(F.col("split") == "train") if "split" in table.frame.columns else table.frame
    pos, neg = F.col(table.label_col) == 1, F.col(table.label_col) == 0
    aggs = []
    for f in table.features:
        aggs += [F.avg(d(f)).alias(f"m_{f}"), F.stddev_pop(d(f)).alias(f"s_{f}"),
                 F.avg(F.when(pos, d(f))).alias(f"p_{f}"), F.avg(F.when(neg, d(f))).alias(f"n_{f}")]
    spread = {f: F.when(steady(f"s_{f}") > 0, steady(f"s_{f}")).otherwise(1.0) for f in table.features}
    row = frame.agg(*aggs).select(
        *[steady((F.col(f"p_{f}") - F.col(f"n_{f}")) / spread[f]).alias(f"w_{f}") for f in table.features],
        *[steady(f"m_{f}").alias(f"m_{f}") for f in table.features],
        *[spread[f].alias(f"s_{f}") for f in table.features]).first()
    return LinearScorer(*({f: row[f"{tag}_{f}"] for f in table.features} for tag in ("w", "m", "s")))


def linear_predictions(table: LabelledTable, scorer: LinearScorer, keep: Sequence[str] = ()) -> DataFrame:
    """(id, label, score, probability, prediction): one projection of the scan."""
    score = F.round(scorer.score(), 6)
    return table.frame.select(
        F.col(table.id_col).alias("id"), F.col(table.label_col).alias("label"), *keep, score.alias("score"),
    ).withColumn("probability", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("score")))
    ).withColumn("prediction", (F.col("score") >= 0).cast("int"))


def roc_auc(pred: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Exact AUC with ties: positives above each negative, half for equals.

    Rows collapse to distinct scores first, then one prefix pass.
    """
    counts = pred.groupBy(*keys, score).agg(
        count_if(F.col("label") == 0).alias("n0"), count_if(F.col("label") == 1).alias("n1"))
    run = cumulate(counts, list(keys), score, ["n0", "n1"])
    won = d("n1") * (d(F.col("cum_n0") - F.col("n0")) + d("n0") / 2.0)
    return run.groupBy(*keys).agg(
        F.sum(won).alias("_won"), F.max("all_n0").alias("_n0"), F.max("all_n1").alias("_n1")).select(
        *keys, r6(ratio("_won", d("_n0") * d("_n1"), None)).alias("roc_auc"))


def confusion_counts(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    y, p = F.col("label") == 1, F.col("prediction") == 1
    return pred.groupBy(*keys).agg(count_if(y & p).alias("tp"), count_if(~y & p).alias("fp"),
                                   count_if(y & ~p).alias("fn"), count_if(~y & ~p).alias("tn"))


def rates(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy, precision, recall, F1 and MCC; zero wherever a denominator is zero."""
    tp, fp, fn, tn = (d(c) for c in ("tp", "fp", "fn", "tn"))
    margins = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return counts.select(
        *keys, (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"),
        r6(ratio(tp + tn, tp + fp + fn + tn)).alias("accuracy"), r6(ratio(tp, tp + fp)).alias("precision"),
        r6(ratio(tp, tp + fn)).alias("recall"), r6(ratio(2.0 * tp, 2.0 * tp + fp + fn)).alias("f1"),
        r6(F.when(margins > 0, (tp * tn - fp * fn) / F.sqrt(margins)).otherwise(0.0)).alias("mcc"))


def score_predictions(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every metric of every cell."""
    return rates(confusion_counts(pred, keys), keys).join(roc_auc(pred, keys), list(keys))


def confusion_matrix(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The full 2 x 2 grid per key, empty cells included, with row shares."""
    grid = F.array(*[F.struct(F.lit(y).alias("label"), F.lit(p).alias("prediction"), F.col(c).alias("n"))
                     for y, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    counts = confusion_counts(pred, keys)
    cells = counts.select(*keys, (F.col("tn") + F.col("fp")).alias("neg"), (F.col("tp") + F.col("fn")).alias("pos"),
                          F.inline(grid))
    whole = F.when(F.col("label") == 0, F.col("neg")).otherwise(F.col("pos"))
    return cells.select(*keys, "label", "prediction", "n", r6(ratio("n", whole)).alias("row_share"))


def log_loss(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean negative log-likelihood of the clipped probability."""
    p = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.col("probability")))
    return pred.groupBy(*keys).agg(
        r6(F.avg(-F.ln(F.when(F.col("label") == 1, p).otherwise(1.0 - p)))).alias("log_loss"))


def majority_baseline(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What always predicting the larger class scores, and how far the model is above it."""
    rate = F.avg(d("label"))
    hit = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    return pred.groupBy(*keys).agg(rate.alias("_rate"), hit.alias("_acc")).select(
        *keys, r6(F.greatest("_rate", 1.0 - F.col("_rate"))).alias("majority_accuracy"), r6("_acc").alias("accuracy"),
        r6(F.col("_acc") - F.greatest("_rate", 1.0 - F.col("_rate"))).alias("accuracy_above_majority"))


def soft_vote(df: DataFrame, members: Sequence[str]) -> DataFrame:
    """Equal-weight mean of member probabilities, 0.5 and above is positive.  No join, no shuffle."""
    mean = reduce(add, [d(m) for m in members]) / F.lit(float(len(members)))
    return df.withColumn("probability", mean).withColumn(
        "prediction", (F.col("probability") >= 0.5).cast("int"))


def seed_summary(scores: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS,
                 model_order: Sequence[str] | None = None) -> DataFrame:
    """Mean and sample std of each metric over seeds, in an explicit model order."""
    got = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_seeds"),
        *[r6(F.avg(m)).alias(f"{m}_mean") for m in metrics],
        *[r6(F.coalesce(F.stddev_samp(m), F.lit(0.0))).alias(f"{m}_std") for m in metrics])
    if model_order is None:
        return got
    place = F.array_position(F.array(*[F.lit(m) for m in model_order]), F.col("model")).cast("int")
    return got.withColumn("model_rank", place).orderBy(*[k for k in keys if k != "model"], "model_rank")


def sanity_checks(summary: DataFrame, expected: DataFrame, floor: float = FLOOR_ACCURACY) -> DataFrame:
    """Each config against its expected band; leak-free configs must stay below a perfect score."""
    acc = F.col("accuracy_mean")
    return summary.join(expected, "config", "left").select(
        "config", "accuracy_mean", (acc >= floor).alias("above_floor"),
        F.coalesce((acc >= F.col("low")) & (acc <= F.col("high")), F.lit(True)).alias("in_band"),
        F.coalesce(~F.col("must_be_imperfect") | (acc < 1.0), F.lit(True)).alias("imperfect_enough"))


def params_for_config(configs: DataFrame, config_params: DataFrame, dataset_params: DataFrame) -> DataFrame:
    """Parameters per config: its own, else those of an identical config, else the dataset's."""
    own = config_params.select("config", F.col("params").alias("own"))
    twin = config_params.select(F.col("config").alias("identical_to"), F.col("params").alias("twin"))
    base = dataset_params.select("dataset", F.col("params").alias("base"))
    found = configs.join(own, "config", "left").join(twin, "identical_to", "left").join(base, "dataset", "left")
    source = (F.when(F.col("own").isNotNull(), "config").when(F.col("twin").isNotNull(), "identical config")
               .when(F.col("base").isNotNull(), "dataset").otherwise("defaults"))
    return found.select("config", "dataset", F.coalesce("own", "twin", "base").alias("params"), source.alias("source"))
