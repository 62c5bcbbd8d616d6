"""Loops of fits whose rows are appended to a table as they come: a stopped run goes on where it was.

A round or trial depends only on the seed and on rows stored before it, so a run that was killed and started again on
the same folder gives the rows of a run that was not, without fitting a stored round twice.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import prod
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.base import Estimator
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwatch.operators import models, scoring
from labelwatch.operators.importance import global_importance
from labelwatch.operators.removal import MAX_REMOVED, TARGET_ACCURACY, removed_marks
from labelwatch.operators.splitting import resume_pending, stratified_folds
from labelwatch.session import ensure_checkpoint_dir, scratch_folder
from labelwatch.sources.tables import local_table
from labelwatch.sources.views import LabelledTable

# Fixed names of the two parameter regimes.
RETUNED, STATIC = "retuned", "static"

# Three product spaces; the numbers of the first and last parameter of each learner are fixed values of the protocol.
SEARCH_SPACES = {
    "forest": {"numTrees": (100, 300, 500), "maxDepth": (10, 20, 30), "minInstancesPerNode": (1, 2, 5),
               "featureSubsetStrategy": ("sqrt", "log2")},
    "boosted_deep": {"maxIter": (100, 300, 500), "maxDepth": (3, 6, 9), "stepSize": (0.01, 0.05, 0.1),
                     "subsamplingRate": (0.8, 1.0), "featureSubsetStrategy": ("0.8", "all")},
    "boosted_wide": {"maxIter": (100, 300, 500), "maxDepth": (5, 6, 7), "stepSize": (0.01, 0.05, 0.1),
                     "minInstancesPerNode": (20, 50)},
}
N_TRIALS, N_FOLDS = 50, 5

CURVE = ("dataset string, seed int, iteration int, n_features int, top_feature string, accuracy double, f1 double, mcc double, "
         "fit_seconds double, attribution_seconds double, total_nodes int, mean_tree_depth double, mean_leaf_depth double, "
         "hyperparameter_regime string")
TRIALS = "dataset string, seed int, learner string, trial int, cell long, params map<string,string>, mean_f1 double"


@dataclass(frozen=True)
class StoredRows:
    """A small table of a loop's rows, below a folder that outlives the driver; an append is there whole or not at all."""

    spark: SparkSession
    folder: str
    schema: str

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def open(self) -> StoredRows:
        """Create the table where it is missing; appending no row changes nothing."""
        self.spark.createDataFrame([], self.schema).write.mode("append").parquet(self.folder)
        return self

    def append(self, row: dict) -> None:
        local_table(self.spark, [row], self.schema).coalesce(1).write.mode("append").parquet(self.folder)


def stored_rows(spark: SparkSession, folder: str | None, schema: str) -> StoredRows:
    return StoredRows(spark, folder or f"{scratch_folder(spark)}/rows", schema).open()


def progressive_removal(table: LabelledTable, target: float = TARGET_ACCURACY, max_removed: int = MAX_REMOVED, seed: int = 42,
                        n_explain: int = models.N_EXPLAIN, params: Mapping[str, Mapping] | None = None,
                        names: Sequence[str] = models.MODELS, store: str | None = None) -> DataFrame:
    """Fit the members, score and explain their vote, drop the top feature; until accuracy falls below target.

    params: of the members, tuned on all features, so only round 0 is of the retuned regime; without any all rounds
    are static. store: a folder in which rounds are kept; stored ones are not fitted again. The driver holds one row
    a round, max_removed + 1 at most.
    """
    spark = table.frame.sparkSession
    kept = stored_rows(spark, store, CURVE)
    mine = (F.col("dataset") == table.name) & (F.col("seed") == seed)
    done = kept.table().filter(mine).orderBy("iteration").collect()
    left = [f for f in table.features if f not in {r["top_feature"] for r in done}]
    accuracy = done[-1]["accuracy"] if done else target
    table, explained = models.settled(table), None
    for iteration in range(len(done), max_removed + 1):
        if accuracy < target or len(left) < 2:
            break
        now = table.only(left)
        start = time.perf_counter()
        fitted = models.fit_base_models(now, seed, params, names)
        fit_seconds = time.perf_counter() - start
        scores = vote_scores(now, fitted)
        start = time.perf_counter()
        if explained is None:  # the same rows in each round, some thousand: drawn and written once
            explained = [models.settled(t) for t in models.explained_rows(table, seed, n_explain)]
        e = models.explain_fitted(now, fitted, seed, n_explain, tuple(t.only(left) for t in explained))
        profile = global_importance(e.attributions.filter("member = 'ensemble'"), [])
        top = profile.orderBy(F.desc("mean_abs"), "feature").first()["feature"]
        accuracy = scores["accuracy"]
        shown = e.paths["forest" if "forest" in e.paths else names[0]]
        kept.append({"dataset": table.name, "seed": seed, "iteration": iteration, "n_features": len(left), "top_feature": top,
                     **{m: scores[m] for m in ("accuracy", "f1", "mcc")}, "fit_seconds": round(fit_seconds, 2),
                     "attribution_seconds": round(time.perf_counter() - start, 2), "total_nodes": shown.n_nodes,
                     "mean_tree_depth": shown.mean_tree_depth, "mean_leaf_depth": float(shown.depth.mean()),
                     "hyperparameter_regime": RETUNED if params and not iteration else STATIC})
        left.remove(top)
    return removed_marks(kept.table().filter(mine), target, max_removed)


def vote_scores(table: LabelledTable, fitted: Mapping) -> Mapping[str, float]:
    """Accuracy, F1 and MCC of the members' vote on the test rows."""
    scored = models.score_models(table.where(F.col("split") == "test"), fitted)
    pred = models.model_predictions(scored, ["ensemble"])
    return scoring.rates(scoring.confusion_counts(pred, ["model"]), ["model"]).first().asDict()


def cell_params(space: Mapping[str, Sequence], cell: int) -> dict:
    """The parameters of one cell of a product space: its number's digits, one for each parameter (mixed radix)."""
    out = {}
    for name, values in space.items():
        cell, digit = divmod(cell, len(values))
        out[name] = values[digit]
    return out


def fold_scores(dealt: DataFrame, estimator: Estimator, metric: Evaluator, folds: int) -> list[float]:
    """The metric on each fold of a fit on the others; nothing is fitted on all rows.

    MLlib's cross validation ends with such a fit, checks each row's fold in Python and caches every part. Boosting is
    many short jobs, one after the other, so all folds run at a time. A forest keeps a count for each row and tree while
    it is fitted, so of forests only two do.
    """
    def one(k: int) -> float:
        return metric.evaluate(estimator.fit(dealt.filter(F.col("fold") != k)).transform(dealt.filter(F.col("fold") == k)))

    at_once = ThreadPool(min(folds, 2) if estimator.hasParam("numTrees") else folds)
    try:
        return at_once.map(inheritable_thread_target(dealt.sparkSession)(one), range(folds))
    finally:
        at_once.close()


def random_search(table: LabelledTable, n_iter: int = N_TRIALS, folds: int = N_FOLDS, seed: int = 42,
                  spaces: Mapping[str, Mapping[str, Sequence]] | None = None, store: str | None = None) -> DataFrame:
    """Trials of each learner, no cell twice, scored by stratified cross-validation on F1 of the positive class.

    (dataset, seed, learner, trial, cell, params, mean_f1). Cells are drawn by number, so a space is never listed.
    store: a folder in which trials are kept; those stored are not run again. Train rows only.
    """
    spark = table.frame.sparkSession
    kept = stored_rows(spark, store, TRIALS)
    spaces = SEARCH_SPACES if spaces is None else spaces
    wanted = []
    for number, (learner, space) in enumerate(spaces.items()):
        size = prod(map(len, space.values()))
        rng, drawn = np.random.default_rng([seed, number]), {}  # more trials begin with the cells of fewer
        while len(drawn) < min(n_iter, size):
            drawn.setdefault(int(rng.integers(size)))
        wanted += [{"dataset": table.name, "seed": seed, "learner": learner, "trial": i, "cell": c} for i, c in enumerate(drawn)]
    keys = ["dataset", "seed", "learner", "trial"]
    listed = local_table(spark, wanted, "dataset string, seed int, learner string, trial int, cell long")
    pending = resume_pending(listed, kept.table(), keys).orderBy("learner", "trial").collect()
    if pending:
        dealt = models.assemble(models.settled(stratified_folds(table.where(F.col("split") == "train"), folds, seed), "fold"))
        if dealt.select("fold").distinct().count() < folds:
            raise ValueError(f"fewer rows than {folds} folds need")
        ensure_checkpoint_dir(spark)  # hundreds of boosting rounds would grow one lineage
    for one in pending:
        own = cell_params(spaces[one["learner"]], one["cell"])
        estimator = models.learner(one["learner"], seed, own)
        metric = MulticlassClassificationEvaluator(labelCol="label", predictionCol=f"_y_{one['learner']}",
                                                   metricName="fMeasureByLabel", metricLabel=1.0)
        kept.append({**one.asDict(), "params": [(k, str(v)) for k, v in own.items()],
                     "mean_f1": float(np.mean(fold_scores(dealt, estimator, metric, folds)))})
    return kept.table().join(listed.select(*keys), keys, "left_semi")


def best_params(trials: DataFrame, spaces: Mapping[str, Mapping[str, Sequence]] | None = None) -> dict[str, dict]:
    """The parameters of each learner's best trial (ties: the smallest trial), as ``fit_base_models`` takes them."""
    spaces = SEARCH_SPACES if spaces is None else spaces
    best = trials.groupBy("learner").agg(F.min(F.struct((-F.col("mean_f1")).alias("less"), "trial", "cell")).alias("best"))
    return {r["learner"]: cell_params(spaces[r["learner"]], r["best"]["cell"]) for r in best.collect()}
