"""Tree models by MLlib, and exact Shapley attributions of the trees they grow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelwatch.functions.numeric import d, r6
from labelwatch.operators import scoring
from labelwatch.operators.importance import global_importance, log_loss, mean_rises, shuffled
from labelwatch.operators.splitting import background_sample, stratified_sample
from labelwatch.operators.tree_paths import TreePaths, margin_shapley, node_depths, probability_shapley, tree_paths
from labelwatch.session import ensure_checkpoint_dir, scratch_folder
from labelwatch.sources.tables import local_table
from labelwatch.sources.views import LabelledTable

MODELS = ("forest", "boosted_deep", "boosted_wide")
N_EXPLAIN = 2000
EXPLAINED_AT_ONCE = 128  # rows of one array of (row, background row, feature) parts


def assemble(table: LabelledTable) -> DataFrame:
    """The vector column appears only here, at the MLlib boundary."""
    frame = table.frame.withColumn("label", d(table.label_col))
    return VectorAssembler(inputCols=list(table.features), outputCol="vector").transform(frame)


def learner(name: str, seed: int, params: Mapping | None = None):
    defaults = {"forest": dict(numTrees=10, maxDepth=5), "boosted_deep": dict(maxIter=5, maxDepth=5),
                "boosted_wide": dict(maxIter=10, maxDepth=2)}[name]
    kind = RandomForestClassifier if name == "forest" else GBTClassifier
    fitted = kind(featuresCol="vector", labelCol="label", seed=seed, **{**defaults, **(params or {})})
    return (fitted.setProbabilityCol(f"_p_{name}").setRawPredictionCol(f"_r_{name}").setPredictionCol(f"_y_{name}"))


def train_rows(table: LabelledTable) -> DataFrame:
    return assemble(table.where(F.col("split") == "train"))


def fit_base_models(table: LabelledTable, seed: int = 42, params: Mapping[str, Mapping] | None = None,
                    names: Sequence[str] = MODELS) -> dict:
    """A forest and two boosted learners on the training rows; the seed is forced on each."""
    rows = train_rows(table)
    return {n: learner(n, seed, (params or {}).get(n)).fit(rows) for n in names}


def score_models(table: LabelledTable, models: Mapping) -> DataFrame:
    """One probability column per model and their soft vote.  Models add columns in turn: no join."""
    frame = assemble(table)
    for name, model in models.items():
        frame = model.transform(frame).withColumn(f"p_{name}", vector_to_array(f"_p_{name}")[1])
    members = [f"p_{n}" for n in models]
    voted = scoring.soft_vote(frame, members).withColumnRenamed("probability", "p_ensemble")
    return voted.select(F.col(table.id_col).alias("id"), F.col("label").cast("int").alias("label"), *members, "p_ensemble")


def model_predictions(scored: DataFrame, names: Sequence[str]) -> DataFrame:
    """(model, id, label, score, probability, prediction) from the wide scores."""
    return scored.unpivot(["id", "label"], [f"p_{n}" for n in names], "model", "probability").select(
        F.substring("model", 3, 100).alias("model"), "id", "label", F.col("probability").alias("score"), "probability",
        (F.col("probability") >= 0.5).cast("int").alias("prediction"))


def performance_grid(tables: Sequence[LabelledTable], seed: int = 42) -> DataFrame:
    """One scored row per (config, model): fits run on the driver's loop, scoring is one plan."""
    parts = []
    for t in tables:
        models = fit_base_models(t, seed)
        scored = score_models(t.where(F.col("split") == "test"), models)
        parts.append(model_predictions(scored, [*models, "ensemble"]).select(
            F.lit(t.name).alias("config"), F.lit(seed).alias("seed"), "*"))
    pred = parts[0]
    for p in parts[1:]:
        pred = pred.unionByName(p)
    return scoring.score_predictions(pred, ["config", "model", "seed"])


def vote_importance(table: LabelledTable, models: Mapping, n_repeats: int = 5, seed: int = 42) -> DataFrame:
    """Permutation importance of the soft vote on the test rows: (feature, importance, importance_std, n_repeats).

    Each test row is scored once as it is and once for each feature and repeat with that
    feature's value taken from its donor; all of it is one pass of the fitted models.
    """
    names = list(table.features)
    cells = shuffled(table.where(F.col("split") == "test"), n_repeats, seed)
    # feature '' is the row as it is
    variants = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), *[d(f"_d_{g}" if g == f else g).alias(g) for g in names]) for f in ("", *names)]))
    rows = cells.select(F.col("rep"), "label", variants.alias("v")).select(
        F.struct("rep", "v.feature").alias("id"), "label", *[F.col(f"v.{g}").alias(g) for g in names])
    scored = score_models(LabelledTable(rows, tuple(names), table.name), models)
    means = scored.groupBy("id.rep", "id.feature").agg(F.avg(log_loss(F.col("p_ensemble"))).alias("loss"))
    base = F.max(F.when(F.col("feature") == "", F.col("loss"))).over(Window.partitionBy("rep"))  # features + 1 rows
    return mean_rises(means.select("rep", "feature", (F.col("loss") - base).alias("rise")).filter("feature != ''"))


def node_table(model, spark) -> DataFrame:
    """The nodes of fitted trees as MLlib stores them: (tree, id, left, right, feature, cut, n0, n1, prediction)."""
    path = f"{scratch_folder(spark)}/trees"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    return nodes.select(
        F.col("treeID").alias("tree"), "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"),
        F.get("impurityStats", F.lit(0)).alias("n0"), F.get("impurityStats", F.lit(1)).alias("n1"),
        "prediction")


def attribution_members(explain: LabelledTable, background: LabelledTable, members: Mapping[str, TreePaths]) -> DataFrame:
    """(member, id, feature, value, attribution) of each member and of their vote, all in probability space.

    Rows are dealt by id; every task receives the paths and the fixed-size
    background once and works on Arrow batches.  The vote, ``ensemble``, is the mean
    of the members' parts, as its probability is the mean of theirs.
    """
    names = list(explain.features)
    spark = explain.frame.sparkSession
    # a fixed number of background rows
    bg = np.array([[float(r[f]) for f in names] for r in background.frame.select(*names).collect()])
    shared = spark.sparkContext.broadcast((bg, dict(members)))

    def batches(parts):
        rows, paths = shared.value
        for whole in parts:
            for at in range(0, len(whole), EXPLAINED_AT_ONCE):
                pdf = whole.iloc[at: at + EXPLAINED_AT_ONCE]
                x = pdf[names].to_numpy(dtype=float)
                phi = {n: (margin_shapley if p.boosted else probability_shapley)(x, rows, p) for n, p in paths.items()}
                phi["ensemble"] = sum(phi.values()) / len(phi)
                for member, own in phi.items():
                    yield pd.DataFrame({
                        "member": member, "id": np.repeat(pdf["id"].to_numpy(), len(names)), "feature": names * len(pdf),
                        "value": x.ravel(), "attribution": own.ravel()})

    wide = explain.frame.select(F.col(explain.id_col).cast("string").alias("id"), *[d(f).alias(f) for f in names])
    # a number of partitions of its own: adaptive execution would put so few rows into one
    dealt = wide.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    return dealt.mapInPandas(batches, "member string, id string, feature string, value double, attribution double")


def attribution_tree(explain: LabelledTable, background: LabelledTable, paths: TreePaths) -> DataFrame:
    """(id, feature, value, attribution) of one model."""
    return attribution_members(explain, background, {"model": paths}).filter("member = 'model'").drop("member")


@dataclass(frozen=True)
class ExplainedForest:
    model: object
    paths: TreePaths
    sample: LabelledTable
    background: LabelledTable
    attributions: DataFrame


@dataclass(frozen=True)
class ExplainedMembers:
    models: Mapping
    sample: LabelledTable
    background: LabelledTable
    attributions: DataFrame
    paths: Mapping[str, TreePaths]


def explain_members(table: LabelledTable, seed: int = 42, n_explain: int = N_EXPLAIN,
                    names: Sequence[str] = MODELS) -> ExplainedMembers:
    """Fit the members on train, explain each and their vote on a stratified sample of test."""
    return explain_fitted(table, fit_base_models(table, seed, names=names), seed, n_explain)


def explained_rows(table: LabelledTable, seed: int = 42, n_explain: int = N_EXPLAIN) -> tuple[LabelledTable, LabelledTable]:
    """A stratified sample of test and a background of train; which rows these are does not depend on the features."""
    return stratified_sample(table.where(F.col("split") == "test"), n_explain, seed), background_sample(table, seed=seed)


def explain_fitted(table: LabelledTable, models: Mapping, seed: int = 42, n_explain: int = N_EXPLAIN,
                   rows: tuple[LabelledTable, LabelledTable] | None = None) -> ExplainedMembers:
    """Explain fitted members and their vote on a stratified sample of test, against a background of train (or given rows)."""
    paths = {n: tree_paths(node_table(m, table.frame.sparkSession), None if n == "forest" else list(m.treeWeights))
             for n, m in models.items()}
    sample, background = rows or explained_rows(table, seed, n_explain)
    return ExplainedMembers(models, sample, background, attribution_members(sample, background, paths), paths)


def member_additivity(table: LabelledTable, seed: int = 42) -> DataFrame:
    """Per member and for the vote: do attributions sum to score minus mean background score within 1e-9?"""
    e = explain_members(settled(table), seed)

    def scores(t: LabelledTable) -> DataFrame:
        return score_models(t, e.models).unpivot(["id"], [f"p_{n}" for n in (*e.models, "ensemble")], "member", "p").select(
            F.expr("substring(member, 3)").alias("member"), F.col("id").cast("string").alias("id"), "p")

    base = scores(e.background).groupBy("member").agg(F.avg("p").alias("base"))
    sums = e.attributions.groupBy("member", "id").agg(F.sum("attribution").alias("total"))
    return sums.join(scores(e.sample), ["member", "id"]).join(base, "member").groupBy("member").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.max(F.abs(F.col("total") - F.col("p") + F.col("base"))) < 1e-9).alias("additive")).select(
        F.lit(table.name).alias("dataset"), "member", "n_rows", "additive")


def explain_forest(table: LabelledTable, seed: int = 42, n_explain: int = N_EXPLAIN,
                   params: Mapping[str, Mapping] | None = None) -> ExplainedForest:
    """Fit a forest on train, explain a stratified sample of test against a train background."""
    model = fit_base_models(table, seed, params, names=("forest",))["forest"]
    paths = tree_paths(node_table(model, table.frame.sparkSession))
    sample = stratified_sample(table.where(F.col("split") == "test"), n_explain, seed)
    background = background_sample(table, seed=seed)
    return ExplainedForest(model, paths, sample, background, attribution_tree(sample, background, paths))


def tree_additivity(table: LabelledTable, seed: int = 42) -> DataFrame:
    """Largest gap between summed attributions and score minus mean background score."""
    e = explain_forest(table, seed)
    base = score_models(e.background, {"forest": e.model}).agg(F.avg("p_forest").alias("b")).first()["b"]
    scores = score_models(e.sample, {"forest": e.model}).select(F.col("id").cast("string").alias("id"), "p_forest")
    sums = e.attributions.groupBy("id").agg(F.sum("attribution").alias("total"))
    return sums.join(scores, "id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.abs(F.col("total") - (F.col("p_forest") - F.lit(base)))).alias("max_error")).select(
        F.lit(table.name).alias("dataset"), "n_rows", (F.col("max_error") < 1e-9).alias("additive"))


def tree_complexity(table: LabelledTable, seed: int = 42) -> DataFrame:
    """Mean tree depth, total nodes and tree count of the fitted forest."""
    model = fit_base_models(table, seed, names=("forest",))["forest"]
    return complexity_of(node_table(model, table.frame.sparkSession)).select(F.lit(table.name).alias("dataset"), "*")


def complexity_of(nodes: DataFrame) -> DataFrame:
    """n_trees, total_nodes, mean_tree_depth of a node table."""
    ensure_checkpoint_dir(nodes.sparkSession)
    trees = node_depths(nodes).groupBy("tree").agg(F.max("depth").alias("depth"), F.count("*").alias("n"))
    return trees.agg(F.count("*").cast("int").alias("n_trees"), F.sum("n").cast("int").alias("total_nodes"),
                     F.avg("depth").alias("mean_tree_depth"))


def test_accuracy(table: LabelledTable, model) -> float:
    scored = score_models(table.where(F.col("split") == "test"), {"forest": model})
    hit = ((F.col("p_forest") >= 0.5).cast("int") == F.col("label")).cast("double")
    return float(scored.agg(F.avg(hit).alias("a")).first()["a"])


def settled(table: LabelledTable, *more: str) -> LabelledTable:
    """The split written once in the shared folder; each fit reads only the features it uses. more: further columns."""
    rows = table.frame.select(table.id_col, table.label_col, "split", *table.features, *more)
    path = f"{scratch_folder(rows.sparkSession)}/split"
    rows.write.parquet(path)
    return replace(table, frame=rows.sparkSession.read.schema(rows.schema).parquet(path))


def sufficiency(table: LabelledTable, ks: Sequence[int] = (3, 5), seed: int = 42) -> DataFrame:
    """Retrain on the top-k features alone and on all the others; compare with the full model."""
    table = settled(table)
    e = explain_forest(table, seed)
    full = test_accuracy(table, e.model)
    order = [r["feature"] for r in global_importance(e.attributions, []).orderBy(F.desc("mean_abs"), "feature").collect()]

    def refit(names: Sequence[str]) -> float:
        part = table.only(names)
        return test_accuracy(part, fit_base_models(part, seed, names=("forest",))["forest"])

    rows = []
    for k in ks:
        suf, com = refit(order[:k]), refit(order[k:])
        rows.append({"dataset": table.name, "k": k, "full_accuracy": full, "sufficiency_accuracy": suf,
                     "comprehensiveness_accuracy": com, "performance_retained": suf / full, "performance_lost": full - com})
    return local_table(table.frame.sparkSession, rows, "dataset string, k int, full_accuracy double, sufficiency_accuracy double, "
                       "comprehensiveness_accuracy double, performance_retained double, performance_lost double")


def half_attributions(table: LabelledTable, seed: int = 42, n_explain: int = N_EXPLAIN) -> DataFrame:
    """Forest attributions of either half, each with its own model, sample and background."""
    parts = []
    for half in ("a", "b"):
        rows = table.frame.filter(F.col("half") == half)
        own = replace(table, frame=rows.withColumn("split", F.lit("train")))
        model = fit_base_models(own, seed, names=("forest",))["forest"]
        paths = tree_paths(node_table(model, rows.sparkSession))
        part = attribution_tree(stratified_sample(own, n_explain, seed), background_sample(own, seed=seed), paths)
        parts.append(part.select(F.lit(table.name).alias("dataset"), F.lit(seed).alias("seed"), F.lit(half).alias("half"), "*"))
    return parts[0].unionByName(parts[1])
