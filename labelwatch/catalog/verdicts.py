"""Registered queries: removal curves, verdicts, scoring."""

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from labelwatch.catalog.leakage import tree_scores_of
from labelwatch.operators import duplicates, labels, removal, scoring
from labelwatch.operators.splitting import stratified_split
from labelwatch.session import settle, stored
from labelwatch.sources import views as v
from labelwatch.sources.tables import local_table, parquet_table

SEEDS = (42, 43, 44, 45, 46)


def union(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


def curves(s, p):
    return curves_of([view(s, p) for view in v.VIEWS.values()])


def curves_of(tables):
    """At most sixteen rows a table, settled: verdicts and joins read them several times."""
    return settle(removal.progressive_removal_single(tables))


def population(s, p):
    tables = [v.stored_view(view(s, p)) for view in v.VIEWS.values()]
    return removal.population_table(tree_scores_of(tables), curves_of(tables))


def all_features(s, p):
    rows = [{"dataset": t.name, "feature": f} for t in (view(s, p) for view in v.VIEWS.values()) for f in t.features]
    return local_table(s, rows, "dataset string, feature string")


def policy_curves(s, p):
    """Orders under both handlings of the intermediate status, as primary and variant."""
    base = v.planted(s, p)
    status = parquet_table(s, p, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    both = labels.label_policy(base.frame.drop("label").join(status, "id"), "o_orderstatus", "F", "P")
    merged = replace(base, frame=both.filter("policy = 'merge'"), name="orders")
    dropped = replace(base, frame=both.filter("policy = 'drop'"), name="orders__intermediate_dropped")
    return removal.screen_rows(removal.progressive_removal_single([merged, dropped]))


def expected_verdicts(s, p):
    expected = local_table(s, [{"dataset": "planted", "expected": "repairable"},
                               {"dataset": "order_status", "expected": "clean"}], "dataset string, expected string")
    return removal.validate_verdicts(removal.screen_rows(curves(s, p)), expected)


def regimes(s, p):
    """The last feature set of each curve: the stored rule against a tree refitted on it."""
    tables = [v.stored_view(view(s, p)) for view in v.VIEWS.values()]
    curve = curves_of(tables)
    last = curve.groupBy("dataset").agg(F.max(F.struct("iteration", "accuracy", "top_feature")).alias("l"))
    static = last.select(F.col("dataset").alias("feature_set"), F.col("l.accuracy").alias("accuracy_static"))
    retuned = last.select("dataset", F.col("l.top_feature").alias("feature")).join(
        tree_scores_of(tables), ["dataset", "feature"]).select(
        F.col("dataset").alias("feature_set"), F.col("accuracy").alias("accuracy_retuned"))
    return removal.regime_reconciliation(static, retuned)


def test_predictions(s, p, seeds=(42,), views=("order_status", "planted")):
    """Test-split predictions of the linear scorer for every (config, seed) cell; a view is built once for all seeds."""
    parts = []
    for name in views:
        table = v.stored_view(v.VIEWS[name](s, p))
        for seed in seeds:
            t = stratified_split(table, seed)
            scored = scoring.linear_predictions(t.where(F.col("split") == "test"), scoring.fit_linear(t))
            parts.append(scored.select(F.lit(name).alias("config"), F.lit("linear").alias("model"),
                                       F.lit(seed).alias("seed"), "id", "label", "score", "probability", "prediction"))
    return union(parts)


CELL = ["config", "model", "seed"]


def vote(s, p):
    """Three linear members on different halves of the features, voting softly."""
    t = stratified_split(v.planted(s, p))
    f = t.features
    sets = {"m1": f[2:], "m2": f[3:], "m3": f[4:]}
    frame = t.frame.filter("split = 'test'")
    for name, names in sets.items():
        scorer = scoring.fit_linear(t.only(names))
        frame = frame.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.round(scorer.score(), 6))))
    voted = scoring.soft_vote(frame, list(sets))
    return voted.select("id", "label", F.round("probability", 6).alias("probability"), "prediction")


def summary(s, p):
    # test rows of all seeds, written once: counted and ranked
    scores = scoring.score_predictions(stored(test_predictions(s, p, SEEDS).select(*CELL, "label", "score", "prediction")), CELL)
    return scoring.seed_summary(scores, ["config", "model"], model_order=["linear"])


def checks(s, p):
    band = local_table(s, [
        {"config": "order_status", "low": 0.4, "high": 0.6, "must_be_imperfect": True},
        {"config": "planted", "low": 0.95, "high": 1.0, "must_be_imperfect": False},
    ], "config string, low double, high double, must_be_imperfect boolean")
    scores = scoring.score_predictions(test_predictions(s, p), CELL)
    return scoring.sanity_checks(scoring.seed_summary(scores, ["config", "model"]), band)


def params(s, p):
    """Leaf-size parameters follow table size; configs inherit where de-duplication changed nothing."""
    audits = union([duplicates.duplicate_audit(t) for t in (v.planted(s, p), v.order_status(s, p), v.dup_events(s, p))])
    base = audits.select("dataset", F.concat(F.lit("min_rows="), F.greatest(
        F.lit(1), F.floor(F.col("n_rows") / 1000)).cast("string")).alias("params"))
    own = base.filter("dataset = 'dup_events'").select(F.lit("dup_events_full").alias("config"), "params").unionByName(
        base.filter("dataset = 'planted'").select(F.lit("planted_full").alias("config"), "params"))
    configs = audits.select(
        F.concat("dataset", F.lit("_dedup")).alias("config"), "dataset",
        F.when(F.col("exact_duplicates") == 0, F.concat("dataset", F.lit("_full"))).alias("identical_to")
    ).unionByName(audits.select(F.concat("dataset", F.lit("_full")).alias("config"), "dataset",
                                F.lit(None).cast("string").alias("identical_to")))
    return scoring.params_for_config(configs, own, base)


def leakfree(s, p):
    gone = curves(s, p).filter("removed_feature <> ''").select("dataset", F.col("removed_feature").alias("feature"))
    return labels.leakfree_features(all_features(s, p), gone)


QUERIES = {
    "progressive_removal_single": curves,
    "curve_lead": lambda s, p: removal.curve_lead(curves(s, p)),
    "feature_set_at_iteration": lambda s, p: removal.feature_set_at_iteration(all_features(s, p), curves(s, p)),
    "removal_outcome": lambda s, p: removal.removal_outcome(curves(s, p)),
    "leakfree_features": leakfree,
    "verdict_at": lambda s, p: removal.verdict_at(curves(s, p)),
    "verdict_sensitivity": lambda s, p: removal.verdict_sensitivity(removal.verdict_at(curves(s, p))),
    "screen_rows": lambda s, p: removal.screen_rows(curves(s, p)),
    "label_policy_sensitivity": lambda s, p: removal.label_policy_sensitivity(policy_curves(s, p)),
    "screen_gate": lambda s, p: removal.screen_gate(
        removal.screen_rows(curves(s, p)).unionByName(policy_curves(s, p))),
    "verdict_validation": expected_verdicts,
    "population_table": population,
    "regime_reconciliation": regimes,
    "score_predictions": lambda s, p: scoring.score_predictions(test_predictions(s, p), CELL),
    "roc_auc": lambda s, p: scoring.roc_auc(test_predictions(s, p), CELL),
    "confusion_matrix": lambda s, p: scoring.confusion_matrix(test_predictions(s, p, SEEDS), ["config", "model"]),
    "log_loss": lambda s, p: scoring.log_loss(test_predictions(s, p), CELL),
    "majority_baseline": lambda s, p: scoring.majority_baseline(test_predictions(s, p), CELL),
    "soft_vote": vote,
    "seed_summary": summary,
    "sanity_checks": checks,
    "params_for_config": params,
}
