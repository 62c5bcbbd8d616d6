"""The end-to-end screen of a labelled table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwatch.functions.numeric import d, r6
from labelwatch.operators import removal, rounds, stumps
from labelwatch.operators.splitting import stratified_split
from labelwatch.sources.views import LabelledTable


def screen_benchmark(table: LabelledTable, seed: int = 42, target: float = removal.TARGET_ACCURACY, n_iter: int = 0, folds: int = rounds.N_FOLDS,
                     spaces: Mapping | None = None, max_removed: int = removal.MAX_REMOVED, store: str | None = None) -> DataFrame:
    """Single-feature power, removal curve of the vote and verdict of one table as one row.

    n_iter: trials of a search for each member's parameters on all features, before round 0 (0: defaults). store: a
    folder that outlives the driver; a screen that was stopped goes on after its last stored trial or round.
    """
    split = stratified_split(table, seed)
    params = None
    if n_iter:
        trials = rounds.random_search(split, n_iter, folds, seed, spaces, store and f"{store}/trials")
        params = rounds.best_params(trials, spaces)
    curve = rounds.progressive_removal(split, target, max_removed, seed, params=params, store=store and f"{store}/rounds")
    scores = stumps.single_feature_tree([split])
    size = table.wide().agg(F.count(F.lit(1)).alias("n_rows"), r6(F.avg(d("label"))).alias("positive_rate")).withColumn(
        "dataset", F.lit(table.name))
    return removal.population_table(scores, curve).join(size, "dataset")


def rule_screen(tables: Sequence[LabelledTable], seed: int = 42) -> DataFrame:
    """The same report for many tables in one plan, with single-cut rules in place of models."""
    scores = stumps.single_feature_tree([stratified_split(t, seed) for t in tables])
    return removal.population_table(scores, removal.progressive_removal_single(tables))
