"""Seeded, stratified splits and samples; every draw is a hash of seed and id."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwatch.functions.draws import digest, digest_long
from labelwatch.functions.numeric import count_if, d, r6
from labelwatch.operators.ordering import MAX_CUTS, at_or_before, hash_cuts, hash_rank, seed_cuts
from labelwatch.session import stored
from labelwatch.sources.views import LabelledTable

TEST_SHARE, VAL_SHARE = 0.15, 0.15
SPLITS = ("train", "val", "test")
FOLDS = 5
BACKGROUND_ROWS = 100


def _ranked(table: LabelledTable, *tag) -> DataFrame:
    return hash_rank(table.frame, [table.label_col], table.id_col, *tag, rank="_rank", total="_total")


def _first_of_class(table: LabelledTable, column: str, upto: dict[str, Column], rest: str, *tag) -> LabelledTable:
    """Adds ``column``: the first name whose last rank, out of ``_total`` rows of the class, is not passed.

    Rows are compared with the digests at those ranks, so none of them is sorted or shuffled.
    """
    cuts = hash_cuts(table.frame, table.label_col, table.id_col, upto, *tag)
    if cuts is None:
        part = F.coalesce(*[F.when(F.col("_rank") <= last, name) for name, last in upto.items()], F.lit(rest))
        return replace(table, frame=_ranked(table, *tag).withColumn(column, part).drop("_rank", "_total"))
    part = F.coalesce(*[F.when(at_or_before(cuts[name], table.label_col, "_key"), name) for name in upto], F.lit(rest))
    keyed = table.frame.withColumn("_key", digest(*tag, F.col(table.id_col)))
    return replace(table, frame=keyed.withColumn(column, part).drop("_key"))


def stratified_split(table: LabelledTable, seed: int = 42, test: float = TEST_SHARE,
                     val: float = VAL_SHARE) -> LabelledTable:
    """Adds ``split``: the same share of every class in test, val and train."""
    n_test = F.floor(d("_total") * test + 0.5)
    n_val = F.floor(d("_total") * val + 0.5)
    return _first_of_class(table, "split", {"test": n_test, "val": n_test + n_val}, "train", seed)


def stratified_halves(table: LabelledTable, seed: int = 42) -> LabelledTable:
    """Adds ``half``: a or b, disjoint and class-balanced."""
    return _first_of_class(table, "half", {"a": F.floor(d("_total") * 0.5 + 0.5)}, "b", "half", seed)


def seed_halves(table: LabelledTable, seeds: Sequence[int]) -> DataFrame:
    """The rows, written once without their ids, with ``a_<seed>``: is the row in half a of ``stratified_halves``?

    A digest a row and seed is computed once and written as a number; cuts of all seeds are found in one pass.
    """
    cut_at = F.floor(d("_total") * 0.5 + 0.5)
    keys = {seed: f"_half_{seed}" for seed in seeds}
    others = [c for c in table.frame.columns if c != table.id_col]
    rows = stored(table.frame.select(*others, *[digest_long("half", seed, F.col(table.id_col)).alias(c) for seed, c in keys.items()]))
    cuts = seed_cuts(rows, table.label_col, cut_at, keys)
    if cuts is not None:
        return rows.select(*others, *[at_or_before(cuts[seed], table.label_col, c, -1).alias(f"a_{seed}") for seed, c in keys.items()])
    for seed in seeds:  # ids repeat at a cut, or classes are many
        table = stratified_halves(table, seed)
        table = replace(table, frame=table.frame.withColumn(f"a_{seed}", F.col("half") == "a").drop("half"))
    return stored(table.frame.select(*others, *[f"a_{seed}" for seed in seeds]))


def stratified_folds(table: LabelledTable, folds: int = FOLDS, seed: int = 42) -> LabelledTable:
    """Adds ``fold`` in 0..folds-1, each class dealt out evenly."""
    fold = F.pmod(F.col("_rank"), F.lit(folds)).cast("int")
    return replace(table, frame=_ranked(table, "fold", seed).withColumn("fold", fold).drop("_rank", "_total"))


def stratified_sample(table: LabelledTable, n: int, seed: int = 42) -> LabelledTable:
    """About n rows in class proportion, at least one per class, never more than n.

    A class gets round(n * share) rows; where rounding gives more than n, the last
    ranks give way.  NULL is a class of its own.  All of this is settled on the
    table of classes, so the rows need no global order and stay partitioned.
    """
    # One row per class: the window over it is as small as the set of classes.
    classes = table.frame.groupBy(table.label_col).agg(F.count(F.lit(1)).alias("_class"))
    pool = F.sum("_class").over(Window.partitionBy(F.lit(0)))
    quota = F.greatest(F.lit(1), F.floor(d(F.least(F.lit(n), pool)) * d("_class") / d(pool) + 0.5))
    every = Window.partitionBy(F.lit(0))
    quotas = classes.select(F.col(table.label_col).alias("_of"), quota.cast("bigint").alias("_quota")).withColumn(
        "_excess", F.sum("_quota").over(every) - F.lit(n))
    # the excess is below the number of classes, so few ranks per class can be concerned
    last = quotas.filter("_excess > 0").select("_of", "_excess", F.explode(F.sequence(
        F.greatest(F.lit(1), F.col("_quota") - F.col("_excess") + 1), F.col("_quota"))).alias("_at"))
    gone = (last.withColumn("_nth", F.row_number().over(every.orderBy(F.desc("_at"), F.desc("_of"))))
            .filter("_nth <= _excess").groupBy(F.col("_of").alias("_less_of")).agg(F.count(F.lit(1)).alias("_less")))
    quotas = quotas.join(gone, F.col("_of").eqNullSafe(F.col("_less_of")), "left").select(
        "_of", (F.col("_quota") - F.coalesce("_less", F.lit(0))).alias("_quota"))
    few = quotas.limit(MAX_CUTS + 1).collect()  # one number for each class
    if 0 < len(few) <= MAX_CUTS:
        last = F.coalesce(*[F.when(F.col("_of").eqNullSafe(F.lit(r["_of"])), F.lit(r["_quota"])) for r in few])
        cuts = hash_cuts(table.frame, table.label_col, table.id_col, {"in": last}, "sample", seed)
        if cuts is not None:
            keyed = table.frame.withColumn("_key", digest("sample", seed, F.col(table.id_col)))
            return replace(table, frame=keyed.filter(at_or_before(cuts["in"], table.label_col, "_key")).drop("_key"))
    ranked = _ranked(table, "sample", seed)
    kept = ranked.join(F.broadcast(quotas), F.col(table.label_col).eqNullSafe(F.col("_of"))).filter("_rank <= _quota")
    return replace(table, frame=kept.drop("_rank", "_total", "_of", "_quota"))


def background_sample(table: LabelledTable, n: int = BACKGROUND_ROWS, seed: int = 42) -> LabelledTable:
    """Explanation background: a stratified sample of the training rows only."""
    return stratified_sample(table.where(F.col("split") == "train"), n, seed)


def split_audit(table: LabelledTable) -> DataFrame:
    """Per split: rows, positive share, ids also found in another split, repeated ids."""
    per_id = table.frame.groupBy(table.id_col).agg(
        *[count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS],
        *[F.sum(F.when(F.col("split") == s, F.col(table.label_col)).otherwise(0)).alias(f"p_{s}") for s in SPLITS])
    present = sum(((F.col(f"n_{s}") > 0).cast("int") for s in SPLITS), F.lit(0))
    parts = per_id.select(present.alias("n_splits"), F.inline(F.array(*[
        F.struct(F.lit(s).alias("split"), F.col(f"n_{s}").alias("n"), F.col(f"p_{s}").alias("p"))
        for s in SPLITS]))).filter("n > 0")
    return parts.groupBy("split").agg(
        F.sum("n").alias("n_rows"), r6(d(F.sum("p")) / d(F.sum("n"))).alias("positive_rate"),
        count_if(F.col("n_splits") > 1).alias("overlapping_ids"),
        count_if(F.col("n") > 1).alias("repeated_ids"))


def scaler_table(table: LabelledTable) -> DataFrame:
    """(feature, mean, std) of the training rows; population std, 1 where there is no spread."""
    return table.where(F.col("split") == "train").long().groupBy("feature").agg(
        F.avg("value").alias("mean"),
        F.when(F.stddev_pop("value") > 0, F.stddev_pop("value")).otherwise(1.0).alias("std"),
        F.count(F.lit(1)).alias("n_fit"))


def standard_scale(table: LabelledTable, scaler: DataFrame | None = None) -> DataFrame:
    """Long scaled values.  Pass another table's scaler for the zero-shot variant."""
    fitted = scaler_table(table) if scaler is None else scaler
    return table.long("split").join(F.broadcast(fitted), "feature").select(
        "id", "label", "split", "feature", ((F.col("value") - F.col("mean")) / F.col("std")).alias("scaled"))


def scale_wide(table: LabelledTable, scaler: DataFrame | None = None) -> LabelledTable:
    """Scaled features in place.  The parameters, two numbers per feature, become literals."""
    fitted = scaler_table(table) if scaler is None else scaler
    params = {r["feature"]: (r["mean"], r["std"]) for r in fitted.collect()}
    scaled = {f: (d(f) - F.lit(params[f][0])) / F.lit(params[f][1]) for f in table.features}
    return replace(table, frame=table.frame.withColumns(scaled))


def resume_pending(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Cells still to run: wanted minus stored."""
    return wanted.join(stored.select(*keys).distinct(), keys, "left_anti")
