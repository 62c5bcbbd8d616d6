"""Attributions in long form and the profiles made of them.

Attribution rows are (keys..., id, feature, value, attribution).  A profile has
one row per (keys..., feature): mean absolute value, mean signed value and the
direction, the rank correlation of value and attribution.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwatch.functions.draws import uniform
from labelwatch.functions.numeric import count_if, d, r6, ratio, steady
from labelwatch.operators.ordering import cumulate, hash_rank, spearman
from labelwatch.session import settle, stored
from labelwatch.sources.views import LabelledTable

BACKGROUND_SHARE = 0.1
ZERO = 1e-12
CONVERGENCE_SIZES = (5000, 10000, 20000)
LADDER = (0.25, 0.5, 1.0)
LADDER_FLOOR = 50
MULTIPLIERS = (1000003, 1000033, 1000037, 1000039, 1000081, 1000099)  # primes


def with_background(table: LabelledTable, seed: int = 42, share: float = BACKGROUND_SHARE) -> LabelledTable:
    """Adds ``drawn``, the draw of the background: one digest a row, not one for each of its features."""
    drawn = uniform("background", seed, F.col(table.id_col)) < share
    return replace(table, frame=table.frame.withColumn("drawn", drawn))


def linear_weights(long_rows: DataFrame, keys: Sequence[str], seed: int = 42,
                   share: float = BACKGROUND_SHARE) -> DataFrame:
    """A linear scorer per key as a table (keys..., feature, weight, centre, spread).

    The weight is the class difference in standard deviations; the centre is the
    mean of a hash-drawn background.  One aggregation with map-side partials.
    Rows may bring the draw along as ``drawn`` (``with_background``).
    """
    v, pos, neg = F.col("value"), F.col("label") == 1, F.col("label") == 0
    drawn = F.col("drawn") if "drawn" in long_rows.columns else uniform("background", seed, F.col("id")) < share
    got = long_rows.groupBy(*keys, "feature").agg(
        F.stddev_pop(v).alias("s"), F.avg(v).alias("m"), F.avg(F.when(drawn, v)).alias("b"),
        F.avg(F.when(pos, v)).alias("p"), F.avg(F.when(neg, v)).alias("n"))
    return got.select(*keys, "feature", *scorer_columns())


def scorer_columns() -> tuple[Column, Column, Column]:
    """weight, centre and spread from a feature's deviation, mean, mean of the background and of either class (s, m, b, p, n)."""
    spread = F.when(steady("s") > 0, steady("s")).otherwise(1.0)
    return (steady(F.coalesce((F.col("p") - F.col("n")) / spread, F.lit(0.0))).alias("weight"),
            steady(F.coalesce("b", "m")).alias("centre"), spread.alias("spread"))


def attribution_linear(long_rows: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Closed form of the Shapley value for a linear scorer: weight * (x - background mean)."""
    # keys x features rows of parameters
    return long_rows.join(F.broadcast(weights), [*keys, "feature"]).withColumn(
        "attribution", F.col("weight") * (F.col("value") - F.col("centre")) / F.col("spread")
    ).drop("weight", "centre", "spread")


def attribution_ensemble(members: DataFrame, keys: Sequence[str], n_members: int) -> DataFrame:
    """Equal-weight mean over members; a member without a feature contributes zero."""
    return members.groupBy(*keys, "id", "feature").agg(
        (F.sum("attribution") / F.lit(float(n_members))).alias("attribution"))


def attribution_additivity(attributions: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest violation of sum(attribution) = score(x) - mean background score."""
    sums = attributions.groupBy(*keys, "id").agg(F.sum("attribution").alias("total"))
    gap = F.abs(F.col("total") - (F.col("score") - F.col("base_score")))
    return sums.join(scores, [*keys, "id"]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.max(gap)).alias("max_error"))


def global_importance(attributions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return attributions.groupBy(*keys, "feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))


def signed_importance(attributions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return attributions.groupBy(*keys, "feature").agg(F.avg("attribution").alias("mean_signed"))


def directional_importance(attributions: DataFrame, keys: Sequence[str], monotone: bool = False) -> DataFrame:
    """Spearman of feature value and attribution; 0 where either is constant.

    monotone: within a key and feature the attribution never turns as the value grows, as with a linear scorer. Then
    ranks differ from each other only where rounding gave several values one attribution. One aggregation by
    attribution finds out; where it did not happen the correlation is the sign, and only other features are ranked.
    """
    keys = [*keys, "feature"]
    if not monotone:
        return spearman(attributions, keys, "value", "attribution", out="direction").drop("n_rows")
    ends = attributions.groupBy(*keys, "attribution").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # one row per key and feature
    seen = settle(ends.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("lo") < F.col("hi")).alias("merged"),
        F.min_by("attribution", "lo").alias("first"), F.max_by("attribution", "hi").alias("last")))
    sign = F.when(F.col("n") == 1, 0.0).when(F.col("first") < F.col("last"), 1.0).otherwise(-1.0)
    plain = seen.filter("n = 1 or not merged").select(*keys, sign.alias("direction"))
    rest = seen.filter("n > 1 and merged").select(*keys)
    if rest.isEmpty():
        return plain
    same = [attributions[k].eqNullSafe(rest[k]) for k in keys]
    return plain.unionByName(directional_importance(attributions.join(F.broadcast(rest), same, "left_semi"), keys[:-1]))


def importance_profile(attributions: DataFrame, keys: Sequence[str], directions: bool = False, monotone: bool = False) -> DataFrame:
    """Mean absolute and mean signed attribution in one aggregation, direction on request."""
    base = attributions.groupBy(*keys, "feature").agg(
        F.avg(F.abs("attribution")).alias("mean_abs"), F.avg("attribution").alias("mean_signed"))
    if not directions:
        return base
    return base.join(directional_importance(attributions, keys, monotone), [*keys, "feature"])


def cancellation_ratio(profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median over features of |mean signed| / mean abs: near 0 when effects cancel.

    ``percentile`` aggregates one number per feature.
    """
    share = F.abs("mean_signed") / F.greatest(F.col("mean_abs"), F.lit(ZERO))
    return profile.groupBy(*keys).agg(r6(F.percentile(share, 0.5)).alias("cancellation_ratio"))


def attribution_mass(profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each feature's share of the total mean absolute attribution."""
    total = F.sum("mean_abs").over(Window.partitionBy(*keys))  # one row per feature
    return profile.select(*keys, "feature", ratio("mean_abs", total).alias("mass"))


def mass_distance(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """L1 distance of two mass vectors and the top mass on each side."""
    w = Window.partitionBy(*keys)
    shares = pairs.select(*keys, (d("abs_a") / F.sum("abs_a").over(w)).alias("ma"),
                          (d("abs_b") / F.sum("abs_b").over(w)).alias("mb"))
    return shares.groupBy(*keys).agg(
        r6(F.sum(F.abs(F.col("ma") - F.col("mb")))).alias("mass_l1_distance"),
        r6(F.max("ma")).alias("top1_mass_a"), r6(F.max("mb")).alias("top1_mass_b"))


def quantile_of(frame: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """Exact quantile per key through the prefix table, for groups too large for one task."""
    from labelwatch.operators.leakage import quantile_columns

    counts = frame.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    run = cumulate(counts, keys, value, ["n"])
    return run.groupBy(*keys).agg(*quantile_columns(value, "n", {"quantile": q}))


def shuffled(table: LabelledTable, n_repeats: int, seed: int = 42, *carry: str) -> DataFrame:
    """(rep, id, label, carry, features, _d_<feature>): every row beside the donor of its shuffled values, in each repeat.

    Rows stand in one digest order, numbered from 0. Repeat r shuffles by a bijection of the
    numbers, k -> (a * k + seed + r) mod n, where a is the first of ``MULTIPLIERS``, from the r-th on,
    that does not divide n. So no second order is computed and every row is donor exactly once a
    repeat. Rows without a label take no part.
    """
    features = list(table.features)
    ranked = hash_rank(table.wide(*carry).filter("label is not null"), [], "id", "slot", seed, rank="k", total="n")
    slots = stored(ranked.withColumn("k", F.col("k") - 1))
    donor = []
    for rep in range(n_repeats):
        turn = rep % len(MULTIPLIERS)
        factor = F.coalesce(*[F.when(F.col("n") % m != 0, F.lit(m)) for m in (*MULTIPLIERS[turn:], *MULTIPLIERS[:turn])])
        donor.append(F.struct(F.lit(rep).alias("rep"), ((F.col("k") * factor + seed + rep) % F.col("n")).alias("k")))
    asked = slots.select("id", "label", *carry, *features, F.inline(F.array(*donor)))
    return asked.join(slots.select("k", *[F.col(f).alias(f"_d_{f}") for f in features]), "k").drop("k")


def log_loss(probability: Column) -> Column:
    """Loss of a row's probability against its label, kept finite."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), probability))
    return -F.ln(F.when(F.col("label") == 1, p).otherwise(1.0 - p))


def mean_rises(rises: DataFrame) -> DataFrame:
    """Mean and deviation over the repeats of (rep, feature, rise)."""
    return rises.groupBy("feature").agg(
        F.avg("rise").alias("importance"), F.coalesce(F.stddev_samp("rise"), F.lit(0.0)).alias("importance_std"),
        F.count(F.lit(1)).alias("n_repeats"))


def permutation_importance(table: LabelledTable, scorer, n_repeats: int = 5, seed: int = 42, carry: Sequence[str] = ()) -> DataFrame:
    """Mean rise of the log-loss when one feature's column is shuffled, for ALL features.

    ``table`` holds the rows to score, which should not be those of the fit. With a ``scoring.CrossFitted``
    scorer these are all rows; carry: the column that it chooses by.
    """
    cells = shuffled(table, n_repeats, seed, *carry).withColumn("_score", F.round(scorer.score(), 6))
    loss = lambda score: log_loss(F.lit(1.0) / (F.lit(1.0) + F.exp(-score)))
    moved = [(loss(F.col("_score") - scorer.part(f) + scorer.part(f, d(f"_d_{f}"))) - loss(F.col("_score"))).alias(f)
             for f in table.features]
    means = cells.select("rep", *moved).groupBy("rep").agg(*[F.avg(f).alias(f) for f in table.features])
    return mean_rises(means.unpivot(["rep"], list(table.features), "feature", "rise"))


def importance_degeneracy(importances: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Zero and distinct importances; more than half at zero says nothing about a ranking."""
    zeros = count_if(F.abs("importance") < ZERO)
    return importances.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_features"), zeros.alias("n_zero"),
        F.countDistinct(F.round("importance", 12)).alias("n_distinct")).withColumn(
        "degenerate", F.col("n_zero") > F.floor(F.col("n_features") / 2))


def attribution_vs_permutation(profile: DataFrame, importances: DataFrame, k: int = 10) -> DataFrame:
    """Rank correlation over all features and the overlap of the two top-k sets."""
    both = profile.select("feature", F.round("mean_abs", 9).alias("a")).join(
        importances.select("feature", F.round("importance", 9).alias("p")), "feature").withColumn("one", F.lit(1))
    rho = spearman(both, ["one"], "a", "p")
    w = Window.partitionBy("one")
    ranked = both.select("one", (F.row_number().over(w.orderBy(F.desc("a"), "feature")) <= k).alias("ta"),
                         (F.row_number().over(w.orderBy(F.desc("p"), "feature")) <= k).alias("tp"))
    overlap = ranked.groupBy("one").agg(count_if(F.col("ta") & F.col("tp")).alias("topk_overlap"))
    return rho.join(overlap, "one").select(F.col("n_rows").alias("n_features"), r6("rho").alias("rho"), "topk_overlap")


def sample_convergence(table: LabelledTable, sizes: Sequence[int] = CONVERGENCE_SIZES, seed: int = 42) -> DataFrame:
    """Does the importance ranking settle as the explained sample grows?

    Nominal sizes clamp to the pool; when the pool is smaller than the largest
    one, a ladder of pool shares is added.  Equal effective sizes are computed
    once, and a pair that clamps to one sample is flagged degenerate.
    """
    from labelwatch.operators.agreement import kendall_tau

    long_rows = table.long().withColumn("dataset", F.lit(table.name))
    weights = linear_weights(long_rows, ["dataset"], seed)
    # one row per class
    classes = table.frame.groupBy(table.label_col).agg(F.count(F.lit(1)).alias("_class"))
    pool = F.sum("_class").over(Window.partitionBy(F.lit(0)))
    wanted = F.array(*[F.lit(int(n)).cast("bigint") for n in sizes])
    steps = F.array(*[F.greatest(F.floor(F.col("_pool") * share), F.lit(LADDER_FLOOR)).cast("bigint") for share in LADDER])
    nominal = F.when(F.col("_pool") < max(sizes), F.array_union(wanted, steps)).otherwise(wanted)
    plan = classes.withColumn("_pool", pool).withColumn("_sizes", F.array_sort(F.array_distinct(nominal)))
    plan = plan.withColumn("_effective", F.array_distinct(
        F.transform("_sizes", lambda n: F.least(n, F.col("_pool")))))

    ranked = hash_rank(table.frame, [table.label_col], table.id_col, "sample", seed, rank="_rank")
    joined = ranked.join(F.broadcast(plan), table.label_col)
    quota = lambda n: F.greatest(F.lit(1), F.floor(d(n) * d("_class") / d("_pool") + 0.5))
    member = joined.withColumn("size", F.explode(
        F.filter("_effective", lambda n: F.col("_rank") <= quota(n))))
    sample = LabelledTable(member, table.features, table.name, table.id_col, table.label_col)
    rows = sample.long("size").withColumn("dataset", F.lit(table.name))
    profile = global_importance(attribution_linear(rows, weights, ["dataset"]), ["dataset", "size"])

    steps_table = plan.select("_pool", "_sizes").distinct().select(
        F.lit(table.name).alias("dataset"), F.col("_pool").alias("n_available"), F.explode("_sizes").alias("nominal"))
    nxt = Window.partitionBy("dataset").orderBy("nominal")
    pairs = steps_table.withColumn("size_b", F.lead("nominal").over(nxt)).filter("size_b is not null").select(
        "dataset", "n_available", F.col("nominal").alias("size_a"), "size_b",
        F.least("nominal", "n_available").alias("effective_a"), F.least("size_b", "n_available").alias("effective_b"))
    # features x sizes rows on either side
    a = profile.select("dataset", F.col("size").alias("effective_a"), "feature", F.col("mean_abs").alias("abs_a"))
    b = profile.select("dataset", F.col("size").alias("effective_b"), "feature", F.col("mean_abs").alias("abs_b"))
    keys = ["dataset", "size_a", "size_b", "effective_a", "effective_b", "n_available"]
    both = pairs.join(a, ["dataset", "effective_a"]).join(b, ["dataset", "effective_b", "feature"])
    return kendall_tau(both, keys, "abs_a", "abs_b").select(
        *keys, r6("tau").alias("tau"), (F.col("effective_a") == F.col("effective_b")).alias("degenerate"))
