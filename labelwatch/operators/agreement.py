"""How far two importance rankings agree, for many pairs of rankings at once.

Input rows are (keys..., feature, abs_a, abs_b[, signed_a, signed_b, rho_a,
rho_b]); one group is the features of one pair, so a group is as large as a
schema is wide.  Groups are what scales, and they are spread by key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelwatch.functions.draws import digest, pick
from labelwatch.functions.numeric import count_if, d, r6, ratio, sign
from labelwatch.sources.tables import local_table

TOP_KS = (5, 10, 15)
RHO_MINS = (0.3, 0.5)
N_PERMUTATIONS = 10_000
N_BOOTSTRAP = 1_000
MIN_SIGN_FEATURES = 3
# Fixed value: untied rankings up to this size have their p-value from the exact distribution.
EXACT_ITEMS = 33
STABLE_TAU, UNSTABLE_TAU = 0.85, 0.70


def align_profiles(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Profiles of side a and b met on feature; features of one side only are left out."""
    cols = [c for c in ("mean_abs", "mean_signed", "direction") if c in a.columns]
    short = {"mean_abs": "abs", "mean_signed": "signed", "direction": "rho"}
    left = a.select(*keys, "feature", *[F.col(c).alias(f"{short[c]}_a") for c in cols])
    right = b.select(*keys, "feature", *[F.col(c).alias(f"{short[c]}_b") for c in cols])
    return left.join(right, [*keys, "feature"])


def alignment_report(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shared, left-only and right-only features; a pair that shares none is not comparable."""
    both = (a.select(*keys, "feature", F.lit(1).alias("_a"))
             .join(b.select(*keys, "feature", F.lit(1).alias("_b")), [*keys, "feature"], "full"))
    return both.groupBy(*keys).agg(
        count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_shared"),
        count_if(F.col("_b").isNull()).alias("only_a"), count_if(F.col("_a").isNull()).alias("only_b")
    ).withColumn("comparable", F.col("n_shared") > 0)


def _ranks(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    return pairs.select(*keys, (F.dense_rank().over(w.orderBy(a)) - 1).cast("bigint").alias("ra"),
                        (F.dense_rank().over(w.orderBy(b)) - 1).cast("bigint").alias("rb"))


def concordance(ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., s): concordant minus discordant pairs, without forming pairs.

    Two different ranks first differ in one binary digit.  For every digit,
    rows that agree above it are ordered by the other ranking, and each row
    counts the opposite digits before it: n log n rows instead of n squared.
    """
    levels = F.sequence(F.lit(0), F.greatest(F.floor(F.log2(F.greatest(F.col("_top"), F.lit(1)).cast("double"))), F.lit(0)).cast("int"))
    spread = (ranks.withColumn("_top", F.max("rb").over(Window.partitionBy(*keys)))
              .withColumn("_level", F.explode(levels))
              .withColumn("_prefix", F.expr("shiftright(rb, _level + 1)"))
              .withColumn("_bit", F.expr("shiftright(rb, _level) & 1")))
    before = (Window.partitionBy(*keys, "_level", "_prefix").orderBy("ra")
              .rangeBetween(Window.unboundedPreceding, -1))
    ones = F.coalesce(F.sum("_bit").over(before), F.lit(0))
    zeros = F.count(F.lit(1)).over(before) - ones
    return (spread.withColumn("_s", F.when(F.col("_bit") == 1, zeros).otherwise(-ones))
                  .groupBy(*keys).agg(F.sum("_s").alias("s")))


def tie_sums(ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sizes and tie corrections of both rankings (names as in the usual variance formula)."""
    ta = F.count(F.lit(1)).over(Window.partitionBy(*keys, "ra")).cast("double")
    tb = F.count(F.lit(1)).over(Window.partitionBy(*keys, "rb")).cast("double")
    sized = ranks.select(*keys, ta.alias("t"), tb.alias("u"))
    t, u = F.col("t"), F.col("u")
    # summing over rows visits a group of t ties t times
    return sized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum((t - 1) / 2).alias("ties_a"), F.sum((u - 1) / 2).alias("ties_b"),
        F.sum((t - 1) * (t - 2)).alias("x0"), F.sum((u - 1) * (u - 2)).alias("y0"),
        F.sum((t - 1) * (2 * t + 5)).alias("x1"), F.sum((u - 1) * (2 * u + 5)).alias("y1"))


def _tau_parts(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    ranks = _ranks(pairs, keys, a, b)
    return concordance(ranks, keys).join(tie_sums(ranks, keys), list(keys))


def _tau(n: str = "n") -> Column:
    all_pairs = d(n) * (d(n) - 1) / 2
    free = (all_pairs - F.col("ties_a")) * (all_pairs - F.col("ties_b"))
    return F.when(free > 0, d("s") / F.sqrt(free))


def kendall_tau(pairs: DataFrame, keys: Sequence[str], a: str = "abs_a", b: str = "abs_b") -> DataFrame:
    """tau-b per key; NULL when one side is constant."""
    return _tau_parts(pairs, keys, a, b).select(*keys, "n", "s", _tau().alias("tau"))


def _normal_tail(z: Column) -> Column:
    """Two-sided normal tail by the classical five-term polynomial (error below 2e-7)."""
    # Published coefficients of the rational approximation of erf.
    p, coefficients = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2.0)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * x)
    poly = F.lit(0.0)
    for c in reversed(coefficients):
        poly = (poly + F.lit(c)) * t
    return poly * F.exp(-x * x)


def exact_tail(spark: SparkSession, largest: int = EXACT_ITEMS) -> DataFrame:
    """(n, fewer, p_exact): two-sided probability that the rarer of concordant and discordant pairs number at most ``fewer``.

    Shares of permutations by inversions, an item more at a time: the new item adds 0 to n - 1 inversions, each
    equally likely. Some ``largest`` cubed / 12 rows, a fixed table.
    """
    rows, share = [], np.ones(1)
    for n in range(2, largest + 1):
        share = np.convolve(share, np.full(n, 1.0 / n))
        tail = np.minimum(2.0 * np.cumsum(share), 1.0)
        rows += [dict(n=n, fewer=k, p_exact=float(tail[k])) for k in range(n * (n - 1) // 4 + 1)]
    return local_table(spark, rows, "n bigint, fewer bigint, p_exact double")


def kendall_pvalue(pairs: DataFrame, keys: Sequence[str], a: str = "abs_a", b: str = "abs_b") -> DataFrame:
    """Two-sided p-value of tau, and the method that gave it.

    ``exact`` for rankings without ties of at most ``EXACT_ITEMS`` items or with at most one pair out of order,
    else ``normal`` with the tie-corrected variance. ``p_normal`` is the approximation in any case.
    """
    n = d("n")
    m = F.when(n > 1, n * (n - 1))  # a single item has no pairs and no p-value
    var = ((m * (2 * n + 5) - F.col("x1") - F.col("y1")) / 18
           + 2 * F.col("ties_a") * F.col("ties_b") / m
           + F.when(n > 2, F.col("x0") * F.col("y0") / (9 * m * (n - 2))).otherwise(0.0))
    untied = (F.col("ties_a") == 0) & (F.col("ties_b") == 0) & (F.col("n") > 1)
    fewer = F.when(untied, (m / 2 - F.abs(d("s"))) / 2).cast("bigint")
    rows = _tau_parts(pairs, keys, a, b).withColumn("fewer", fewer)
    rows = rows.join(F.broadcast(exact_tail(pairs.sparkSession)), ["n", "fewer"], "left")
    # 2 * P(0) = 2 / n!, 2 * P(1 or less) = 2 / (n - 1)!
    near = F.exp(F.lit(math.log(2.0)) - F.expr("aggregate(sequence(1L, n - fewer), 0D, (t, i) -> t + ln(i))"))
    exact = F.coalesce("p_exact", F.when((F.col("n") > EXACT_ITEMS) & (F.col("fewer") <= 1), near))
    normal = F.when(var > 0, _normal_tail(d("s") / F.sqrt(var)))
    method = F.when(exact.isNotNull(), "exact").when(var > 0, "normal")
    return rows.select(*keys, r6(_tau()).alias("tau"), r6(normal).alias("p_normal"),
                       r6(F.coalesce(exact, normal)).alias("p_value"), method.alias("method"))


def permutation_null(pairs: DataFrame, keys: Sequence[str], a: str = "abs_a", b: str = "abs_b",
                     n_perm: int = N_PERMUTATIONS, seed: int = 42) -> DataFrame:
    """Empirical two-sided p-value of tau against shuffles of one side.

    Every (pair, iteration) is an independent group.  The tie corrections do not
    change under a shuffle, so only the concordance is recomputed, and extremes
    are counted on integers.
    """
    keys = list(keys)
    ranks = _ranks(pairs, keys, a, b)
    w = Window.partitionBy(*keys)
    ordered = pairs.select(
        *keys, "feature", F.row_number().over(w.orderBy("feature")).alias("_slot"),
        (F.dense_rank().over(w.orderBy(a)) - 1).cast("bigint").alias("ra"),
        (F.dense_rank().over(w.orderBy(b)) - 1).cast("bigint").alias("rb"))
    # bounded: one array entry per feature of the pair
    rb_of = ordered.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_slot", "rb"))), lambda s: s["rb"]).alias("_rb"))
    trials = ordered.join(rb_of, keys).withColumn("_it", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))
    draw = Window.partitionBy(*keys, "_it").orderBy(digest(seed, F.col("_it"), F.col("feature")), "feature")
    shuffled = trials.withColumn("_to", F.row_number().over(draw)).select(
        *keys, "_it", "ra", F.element_at("_rb", F.col("_to").cast("int")).alias("rb"))
    null = concordance(shuffled, [*keys, "_it"]).withColumnRenamed("s", "s_null")
    observed = concordance(ranks, keys).join(tie_sums(ranks, keys), keys).select(*keys, "s", "n", "ties_a", "ties_b")
    scored = null.join(observed, keys)
    all_pairs = d("n") * (d("n") - 1) / 2
    free = (all_pairs - F.col("ties_a")) * (all_pairs - F.col("ties_b"))
    tau_null = F.when(free > 0, d("s_null") / F.sqrt(free)).otherwise(0.0)
    got = scored.groupBy(*keys).agg(
        F.max(_tau()).alias("tau"), F.count(F.lit(1)).alias("n_perm"),
        count_if(F.abs("s_null") >= F.abs("s")).alias("n_extreme"),
        F.avg(tau_null).alias("null_mean"), F.stddev_samp(tau_null).alias("null_std"))
    return got.select(*keys, r6("tau").alias("tau"), "n_perm", "n_extreme",
                      r6((d("n_extreme") + 1) / (d("n_perm") + 1)).alias("p_empirical"),
                      r6("null_mean").alias("null_mean"), r6("null_std").alias("null_std"))


def _top_flags(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Position of each feature in either ranking; ties by feature name."""
    w = Window.partitionBy(*keys)
    return pairs.withColumns({
        "_pa": F.row_number().over(w.orderBy(F.desc("abs_a"), "feature")),
        "_pb": F.row_number().over(w.orderBy(F.desc("abs_b"), "feature"))})


def _each_k(pairs: DataFrame, ks: Sequence[int]) -> DataFrame:
    if any(k <= 0 for k in ks):
        raise ValueError("k must be positive")
    return pairs.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))


def jaccard_at_k(pairs: DataFrame, keys: Sequence[str], ks: Sequence[int] = TOP_KS) -> DataFrame:
    """Overlap of the two top-k sets over their union, one row per k."""
    a, b = F.col("_pa") <= F.col("k"), F.col("_pb") <= F.col("k")
    return _each_k(_top_flags(pairs, keys), ks).groupBy(*keys, "k").agg(
        r6(ratio(count_if(a & b), count_if(a | b))).alias("jaccard"))


def sign_agreement_topk(pairs: DataFrame, keys: Sequence[str], ks: Sequence[int] = TOP_KS,
                        a: str = "signed_a", b: str = "signed_b") -> DataFrame:
    """Percent of equal signs over features in BOTH top-k sets; NULL below three of them."""
    both = (F.col("_pa") <= F.col("k")) & (F.col("_pb") <= F.col("k"))
    got = _each_k(_top_flags(pairs, keys), ks).groupBy(*keys, "k").agg(
        count_if(both).alias("n_features"), count_if(both & (sign(a) == sign(b))).alias("_same"))
    return got.select(*keys, "k", "n_features", r6(F.when(
        F.col("n_features") >= MIN_SIGN_FEATURES, 100.0 * d("_same") / d("n_features"))).alias("percent"))


def sign_agreement_weighted(pairs: DataFrame, keys: Sequence[str], a: str = "signed_a", b: str = "signed_b") -> DataFrame:
    """Equal signs weighted by the mean of both magnitudes; NULL without any magnitude."""
    w = (F.col("abs_a") + F.col("abs_b")) / 2.0
    got = pairs.groupBy(*keys).agg(
        F.sum(w).alias("_all"), F.sum(F.when(sign(a) == sign(b), w).otherwise(0.0)).alias("_same"))
    return got.select(*keys, r6(ratio(100.0 * F.col("_same"), "_all", None)).alias("percent_weighted"))


def sign_agreement_all(pairs: DataFrame, keys: Sequence[str], a: str = "signed_a", b: str = "signed_b") -> DataFrame:
    """Percent of equal signs over all features; zero agrees with zero only."""
    return pairs.groupBy(*keys).agg(r6(100.0 * F.avg((sign(a) == sign(b)).cast("double"))).alias("percent_all"))


def sign_agreement_profile(pairs: DataFrame, keys: Sequence[str], ks: Sequence[int] = TOP_KS) -> DataFrame:
    """All sign-agreement variants side by side."""
    tops = sign_agreement_topk(pairs, keys, ks).groupBy(*keys).agg(*[
        F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{n}_top{k}")
        for k in ks for c, n in (("percent", "sign"), ("n_features", "n"))])
    return tops.join(sign_agreement_weighted(pairs, keys), list(keys)).join(sign_agreement_all(pairs, keys), list(keys))


def directional_consistency(pairs: DataFrame, keys: Sequence[str], ks: Sequence[int] = (10,),
                            rho_mins: Sequence[float] = (0.3,)) -> DataFrame:
    """Percent of the top-k features whose directions agree and are both pronounced.

    The denominator is k, not the number of pronounced features; that number is
    reported next to it.
    """
    w = Window.partitionBy(*keys)
    combined = (F.col("abs_a") + F.col("abs_b")) / 2.0
    placed = pairs.withColumn("_p", F.row_number().over(w.orderBy(F.desc(combined), "feature")))
    grid = _each_k(placed, ks).filter(F.col("_p") <= F.col("k")).withColumn(
        "rho_min", F.explode(F.array(*[F.lit(float(r)) for r in rho_mins])))
    strong = (F.abs("rho_a") >= F.col("rho_min")) & (F.abs("rho_b") >= F.col("rho_min"))
    agree = strong & (sign("rho_a") == sign("rho_b"))
    got = grid.groupBy(*keys, "k", "rho_min").agg(
        F.count(F.lit(1)).alias("n_considered"), count_if(strong).alias("n_meeting"), count_if(agree).alias("n_agreeing"),
        r6(F.min(F.least(F.abs("rho_a"), F.abs("rho_b")))).alias("min_abs_rho"))
    return got.withColumn("percent", r6(100.0 * d("n_agreeing") / d("n_considered")))


def rho_pairs(pairs: DataFrame, keys: Sequence[str], k: int = 10, rho_min: float = 0.3) -> DataFrame:
    """The features behind ``directional_consistency``, one row each."""
    w = Window.partitionBy(*keys)
    combined = (F.col("abs_a") + F.col("abs_b")) / 2.0
    strong = (F.abs("rho_a") >= rho_min) & (F.abs("rho_b") >= rho_min)
    return (pairs.withColumn("_p", F.row_number().over(w.orderBy(F.desc(combined), "feature")))
            .filter(F.col("_p") <= k).select(
                *keys, "feature", r6("rho_a").alias("rho_a"), r6("rho_b").alias("rho_b"),
                r6(combined).alias("mean_abs"), strong.alias("meets_rho_min"),
                (strong & (sign("rho_a") == sign("rho_b"))).alias("agrees")))


def directional_profile(pairs: DataFrame, keys: Sequence[str], ks: Sequence[int] = TOP_KS,
                        rho_mins: Sequence[float] = RHO_MINS) -> DataFrame:
    """Every (k, rho_min) cell, so that sensitivity to the thresholds shows."""
    return directional_consistency(pairs, keys, ks, rho_mins)


def _resampled(frame: DataFrame, keys: Sequence[str], fields: Sequence[str], order: str,
               n: int, seed: int) -> DataFrame:
    """(keys..., rep, slot, fields...): n resamples with replacement of a bounded sample per key.

    The draw depends on (seed, rep, slot) only, so paired fields share their index.
    """
    # bounded: one entry per sample element (a seed or a feature)
    packed = frame.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("_sample"))
    slots = packed.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn(
        "slot", F.explode(F.sequence(F.lit(1), F.size("_sample"))))
    at = pick(F.size("_sample"), "boot", seed, F.col("rep"), F.col("slot"))
    return slots.withColumn("_x", F.element_at("_sample", (at + 1).cast("int"))).select(
        *keys, "rep", "slot", *[F.col(f"_x.{f}").alias(f) for f in fields])


def _interval(replicates: DataFrame, keys: Sequence[str], ci: float) -> DataFrame:
    """Percentile interval over the finite replicates (n_bootstrap numbers per key)."""
    low, high = (100 - ci) / 200, 1 - (100 - ci) / 200
    return replicates.filter(F.col("stat").isNotNull()).groupBy(*keys).agg(
        r6(F.percentile("stat", low)).alias("ci_lower"), r6(F.percentile("stat", high)).alias("ci_upper"),
        r6(F.avg("stat")).alias("bootstrap_mean"), r6(F.coalesce(F.stddev_samp("stat"), F.lit(0.0))).alias("bootstrap_std"),
        F.count(F.lit(1)).alias("n_bootstrap"))


def bootstrap_mean_ci(sample: DataFrame, keys: Sequence[str], value: str, order: str,
                      n: int = N_BOOTSTRAP, seed: int = 42, ci: float = 95.0) -> DataFrame:
    """Percentile bootstrap of the mean of a one-dimensional sample per key."""
    finite = sample.filter(F.col(value).isNotNull())
    stats = _resampled(finite, keys, [value], order, n, seed).groupBy(*keys, "rep").agg(F.avg(value).alias("stat"))
    point = finite.groupBy(*keys).agg(r6(F.avg(value)).alias("point"))
    return point.join(_interval(stats, keys, ci), list(keys))


def bootstrap_tau_ci(pairs: DataFrame, keys: Sequence[str], a: str = "abs_a", b: str = "abs_b",
                     n: int = N_BOOTSTRAP, seed: int = 42, ci: float = 95.0) -> DataFrame:
    """Bootstrap of tau over features, both sides drawn with one shared index.

    A replicate in which one side is constant has no tau and is left out.
    """
    boot = _resampled(pairs, keys, [a, b], "feature", n, seed)
    stats = kendall_tau(boot, [*keys, "rep"], a, b).withColumnRenamed("tau", "stat")
    point = kendall_tau(pairs, keys, a, b).select(*keys, r6("tau").alias("point"))
    return point.join(_interval(stats, keys, ci), list(keys))


def all_agreement(pairs: DataFrame, keys: Sequence[str], ks: Sequence[int] = TOP_KS,
                  n_perm: int = N_PERMUTATIONS, seed: int = 42) -> DataFrame:
    """Every agreement metric of every pair as one row."""
    keys = list(keys)
    jac = jaccard_at_k(pairs, keys, ks).groupBy(*keys).agg(
        *[F.max(F.when(F.col("k") == k, F.col("jaccard"))).alias(f"jaccard_{k}") for k in ks])
    null = permutation_null(pairs, keys, n_perm=n_perm, seed=seed).select(*keys, "p_empirical", "null_mean", "null_std")
    return (kendall_pvalue(pairs, keys).join(null, keys).join(jac, keys)
            .join(sign_agreement_profile(pairs, keys, ks), keys))


def top1_agreement(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The leading feature of either side and whether it is the same."""
    got = pairs.groupBy(*keys).agg(
        F.min(F.struct((-F.col("abs_a")).alias("v"), "feature"))["feature"].alias("top1_a"),
        F.min(F.struct((-F.col("abs_b")).alias("v"), "feature"))["feature"].alias("top1_b"))
    return got.withColumn("top1_agrees", F.col("top1_a") == F.col("top1_b"))


def agreement_summary(per_seed: DataFrame, keys: Sequence[str], metrics: Sequence[str],
                      seed: int = 42, n: int = N_BOOTSTRAP) -> DataFrame:
    """Mean, std and bootstrap interval over seeds; missing values are left out."""
    keys = list(keys)
    base = per_seed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_seeds"), r6(F.avg(d(F.col("top1_agrees").cast("int")))).alias("top1_agreement_rate"),
        *[r6(F.avg(m)).alias(f"{m}_mean") for m in metrics],
        *[r6(F.coalesce(F.stddev_samp(m), F.lit(0.0))).alias(f"{m}_std") for m in metrics])
    long_form = per_seed.select(*keys, "seed", *[d(m).alias(m) for m in metrics]).unpivot(
        [*keys, "seed"], list(metrics), "metric", "v")
    cis = bootstrap_mean_ci(long_form, [*keys, "metric"], "v", "seed", n, seed).groupBy(*keys).agg(*[
        F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m in metrics for c in ("ci_lower", "ci_upper")])
    return base.join(cis, keys)


def stability_band(summary: DataFrame, tau: str = "tau_mean") -> DataFrame:
    band = (F.when(F.col(tau) > STABLE_TAU, "stable").when(F.col(tau) < UNSTABLE_TAU, "unstable")
             .otherwise("intermediate"))
    return summary.withColumn("stability", band)


def sign_diagnostic(per_seed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Did restricting to important features raise the sign agreement, and if not, is it cancellation?"""
    got = per_seed.groupBy(*keys).agg(
        r6(F.avg("sign_top")).alias("sign_top"), r6(F.avg("sign_all")).alias("sign_all"),
        r6(F.avg("direction_top")).alias("direction_top"),
        r6(F.avg((F.col("cancellation_a") + F.col("cancellation_b")) / 2.0)).alias("cancellation_ratio"))
    return got.withColumn("thresholding_raised", F.coalesce(F.col("sign_top") > F.col("sign_all"), F.lit(False)))


def ceiling_gap(cross: DataFrame, ceilings: DataFrame) -> DataFrame:
    """Cross-dataset tau against the within-dataset ceiling."""
    gap = F.col("ceiling") - F.col("tau_mean")
    verdict = (F.when(F.col("ceiling").isNull(), "not interpretable").when(gap <= 0.05, "close to ceiling")
                .when(F.col("tau_mean") < 0.3, "far below ceiling").otherwise("materially below ceiling"))
    return cross.join(ceilings, "dataset", "left").select(
        *cross.columns, "ceiling", r6(gap).alias("gap"), verdict.alias("reading"))
