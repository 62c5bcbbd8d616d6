"""Registered queries: attributions, importance profiles and their agreement."""

from functools import reduce

from pyspark.sql import functions as F

from labelwatch.functions.numeric import d, r6
from labelwatch.operators import agreement as ag
from labelwatch.operators import importance as im
from labelwatch.operators import scoring
from labelwatch.operators.seeded import half_profiles as half_profiles_of
from labelwatch.operators.splitting import stratified_halves, stratified_split
from labelwatch.session import settle
from labelwatch.sources import views as v

KEYS = ["dataset", "seed"]
KS = (3, 5, 10)
SEEDS = (42, 43, 44)
EVERY_SEED = (42, 43, 44, 45, 46)


def union(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


def half_rows(tables, seed):
    """Long rows of every view with the half they fall in and the draw of the background."""
    halves = [im.with_background(stratified_halves(t, seed), seed) for t in tables]
    return v.pooled_long(halves, "half", "drawn").withColumn("seed", F.lit(seed))


def half_attributions(s, p, seeds=(42,), views=tuple(v.VIEWS)):
    """Views are built once, for all seeds; parameters, numbers per feature, are settled before rows are read again."""
    keys = [*KEYS, "half"]
    tables = [v.stored_view(v.VIEWS[w](s, p)) for w in views]
    parts = []
    for seed in seeds:
        rows = half_rows(tables, seed)
        parts.append(im.attribution_linear(rows, settle(im.linear_weights(rows, keys, seed)), keys).drop("drawn"))
    return union(parts)


def half_profiles(s, p, seeds=(42,), directions=False, views=tuple(v.VIEWS)):
    return settle(im.importance_profile(half_attributions(s, p, seeds, views), [*KEYS, "half"], directions, monotone=True))


def half_pairs(s, p, seeds=(42,), directions=False, views=tuple(v.VIEWS)):
    profiles = half_profiles(s, p, seeds, directions, views)
    return paired(profiles)


def paired(profiles):
    """Settled profiles split into sides: metrics read a table of features, not the rows behind it."""
    return ag.align_profiles(profiles.filter("half = 'a'"), profiles.filter("half = 'b'"), KEYS)


def rounded(profile, *cols, keys=(*KEYS, "half", "feature")):
    return profile.select(*keys, *[r6(c).alias(c) for c in cols])


def additivity(s, p):
    """The parts of the linear attribution against the score computed in one expression."""
    t = stratified_split(v.planted(s, p))
    rows = t.long().withColumn("dataset", F.lit(t.name))
    weights = im.linear_weights(rows, ["dataset"])
    attr = im.attribution_linear(rows, weights, ["dataset"])
    fitted = {r["feature"]: r for r in weights.collect()}  # one row per feature
    scorer = scoring.LinearScorer(*({f: fitted[f][c] for f in t.features} for c in ("weight", "centre", "spread")))
    scores = t.frame.select(F.lit(t.name).alias("dataset"), "id", scorer.score().alias("score"),
                            F.lit(0.0).alias("base_score"))
    return im.attribution_additivity(attr, scores, ["dataset"])


def ensemble(s, p):
    """Mean of two members fitted with different backgrounds."""
    rows = v.order_status(s, p).long().withColumn("dataset", F.lit("order_status"))
    members = union([im.attribution_linear(rows, im.linear_weights(rows, ["dataset"], seed), ["dataset"])
                     for seed in SEEDS[:2]])
    return im.attribution_ensemble(members, ["dataset"], 2).select(
        "dataset", "id", "feature", r6("attribution").alias("attribution"))


def linear_rows(s, p):
    attr = half_attributions(s, p, views=("order_status",))
    return attr.select("dataset", "half", "id", "feature", "value", r6("attribution").alias("attribution"))


def permutation(s, p):
    """Fitted on train, scored on test, five shuffles."""
    t = stratified_split(v.planted(s, p))
    return im.permutation_importance(t.where(F.col("split") == "test"), scoring.fit_linear(t))


def permutation_whole(s, p):
    """All rows scored in five shuffles, those of either half by the fit on the other."""
    t = stratified_halves(v.planted(s, p))
    return im.permutation_importance(t, scoring.cross_fit(t), carry=["half"])


def planted_profile(s, p):
    rows = v.planted(s, p).long().withColumn("dataset", F.lit("planted"))
    return im.global_importance(im.attribution_linear(rows, im.linear_weights(rows, ["dataset"]), ["dataset"]), ["dataset"])


def tau_rows(s, p):
    return ag.kendall_tau(half_pairs(s, p), KEYS).select(*KEYS, "n", "s", r6("tau").alias("tau"))


def every_profile(s, p):
    """Profiles of both halves of every view in all five seeds, settled: (dataset, seed, half, feature) rows."""
    return settle(union([half_profiles_of(view(s, p), EVERY_SEED).withColumn("dataset", F.lit(name)) for name, view in v.VIEWS.items()]))


def joined(parts):
    return reduce(lambda a, b: a.join(b, KEYS), parts)


def cancellation(profiles):
    """The cancellation ratio of either half beside each other."""
    return im.cancellation_ratio(profiles, [*KEYS, "half"]).groupBy(*KEYS).agg(*[
        F.max(F.when(F.col("half") == h, F.col("cancellation_ratio"))).alias(f"cancellation_{h}") for h in "ab"])


def wide_k(frame, columns):
    """One row per (dataset, seed): each column of the rows per k under its name with k."""
    return frame.groupBy(*KEYS).agg(*[
        F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{name}{k}") for k in ag.TOP_KS for c, name in columns.items()])


def directions(pairs):
    """Agreement of directions: in top-k sets, weighted, over all features, and with both directions pronounced."""
    rho = ("rho_a", "rho_b")
    grid = ag.directional_profile(pairs, KEYS)
    cells = [F.max(F.when((F.col("k") == k) & (F.col("rho_min") == r), F.col(c))).alias(f"{name}_{k}_{int(100 * r)}")
             for k in ag.TOP_KS for r in ag.RHO_MINS for c, name in (("percent", "directional"), ("n_meeting", "n_directional"))]
    return [wide_k(ag.sign_agreement_topk(pairs, KEYS, a=rho[0], b=rho[1]), {"percent": "direction_top", "n_features": "n_direction_top"}),
            ag.sign_agreement_weighted(pairs, KEYS, *rho).withColumnRenamed("percent_weighted", "direction_weighted"),
            ag.sign_agreement_all(pairs, KEYS, *rho).withColumnRenamed("percent_all", "direction_all"),
            grid.groupBy(*KEYS).agg(*cells)]


def rankings(pairs):
    """Leading features, overlap of the top-k sets and agreement of signs."""
    return [ag.top1_agreement(pairs, KEYS), wide_k(ag.jaccard_at_k(pairs, KEYS), {"jaccard": "jaccard_"}),
            ag.sign_agreement_profile(pairs, KEYS)]


def per_seed(s, p):
    """One row per (dataset, seed) of all views and seeds: tau with both p-values and interval, overlaps, signs, directions, cancellation."""
    profiles = every_profile(s, p)
    pairs = settle(paired(profiles))
    null = ag.permutation_null(pairs, KEYS).select(*KEYS, "p_empirical", "null_mean", "null_std")
    interval = ag.bootstrap_tau_ci(pairs, KEYS).select(*KEYS, "ci_lower", "ci_upper")
    size = pairs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_features"))
    return joined([size, ag.kendall_pvalue(pairs, KEYS), null, interval, *rankings(pairs), *directions(pairs), cancellation(profiles)])


def summary(s, p):
    """Mean, deviation and interval over the seeds of every metric of the rankings."""
    pairs = settle(paired(every_profile(s, p)))
    rows = settle(joined([ag.kendall_tau(pairs, KEYS).select(*KEYS, r6("tau").alias("tau")), *rankings(pairs)]))
    metrics = ["tau", *[f"{m}{k}" for m in ("jaccard_", "sign_top") for k in ag.TOP_KS], "percent_weighted", "percent_all"]
    return ag.agreement_summary(rows, ["dataset"], metrics, n=1000)


def diagnostic(s, p):
    """One row per (dataset, k)."""
    profiles = every_profile(s, p)
    pairs = settle(paired(profiles))
    top = ag.sign_agreement_topk(pairs, KEYS).select(*KEYS, "k", F.col("percent").alias("sign_top"))
    direction = ag.sign_agreement_topk(pairs, KEYS, a="rho_a", b="rho_b").select(*KEYS, "k", F.col("percent").alias("direction_top"))
    every = ag.sign_agreement_all(pairs, KEYS).withColumnRenamed("percent_all", "sign_all")
    return ag.sign_diagnostic(joined([top.join(direction, [*KEYS, "k"]), every, cancellation(profiles)]), ["dataset", "k"])


def cross_pairs(s, p, directions=False):
    """Concept profiles of the two collections, each with its own scorer."""
    rows = v.pooled_long([v.concept_side(s, p, "a"), v.concept_side(s, p, "b")])
    attr = im.attribution_linear(rows, im.linear_weights(rows, ["dataset"]), ["dataset"])
    profile = settle(im.importance_profile(attr, ["dataset"], directions, monotone=True))
    side = lambda n: profile.filter(F.col("dataset") == n).withColumn("dataset", F.lit("concept_a->concept_b"))
    return ag.align_profiles(side("concept_a"), side("concept_b"), ["dataset"])


def cross(s, p):
    pairs, keys = cross_pairs(s, p, True), ["dataset"]
    direct = ag.directional_consistency(pairs, keys, (5,), (0.3,)).select("dataset", F.col("percent").alias("directional"))
    jac = ag.jaccard_at_k(pairs, keys, (5,)).select("dataset", "jaccard")
    return reduce(lambda a, b: a.join(b, keys), [
        ag.kendall_pvalue(pairs, keys), jac, ag.sign_agreement_weighted(pairs, keys), ag.sign_agreement_all(pairs, keys),
        direct, im.mass_distance(pairs, keys), ag.top1_agreement(pairs, keys)])


def gap(s, p):
    """Cross-collection tau of every view's halves taken as ceiling for the concept pair."""
    crossed = ag.kendall_tau(cross_pairs(s, p), ["dataset"]).select("dataset", r6("tau").alias("tau_mean"))
    within = ag.kendall_tau(half_pairs(s, p), KEYS).select("dataset", F.col("tau").alias("tau_mean"))
    ceilings = within.filter("dataset <> 'doc_quality'").select("dataset", r6("tau_mean").alias("ceiling"))
    all_cross = crossed.unionByName(within.select("dataset", r6(F.col("tau_mean") - 0.2).alias("tau_mean")))
    return ag.ceiling_gap(all_cross, ceilings)


def alignment(s, p):
    """Profiles that share only part of their features."""
    profiles = half_profiles(s, p)
    a = profiles.filter("half = 'a' and feature <> 'noise'")
    b = profiles.filter("half = 'b' and feature not in ('tax', 'n_chars')")
    return ag.alignment_report(a, b, KEYS)


QUERIES = {
    "attribution_linear": linear_rows,
    "attribution_ensemble": ensemble,
    "attribution_additivity": additivity,
    "global_importance": lambda s, p: rounded(im.global_importance(half_attributions(s, p), [*KEYS, "half"]), "mean_abs"),
    "signed_importance": lambda s, p: rounded(im.signed_importance(half_attributions(s, p), [*KEYS, "half"]), "mean_signed"),
    "directional_importance": lambda s, p: rounded(
        im.directional_importance(half_attributions(s, p), [*KEYS, "half"], monotone=True), "direction"),
    "cancellation_ratio": lambda s, p: im.cancellation_ratio(half_profiles(s, p), [*KEYS, "half"]),
    "attribution_mass": lambda s, p: rounded(im.attribution_mass(half_profiles(s, p), [*KEYS, "half"]), "mass"),
    "mass_distance": lambda s, p: im.mass_distance(half_pairs(s, p), KEYS),
    "permutation_importance": lambda s, p: permutation_whole(s, p).select(
        "feature", r6("importance").alias("importance"), r6("importance_std").alias("importance_std"), "n_repeats"),
    "importance_degeneracy": lambda s, p: im.importance_degeneracy(permutation(s, p)),
    "attribution_vs_permutation": lambda s, p: im.attribution_vs_permutation(planted_profile(s, p), permutation(s, p), 3),
    "sample_convergence": lambda s, p: im.sample_convergence(v.order_status(s, p)),
    "align_profiles": alignment,
    "kendall_tau": tau_rows,
    "kendall_pvalue": lambda s, p: ag.kendall_pvalue(half_pairs(s, p), KEYS),
    "permutation_null": lambda s, p: ag.permutation_null(half_pairs(s, p), KEYS),
    "jaccard_at_k": lambda s, p: ag.jaccard_at_k(half_pairs(s, p), KEYS, KS),
    "sign_agreement_topk": lambda s, p: ag.sign_agreement_topk(half_pairs(s, p), KEYS, KS),
    "sign_agreement_weighted": lambda s, p: ag.sign_agreement_weighted(half_pairs(s, p), KEYS),
    "sign_agreement_all": lambda s, p: ag.sign_agreement_all(half_pairs(s, p), KEYS),
    "sign_agreement_profile": lambda s, p: ag.sign_agreement_profile(half_pairs(s, p), KEYS, KS),
    "directional_consistency": lambda s, p: ag.directional_consistency(half_pairs(s, p, directions=True), KEYS),
    "directional_profile": lambda s, p: ag.directional_profile(half_pairs(s, p, directions=True), KEYS, KS),
    "rho_pairs": lambda s, p: ag.rho_pairs(half_pairs(s, p, directions=True), KEYS),
    "bootstrap_ci": lambda s, p: ag.bootstrap_tau_ci(half_pairs(s, p), KEYS),
    "bootstrap_mean_ci": lambda s, p: ag.bootstrap_mean_ci(half_pairs(s, p), KEYS, "abs_a", "feature"),
    "all_agreement": lambda s, p: ag.all_agreement(half_pairs(s, p), KEYS, KS, n_perm=10000),
    "half_agreement": per_seed,
    "agreement_summary": summary,
    "stability_band": lambda s, p: ag.stability_band(ag.kendall_tau(half_pairs(s, p, SEEDS), KEYS).groupBy("dataset").agg(
        r6(F.avg("tau")).alias("tau_mean"))),
    "sign_diagnostic": diagnostic,
    "cross_agreement": cross,
    "ceiling_gap": gap,
}
