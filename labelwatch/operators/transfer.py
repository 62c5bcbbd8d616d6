"""Does a concept, or a scorer, learned on one table hold on another?"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwatch.functions.draws import digest, hex_uniform, uniform
from labelwatch.functions.numeric import count_if, d, r6, ratio
from labelwatch.operators.agreement import bootstrap_mean_ci
from labelwatch.operators.leakage import pooled_thresholds
from labelwatch.operators.ordering import hash_rank, spearman_binary
from labelwatch.operators.scoring import METRICS, LinearScorer, linear_predictions
from labelwatch.sources.views import LabelledTable, pooled_long

NO_SIGNAL = 0.02
HEADLINE_WEIGHT = 0.5
FAITH_KS = (3, 5, 10)
STRENGTHS = (0.05, 0.25, 0.50)
INJECTED = "injected"


def polarity(a: LabelledTable, b: LabelledTable) -> DataFrame:
    """Does each shared concept point the same way on both tables?

    The no-signal case is decided before the signs: a vacuous match is not
    agreement.
    """
    rho = spearman_binary(pooled_long([a, b]), ["dataset", "feature"], "value", "label")
    both = rho.groupBy(F.col("feature").alias("concept")).agg(
        F.max(F.when(F.col("dataset") == a.name, F.col("rho"))).alias("rho_a"),
        F.max(F.when(F.col("dataset") == b.name, F.col("rho"))).alias("rho_b"))
    weak_a, weak_b = F.abs("rho_a") < NO_SIGNAL, F.abs("rho_b") < NO_SIGNAL
    status = (F.when(weak_a & weak_b, "NO_SIGNAL_BOTH").when(weak_b, "NO_SIGNAL_B").when(weak_a, "NO_SIGNAL_A")
               .when(F.signum("rho_a") == F.signum("rho_b"), "agrees").otherwise("INVERTED"))
    return both.withColumn("status", status).select(
        "concept", r6("rho_a").alias("rho_a"), r6("rho_b").alias("rho_b"),
        (F.col("status") == "agrees").alias("direction_agrees"), "status")


def directional_inconsistency(pol: DataFrame) -> DataFrame:
    """Disagreements ranked by how much the concept matters on either side."""
    weight = F.greatest(F.abs("rho_a"), F.abs("rho_b"))
    return (pol.withColumn("importance_weight", weight)
            .withColumn("headline", ~F.col("direction_agrees") & (F.col("importance_weight") >= HEADLINE_WEIGHT))
            .orderBy(F.desc("headline"), F.desc("importance_weight"), "concept"))


def concept_mapping_table(mapped: DataFrame, unmapped_a: DataFrame, unmapped_b: DataFrame, pol: DataFrame) -> DataFrame:
    """Mapped concepts with their polarity, then what either side has without a counterpart.

    ``mapped`` is (concept, column_a, column_b, reason); the others (column, reason).
    """
    rows = mapped.select("concept", F.lit("mapped").alias("mapping"), "column_a", "column_b", "reason").unionByName(
        unmapped_a.select(F.lit("").alias("concept"), F.lit("unmapped_a").alias("mapping"),
                          F.col("column").alias("column_a"), F.lit("").alias("column_b"), "reason")).unionByName(
        unmapped_b.select(F.lit("").alias("concept"), F.lit("unmapped_b").alias("mapping"),
                          F.lit("").alias("column_a"), F.col("column").alias("column_b"), "reason"))
    return rows.join(pol, "concept", "left")


def transfer_predictions(tables: Mapping[str, LabelledTable], scorers: Mapping[str, LinearScorer], seed: int) -> DataFrame:
    """Every source scorer on every target's own test rows; the source's scaling applies to the target."""
    parts = []
    for source, scorer in scorers.items():
        for target, table in tables.items():
            parts.append(linear_predictions(table.where(F.col("split") == "test"), scorer).select(
                F.lit(f"{source}->{target}").alias("direction"), F.lit(source == target).alias("in_distribution"),
                F.lit(seed).alias("seed"), "label", "score", "probability", "prediction"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def transfer_summary(matrix: DataFrame, metrics: Sequence[str] = METRICS, n: int = 1000, seed: int = 42) -> DataFrame:
    """Mean, std and bootstrap interval of every metric per direction; metrics in long form."""
    long_form = matrix.select("direction", "seed", *[d(m).alias(m) for m in metrics]).unpivot(
        ["direction", "seed"], list(metrics), "metric", "v")
    spread = long_form.groupBy("direction", "metric").agg(
        F.count(F.lit(1)).alias("n_seeds"), r6(F.coalesce(F.stddev_samp("v"), F.lit(0.0))).alias("std"))
    cis = bootstrap_mean_ci(long_form, ["direction", "metric"], "v", "seed", n, seed).select(
        "direction", "metric", F.col("point").alias("mean"), "ci_lower", "ci_upper")
    return spread.join(cis, ["direction", "metric"])


def transfer_verdict(means: DataFrame) -> DataFrame:
    """(direction, accuracy_above_majority, roc_auc, mcc) -> what transfers.

    Accuracy at a fixed cut punishes calibration, AUC only ordering; failing the
    first while passing the second is reported as mixed.
    """
    failed = F.col("accuracy_above_majority") <= 0.02
    verdict = (F.when(failed & (F.col("roc_auc") < 0.65), "no transfer").when(failed, "mixed").otherwise("transfers"))
    return means.withColumn("verdict", verdict).withColumn("anti_correlated", F.col("mcc") < -0.02)


def rule_sufficiency(table: LabelledTable, scorer: LinearScorer, ks: Sequence[int] = FAITH_KS) -> DataFrame:
    """Accuracy with the top-k features only, and without them, against all of them.

    A feature left out stays at its centre.  All variants are expressions over
    one scan; the ranking of a handful of weights is known on the driver.
    """
    order = sorted(scorer.features, key=lambda f: (-abs(scorer.weights[f]), f))

    def hit(names: Sequence[str]) -> Column:
        score = F.round(scorer.score(names), 6) if names else F.lit(0.0)
        return F.avg(((score >= 0).cast("int") == F.col(table.label_col)).cast("double"))

    frame = table.frame.filter(F.col("split") == "test")
    wide = frame.agg(hit(order).alias("full"), *[hit(order[:k]).alias(f"suf_{k}") for k in ks],
                     *[hit(order[k:]).alias(f"com_{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit("; ".join(order[:k])).alias("top_k_features"),
                              F.col(f"suf_{k}").alias("s"), F.col(f"com_{k}").alias("c")) for k in ks])
    return wide.select("full", F.inline(rows)).select(
        F.lit(table.name).alias("dataset"), "k", "top_k_features", r6("full").alias("full_accuracy"),
        r6("s").alias("sufficiency_accuracy"), r6("c").alias("comprehensiveness_accuracy"),
        r6(ratio("s", "full")).alias("performance_retained"), r6(F.col("full") - F.col("c")).alias("performance_lost"))


def faithfulness_summary(rows: DataFrame, k_flag: int = 3, bar: float = 0.99) -> DataFrame:
    """Means over seeds; a few features that reproduce the whole model are a leak in other words."""
    got = rows.groupBy("dataset", "k").agg(
        F.count(F.lit(1)).alias("n_seeds"), r6(F.avg("performance_retained")).alias("performance_retained"),
        r6(F.avg("performance_lost")).alias("performance_lost"), r6(F.avg("full_accuracy")).alias("full_accuracy"))
    return got.withColumn("few_features_suffice", (F.col("k") == k_flag) & (F.col("performance_retained") > bar))


def weak_proxy(strength: float, seed: int, label: Column, row_id: Column) -> Column:
    """The label with probability ``strength``, a coin flip otherwise."""
    coin = F.floor(uniform("coin", seed, strength, row_id) * 2).cast("double")
    return F.when(uniform("reveal", seed, strength, row_id) < strength, label.cast("double")).otherwise(coin)


def gaussian(seed: int, row_id: Column) -> Column:
    """Standard normal by Box-Muller on two digests."""
    u1 = F.lit(1.0) - hex_uniform(digest("normal_1", seed, row_id))
    u2 = hex_uniform(digest("normal_2", seed, row_id))
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def inject_feature(table: LabelledTable, donor: str, seed: int = 42, strengths: Sequence[float] = STRENGTHS) -> DataFrame:
    """One planted column per strategy: a shuffled copy, noise, and label proxies of rising strength."""
    base = table.wide()
    here = hash_rank(base.select("id", "label"), [], "id", "slot", seed, rank="k")
    copies = hash_rank(base.select("id", d(donor).alias("permuted_copy")), [], "id", "donor", seed, rank="k").select(
        "k", "permuted_copy")
    proxies = {f"proxy_{int(round(s * 100)):02d}": weak_proxy(s, seed, F.col("label"), F.col("id")) for s in strengths}
    return here.join(copies, "k").select(
        "id", "label", "permuted_copy", gaussian(seed, F.col("id")).alias("pure_noise"),
        *[c.alias(n) for n, c in proxies.items()])


def injection_rank(table: LabelledTable, donor: str, seed: int = 42) -> DataFrame:
    """Rank of every planted column among the genuine features, by single-cut balanced accuracy."""
    planted = inject_feature(table, donor, seed)
    columns = [c for c in planted.columns if c not in ("id", "label")]
    genuine = pooled_thresholds([table]).select("feature", "balanced_accuracy")
    injected = pooled_thresholds([LabelledTable(planted, tuple(columns), INJECTED)]).select(
        F.col("feature").alias("strategy"), F.col("balanced_accuracy").alias("injected_accuracy"))
    # planted columns x features rows, both model-sized
    better = genuine.withColumn("strategy", F.explode(F.array(*[F.lit(c) for c in columns]))).join(injected, "strategy")
    return better.groupBy("strategy", "injected_accuracy").agg(
        (count_if(F.col("balanced_accuracy") > F.col("injected_accuracy")) + 1).alias("injected_rank"),
        (F.count(F.lit(1)) + 1).alias("n_features")).withColumn("reached_rank_1", F.col("injected_rank") == 1)


def lowest_winning_strength(ranks: DataFrame) -> DataFrame:
    """The weakest label proxy that reaches rank 1, NULL if none does."""
    strength = F.regexp_extract("strategy", "^proxy_([0-9]+)$", 1).try_cast("int") / 100.0
    return ranks.withColumn("strength", strength).filter("strength is not null").agg(
        count_if(F.col("reached_rank_1")).alias("n_reached"),
        F.min(F.when(F.col("reached_rank_1"), F.col("strength"))).alias("lowest_strength"))
