"""Profiles of both halves for many seeds at once: rows are read a fixed number of times, not once more for each seed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelwatch.functions.draws import drawn
from labelwatch.functions.numeric import d
from labelwatch.operators.importance import BACKGROUND_SHARE, directional_importance, scorer_columns
from labelwatch.operators.splitting import seed_halves
from labelwatch.sources.tables import local_table
from labelwatch.sources.views import LabelledTable

KEYS = ["seed", "half"]
PARAMETERS = ("weight", "centre", "spread")
# Rounding merges values only below some 2 ** -50 of the largest one; a distance of 2 ** -40 is safe.
SAFE_DISTANCE = 2.0 ** -40


def half_profiles(table: LabelledTable, seeds: Sequence[int], share: float = BACKGROUND_SHARE) -> DataFrame:
    """(seed, half, feature, mean_abs, mean_signed, direction) of a linear scorer fitted on either half of each seed.

    The rows of ``importance_profile`` on ``attribution_linear`` of each seed's halves, without long rows: the view is
    written once and read once each for the cuts, the parameters and the profiles of all seeds. Parameters, numbers per
    feature, pass the driver. A linear attribution is monotone, so its direction is the sign of its weight (0 for a
    constant value) unless rounding gave several values one attribution. It cannot where different values keep a
    distance well above the rounding error; only other features are aggregated by attribution (``directional_importance``).
    """
    names, spark = list(table.features), table.frame.sparkSession
    wide = table.frame.select(
        F.col(table.id_col).alias("id"), F.col(table.label_col).alias("label"), *[(d(f) + F.lit(0.0)).alias(f) for f in names],
        *[drawn(share, "background", seed, F.col(table.id_col)).alias(f"drawn_{seed}") for seed in seeds])
    rows = seed_halves(LabelledTable(wide, table.features, table.name), seeds)
    fitted = half_weights(rows, names, seeds).collect()  # a row for each feature, seed and half
    of_half: dict[tuple, dict] = {}
    for r in fitted:
        of_half.setdefault((r["seed"], r["half"]), {}).update({f"{c}_{r['feature']}": r[c] for c in PARAMETERS})
    params = local_table(spark, [{"seed": s, "half": h, **own} for (s, h), own in of_half.items()], ", ".join(
        ["seed int", "half string", *[f"`{c}_{f}` double" for f in names for c in PARAMETERS]]))
    scored = rows.select(*names, F.inline(F.array(*[
        F.struct(F.lit(seed).alias("seed"), F.when(F.col(f"a_{seed}"), "a").otherwise("b").alias("half")) for seed in seeds])
    )).join(F.broadcast(params), KEYS)
    part = {f: F.col(f"weight_{f}") * (F.col(f) - F.col(f"centre_{f}")) / F.col(f"spread_{f}") for f in names}
    sums = scored.groupBy(*KEYS).agg(F.array(*[F.struct(
        F.lit(f).alias("feature"), F.sum(F.abs(x)).alias("size"), F.sum(x).alias("signed"), F.count(x).alias("n")) for f, x in part.items()]).alias("_all"))
    profile = sums.select(*KEYS, F.inline("_all")).filter("n > 0").select(
        *KEYS, "feature", (F.col("size") / F.col("n")).alias("mean_abs"), (F.col("signed") / F.col("n")).alias("mean_signed"))

    close = sorted({r["feature"] for r in fitted if not (max(abs(r["lo"]), abs(r["hi"])) + abs(r["centre"])) * SAFE_DISTANCE < r["gap"]})
    known = [{"seed": r["seed"], "half": r["half"], "feature": r["feature"], "direction": float(np.sign(r["weight"])) * (r["lo"] < r["hi"])}
             for r in fitted if r["feature"] not in close]
    directions = local_table(spark, known, "seed int, half string, feature string, direction double")
    if close:
        rows_of_close = scored.select(*KEYS, F.inline(F.array(*[
            F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), part[f].alias("attribution")) for f in close]))).filter("value is not null")
        directions = directions.unionByName(directional_importance(rows_of_close, KEYS, monotone=True))
    return profile.join(directions, [*KEYS, "feature"])


def half_weights(rows: DataFrame, names: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """(seed, half, feature, weight, centre, spread, gap, lo, hi) of ``linear_weights`` on either half of each seed.

    Rows are summed once, by label and by their halves and background draws of all seeds; these cells, at most
    4 ** seeds for each label, are then put together for each seed and half. gap: a distance that different values keep,
    as decimals of two places or whole multiples of 2 ** -32 (0: unknown). lo, hi: the least and the largest value.
    """
    mask = lambda kind: reduce(add, [F.col(f"{kind}_{seed}").cast("long") * 2 ** i for i, seed in enumerate(seeds)])
    off = lambda x, grid: F.max(F.rint(x * grid) / grid != x)
    cells = rows.groupBy(F.col("label").cast("int").alias("label"), mask("a").alias("_a"), mask("drawn").alias("_drawn")).agg(
        F.array(*[F.struct(F.lit(f).alias("feature"), F.count(f).alias("rows"), F.sum(f).alias("total"), F.var_pop(f).alias("var"),
                           off(F.col(f), 100.0).alias("off_decimal"), off(F.col(f), 2.0 ** 32).alias("off_binary"),
                           F.min(f).alias("lo"), F.max(f).alias("hi")) for f in names]).alias("_all"))
    has = lambda kind, i: F.col(kind).bitwiseAND(F.lit(2 ** i)) > 0
    each = cells.select("label", "_a", "_drawn", F.inline("_all")).filter("rows > 0").select("*", F.inline(F.array(*[
        F.struct(F.lit(seed).alias("seed"), F.when(has("_a", i), "a").otherwise("b").alias("half"), has("_drawn", i).alias("drawn"))
        for i, seed in enumerate(seeds)])))
    own = Window.partitionBy(*KEYS, "feature")  # cells
    centred = each.withColumn("_mean", F.sum("total").over(own) / F.sum("rows").over(own))
    inside = F.col("var") + F.pow(F.col("total") / F.col("rows") - F.col("_mean"), 2)
    mean = lambda where: F.sum(F.when(where, F.col("total"))) / F.sum(F.when(where, F.col("rows")))
    return centred.groupBy(*KEYS, "feature").agg(
        F.sqrt(F.sum(F.col("rows") * inside) / F.sum("rows")).alias("s"), F.max("_mean").alias("m"), mean(F.col("drawn")).alias("b"),
        mean(F.col("label") == 1).alias("p"), mean(F.col("label") == 0).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.when(~F.max("off_decimal"), 0.01).when(~F.max("off_binary"), 2.0 ** -32).otherwise(0.0).alias("gap"),
    ).select(*KEYS, "feature", *scorer_columns(), "gap", "lo", "hi")
