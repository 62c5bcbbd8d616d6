"""Duplicates within a table and twins across its splits.

Copies collapse in a map-side aggregation, so a group of copies holding a third
of all rows is one row per task by the time it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwatch.functions.numeric import count_if, d, r6, ratio
from labelwatch.sources.views import LabelledTable

SHIFT_BAR = 0.02
RATE_TOLERANCE = 0.01


def vector_counts(table: LabelledTable) -> DataFrame:
    """Distinct (features, label) with their row count and smallest id."""
    return table.wide().groupBy(*table.features, "label").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))


def duplicate_audit(table: LabelledTable) -> DataFrame:
    """Exact duplicates, feature-vector duplicates and conflicts.  Always counted, whatever the policy."""
    vectors = vector_counts(table).groupBy(*table.features).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_labels"), F.sum(F.col("n") - 1).alias("exact"))
    got = vectors.agg(
        F.sum("n").alias("n_rows"), F.sum("exact").alias("exact_duplicates"),
        F.sum(F.col("n") - 1).alias("feature_duplicates"),
        count_if(F.col("n_labels") > 1).alias("conflicting_vectors"))
    return got.select(
        F.lit(table.name).alias("dataset"), "n_rows", "exact_duplicates", "feature_duplicates",
        (F.col("feature_duplicates") - F.col("exact_duplicates")).alias("conflicting_duplicates"),
        "conflicting_vectors", r6(ratio("exact_duplicates", "n_rows")).alias("duplicate_rate"))


def dedup_keep_first(table: LabelledTable) -> DataFrame:
    """One row per (features, label), the one with the smallest id.

    The grouping key holds every surviving column, so the row is rebuilt from
    the aggregate and no window or self-join is needed.
    """
    return vector_counts(table).select("id", "label", *table.features)


def balance_shift(table: LabelledTable, published_rate: float | None = None) -> DataFrame:
    """Positive rate before and after de-duplication, from one pass over the vectors."""
    label = d("label")
    got = vector_counts(table).agg(
        F.sum("n").alias("rows_before"), F.count(F.lit(1)).alias("rows_after"),
        (F.sum(label * d("n")) / d(F.sum("n"))).alias("before"), F.avg(label).alias("after"))
    expected = F.lit(published_rate).cast("double")
    return got.select(
        F.lit(table.name).alias("dataset"), "rows_before", "rows_after",
        r6("before").alias("rate_before"), r6("after").alias("rate_after"),
        r6(F.abs(F.col("after") - F.col("before"))).alias("shift"),
        (F.abs(F.col("after") - F.col("before")) > SHIFT_BAR).alias("shifted"),
        F.coalesce(F.abs(F.col("before") - expected) <= RATE_TOLERANCE, F.lit(True)).alias("matches_published"))


def train_twin_rate(table: LabelledTable) -> DataFrame:
    """Share of test rows whose exact feature vector occurs in train.

    Both sides meet in one aggregation per vector; no join, hence no skewed key.
    Missing values group together, as a null-safe join would match them.
    """
    train, test = F.col("split") == "train", F.col("split") == "test"
    vectors = table.frame.groupBy(*table.features).agg(
        count_if(train).alias("n_train"), count_if(test).alias("n_test"))
    twin = F.sum(F.when(F.col("n_train") > 0, F.col("n_test")).otherwise(0))
    return vectors.agg(F.sum("n_test").alias("n_test"), twin.alias("n_with_twin")).select(
        F.lit(table.name).alias("dataset"), "n_test", "n_with_twin",
        r6(ratio("n_with_twin", "n_test")).alias("twin_rate"))


def prefer_first(df: DataFrame, keys: Sequence[str], preference: Sequence[Column | str]) -> DataFrame:
    """Per key the row that comes first in the preference order; ties by all other columns.

    ``min_by`` style aggregation: partial minima before the shuffle instead of a
    window that sorts every copy.
    """
    pref = [F.col(p) if isinstance(p, str) else p for p in preference]
    rest = [c for c in df.columns if c not in keys]
    packed = F.min(F.struct(*[p.alias(f"_p{i}") for i, p in enumerate(pref)], *rest)).alias("_first")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])
