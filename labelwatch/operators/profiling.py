"""What a table holds before anything is concluded from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelwatch.functions.numeric import count_if, d, r6
from labelwatch.sources.views import LabelledTable


def missing_counts(df: DataFrame, name: str) -> DataFrame:
    """Rows and missing cells per column: one pass, then a tiny unpivot."""
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"),
                  *[count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return (wide.unpivot(["n_rows"], df.columns, "column_name", "n_missing")
                .select(F.lit(name).alias("dataset"), "column_name", "n_rows", "n_missing",
                        r6(d("n_missing") / d("n_rows")).alias("missing_share")))


def raw_class_counts(df: DataFrame, label: str, name: str) -> DataFrame:
    """Raw label values with count and percent; a missing label is a value of its own."""
    counts = df.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("<missing>")).alias("raw_label")).agg(
        F.count(F.lit(1)).alias("n"))
    # one row per raw label value
    total = F.sum("n").over(Window.partitionBy(F.lit(name)))
    return counts.select(F.lit(name).alias("dataset"), "raw_label", "n",
                         r6(100.0 * d("n") / d(total)).alias("percent"))


def dataset_profile(df: DataFrame, label: str, name: str) -> DataFrame:
    """Both diagnostics as one report: (dataset, item, kind, n, percent)."""
    missing = missing_counts(df, name).select(
        "dataset", F.lit("missing").alias("kind"), F.col("column_name").alias("item"),
        F.col("n_missing").alias("n"), r6(100.0 * F.col("missing_share")).alias("percent"))
    classes = raw_class_counts(df, label, name).select(
        "dataset", F.lit("class").alias("kind"), F.col("raw_label").alias("item"), "n", "percent")
    return missing.unionByName(classes)


def shape_check(df: DataFrame, name: str, rows: int, features: int, label_columns: int = 1) -> DataFrame:
    """Observed against published (rows, features)."""
    found = len(df.columns) - label_columns
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_rows")).select(
        F.lit(name).alias("dataset"), "n_rows", F.lit(rows).cast("bigint").alias("expected_rows"),
        F.lit(found).alias("n_features"), F.lit(features).alias("expected_features"),
        ((F.col("n_rows") == rows) & F.lit(found == features)).alias("matches"))


def feature_inventory(catalogue: DataFrame, df: DataFrame, label: str, retained: Sequence[str],
                      name: str, reasons: Mapping[str, str] | None = None) -> DataFrame:
    """Every column of the catalogue or the delivery, what became of it and how full it is.

    ``catalogue`` is (column_name, role, declared_type); a column known to one
    side only still gets its row.
    """
    pairs = [F.lit(x) for kv in (reasons or {}).items() for x in kv]
    given = F.create_map(*pairs)[F.col("column_name")] if pairs else F.lit(None).cast("string")
    delivered = missing_counts(df, name).select("column_name", "n_missing", F.lit(True).alias("in_delivery"))
    both = catalogue.join(delivered, "column_name", "full")
    status = (F.when(F.col("in_delivery").isNull(), "not_delivered")
               .when(F.col("column_name") == label, "label")
               .when(F.col("column_name").isin(list(retained)), "retained").otherwise("dropped"))
    reason = (F.when(F.col("status") == "not_delivered",
                     F.concat(F.lit("declared with role "), F.col("role"), F.lit(" but absent from the delivery")))
               .when(F.col("status") == "label", "target variable, 1 = positive")
               .when(F.col("status") == "retained", "")
               .otherwise(F.coalesce(given, F.lit("dropped during preparation"))))
    return both.withColumn("status", status).select(
        F.lit(name).alias("dataset"), "column_name", F.coalesce("in_delivery", F.lit(False)).alias("in_delivery"),
        F.coalesce("role", F.lit("<unknown>")).alias("role"),
        F.coalesce("declared_type", F.lit("<unknown>")).alias("declared_type"),
        F.coalesce("n_missing", F.lit(-1)).alias("n_missing"), "status", reason.alias("reason"))


def inventory_counts(inventory: DataFrame) -> DataFrame:
    """Reconciliation: columns per status."""
    return inventory.groupBy("dataset", "status").agg(F.count(F.lit(1)).alias("n_columns"))


def dataset_characteristics(tables: Sequence[LabelledTable]) -> DataFrame:
    """Rows, features, positive rate and duplicate rate of each table."""
    from labelwatch.operators.duplicates import duplicate_audit

    out = None
    for t in tables:
        rates = t.wide().agg(F.count(F.lit(1)).alias("n_rows"), r6(F.avg(d("label"))).alias("positive_rate")).select(
            F.lit(t.name).alias("dataset"), "n_rows", F.lit(len(t.features)).alias("n_features"), "positive_rate")
        row = rates.join(duplicate_audit(t).select(F.lit(t.name).alias("dataset"), "exact_duplicates", "duplicate_rate"),
                         "dataset")
        out = row if out is None else out.unionByName(row)
    return out
