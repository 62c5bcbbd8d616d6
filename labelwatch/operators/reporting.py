"""Tables as they are shown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGNIFICANT = 6


def top_features(scores: DataFrame, k: int = 15) -> DataFrame:
    """The k best single features per dataset."""
    w = Window.partitionBy("dataset").orderBy(F.desc("accuracy"), "feature")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "dataset", "rank", "feature", "accuracy")


def missing_tables(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """Expected tables (table_name, reason) that were not produced: recorded, never written empty."""
    return expected.join(produced.select("table_name").distinct(), "table_name", "left_anti")


def display_names(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Whole-cell identifiers, also ``a->b``, get their display name; prose is left alone.

    ``names`` (key, display) is a fixed list of known identifiers, small by nature.
    """
    lookup = F.broadcast(names)
    parts = F.split(F.trim(column), "->")
    base = df.withColumn("_first", F.trim(F.get(parts, F.lit(0)))).withColumn(
        "_second", F.trim(F.get(parts, F.lit(1)))).withColumn("_parts", F.size(parts))
    named = (base.join(lookup.select(F.col("key").alias("_first"), F.col("display").alias("_n1")), "_first", "left")
                 .join(lookup.select(F.col("key").alias("_second"), F.col("display").alias("_n2")), "_second", "left"))
    shown = (F.when((F.col("_parts") == 1) & F.col("_n1").isNotNull(), F.col("_n1"))
              .when((F.col("_parts") == 2) & F.col("_n1").isNotNull() & F.col("_n2").isNotNull(),
                    F.concat("_n1", F.lit(" -> "), "_n2")).otherwise(F.col(column)))
    return named.withColumn(column, shown).select(*df.columns)


def significant(value: Column, digits: int = SIGNIFICANT) -> Column:
    """Rounded to significant figures; the scale is a power of ten taken from the magnitude."""
    scale = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value * scale) / scale)


def sig_figs(df: DataFrame, columns: Sequence[str], digits: int = SIGNIFICANT) -> DataFrame:
    return df.withColumns({c: significant(F.col(c), digits) for c in columns})
