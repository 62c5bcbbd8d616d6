"""From raw labels and raw columns to a prepared table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from labelwatch.functions.numeric import count_if, d, r6
from labelwatch.operators.profiling import missing_counts

RATE_TOLERANCE = 0.01
LABEL_POLICIES = ("merge", "drop")


def _lookup(mapping: Mapping[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def harmonise_labels(df: DataFrame, raw: str, mapping: Mapping[str, int], out: str = "label") -> DataFrame:
    """Raw value -> 1 positive / 0 negative; a value outside the mapping becomes NULL."""
    return df.withColumn(out, _lookup(mapping)[F.col(raw).cast("string")].cast("int"))


def label_report(df: DataFrame, raw: str, mapping: Mapping[str, int], published_rate: float, name: str,
                 tolerance: float = RATE_TOLERANCE) -> DataFrame:
    """One row: unexpected raw values, positive rate and whether it matches the published one."""
    mapped = harmonise_labels(df, raw, mapping, "_label")
    row = mapped.agg(F.count(F.lit(1)).alias("n_rows"), count_if(F.col("_label").isNull()).alias("n_unexpected"),
                     F.avg(d("_label")).alias("_rate"))
    return row.select(
        F.lit(name).alias("dataset"), "n_rows", "n_unexpected", r6("_rate").alias("positive_rate"),
        F.lit(published_rate).alias("published_rate"),
        ((F.col("n_unexpected") == 0) & (F.abs(F.col("_rate") - published_rate) <= tolerance)).alias("accepted"))


def checked_labels(df: DataFrame, raw: str, mapping: Mapping[str, int], published_rate: float, name: str,
                   tolerance: float = RATE_TOLERANCE) -> DataFrame:
    """``harmonise_labels`` behind its gate: raises rather than pass a wrong label on."""
    row = label_report(df, raw, mapping, published_rate, name, tolerance).first()
    if row["n_unexpected"]:
        raise ValueError(f"[{name}] {row['n_unexpected']} rows carry raw labels outside {sorted(mapping)}")
    if not row["accepted"]:
        raise ValueError(f"[{name}] positive rate {row['positive_rate']} is not the published {published_rate}"
                         f" within {tolerance}; the label may be inverted")
    return harmonise_labels(df, raw, mapping)


def label_policy(df: DataFrame, raw: str, positive: str, intermediate: str,
                 policies: Sequence[str] = LABEL_POLICIES) -> DataFrame:
    """A three-class label made binary under every policy in one pass.

    ``merge`` counts the intermediate class as positive, ``drop`` leaves it out.
    """
    unknown = set(policies) - set(LABEL_POLICIES)
    if unknown:
        raise ValueError(f"unknown label policies {sorted(unknown)}")
    between = F.col(raw).cast("string") == intermediate
    each = df.withColumn("policy", F.explode(F.array(*[F.lit(p) for p in policies])))
    return each.filter(~((F.col("policy") == "drop") & between)).withColumn(
        "label", ((F.col(raw).cast("string") == positive) | between).cast("int"))


def label_policy_report(df: DataFrame, raw: str, positive: str, intermediate: str) -> DataFrame:
    """Rows and positive rate before and after each policy, from the raw class counts alone."""
    classes = df.groupBy(F.col(raw).cast("string").alias("raw_label")).agg(F.count(F.lit(1)).alias("n"))
    each = classes.withColumn("policy", F.explode(F.array(*[F.lit(p) for p in LABEL_POLICIES])))
    between = F.col("raw_label") == intermediate
    kept = ~((F.col("policy") == "drop") & between)
    pos = kept & ((F.col("raw_label") == positive) | between)
    return each.groupBy("policy").agg(
        F.sum("n").alias("n_before"), F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("n_after"),
        F.sum(F.when(between, F.col("n")).otherwise(0)).alias("n_intermediate"),
        r6(d(F.sum(F.when(pos, F.col("n")).otherwise(0)))
           / d(F.sum(F.when(kept, F.col("n")).otherwise(0)))).alias("positive_rate"))


def label_value_match(df: DataFrame, raw: str, positive: str) -> DataFrame:
    """String label -> label == positive."""
    return df.withColumn("label", (F.col(raw) == F.lit(positive)).cast("int"))


def dropped_columns(df: DataFrame, identifiers: Sequence[str]) -> list[tuple[str, str]]:
    """(column, reason) for listed identifiers, then every non-numeric column."""
    out = [(c, "identifier") for c in df.columns if c in set(identifiers)]
    out += [(f.name, "not numeric") for f in df.schema.fields
            if f.name not in set(identifiers) and not isinstance(f.dataType, NumericType)]
    return out


def drop_identifiers(df: DataFrame, identifiers: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The numeric columns; a pruned scan, since nothing else is read."""
    gone = {c for c, _ in dropped_columns(df, identifiers)} - set(keep)
    return df.select(*[c for c in df.columns if c not in gone])


def drop_report(df: DataFrame, identifiers: Sequence[str]) -> DataFrame:
    """Every column with what happens to it, its reason, and its distinct-count evidence."""
    gone = dict(dropped_columns(df, identifiers))
    rows = [(f.name, f.name not in gone, gone.get(f.name, "")) for f in df.schema.fields]
    table = df.sparkSession.createDataFrame(rows, "column_name string, kept boolean, reason string")
    filled = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "column_name", "n_filled")
    return table.join(filled, "column_name")


def select_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("id", "label")) -> DataFrame:
    """Restrict to named features; a missing one is an error."""
    absent = [f for f in features if f not in df.columns]
    if absent:
        raise KeyError(f"features absent: {absent}")
    return df.select(*keep, *features)


def leakfree_features(all_features: DataFrame, removed: DataFrame) -> DataFrame:
    """(dataset, feature) that survive removal."""
    return all_features.join(removed.select("dataset", "feature"), ["dataset", "feature"], "left_anti")


def shared_names(a: DataFrame, b: DataFrame, minimum: int = 3) -> DataFrame:
    """Column names two tables share whatever their case, with each side's missing cells."""
    names_b = {c.lower() for c in b.columns}
    shared = [c for c in a.columns if c.lower() in names_b]
    if len(shared) < minimum:
        raise ValueError(f"only {len(shared)} shared feature names, at least {minimum} are needed")

    def side(df: DataFrame, tag: str) -> DataFrame:
        return missing_counts(df, tag).select(
            F.lower("column_name").alias("name"), F.col("column_name").alias(f"name_{tag}"),
            F.col("n_missing").alias(f"n_missing_{tag}"))

    return side(a, "a").join(side(b, "b"), "name")
