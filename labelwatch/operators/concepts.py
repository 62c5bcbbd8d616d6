"""Projecting tables onto concepts they share, and scanning text for forbidden content."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwatch.functions.numeric import d, r6, ratio
from labelwatch.sources.views import LabelledTable

# Cut points of the published ternary encoding, 1 = good, 0 = unclear, -1 = bad.
LENGTH_CUTS = (54, 75)
DEPTH_CUTS = (1, 2)
RATIO_CUTS = (0.31, 0.67)


def ternary(value: Column, low: float, high: float, inclusive_low: bool) -> Column:
    """1 below the first cut, 0 up to the second (inclusive), -1 above."""
    first = (value <= low) if inclusive_low else (value < low)
    return F.when(first, 1).when(value <= high, 0).otherwise(-1)


def bin_length(length: Column) -> Column:
    return ternary(length, *LENGTH_CUTS, inclusive_low=False)


def bin_depth(depth: Column) -> Column:
    return ternary(depth, *DEPTH_CUTS, inclusive_low=True)


def external_ratio(external: Column, own: Column, empty: Column) -> Column:
    return ratio(external, external + own + empty)


def bin_ratio(external: Column, own: Column, empty: Column) -> Column:
    return ternary(external_ratio(external, own, empty), *RATIO_CUTS, inclusive_low=False)


def page_rules() -> dict[str, tuple[tuple[str, ...], Column]]:
    """Concepts of a table of page features, each with the columns it needs: 1 plain, 0 between, -1 heavy."""
    scripts, images, dead = F.col("n_script"), F.col("n_img"), F.col("empty_refs")
    out, own = F.col("external_refs"), F.col("self_refs")
    return {
        "script_weight": (("n_script",), ternary(scripts, 0, 2, inclusive_low=True)),
        "picture_mix": (("n_img", "n_script"), F.signum(images - scripts)),
        "link_reach": (("self_refs", "external_refs"), F.signum(own - out)),
        "dead_links": (("empty_refs",), ternary(dead, 0, 3, inclusive_low=True)),
        "host_shape": (("n_subdomain", "is_ip"),
                       F.when(F.col("is_ip") == 1, -1).when(F.col("n_subdomain") == 0, 1).otherwise(0)),
    }


def concept_project(df: DataFrame, rules: Mapping[str, tuple[Sequence[str], Column]],
                    keep: Sequence[str] = ("id", "label")) -> DataFrame:
    """One select: the kept columns and one integer column per concept."""
    return df.select(*keep, *[rule.cast("int").alias(name) for name, (_, rule) in rules.items()])


def concept_loss(sources: DataFrame, survivors: DataFrame) -> DataFrame:
    """Which concepts can still be expressed: every one of their source columns must survive.

    ``sources`` is (concept, feature), ``survivors`` is (feature).
    """
    marked = sources.join(survivors.select("feature", F.lit(1).alias("alive")).distinct(), "feature", "left")
    got = marked.groupBy("concept").agg(
        F.count("alive").alias("n_alive"), F.count(F.lit(1)).alias("n_sources"),
        # bounded: the source columns of one concept
        F.array_sort(F.collect_list(F.when(F.col("alive").isNull(), F.col("feature")))).alias("gone"))
    kept = F.col("n_alive") == F.col("n_sources")
    return got.select(
        "concept", "n_sources", "n_alive", F.when(kept, "kept").otherwise("lost").alias("status"),
        F.when(kept, "").otherwise(F.concat(F.lit("removed as leaking: "), F.array_join("gone", "; "))).alias("reason"))


def shared_distribution(tables: Sequence[LabelledTable]) -> DataFrame:
    """Per (dataset, concept, value): rows, share of the dataset, positive rate."""
    counts = None
    for t in tables:
        part = t.long().groupBy("feature", "value").agg(
            F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_positive")).select(
            F.lit(t.name).alias("dataset"), F.col("feature").alias("concept"), "value", "n", "n_positive")
        counts = part if counts is None else counts.unionByName(part)
    sizes = counts.groupBy("dataset", "concept").agg(F.sum("n").alias("total"))
    return counts.join(sizes, ["dataset", "concept"]).select(
        "dataset", "concept", "value", "n", r6(d("n") / d("total")).alias("share"),
        r6(d("n_positive") / d("n")).alias("positive_rate"))


def shared_distribution_pivot(tables: Sequence[LabelledTable]) -> DataFrame:
    """Concept and value as rows, one positive-rate column per dataset."""
    names = [t.name for t in tables]
    return (shared_distribution(tables).groupBy("concept", "value")
            .pivot("dataset", names).agg(F.first("positive_rate")))


def forbidden_content_scan(df: DataFrame, id_col: str, columns: Sequence[str], name: str,
                           patterns: Mapping[str, str]) -> DataFrame:
    """Cells that match a forbidden pattern, with the first match.

    Patterns are expressions of one projection, so a cell is read once for all
    of them and only hits travel on.
    """
    cells = df.select(F.col(id_col).alias("id"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("cell")) for c in columns])))
    tests = F.array(*[F.struct(F.lit(k).alias("pattern"), F.regexp_extract("cell", p, 0).alias("first_match"))
                      for k, p in patterns.items()])
    return (cells.select("id", "column_name", F.inline(tests)).filter(F.col("first_match") != "")
                 .select(F.lit(name).alias("table_name"), "id", "column_name", "pattern", "first_match"))


def refuse_forbidden(df: DataFrame, id_col: str, columns: Sequence[str], name: str,
                     patterns: Mapping[str, str]) -> DataFrame:
    """The table itself, or an error naming the first offending cell."""
    hit = forbidden_content_scan(df, id_col, columns, name, patterns).first()
    if hit:
        raise ValueError(f"{name}.{hit['column_name']} id={hit['id']}: refusing to write {hit['pattern']}")
    return df
