"""Labelled feature tables built from the raw tables.

Every view has a unique ``id``, an integer ``label`` (1 = positive) and numeric
features, which is all the operators assume.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwatch.functions.draws import uniform
from labelwatch.session import stored
from labelwatch.sources.tables import parquet_table

EPOCH = "1992-01-01"


@dataclass(frozen=True)
class LabelledTable:
    """A table under audit: which column identifies, which labels, which describe."""

    frame: DataFrame
    features: tuple[str, ...]
    name: str
    id_col: str = "id"
    label_col: str = "label"

    def only(self, features: Sequence[str]) -> LabelledTable:
        """Restrict to named features; a missing name is an error."""
        absent = [f for f in features if f not in self.frame.columns]
        if absent:
            raise KeyError(f"[{self.name}] features absent: {absent}")
        return replace(self, features=tuple(features))

    def where(self, condition: Column) -> LabelledTable:
        return replace(self, frame=self.frame.filter(condition))

    def named(self, name: str) -> LabelledTable:
        return replace(self, name=name)

    def wide(self, *carry: str) -> DataFrame:
        """Identifier, label and features; nothing else reaches the scan."""
        return self.frame.select(F.col(self.id_col).alias("id"),
                                 F.col(self.label_col).cast("int").alias("label"), *carry, *self.features)

    def long(self, *carry: str) -> DataFrame:
        """One row per (row, feature).  Meant to be aggregated at once, never stored."""
        base = self.frame.select(
            F.col(self.id_col).alias("id"), F.col(self.label_col).cast("int").alias("label"),
            *carry, *[(F.col(f).cast("double") + F.lit(0.0)).alias(f) for f in self.features])
        return (base.unpivot(["id", "label", *carry], list(self.features), "feature", "value")
                    .filter(F.col("value").isNotNull()))


def pooled_long(tables: Sequence[LabelledTable], *carry: str) -> DataFrame:
    """The long rows of several tables with their dataset name: one plan audits them all."""
    parts = [t.long(*carry).withColumn("id", F.col("id").cast("string")).withColumn("dataset", F.lit(t.name))
             for t in tables]
    return reduce(lambda a, b: a.unionByName(b), parts)


def stored_view(table: LabelledTable) -> LabelledTable:
    """The view written once in the shared folder, for operators that read its rows several times."""
    return replace(table, frame=stored(table.frame.select(table.id_col, table.label_col, *table.features)))


def day_number(ts: str) -> Column:
    return F.datediff(F.col(ts).cast("date"), F.lit(EPOCH).cast("date"))


def line_returned(spark: SparkSession, folder: str) -> LabelledTable:
    """Order lines; label: the line was returned.  The scale fixture."""
    li = parquet_table(spark, folder, "lineitem")
    ship_day = day_number("l_shipdate")
    key = F.md5(F.concat_ws(
        "|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        ship_day.cast("string"), F.round("l_quantity").cast("bigint").cast("string")))
    frame = li.select(
        key.alias("id"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_linenumber").cast("double").alias("linenumber"),
        ship_day.cast("double").alias("ship_day"))
    return LabelledTable(frame, ("quantity", "extendedprice", "discount", "tax", "linenumber",
                                 "ship_day"), "line_returned")


def order_status(spark: SparkSession, folder: str) -> LabelledTable:
    """All orders with their lines summed up (zeros without lines); label: the order is finished."""
    orders = parquet_table(spark, folder, "orders")
    lines = (parquet_table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"),
        F.sum(F.round("l_quantity").cast("bigint")).cast("double").alias("sum_qty"),
        (F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).cast("double")
         / F.count(F.lit(1)).cast("double")).alias("avg_discount_pct")))
    frame = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.col("o_totalprice").alias("totalprice"),
        day_number("o_orderdate").cast("double").alias("order_day"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("n_lines", "sum_qty", "avg_discount_pct")])
    return LabelledTable(frame, ("totalprice", "order_day", "priority", "n_lines", "sum_qty",
                                 "avg_discount_pct"), "order_status")


def _occurrences(text: str, pattern: str) -> Column:
    return F.regexp_count(F.col(text), F.lit(pattern)).cast("double")


def doc_quality(spark: SparkSession, folder: str) -> LabelledTable:
    """Text statistics of judged documents; label: judged good."""
    docs = parquet_table(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars")
    labels = parquet_table(spark, folder, "labels").select("doc_id", "quality")
    words = F.filter(F.split("text", "[^0-9A-Za-z]+"), lambda w: w != "")
    length = F.greatest(F.length("text"), F.lit(1)).cast("double")
    base = (docs.join(labels, "doc_id")
                .withColumn("_words", words)
                .withColumn("_n", F.size("_words").cast("double")))
    frame = base.select(
        F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"), "lang",
        F.col("n_chars").cast("double").alias("n_chars"), F.col("_n").alias("n_words"),
        (_occurrences("text", "\n") + 1.0).alias("n_lines"),
        (_occurrences("text", "[0-9]") / length).alias("digit_ratio"),
        (_occurrences("text", "[.,;:!?]") / length).alias("punct_ratio"),
        (F.size(F.array_distinct("_words")).cast("double")
         / F.greatest(F.col("_n"), F.lit(1.0))).alias("uniq_word_ratio"))
    return LabelledTable(frame, ("n_chars", "n_words", "n_lines", "digit_ratio", "punct_ratio",
                                 "uniq_word_ratio"), "doc_quality")


def page_urls(spark: SparkSession, folder: str) -> LabelledTable:
    """Page address and markup counts; label: not served over https."""
    pages = parquet_table(spark, folder, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    frame = pages.select(
        F.col("page_id").alias("id"), (~F.col("url").startswith("https://")).cast("int").alias("label"),
        F.length("url").cast("double").alias("url_length"),
        F.col("url").startswith("https://").cast("int").cast("double").alias("is_https"),
        F.greatest(F.regexp_count(host, F.lit("[.]")) - 1, F.lit(0)).cast("double").alias("n_subdomain"),
        host.rlike("^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$").cast("int").cast("double").alias("is_ip"),
        _occurrences("html", "<iframe").alias("n_iframe"),
        _occurrences("html", "window[.]open").alias("n_popup"),
        _occurrences("html", 'href="http').alias("external_refs"),
        _occurrences("html", 'href="/').alias("self_refs"),
        _occurrences("html", 'href="#').alias("empty_refs"),
        _occurrences("html", "<form").alias("n_form"),
        _occurrences("html", "<script").alias("n_script"),
        _occurrences("html", "<img").alias("n_img"))
    return LabelledTable(frame, ("url_length", "n_subdomain", "is_ip", "n_iframe", "n_popup",
                                 "external_refs", "self_refs", "empty_refs", "n_form", "n_script",
                                 "n_img"), "page_urls")


PROXY_STRENGTHS = {"proxy_05": 0.05, "proxy_25": 0.25, "proxy_50": 0.50}


def planted(spark: SparkSession, folder: str) -> LabelledTable:
    """Orders with columns whose leakage is known: the positive controls."""
    orders = parquet_table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    base = orders.select(F.col("o_orderkey").alias("id"),
                         (F.col("o_orderstatus") == "F").cast("int").alias("label"))

    def u(tag: str) -> Column:
        return uniform(tag, F.col("id"))

    negative = F.col("label") == 0
    columns = {
        "leak_point_mass": F.when(negative | (u("edge") < 0.0078), 100.0)
                            .otherwise(F.floor(u("mass") * 1000).cast("double") / 10.0),
        "leak_disjoint": F.floor(u("disjoint") * 50).cast("double") + F.when(negative, 50.0).otherwise(0.0),
        "overlap_strong": F.floor(u("overlap") * 60).cast("double") + F.when(negative, 40.0).otherwise(0.0),
        "noise": u("noise"),
    }
    for name, strength in PROXY_STRENGTHS.items():
        columns[name] = (F.when(u(f"{name}_reveal") < strength, F.col("label").cast("double"))
                          .otherwise(F.floor(u(f"{name}_coin") * 2).cast("double")))
    frame = base.select("id", "label", *[c.alias(n) for n, c in columns.items()])
    return LabelledTable(frame, tuple(columns), "planted")


# Concept, strength on side a, strength on side b.  A positive
# strength raises the count of a positive row, a negative one lowers it.
CONCEPT_STRENGTHS = {
    "address_length": (0.6, 0.5),
    "host_depth": (0.4, 0.3),
    "plain_host": (0.3, -0.4),
    "frame_use": (0.2, 0.0),
    "popup_use": (0.0, 0.0),
    "anchor_share": (0.7, -0.6),
    "form_target": (0.5, 0.2),
}


def concept_side(spark: SparkSession, folder: str, side: str) -> LabelledTable:
    """One of two collections over orders (even ids: a, odd ids: b) with label-linked counts."""
    position = {"a": 0, "b": 1}[side]
    base = (parquet_table(spark, folder, "orders")
            .filter(F.col("o_orderkey") % 2 == position)
            .select(F.col("o_orderkey").alias("id"),
                    (F.col("o_orderstatus") == "F").cast("int").alias("label")))
    columns = []
    for name, strengths in CONCEPT_STRENGTHS.items():
        s = strengths[position]
        shift = F.when((F.col("label") == (1 if s >= 0 else 0))
                       & (uniform(f"{name}_{side}_link", F.col("id")) < abs(s)), 40.0).otherwise(0.0)
        columns.append((F.floor(uniform(f"{name}_{side}", F.col("id")) * 60).cast("double") + shift).alias(name))
    frame = base.select("id", "label", *columns)
    return LabelledTable(frame, tuple(CONCEPT_STRENGTHS), f"concept_{side}")


def dup_events(spark: SparkSession, folder: str) -> LabelledTable:
    """Events on a coarse grid, so equal feature vectors and conflicting labels occur."""
    events = parquet_table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    frame = events.select(
        F.col("event_id").alias("id"), (F.col("event_type") == "error").cast("int").alias("label"),
        F.floor(F.col("value") / 50.0).cast("double").alias("value_band"),
        (k % 3).cast("double").alias("k_mod"), (F.col("user_id") % 4).cast("double").alias("user_mod"))
    return LabelledTable(frame, ("value_band", "k_mod", "user_mod"), "dup_events")


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as log lines of eight files: (file, line_no, text, ts)."""
    events = parquet_table(spark, folder, "events")
    return events.select(
        F.concat(F.lit("run_"), (F.col("user_id") % 8).cast("string"), F.lit(".log")).alias("file"),
        F.col("event_id").alias("line_no"),
        F.concat_ws(" | ", F.date_format("ts", "HH:mm:ss"), F.lit("INFO"),
                    F.concat(F.lit("job."), F.col("event_type")),
                    F.concat(F.lit("iter="), (F.col("event_id") % 100).cast("string"),
                             F.lit(" fit_centis="), F.round(F.col("value") * 100).cast("bigint").cast("string")))
         .alias("text"),
        "ts")


VIEWS = {
    "line_returned": line_returned,
    "order_status": order_status,
    "doc_quality": doc_quality,
    "planted": planted,
}
