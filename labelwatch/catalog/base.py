"""Registered queries: sources, label preparation, duplicates, splits."""

from pyspark.sql import functions as F

from labelwatch.functions.numeric import d, r6
from labelwatch.operators import concepts, duplicates, labels, profiling, splitting
from labelwatch.session import scratch_folder
from labelwatch.sources import views as v
from labelwatch.sources.tables import local_table, parquet_table, read_table, write_table

# Declared columns of the order table; the last one is never delivered.
ORDER_CATALOGUE = (
    ("o_orderkey", "ID", "Integer"), ("o_custkey", "ID", "Integer"), ("o_orderstatus", "Target", "Categorical"),
    ("o_totalprice", "Feature", "Continuous"), ("o_orderdate", "Feature", "Date"),
    ("o_clerk", "Other", "Categorical"))
STATUS_LABEL = {"F": 1, "O": 0, "P": 0}


def orders(s, p):
    return parquet_table(s, p, "orders")


def parquet_scan(s, p):
    li = parquet_table(s, p, "lineitem")
    return (li.filter(F.col("l_quantity") >= 45).groupBy("l_returnflag", "l_linestatus")
              .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("avg_discount")))


def csv_round_trip(s, p):
    """Write orders as CSV, read them back with a declared schema."""
    base = orders(s, p).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    back = write_table(base, f"{scratch_folder(s)}/orders", "csv")
    return back.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("max_price"))


def json_round_trip(s, p):
    base = parquet_table(s, p, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    back = write_table(base, f"{scratch_folder(s)}/customer", "json")
    return back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("min_balance"))


def table_sink(s, p):
    """Write a partitioned table through the commit protocol and read it back."""
    base = parquet_table(s, p, "events").select("event_id", "event_type", "user_id")
    back = write_table(base, f"{scratch_folder(s)}/events", partition_by=["event_type"])
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


def inventory(s, p):
    catalogue = local_table(s, [dict(zip(("column_name", "role", "declared_type"), r)) for r in ORDER_CATALOGUE],
                            "column_name string, role string, declared_type string")
    return profiling.feature_inventory(
        catalogue, orders(s, p), "o_orderstatus", ["o_totalprice", "o_orderdate"], "orders",
        {"o_orderkey": "row identifier", "o_custkey": "customer identifier"})


def harmonised(s, p):
    return labels.harmonise_labels(orders(s, p), "o_orderstatus", STATUS_LABEL).select("o_orderkey", "label")


def policy_rows(s, p):
    return labels.label_policy(orders(s, p), "o_orderstatus", "F", "P").select("o_orderkey", "policy", "label")


def shared_names(s, p):
    a, b = v.concept_side(s, p, "a"), v.concept_side(s, p, "b")
    loud = b.frame.select(*[F.col(f).alias(f.upper()) for f in b.features])
    return labels.shared_names(a.frame.select(*a.features), loud)


def page_concepts(s, p):
    return concepts.concept_project(v.page_urls(s, p).frame, concepts.page_rules())


def threshold_bins(s, p):
    pages = v.page_urls(s, p).frame
    return pages.select("id", "url_length", concepts.bin_length(F.col("url_length")).alias("length_bin"),
                        "n_subdomain", concepts.bin_depth(F.col("n_subdomain")).alias("depth_bin"))


def ratio_bins(s, p):
    pages = v.page_urls(s, p).frame
    parts = [F.col(c) for c in ("external_refs", "self_refs", "empty_refs")]
    return pages.select("id", r6(concepts.external_ratio(*parts)).alias("external_ratio"),
                        concepts.bin_ratio(*parts).alias("ratio_bin"))


# what documents and pages hold that an export should not: contacts, addresses, keys, trackers
PRIVATE = {
    "phone": r"[+][0-9]{1,3} [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}",
    "mailbox": r"[a-z0-9][a-z0-9._]*@mail[0-9]*[.][a-z.]+",
    "address": r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}",
    "access_key": r"AKIA[A-Z0-9]{12,}",
    "tracker": r"track[(][0-9]+[)]",
}


def forbidden(s, p):
    docs = concepts.forbidden_content_scan(parquet_table(s, p, "documents"), "doc_id", ["text"], "documents", PRIVATE)
    pages = concepts.forbidden_content_scan(parquet_table(s, p, "pages"), "page_id", ["url", "html"], "pages", PRIVATE)
    return docs.unionByName(pages)


def split_dups(s, p):
    return splitting.stratified_split(v.dup_events(s, p))


def scaled_summary(s, p, source=None):
    """Scaled values per (feature, split); train must come out at mean 0, std 1."""
    if source:
        fitted = splitting.scaler_table(splitting.stratified_split(v.concept_side(s, p, "a")))
        target = splitting.stratified_split(v.concept_side(s, p, "b"))
        rows = splitting.standard_scale(target, fitted)
    else:
        rows = splitting.standard_scale(splitting.stratified_split(v.line_returned(s, p)))
    return rows.groupBy("feature", "split").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("scaled")).alias("mean_scaled"),
        r6(F.stddev_pop("scaled")).alias("std_scaled"), r6(F.max("scaled")).alias("max_scaled"))


def scaler(s, p):
    fitted = splitting.scaler_table(splitting.stratified_split(v.line_returned(s, p)))
    return fitted.select("feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n_fit")


QUERIES = {
    "src_parquet": parquet_scan,
    "src_csv": csv_round_trip,
    "src_json": json_round_trip,
    "sink_table": table_sink,
    "dataset_profile": lambda s, p: profiling.dataset_profile(orders(s, p), "o_orderstatus", "orders"),
    "shape_check": lambda s, p: profiling.shape_check(parquet_table(s, p, "lineitem"), "lineitem", 60000, 10),
    "feature_inventory": inventory,
    "feature_inventory_counts": lambda s, p: profiling.inventory_counts(inventory(s, p)),
    "dataset_characteristics": lambda s, p: profiling.dataset_characteristics(
        [v.line_returned(s, p), v.order_status(s, p), v.dup_events(s, p)]),
    "harmonise_labels": harmonised,
    "label_report": lambda s, p: labels.label_report(orders(s, p), "o_orderstatus", STATUS_LABEL, 0.33, "orders"),
    "label_policy": policy_rows,
    "label_policy_report": lambda s, p: labels.label_policy_report(orders(s, p), "o_orderstatus", "F", "P"),
    "label_value_match": lambda s, p: labels.label_value_match(
        parquet_table(s, p, "events"), "event_type", "error").select("event_id", "label"),
    "drop_identifiers": lambda s, p: labels.drop_identifiers(
        parquet_table(s, p, "customer"), ["c_custkey"], keep=[]),
    "drop_report": lambda s, p: labels.drop_report(parquet_table(s, p, "customer"), ["c_custkey", "c_name"]),
    "select_features": lambda s, p: labels.select_features(
        v.order_status(s, p).frame, ["totalprice", "n_lines"]),
    "shared_names": shared_names,
    "concept_project": page_concepts,
    "bin_thresholds": threshold_bins,
    "ratio_bin": ratio_bins,
    "forbidden_content_scan": forbidden,
    "duplicate_audit": lambda s, p: duplicates.duplicate_audit(v.dup_events(s, p)),
    "dedup_keep_first": lambda s, p: duplicates.dedup_keep_first(v.dup_events(s, p)),
    "balance_shift": lambda s, p: duplicates.balance_shift(v.dup_events(s, p), 0.2),
    "train_twin_rate": lambda s, p: duplicates.train_twin_rate(split_dups(s, p)),
    "stratified_split": lambda s, p: splitting.stratified_split(v.line_returned(s, p)).frame.select("id", "label", "split"),
    "split_audit": lambda s, p: splitting.split_audit(splitting.stratified_split(v.line_returned(s, p))),
    "stratified_halves": lambda s, p: splitting.stratified_halves(v.order_status(s, p)).frame.select("id", "label", "half"),
    "stratified_sample": lambda s, p: splitting.stratified_sample(v.line_returned(s, p), 2000).frame.select("id", "label"),
    "background_sample": lambda s, p: splitting.background_sample(
        splitting.stratified_split(v.line_returned(s, p))).frame.select("id", "label"),
    "stratified_folds": lambda s, p: splitting.stratified_folds(v.order_status(s, p)).frame.select("id", "label", "fold"),
    "standard_scale": scaled_summary,
    "standard_scale_zero_shot": lambda s, p: scaled_summary(s, p, "a"),
    "scaler_table": scaler,
    "shared_distribution": lambda s, p: concepts.shared_distribution(
        [v.concept_side(s, p, "a"), v.concept_side(s, p, "b")]),
    "shared_distribution_pivot": lambda s, p: concepts.shared_distribution_pivot(
        [v.concept_side(s, p, "a"), v.concept_side(s, p, "b")]),
}
