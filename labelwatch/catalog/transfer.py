"""Registered queries: transfer, faithfulness, timing logs, reports."""

from functools import reduce

from pyspark.sql import functions as F

from labelwatch.catalog.leakage import tree_scores
from labelwatch.functions.numeric import d, r6
from labelwatch.operators import concepts, reporting, scoring, splitting, timing
from labelwatch.operators import transfer as tr
from labelwatch.session import settle
from labelwatch.sources import views as v
from labelwatch.sources.tables import local_table, parquet_table

SEEDS = (42, 43)


def sides(s, p):
    return v.concept_side(s, p, "a"), v.concept_side(s, p, "b")


def pol(s, p):
    return tr.polarity(*sides(s, p))


def mapping(s, p):
    mapped = local_table(s, [{"concept": c, "column_a": c, "column_b": c.upper(), "reason": "same quantity"}
                             for c in v.CONCEPT_STRENGTHS if c != "form_target"],
                         "concept string, column_a string, column_b string, reason string")
    rest = "column string, reason string"
    only_a = local_table(s, [{"column": "form_target", "reason": "no counterpart"}], rest)
    only_b = local_table(s, [{"column": "FORM_TARGET", "reason": "no counterpart"}], rest)
    return tr.concept_mapping_table(mapped, only_a, only_b, pol(s, p))


def lost_concepts(s, p):
    """Page concepts whose source columns survive: a column without variation counts as removed."""
    t = v.page_urls(s, p)
    rows = [{"concept": c, "feature": f} for c, (fs, _) in concepts.page_rules().items() for f in fs]
    sources = local_table(s, rows, "concept string, feature string")
    alive = t.long().groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).filter("lo < hi")
    return concepts.concept_loss(sources, alive)


def predictions(s, p, seeds=SEEDS):
    parts = []
    for seed in seeds:
        a, b = (splitting.stratified_split(t, seed) for t in sides(s, p))
        tables = {"a": a, "b": b}
        parts.append(tr.transfer_predictions(tables, {n: scoring.fit_linear(t) for n, t in tables.items()}, seed))
    return reduce(lambda x, y: x.unionByName(y), parts)


def matrix(s, p):
    pred, keys = predictions(s, p), ["direction", "seed"]
    base = scoring.majority_baseline(pred, keys).select(*keys, "majority_accuracy", "accuracy_above_majority")
    return scoring.score_predictions(pred, keys).join(base, keys)


def verdicts(s, p):
    means = matrix(s, p).groupBy("direction").agg(
        *[r6(F.avg(c)).alias(c) for c in ("accuracy_above_majority", "roc_auc", "mcc")])
    return tr.transfer_verdict(means)


def sufficiency(s, p, seeds=SEEDS):
    parts = []
    for seed in seeds:
        t = splitting.stratified_split(v.planted(s, p), seed)
        parts.append(tr.rule_sufficiency(t, scoring.fit_linear(t)).withColumn("seed", F.lit(seed)))
    return reduce(lambda x, y: x.unionByName(y), parts)


def injected(s, p):
    rows = tr.inject_feature(v.order_status(s, p), "totalprice")
    return rows.withColumn("pure_noise", r6("pure_noise"))


def ranks(s, p):
    return tr.injection_rank(v.order_status(s, p), "totalprice")


def pending(s, p):
    """Every order is a cell to run; those with lines are done."""
    wanted = parquet_table(s, p, "orders").select(F.col("o_orderkey").alias("cell"), F.lit(42).alias("seed"))
    stored = parquet_table(s, p, "lineitem").select(F.col("l_orderkey").alias("cell"), F.lit(42).alias("seed"))
    return splitting.resume_pending(wanted, stored, ["cell", "seed"])


def log_events(s, p):
    return timing.log_extract(v.event_log(s, p))


def dated(s, p):
    return timing.day_index(log_events(s, p))


OWN, COMPETING = "job.purchase", {"job.error": "errors", "job.signup": "signups"}


def windows(s, p):
    return timing.iteration_windows(dated(s, p), OWN)


def contended(s, p):
    events = dated(s, p)
    return timing.contention_join(timing.iteration_windows(events, OWN), events, COMPETING)


def loads(s, p):
    """View events as load samples; windows get the date of their completion."""
    events = dated(s, p)
    dates = events.select("file", "day", "line_no", F.date_format("ts", "yyyy-MM-dd").alias("date"))
    wins = timing.iteration_windows(events, OWN).join(dates, ["file", "day", "line_no"])
    samples = parquet_table(s, p, "events").filter("event_type = 'view'").select(
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("second"), F.col("value").alias("cpu"),
        (F.col("user_id") % 8).alias("n_procs"),
        F.when(F.col("user_id") % 3 == 0, "worker;train").when(F.col("user_id") % 3 == 1, "other").otherwise("search;train").alias("tags"))
    return timing.load_in_window(wins, samples)


def costs(s, p):
    clean = log_events(s, p).filter("logger = 'job.click' and fit_seconds >= 100").groupBy("file", "iteration").agg(
        F.min("fit_seconds").alias("clean_seconds"))
    return timing.cost_eligibility(contended(s, p), clean)


def profile(s, p):
    screening = log_events(s, p).filter("logger = 'job.view'").groupBy("file", "iteration").agg(
        F.max("fit_seconds").alias("seconds"))
    return timing.cost_profile(costs(s, p), screening)


def missing(s, p):
    expected = local_table(s, [{"table_name": f"t_{x}", "reason": f"no event of type {x} was logged"}
                               for x in ("click", "error", "refund", "view")], "table_name string, reason string")
    produced = parquet_table(s, p, "events").select(F.concat(F.lit("t_"), "event_type").alias("table_name"))
    return reporting.missing_tables(expected, produced)


def named(s, p):
    names = local_table(s, [{"key": "src0", "display": "Source Zero"}, {"key": "src1", "display": "Source One"},
                            {"key": "en", "display": "English"}, {"key": "fr", "display": "French"}], "key string, display string")
    docs = parquet_table(s, p, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(
            F.col("doc_id") % 3 == 1, F.concat("source", F.lit("->"), "lang")).otherwise(F.concat(F.lit("about "), "source")).alias("cell"))
    return reporting.display_names(docs, "cell", names)


QUERIES = {
    "polarity": pol,
    "directional_inconsistency": lambda s, p: tr.directional_inconsistency(pol(s, p)),
    "concept_mapping_table": mapping,
    "concept_loss": lost_concepts,
    "transfer_matrix": matrix,
    "transfer_summary": lambda s, p: tr.transfer_summary(settle(matrix(s, p)), n=1000),
    "transfer_verdict": verdicts,
    "rule_sufficiency": sufficiency,
    "faithfulness_summary": lambda s, p: tr.faithfulness_summary(sufficiency(s, p)),
    "inject_feature": injected,
    "injection_rank": ranks,
    "lowest_winning_strength": lambda s, p: tr.lowest_winning_strength(ranks(s, p)),
    "resume_pending": pending,
    "log_extract": lambda s, p: log_events(s, p).drop("ts"),
    "day_index": lambda s, p: dated(s, p).select("file", "line_no", "day", "second"),
    "iteration_windows": windows,
    "contention_join": lambda s, p: contended(s, p).select("file", "day", "line_no", "jobs"),
    "load_in_window": loads,
    "cost_eligibility": lambda s, p: costs(s, p).select(
        "file", "line_no", "iteration", "seconds", "remeasured_clean", "cache_replay", "contended", "eligible"),
    "eligibility_counts": lambda s, p: timing.eligibility_counts(costs(s, p)),
    "prefer_measured": lambda s, p: timing.prefer_measured(costs(s, p)).select("file", "iteration", "line_no", "seconds", "cache_replay"),
    "cost_profile": profile,
    "cost_curve": lambda s, p: timing.cost_curve(profile(s, p)),
    "top_features": lambda s, p: reporting.top_features(tree_scores(s, p), 15),
    "missing_tables": missing,
    "display_names": named,
    "sig_figs": lambda s, p: reporting.sig_figs(
        parquet_table(s, p, "part").select("p_partkey", (d("p_retailprice") * 12.3456789).alias("x")), ["x"], 4),
}
