"""Timing logs: which measured costs are clean, and what their curve looks like."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwatch.functions.numeric import count_if, d, r6, ratio
from labelwatch.operators.duplicates import prefer_first

LINE_BLOCK = 1 << 16
SLOT_SECONDS = 600
CACHE_REPLAY_SECONDS = 1.0
SETUP_SECONDS = 30
PLATEAU_SPREAD = 0.10
IGNORED_TAGS = ("", "other", "worker")


def seconds_of_day(clock: str) -> Column:
    part = F.split(clock, ":")
    return (part[0].cast("int") * 3600 + part[1].cast("int") * 60 + part[2].cast("int")).cast("int")


def log_extract(lines: DataFrame) -> DataFrame:
    """(file, line_no, clock, logger, iteration, fit_seconds); lines of another shape are left out."""
    shape = r"^([0-9]{2}:[0-9]{2}:[0-9]{2}) [|] [A-Z]+ [|] ([A-Za-z_.]+) [|] (.*)$"
    body = F.regexp_extract("text", shape, 3)
    return (lines.filter(F.col("text").rlike(shape)).select(
        *[c for c in lines.columns if c != "text"], F.regexp_extract("text", shape, 1).alias("clock"),
        F.regexp_extract("text", shape, 2).alias("logger"),
        F.regexp_extract(body, r"iter=([0-9]+)", 1).try_cast("int").alias("iteration"),
        (F.regexp_extract(body, r"fit_centis=([0-9]+)", 1).try_cast("double") / 100.0).alias("fit_seconds")))


def day_index(events: DataFrame) -> DataFrame:
    """Adds ``day``: the clock running backwards within a file starts a new day.

    Lines are processed in blocks of consecutive numbers, so one huge file is
    many tasks; the block table (first and last clock, falls inside) carries the
    day from block to block.
    """
    timed = events.withColumn("_sec", seconds_of_day("clock")).withColumn(
        "_block", F.floor(F.col("line_no") / LINE_BLOCK))
    inside = Window.partitionBy("file", "_block").orderBy("line_no")
    fell = F.coalesce((F.col("_sec") < F.lag("_sec").over(inside)).cast("int"), F.lit(0))
    marked = timed.withColumn("_fell", fell).withColumn("_local", F.sum("_fell").over(inside))
    ends = marked.groupBy("file", "_block").agg(
        F.min(F.struct("line_no", "_sec"))["_sec"].alias("_first"), F.max(F.struct("line_no", "_sec"))["_sec"].alias("_last"),
        F.sum("_fell").alias("_falls"))
    run = Window.partitionBy("file").orderBy("_block")
    jump = F.coalesce((F.col("_first") < F.lag("_last").over(run)).cast("int"), F.lit(0))
    base = (ends.withColumn("_jump", jump)
                .withColumn("_base", F.sum(F.col("_falls") + F.col("_jump")).over(run) - F.col("_falls"))
                .select("file", "_block", "_base"))
    return (marked.join(base, ["file", "_block"])
            .withColumn("day", (F.col("_base") + F.col("_local")).cast("int"))
            .withColumn("second", F.col("_sec")).drop("_sec", "_block", "_fell", "_local", "_base"))


def iteration_windows(events: DataFrame, logger: str) -> DataFrame:
    """Window of each iteration: previous completion of the day to its own.

    The first of a day has no predecessor; its start is rebuilt from its own
    measured duration plus a fixed set-up time.
    """
    own = events.filter(F.col("logger") == logger)
    before = Window.partitionBy("file", "day").orderBy("line_no")
    rebuilt = F.greatest(F.col("second") - (F.ceil("fit_seconds") + SETUP_SECONDS), F.lit(0))
    previous = F.lag("second").over(before)
    return own.select(
        "file", "day", "line_no", "iteration", "fit_seconds", F.coalesce(previous, rebuilt).cast("int").alias("start"),
        F.col("second").alias("end"), previous.isNull().alias("window_reconstructed"))


def _in_slots(windows: DataFrame) -> DataFrame:
    slots = F.sequence(F.floor(F.col("start") / SLOT_SECONDS), F.floor(F.col("end") / SLOT_SECONDS))
    return windows.withColumn("_slot", F.explode(slots))


def contention_join(windows: DataFrame, events: DataFrame, competing: Mapping[str, str]) -> DataFrame:
    """Adds the distinct competing jobs active inside each window.

    An interval join over (file, day, ten-minute slot).  Events collapse to
    distinct seconds per job first, which bounds every slot whatever the volume.
    """
    pairs = [F.lit(x) for kv in competing.items() for x in kv]
    jobs = (events.filter(F.col("logger").isin(*competing))
            .select("file", "day", "second", F.create_map(*pairs)[F.col("logger")].alias("job")).distinct()
            .withColumn("_slot", F.floor(F.col("second") / SLOT_SECONDS)))
    keys = ["file", "day", "line_no"]
    hits = _in_slots(windows.select(*keys, "start", "end")).join(jobs, ["file", "day", "_slot"]).filter(
        (F.col("second") >= F.col("start")) & (F.col("second") <= F.col("end")))
    # bounded: the set holds names of competing jobs
    found = hits.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("job")), ";").alias("jobs"))
    return windows.join(found, keys, "left").withColumn("jobs", F.coalesce("jobs", F.lit("")))


def load_in_window(windows: DataFrame, samples: DataFrame) -> DataFrame:
    """Sampled load within windows (file, day, line_no, date, start, end): one row for each window.

    Samples are (date, second, cpu, n_procs, tags); a window without a date or
    a sample has n_samples 0 and NULL elsewhere.  Samples of one second are summed up before the join.
    """
    per_second = samples.groupBy("date", "second").agg(
        F.sum(F.round(d("cpu") * 100).cast("bigint")).alias("cents"), F.max("cpu").alias("cpu_max"),
        F.max("n_procs").alias("procs_max"), F.count(F.lit(1)).alias("n"),
        # bounded: distinct tag strings of one second
        F.array_distinct(F.flatten(F.collect_set(F.split("tags", ";")))).alias("tag_set")
    ).withColumn("_slot", F.floor(F.col("second") / SLOT_SECONDS))
    keys = ["file", "day", "line_no"]
    hits = _in_slots(windows.filter("date is not null").select(*keys, "date", "start", "end")).join(
        per_second, ["date", "_slot"]).filter((F.col("second") >= F.col("start")) & (F.col("second") <= F.col("end")))
    tags = F.array_sort(F.array_except(F.array_distinct(F.flatten(F.collect_set("tag_set"))),
                                       F.array(*[F.lit(t) for t in IGNORED_TAGS])))
    found = hits.groupBy(*keys).agg(
        # exact half-up rounding on integer hundredths: the order of summation cannot show
        (F.floor(d(2 * F.sum("cents") + F.sum("n")) / d(2 * F.sum("n"))) / 100.0).alias("cpu_mean"), F.max("cpu_max").alias("cpu_max"),
        F.max("procs_max").alias("procs_max"), F.sum("n").alias("n_samples"), F.array_join(tags, ";").alias("tags"))
    return (windows.select(*keys).join(found, keys, "left")
            .withColumn("n_samples", F.coalesce("n_samples", F.lit(0).cast("bigint"))))


def cost_eligibility(windows: DataFrame, remeasured: DataFrame) -> DataFrame:
    """A cache replay is no timing and a contended run times the wrong thing; a clean re-measurement overrides both.

    ``remeasured`` is (file, iteration, clean_seconds), one row per iteration.
    """
    joined = windows.join(remeasured, ["file", "iteration"], "left")
    clean = F.col("clean_seconds").isNotNull()
    seconds = F.coalesce("clean_seconds", "fit_seconds")
    replay = ~clean & (F.col("fit_seconds") < CACHE_REPLAY_SECONDS)
    contended = ~clean & (F.col("jobs") != "")
    return joined.select(
        *windows.columns, seconds.alias("seconds"), clean.alias("remeasured_clean"), replay.alias("cache_replay"),
        contended.alias("contended"), (~replay & ~contended).alias("eligible"))


def eligibility_counts(costs: DataFrame) -> DataFrame:
    return costs.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_iterations"), count_if(F.col("cache_replay")).alias("n_cache_replay"),
        count_if(F.col("contended")).alias("n_contended"), count_if(F.col("eligible")).alias("n_eligible"))


def prefer_measured(costs: DataFrame) -> DataFrame:
    """One row per (file, iteration): a measurement before a replay, then the earliest line."""
    return prefer_first(costs, ["file", "iteration"], ["cache_replay", "line_no"])


def cost_profile(costs: DataFrame, screening: DataFrame) -> DataFrame:
    """The preferred row per iteration plus screening rows, whose eligibility is not assessed (NULL)."""
    own = prefer_measured(costs).select("file", "iteration", "seconds", "eligible", F.lit("log").alias("source"))
    return own.unionByName(screening.withColumn("source", F.lit("screening")), allowMissingColumns=True)


def cost_curve(profile: DataFrame) -> DataFrame:
    """Shape of the eligible costs over iterations: fold range, falling steps, plateau.

    One row per (file, iteration) goes in, so a window holds one curve. A file
    with fewer than three eligible iterations keeps its row: its count, the
    full range, a note, and NULL for the shape.
    """
    eligible = profile.filter("source = 'log' and eligible")
    w = Window.partitionBy("file").orderBy("iteration")
    steps = eligible.select("file", "iteration", "seconds",
                            (F.col("seconds") < F.lag("seconds").over(w)).alias("falls"),
                            F.row_number().over(Window.partitionBy("file").orderBy(F.desc("iteration"))).alias("from_end"))
    tail = F.when(F.col("from_end") <= 3, F.col("seconds"))
    got = steps.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_eligible"), F.min("seconds").alias("seconds_min"), F.max("seconds").alias("seconds_max"),
        count_if(F.col("falls")).alias("n_decreasing_steps"), (F.max(tail) - F.min(tail)).alias("_span"), F.max(tail).alias("_high"))
    everything = profile.filter("source = 'log'").groupBy("file").agg(
        r6(ratio(F.max("seconds"), F.min("seconds"), None)).alias("fold_full_range_lower_bound"))
    spread = F.when(F.col("_high").isNotNull(), ratio("_span", "_high"))
    shape = ["seconds_min", "seconds_max", "n_decreasing_steps", "_span", "_high"]
    enough = got.select("file", "n_eligible", *[F.when(F.col("n_eligible") >= 3, F.col(c)).alias(c) for c in shape])
    few = F.coalesce("n_eligible", F.lit(0)) < 3
    return everything.join(enough, "file", "left").select(
        "file", F.coalesce("n_eligible", F.lit(0).cast("bigint")).alias("n_eligible"), "seconds_min", "seconds_max",
        r6(ratio("seconds_max", "seconds_min", None)).alias("fold"),
        "fold_full_range_lower_bound", "n_decreasing_steps", (F.col("n_decreasing_steps") == 0).alias("monotonic"),
        r6(spread).alias("tail_spread"), (spread < PLATEAU_SPREAD).alias("plateau"),
        F.when(few, "fewer than 3 eligible iterations").alias("note"))
