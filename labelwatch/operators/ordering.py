"""Global order without a global sort in one task.

Four building blocks carry every ranked or cumulative computation of the
package.  Each one splits the order into as many parts as the session has
shuffle partitions (or a multiple of it), totals the parts and finishes
inside them, in one way at any size:

* ``hash_rank``   position of each row in digest order, per group
* ``hash_cuts``   digests at given ranks, for splits that need no position of each row (``seed_cuts``: for many seeds at once)
* ``cumulate``    running sums over the distinct values of each key
* ``mean_ranks``  tie-averaged ranks, from ``cumulate``
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwatch.functions.draws import DIGEST_BITS, digest
from labelwatch.session import shuffle_width, stored

# Digest buckets for each shuffle partition of the session: tasks take several, so they finish together.
BUCKETS_PER_PARTITION = 4
# Digest buckets for the ranks of single rows, and how many such ranks are looked up without ranking all rows.
CUT_BUCKETS, MAX_CUTS = 4096, 64


def hash_rank(df: DataFrame, group: Sequence[str], id_col: str, *tag: Column | str | int,
              rank: str = "rank", total: str | None = None) -> DataFrame:
    """Add the 1-based position of every row in digest order within its group.

    Digest prefixes are uniform whatever the data, so buckets never skew, and a
    group that holds a third of all rows is still spread over all of them. Their
    number follows the session's shuffle partitions; the ranks do not depend on it.
    """
    buckets = BUCKETS_PER_PARTITION * shuffle_width(df.sparkSession)
    prefix = F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint")
    keyed = (df.withColumn("_key", digest(*tag, F.col(id_col)))
               .withColumn("_bucket", F.shiftright(prefix * F.lit(buckets), 32)))
    keys = [*group, "_bucket"]
    sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket")
    whole = Window.partitionBy(*group)
    offsets = sizes.select(
        *keys,
        (F.sum("_n").over(before) - F.col("_n")).alias("_before"),
        F.sum("_n").over(whole).alias("_all"))
    inside = Window.partitionBy(*keys).orderBy("_key", id_col)
    # NULL is a group of its own: an ordinary join would lose its rows
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    offsets = offsets.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_before", "_all")
    ranked = keyed.withColumn("_pos", F.row_number().over(inside)).join(offsets, same)
    out = ranked.withColumn(rank, (F.col("_before") + F.col("_pos")).cast("bigint"))
    if total:
        out = out.withColumn(total, F.col("_all"))
    return out.drop("_key", "_bucket", "_pos", "_before", "_all", *[f"_of_{k}" for k in keys])


def hash_cuts(df: DataFrame, group: str, id_col: str, ranks: Mapping[str, Column], *tag: str | int) -> dict[str, dict] | None:
    """The digest of the row at each of some ranks of a group: {name: {group value: digest}}.

    A row's rank is at most that of the cut exactly if its digest is (``at_or_before``), so rows need no order to be told
    apart by rank. ranks: expressions over ``_total``, the rows of the group; a cut at rank 0 is left out. Rows are
    counted by digest prefix, and only those in a cut's bucket, one of ``CUT_BUCKETS``, are ordered. What reaches the
    driver is one digest for each group and cut.

    None where that does not do: several rows have the digest of a cut (ids repeat), or there are many groups.
    """
    prefix = F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint")
    keyed = df.select(F.col(group).alias("_of"), digest(*tag, F.col(id_col)).alias("_key")).withColumn(
        "_bucket", F.shiftright(prefix * F.lit(CUT_BUCKETS), 32))
    found = _keys_at(keyed, ["_of"], ranks, MAX_CUTS)
    if found is None:
        return None
    cuts: dict[str, dict] = {n: {} for n in ranks}
    for r, key in found:
        cuts[r["name"]][r["_of"]] = key
    return cuts


def seed_cuts(df: DataFrame, group: str, last: Column, keys: Mapping[int, str]) -> dict[int, dict] | None:
    """The key at rank ``last`` of a group for each of several seeds, in one pass: {seed: {group value: key}}.

    keys: for each seed the column of ``digest_long``. None as with ``hash_cuts``.
    """
    keyed = df.select(F.col(group).alias("_of"), F.inline(F.array(*[
        F.struct(F.lit(seed).alias("_seed"), F.col(c).alias("_key")) for seed, c in keys.items()]))).withColumn(
        "_bucket", F.shiftright("_key", DIGEST_BITS + 1 - CUT_BUCKETS.bit_length()))
    found = _keys_at(keyed, ["_seed", "_of"], {"cut": last}, MAX_CUTS * len(keys))
    if found is None:
        return None
    cuts: dict[int, dict] = {seed: {} for seed in keys}
    for r, key in found:
        cuts[r["_seed"]][r["_of"]] = key
    return cuts


def _keys_at(keyed: DataFrame, groups: Sequence[str], ranks: Mapping[str, Column], most: int) -> list[tuple] | None:
    """(wanted rank, ``_key`` at it) of each group of rows with ``_key`` and its ``_bucket``; None as in ``hash_cuts``."""
    sizes = keyed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole, before = Window.partitionBy(*groups), Window.partitionBy(*groups).orderBy("_bucket")
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.least(r, F.col("_total")).cast("bigint").alias("rank")) for n, r in ranks.items()])
    at = sizes.withColumns({"_total": F.sum("_n").over(whole), "_upto": F.sum("_n").over(before)}).select(
        *groups, "_bucket", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", F.inline(wanted)).filter(
        "rank > _before and rank <= _upto").limit(most + 1).collect()
    if len(at) > most:
        return None
    if not at:
        return []

    def inside(r) -> Column:
        return reduce(and_, [F.col(k).eqNullSafe(F.lit(r[k])) for k in groups]) & (F.col("_bucket") == r["_bucket"])

    order = Window.partitionBy(*groups, "_bucket").orderBy("_key")
    placed = keyed.filter(reduce(or_, map(inside, at))).select(
        "*", F.row_number().over(order).alias("_pos"), (F.lead("_key").over(order) == F.col("_key")).alias("_again"))
    here = reduce(or_, [inside(r) & (F.col("_pos") == r["rank"] - r["_before"]) for r in at])
    place = lambda r, pos: (*[r[k] for k in groups], r["_bucket"], pos)
    found = {place(r, r["_pos"]): r for r in placed.filter(here).collect()}
    rows = [(r, found[place(r, r["rank"] - r["_before"])]) for r in at]
    return None if any(row["_again"] for _, row in rows) else [(r, row["_key"]) for r, row in rows]


def at_or_before(cut: Mapping, group: str, key: str, least: str | int = "") -> Column:
    """Does a row with the digest ``key`` stand at or before its group's cut? least: below any key, for groups without a cut."""
    return F.col(key) <= F.coalesce(*[F.when(F.col(group).eqNullSafe(F.lit(g)), k) for g, k in cut.items()], F.lit(least))


def cumulate(counts: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str],
             parts: int | None = None) -> DataFrame:
    """Running sums of pre-aggregated measures over increasing ``value``.

    ``counts`` holds one row per (keys, value).  Adds ``cum_<measure>`` (rows at
    or below the value), ``all_<measure>`` and ``next_value``.  NULL keys are keys.

    A prefix scan in two levels: a range shuffle on keys and value deals the rows
    into ``parts`` contiguous parts (the session's shuffle partitions), stored once
    so that a part keeps its rows in every later branch and after a lost executor.
    Totals per part and key, no more rows than parts and keys together, become base
    rows; inside a part each base row stands before its key's own rows, so no join
    is needed and no task holds more than a part.
    """
    keys, spark = list(keys), counts.sparkSession
    dealt = counts.repartitionByRange(parts or shuffle_width(spark), *keys, value)
    placed = stored(dealt.withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy(*keys, "_part").agg(
        F.min(value).alias("_first"), *[F.sum(m).alias(f"_sum_{m}") for m in measures])
    by_part, whole = Window.partitionBy(*keys).orderBy("_part"), Window.partitionBy(*keys)
    bases = totals.select(
        *keys, "_part", F.lit(False).alias("_own"), F.lead("_first").over(by_part).alias("_following"),
        *[(F.sum(f"_sum_{m}").over(by_part) - F.col(f"_sum_{m}")).alias(f"_add_{m}") for m in measures],
        *[F.sum(f"_sum_{m}").over(whole).alias(f"all_{m}") for m in measures])
    own = placed.select("*", F.lit(True).alias("_own"), *[F.col(m).alias(f"_add_{m}") for m in measures])
    order = Window.partitionBy(*keys, "_part").orderBy("_own", value)
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return own.unionByName(bases, allowMissingColumns=True).select(
        *counts.columns, "_own",
        *[F.sum(f"_add_{m}").over(run).alias(f"cum_{m}") for m in measures],
        *[F.first(f"all_{m}").over(run).alias(f"all_{m}") for m in measures],
        F.coalesce(F.lead(value).over(order), F.first("_following").over(run)).alias("next_value"),
    ).filter("_own").drop("_own")


def mean_ranks(counts: DataFrame, keys: Sequence[str], value: str, n: str = "n",
               parts: int | None = None) -> DataFrame:
    """Tie-averaged rank of every distinct value: (rows below) + (own rows + 1) / 2."""
    run = cumulate(counts, keys, value, [n], parts)
    return run.withColumn(
        "mean_rank", (F.col(f"cum_{n}") - F.col(n)).cast("double")
        + (F.col(n).cast("double") + 1.0) / 2.0).drop(f"cum_{n}", f"all_{n}", "next_value")


def spearman(pairs: DataFrame, keys: Sequence[str], x: str, y: str, n: str | None = None,
             out: str = "rho") -> DataFrame:
    """Rank correlation per key; a side without spread gives 0.0.

    Equal (x, y) pairs collapse to one weighted row first, so a hot value costs
    one row per distinct partner instead of one per copy.
    """
    keys = list(keys)
    weight = F.sum(n) if n else F.count(F.lit(1))
    joint = stored(pairs.groupBy(*keys, x, y).agg(weight.cast("bigint").alias("_n")))  # read three times

    def ranks(v: str, name: str) -> DataFrame:
        counts = joint.groupBy(*keys, v).agg(F.sum("_n").alias("n"))
        return mean_ranks(counts, keys, v).select(
            *keys, v, F.col("mean_rank").alias(name))

    ranked = joint.join(ranks(x, "_rx"), [*keys, x]).join(ranks(y, "_ry"), [*keys, y])
    w, rx, ry = F.col("_n").cast("double"), F.col("_rx"), F.col("_ry")
    # The mean rank of N rows is (N + 1) / 2 with or without ties, so one pass suffices.
    sums = ranked.groupBy(*keys).agg(
        F.sum("_n").alias("_rows"),
        F.sum(w * rx * ry).alias("_xy"), F.sum(w * rx * rx).alias("_xx"),
        F.sum(w * ry * ry).alias("_yy"))
    rows = F.col("_rows").cast("double")
    centre = rows * (rows + 1.0) * (rows + 1.0) / 4.0
    vx, vy = F.col("_xx") - centre, F.col("_yy") - centre
    rho = F.when((vx > 0) & (vy > 0), (F.col("_xy") - centre) / F.sqrt(vx * vy)).otherwise(0.0)
    return sums.select(*keys, F.col("_rows").alias("n_rows"), rho.alias(out))


def spearman_binary(pairs: DataFrame, keys: Sequence[str], x: str, side: str, out: str = "rho",
                    parts: int | None = None) -> DataFrame:
    """Rank correlation of x with a side of 0 and 1, per key; no spread on either gives 0.0.

    The ranks of a 0/1 side take two values, so the correlation follows from the mean rank of
    the rows at 1: one prefix scan over distinct values and one sum, no join and no key of two
    values. Rows without a value or a side take no part.
    """
    keys, one = list(keys), F.col(side) == 1
    counts = pairs.filter(F.col(x).isNotNull() & F.col(side).isin(0, 1)).groupBy(*keys, x).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(one, 1)).alias("ones"))
    run = cumulate(counts, keys, x, ["n", "ones"], parts)
    n, ones, rows = F.col("n").cast("double"), F.col("ones").cast("double"), F.col("all_n").cast("double")
    # mean-centred rank of a value
    rank = F.col("cum_n").cast("double") - n + (n + 1.0) / 2.0 - (rows + 1.0) / 2.0
    sums = run.groupBy(*keys).agg(
        F.max("all_n").alias("n_rows"), F.max("all_ones").alias("_ones"),
        F.sum(ones * rank).alias("_above"), F.sum(n * rank * rank).alias("_spread"))
    n1 = F.col("_ones").cast("double")
    n0 = F.col("n_rows").cast("double") - n1
    rho = F.when((F.col("_spread") > 0) & (n0 > 0) & (n1 > 0),
                 F.col("_above") * F.sqrt(F.col("n_rows").cast("double")) / F.sqrt(F.col("_spread") * n0 * n1)).otherwise(0.0)
    return sums.select(*keys, F.col("n_rows").cast("double").alias("n_rows"), rho.alias(out))
