"""Document fingerprints by winnowing, in DataFrame functions only.

Units are words, those above 12 characters in parts of 12. A rolling polynomial hash modulo 2**31 - 1 covers
each ``K`` consecutive units; of each window of ``W`` hashes the smallest is chosen, the rightmost of equal
ones, and kept with its position. So two texts with W + K - 1 = 11 equal consecutive units share a chosen
hash (match guarantee), and nothing below K units is ever matched.

Hashes and minima are built by doubling: a pass over one array and its shifted copy doubles the span, so
each costs log2 passes and no array of arrays. A hash and its position share one long (hash above, inverted
position below), so the smallest long is the smallest hash at its rightmost place.
Units rather than single characters: a pass costs some 60 ns an element in the JVM, and there are six
characters to a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W = 4, 8
UNIT = r"[^\x20\x09-\x0D]{1,12}"
PRIME = (1 << 31) - 1
BASE = 1_000_003
LOW = (1 << 32) - 1
BUCKET_ROWS = 2_000
BROADCAST_ROWS = 100_000
CUTS = 500
SMALLEST = -(1 << 63)


def _shifted(name: str, by: int, step) -> Column:
    """step(element, element ``by`` places on); at the end the second is null."""
    return F.zip_with(F.col(name), F.slice(name, 1 + by, F.greatest(F.size(name), F.lit(1))), step)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the chosen longs of a text column; null and empty texts, and those without words, have none.

    Texts of fewer than K units have one hash of them all.
    """
    a, b, n = f"_{out}", f"_{out}_2", f"_{out}_n"
    df = df.withColumn(a, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))).withColumn(n, F.size(a))
    df = df.withColumn(a, F.when(F.col(n) < K, F.transform(F.filter(F.array(F.array_join(a, " ")), lambda x: x != ""), _unit))
                       .otherwise(F.transform(a, _unit)))
    # spans of 2, then of 4 = K units
    df = df.withColumn(b, F.when(F.col(n) < K, F.col(a)).otherwise(
        _shifted(a, 1, lambda x, y: (x * BASE + F.coalesce(y, F.lit(0))) % PRIME)))
    df = df.withColumn(a, F.when(F.col(n) < K, F.col(b)).otherwise(
        F.slice(_shifted(b, 2, lambda x, y: (x * (BASE * BASE % PRIME) + F.coalesce(y, F.lit(0))) % PRIME), 1, F.greatest(F.col(n) - K + 1, F.lit(0)))))
    df = df.withColumn(n, F.size(a))
    df = df.withColumn(a, F.transform(a, lambda x, i: F.shiftleft(x, 32) + (F.lit(LOW) - i)))
    # minima of 2, 4, 8 = W; shorter texts are one window
    df = df.withColumn(b, _shifted(a, 1, lambda x, y: F.least(x, y)))
    df = df.withColumn(a, _shifted(b, 2, lambda x, y: F.least(x, y)))
    df = df.withColumn(b, _shifted(a, 4, lambda x, y: F.least(x, y)))
    chosen = F.slice(b, 1, F.when(F.col(n) < W, F.least(F.col(n), F.lit(1))).otherwise(F.col(n) - W + 1))
    return df.withColumn(out, F.array_distinct(chosen)).drop(a, b, n)


def _unit(x: Column) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(PRIME))


def _written_out(name: str) -> Column:
    """hash:position of each chosen hash, in text order."""
    one = F.transform(name, lambda x: F.concat(F.hex(F.shiftright(x, 32)), F.lit(":"), F.lit(LOW) - x.bitwiseAND(F.lit(LOW))))
    return F.array_join(one, ",")


def _likeness(a: str, b: str) -> Column:
    """Shared chosen hashes over all of them; 1 for two empty fingerprints, 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _bucketed(df: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """df with _order, _cut and _bucket, the smallest _order of each bucket, and a bound on the number of buckets.

    Quantiles of doc_id cut the rows into at most ``CUTS`` ranges, each range into buckets of equal width for some
    ``BUCKET_ROWS`` rows each, so a doc_id far from all others widens the buckets of its own range only. The
    steps are in doubles and keep the order; rows of one doc_id share a bucket. A null doc_id is the smallest.
    """
    df = df.withColumn("_order", F.coalesce("doc_id", F.lit(SMALLEST).cast("long")))
    n = df.count()
    cuts = min(CUTS, n // BUCKET_ROWS)
    points = [i / cuts for i in range(1, cuts)]
    bounds = df.agg(F.percentile_approx("_order", points, 10 * cuts)).first()[0] if points else []
    at = F.array(*[F.lit(x).cast("long") for x in sorted(set(bounds))]) if bounds else F.array().cast("array<long>")
    df = df.withColumn("_cut", F.size(F.filter(at, lambda x: x <= F.col("_order"))))
    ranges = df.groupBy("_cut").agg(F.min("_order").alias("_low"), F.max("_order").alias("_high"), F.count("*").alias("_n")).collect()
    # a low end and a width for each range, as arrays of at most CUTS numbers
    low, width = [0.0] * (len(set(bounds)) + 1), [1.0] * (len(set(bounds)) + 1)
    for r in ranges:
        low[r._cut] = float(r._low)
        width[r._cut] = max(1.0, (r._high - r._low) / max(1, r._n // BUCKET_ROWS))

    def of(values: list[float]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("_cut") + 1)

    df = df.withColumn("_bucket", F.floor((F.col("_order").cast("double") - of(low)) / of(width)))
    return df, df.groupBy("_cut", "_bucket").agg(F.min("_order").alias("_order")), sum(r._n // BUCKET_ROWS + 1 for r in ranges)


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with next_<column> of the row with the next larger doc_id; the last row gets the first one's.

    Rows are bucketed by doc_id, so no task sorts all of them; the first row of each bucket is also sent to the
    bucket before. Rows with one doc_id follow each other in order of their first column, null doc_ids come first.
    """
    names = df.columns
    df, firsts, buckets = _bucketed(df)
    # the bucket before: in the same range, else the last one of the range before, else the last of all
    ends = firsts.groupBy("_cut").agg(F.max("_bucket").alias("_last"))  # at most CUTS rows
    order, back = Window.orderBy("_cut"), Window.orderBy(F.col("_cut").desc())
    before = F.struct("_cut", F.col("_last").alias("_bucket"))
    ends = ends.select("_cut", F.coalesce(F.lag(before).over(order), F.first(before).over(back)).alias("_before"))
    own = F.lag(F.struct("_cut", "_bucket")).over(Window.partitionBy("_cut").orderBy("_bucket"))
    firsts = firsts.withColumn("_own", own).join(F.broadcast(ends), "_cut").select("_order", F.coalesce("_own", "_before").alias("_to"))
    heads = df.join(F.broadcast(firsts) if buckets <= BROADCAST_ROWS else firsts, "_order")
    heads = heads.withColumns({"_cut": F.col("_to._cut"), "_bucket": F.col("_to._bucket"), "_head": F.lit(True)})
    every = df.withColumn("_head", F.lit(False)).unionByName(heads.select(*df.columns, "_head"))
    # the head sent here sorts behind the bucket's own rows; in the last bucket it is the table's first row
    own = Window.partitionBy("_cut", "_bucket").orderBy("_head", "_order", columns[0])
    return (every.withColumns({f"next_{c}": F.lead(c).over(own) for c in columns})
            .filter(~F.col("_head")).select(*names, *[f"next_{c}" for c in columns]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and text with the fingerprint (array of longs) of every whole text, null as empty."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return with_fingerprint(docs, "text", "chosen")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text, of its edited text, and the likeness to that and to the next document's.

    The edited text has the last floor(n_chars / 2) code points replaced by as many first ones of the next
    document (all, if it is shorter). docs: doc_id, text; other columns are not read. A single document is its
    own next. Copies with one doc_id follow each other, rows without one come first. An empty table gives an empty result.
    """
    df = with_next(fingerprints(docs), ["text", "chosen"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    df = df.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))).drop("text", "next_text")
    df = with_fingerprint(df, "edited", "edited_chosen")
    hashes = {f"_h{i}": F.array_distinct(F.transform(c, lambda x: F.shiftright(x, 32)))
              for i, c in enumerate(("chosen", "edited_chosen", "next_chosen"))}
    return df.withColumns(hashes).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        _written_out("chosen").alias("fingerprint"), _written_out("edited_chosen").alias("edited_fingerprint"),
        _likeness("_h0", "_h1").alias("near_edited"), _likeness("_h0", "_h2").alias("near_next"))
