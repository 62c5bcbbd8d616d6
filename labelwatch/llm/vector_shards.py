"""Shards of equal bytes, tokens and rows by vector bin packing.

A group (all rows of one text) is placed where the dot product of its vector (bytes, tokens, rows as shares
of the totals) with the residual capacity is highest. At most 3 * shards * 512 groups hold over
1 / (shards * 512) of some total; they are placed one by one. All lighter groups are hashed into 4096 batches
that are placed as wholes. So what the driver places is bounded whatever the input, and every group stays in
one shard, but for a group above half a shard: no placing could level that, so it is split by hash of doc_id.
Then items move or swap between the fullest and the emptiest shard as long as that levels their bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelwatch.llm.blocks import written

SHARDS, HEAVY, BATCHES = 8, 512, 4096
BUCKET_ROWS = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; items: shares of bytes, tokens, rows, one row each."""
    room = np.full((shards, items.shape[1]), 1.0 / shards)
    shard = np.zeros(len(items), np.int64)
    for i in np.argsort(-items.max(1), kind="stable"):
        shard[i] = int(np.argmax(room @ items[i]))
        room[shard[i]] -= items[i]
    return _levelled(items[:, 0], shard, shards)


def _levelled(bytes_: np.ndarray, shard: np.ndarray, shards: int, rounds: int = 2000) -> np.ndarray:
    """Move or swap items between the fullest and the emptiest shard while their difference shrinks."""
    for _ in range(rounds):
        load = np.bincount(shard, weights=bytes_, minlength=shards)
        full, empty = int(load.argmax()), int(load.argmin())
        gap = load[full] - load[empty]
        mine, theirs = np.flatnonzero(shard == full), np.flatnonzero(shard == empty)
        if not len(mine):
            break
        theirs = theirs[np.argsort(bytes_[theirs], kind="stable")]
        options = np.concatenate([[0.0], bytes_[theirs]])  # 0: nothing comes back
        goal = bytes_[mine] - gap / 2
        at = np.clip(np.searchsorted(options, goal), 0, len(options) - 1)
        at = np.where((at > 0) & (np.abs(options[at - 1] - goal) < np.abs(options[at] - goal)), at - 1, at)
        left = np.abs(gap - 2 * (bytes_[mine] - options[at]))
        best = int(left.argmin())
        if left[best] >= gap * (1 - 1e-9):
            break
        shard[mine[best]] = empty
        if at[best]:
            shard[theirs[at[best] - 1]] = full
    return shard


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) of every document.

    docs: doc_id, text; other columns are not read. size is the UTF-8 bytes of the text (null: none) plus 1.
    Null texts form one group, apart from empty texts. slot counts from 0 without gaps in each shard, by bucket
    and doc_id. With fewer groups than shards some shards stay empty. An empty table gives an empty result.
    """
    text = F.col("text")
    rows = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).alias("tokens"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("null")).alias("key")))
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.sum(F.lit(1)).alias("r")]
    total = rows.agg(*sums).first()
    if not total.r:
        return _slotted(rows.withColumn("shard", F.lit(0)), 1)
    scale = [total.b, max(total.t, 1), total.r]
    most = F.greatest(F.col("b") / scale[0], F.col("t") / scale[1], F.col("r") / scale[2])
    groups = written(rows.groupBy("key").agg(*sums).withColumn("most", most))
    # at most 6 * shards groups are split
    spark = docs.sparkSession
    split = [(r.key, int(np.ceil(r.most * shards * 8))) for r in groups.filter(F.col("most") > 0.5 / shards).collect()]
    if split:
        parts = spark.createDataFrame(split, "key string, parts int")
        rows = rows.join(F.broadcast(parts), "key", "left").withColumn("key", F.when(F.col("parts").isNull(), F.col("key")).otherwise(
            F.concat("key", F.lit("/"), F.expr("pmod(xxhash64(doc_id), parts)")))).drop("parts")
        groups = rows.groupBy("key").agg(*sums).withColumn("most", most)
    heavy = F.col("most") > 1.0 / (shards * HEAVY)
    batch = F.concat(F.lit("batch "), F.pmod(F.xxhash64("key"), F.lit(BATCHES)))
    items = (groups.withColumn("item", F.when(heavy, F.col("key")).otherwise(batch)).groupBy("item")
             .agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("r").alias("r")).orderBy("item").collect())
    shard = place(np.array([[r.b, r.t, r.r] for r in items], float) / scale, shards)
    placed = spark.createDataFrame([(r.item, int(s)) for r, s in zip(items, shard)], "item string, shard int")
    alone = placed.filter("item not like 'batch %'").select(F.col("item").alias("key"), F.col("shard").alias("own"))
    rest = placed.filter("item like 'batch %'")
    out = (rows.join(F.broadcast(alone), "key", "left").withColumn("item", batch).join(F.broadcast(rest), "item", "left")
           .withColumn("shard", F.coalesce("own", "shard")))
    return _slotted(out, max(1, total.r // BUCKET_ROWS))


def _slotted(rows: DataFrame, buckets: int) -> DataFrame:
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(buckets)))
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("c"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("_nth", F.row_number().over(own) - 1).join(offsets, ["shard", "_bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("_nth") + F.col("_before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
