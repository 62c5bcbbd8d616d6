"""N-gram Jaccard self-join by token-combination prefixes.

Tokens are the hashes of a document's distinct word shingles. Counts over all documents are kept for 2**18
slots of token hashes; the global order is by slot count, then hash, so rare tokens come first. Tokens of
slots with over twice the mean count are frequent: rare ones sign alone, frequent ones sign in pairs. Frequent tokens are dealt into
groups by hash, so a document of n tokens has O(n) pairs; groups follow the size label of a document.
A linked pair differs in size by 1/threshold at most, so it shares one of the two labels each side signs.

Prefix: x may miss |x| - o tokens of a partner, o = ceil(threshold * |x|). Its prefix is extended until
rare tokens + sum over groups of (frequent tokens - 1) exceeds |x| - o. Then of two linked documents the
one whose prefix ends first shares a rare token or two frequent tokens of one group with the other, inside
both prefixes. So no link is lost.

Components without all pairs: within a signature each document is verified against the first and the
previous one (a linear number of pairs), links are contracted, and then every candidate pair whose ends
are still in different components is verified. Pairs left out lie inside one component.
Verification: bitmaps of two bits a token give an upper bound of what two sets share (a bit of one that the other
lacks stands for a token it lacks). Only pairs whose bound reaches the threshold send their whole sets.
Which documents are needed goes to the tasks as 2**26 bits by hash of doc_id, so no text is shuffled; sets that only share a
bit with a needed one find no partner in the join that follows. Exact copies are one node. These bits and the slot counts,
2**18 numbers, are all that reaches the driver, at any input size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelwatch.llm.blocks import (U, dropped, gram_hashes, mix, slices, span_hash, strings, word_bounds, word_hashes,
                                   written)

WORDS, PERCENT = 5, 80
SLOTS = 1 << 18
PER_GROUP = 4
ID_SLOTS, PART_BYTES = 1 << 26, 4096  # bits of the mark on doc_ids; bytes of one of Spark's bitmaps
SMALL = 20  # sets below this size sign single tokens only

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _token_sets(part: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Row, sorted distinct shingle hashes and digest of the word sequence of each text."""
    data, offsets = strings(part.column("text"))
    data = _LOWER[data]
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    grams = gram_hashes(words, k)
    for row, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
        if a == b:
            yield row, grams[:0], b""
            continue
        found = np.unique(grams[a: b - k + 1]) if b - a >= k else span_hash(words, np.array([a]), np.array([b]))
        yield row, found, hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest()


def bitmap(found: np.ndarray) -> bytes:
    """One to two bits for each token of a set, addressed by the low bits of its hash."""
    size = 1 << max(3, len(found).bit_length())
    flags = np.zeros(size, bool)
    flags[(found & U(size - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, size), 0)


def _can_link(percent: int):
    """Pairs whose bitmaps leave room for enough common tokens; sizes n_a, n_b and bitmaps x, y."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sizes = zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist())
            for i, (x, y, (n_a, n_b)) in enumerate(zip(batch.column("x"), batch.column("y"), sizes)):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                x, y = _fold(x, size), _fold(y, size)
                most = min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))
                keep[i] = 100 * most >= percent * (n_a + n_b - most)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return run


def _described(k: int):
    """Per document its set size, digest and bitmap; per task the number of tokens in each slot."""
    names = ["doc_id", "n", "digest", "bits", "slot", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in slices(batch):
                sizes, digests, bits = [], [], []
                for _, found, digest in _token_sets(part, k):
                    slots += np.bincount((found & U(SLOTS - 1)).astype(np.int64), minlength=SLOTS) if len(found) > 5000 else 0
                    if len(found) <= 5000:
                        np.add.at(slots, (found & U(SLOTS - 1)).astype(np.int64), 1)
                    sizes.append(len(found))
                    digests.append(digest)
                    bits.append(bitmap(found))
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(bits, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=names)
        used = np.flatnonzero(slots)
        n = len(used)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
             pa.array(used.astype(np.int32)), pa.array(slots[used])], names=names)
    return run


def signatures(found: np.ndarray, counts: np.ndarray, percent: int = PERCENT):
    """Of one token set: signatures, which of them are single rare tokens, and whether all its rare tokens sign."""
    n = len(found)
    if not n:
        return found, np.zeros(0, bool), False
    need = n - -(-percent * n // 100) + 1
    own_count = counts[(found & U(SLOTS - 1)).astype(np.int64)]
    order = np.lexsort((found, own_count))
    found, flags = found[order], own_count[order] > 2 * counts.mean() + 32
    step = math.log(100 / percent) if percent < 100 else math.inf
    label = int(math.log(n) / step)
    alone, pairs = np.zeros(n, bool), [found[:0]]
    for own in (label, label + 1):
        size = math.exp(own * step) if own else 1.0
        if size < SMALL or not flags[:need].any():
            alone[:need] = True
            continue
        groups = max(1, round(size * (100 - percent) / 100 / PER_GROUP))
        group = (mix(found + U(own)) % U(groups)).astype(np.int64)
        paired = np.flatnonzero(flags)
        paired = paired[np.argsort(group[paired], kind="stable")]
        opens = np.ones(len(paired), bool)
        opens[1:] = group[paired[1:]] != group[paired[:-1]]
        worth = np.ones(n, np.int64)
        worth[paired[opens]] = 0  # the first of a group pairs with none before it
        end = int(np.searchsorted(np.cumsum(worth), need)) + 1
        if end > n:  # the group number keeps this from happening for sizes of 20 and more
            raise ValueError("a prefix cannot reach its length")
        alone[:end] |= ~flags[:end]
        inside = paired[paired < end]
        with np.errstate(over="ignore"):
            for lag in range(1, len(inside)):
                a, b = inside[:-lag], inside[lag:]
                same = group[a] == group[b]
                if not same.any():
                    break
                pairs.append(mix(found[a[same]] * U(3) + mix(found[b[same]]) + U(own)))
    pairs = np.unique(np.concatenate(pairs))
    rare = np.concatenate([~flags[alone], np.zeros(len(pairs), bool)])
    return np.concatenate([found[alone], pairs]), rare, int(np.count_nonzero(~flags)) < need


def _signed(k: int, percent: int, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            for part in slices(batch):
                ids = part.column("doc_id").to_pylist()
                sigs, docs, sizes, alone, one, deep = [], [], [], [], [], []
                for row, found, digest in _token_sets(part, k):
                    if not len(found) or digest in seen:  # a copy in the batch is represented already
                        continue
                    seen.add(digest)
                    signed, rare, all_rare = signatures(found, counts, percent)
                    total = len(signed)
                    sigs.append(signed)
                    one.append(rare)
                    docs.append(np.full(total, ids[row], np.int64))
                    sizes.append(np.full(total, len(found), np.int32))
                    alone.append(np.full(total, int(rare.sum()), np.int32))
                    deep.append(np.full(total, all_rare))
                if sigs:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(docs)),
                         pa.array(np.concatenate(sizes)), pa.array(np.concatenate(alone)), pa.array(np.concatenate(one)), pa.array(np.concatenate(deep))],
                        names=["sig", "doc_id", "n", "alone", "one", "deep"])
    return run


def id_slots(ids: np.ndarray) -> np.ndarray:
    """Numbers below ID_SLOTS, by hash."""
    return (mix(ids.astype(np.int64).view(U)) & U(ID_SLOTS - 1)).astype(np.int64)


def marked(ids: DataFrame) -> np.ndarray:
    """ID_SLOTS bits, 8 MB at any input size, in which those of doc_id in ids are set; tasks mark, the driver unites."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Spark's bitmaps count from 1
            yield pa.RecordBatch.from_arrays([pa.array(id_slots(batch.column("doc_id").to_numpy()) + 1)], names=["slot"])

    slots = ids.mapInArrow(run, "slot long")
    parts = slots.groupBy(F.expr("bitmap_bucket_number(slot)").alias("part")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")).toArrow()
    flags = np.zeros(ID_SLOTS // 8, np.uint8)
    for part, bits in zip(parts.column("part").to_pylist(), parts.column("bits").to_pylist()):
        at = (part - 1) * PART_BYTES
        flags[at: at + PART_BYTES] = np.frombuffer(bits, np.uint8)
    return flags


def _sets(k: int, flags: np.ndarray):
    """Token sets of the marked documents and of the few that share a bit with one; others leave no row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = id_slots(batch.column("doc_id").to_numpy())
            batch = batch.filter(pa.array((flags[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))
            for part in slices(batch):
                found = [f.tobytes() for _, f, _ in _token_sets(part, k)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.binary())],
                                                 names=["doc_id", "tokens"])
    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int(np.count_nonzero(y[at] == x))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return run


def verified(docs: DataFrame, meta: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The linked ones of candidate pairs (a, b), as a written table. meta: doc_id, n, bits."""
    side = lambda doc, n, bits: meta.select(F.col("doc_id").alias(doc), F.col("n").alias(n), F.col("bits").alias(bits))
    near = written(pairs.join(side("a", "n_a", "x"), "a").join(side("b", "n_b", "y"), "b")
                   .mapInArrow(_can_link(percent), "a long, b long"))
    # texts stay where they are read: a join with the ids would shuffle them all
    flags = marked(near.select(F.col("a").alias("doc_id")).union(near.select("b")))
    sets = written(docs.mapInArrow(_sets(k, flags), "doc_id long, tokens binary"))
    both = (near.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
            .select("a", "b", "x", "y"))
    # sets of a few hundred KB: small Arrow batches for this job
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, 500)
    try:
        links = written(both.mapInArrow(_linked(percent), "a long, b long"))
    finally:
        conf.set(name, before)
    dropped(near, sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every end of a link: root is the smallest id reachable.

    Each round hooks every root to the smallest root beside it and then shortens the trees, so the
    number of rounds grows with the logarithm of a chain's length.
    """
    labels = written(links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
                     .withColumn("root", F.col("id")))
    while True:
        ends = (links.join(labels.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a")
                .join(labels.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
                .filter("ra != rb").select(F.greatest("ra", "rb").alias("root"), F.least("ra", "rb").alias("to")))
        hooks = written(ends.groupBy("root").agg(F.min("to").alias("to")))
        if hooks.isEmpty():
            return labels
        hooks = _shortened(hooks)
        labels = written(labels.join(hooks, "root", "left").select("id", F.coalesce("to", "root").alias("root")))


def _shortened(hooks: DataFrame) -> DataFrame:
    """Follow root -> to, whose targets are always smaller, to the end of each chain, doubling the step."""
    while True:
        onward = hooks.select(F.col("root").alias("to"), F.col("to").alias("next"))
        hooks = written(hooks.join(onward, "to", "left").select("root", F.coalesce("next", "to").alias("to"),
                                                               F.col("next").isNotNull().alias("moved")))
        moved = not hooks.filter("moved").isEmpty()
        hooks = hooks.select("root", "to")
        if not moved:
            return hooks


def near_classes(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    docs: doc_id (distinct, not null), text; other columns are not read. Words are maximal runs without ASCII
    white space, A-Z lower-cased. Set: distinct k-word shingles, the whole sequence as one if there are fewer
    words. Two documents link when 100 * |A and B| >= percent * |A or B|; component_id is the smallest doc_id
    reachable. Null texts and texts without words have an empty set and are linked with nothing, each its own
    component. An empty table gives an empty result.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = written(docs.mapInArrow(_described(k), "doc_id long, n long, digest binary, bits binary, slot int, c long"))
    meta = described.filter("slot is null").select("doc_id", "n", "digest", "bits")
    slots = described.filter("slot is not null").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[slots.column("slot").to_numpy()] = slots.column("c").to_numpy()
    first = meta.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    copies = written(meta.drop("bits").join(first.filter("copies > 1"), "digest").filter("doc_id != node").select("doc_id", "node"))

    postings = docs.mapInArrow(_signed(k, percent, counts), "sig long, doc_id long, n int, alone int, one boolean, deep boolean")
    node = F.coalesce("node", "doc_id")
    shared = (_neighbours(postings).join(copies, "doc_id", "left").withColumn("doc_id", node)
              .select(postings.columns).distinct())
    live = written(_neighbours(shared))
    # If y signs all its rare tokens, a rare token that only x signs is not in y. If both sign all of theirs, they share
    # a rare token only if they meet in it; met in a pair of frequent tokens, at most the frequent ones are common.
    bound = written(live.groupBy("doc_id").agg(F.first("n").alias("n"), F.first("deep").alias("deep"),
                    (F.first("n") - F.first("alone")).alias("frequent"),
                    (F.first("n") - F.first("alone") + F.sum(F.col("one").cast("int"))).alias("most")))
    ends = (live.filter("before is not null")
            .select("one", F.col("doc_id").alias("b"), F.explode(F.array("first", "before")).alias("a")).distinct())
    x, y = bound.select(F.struct("*").alias("x")), bound.select(F.struct("*").alias("y"))
    most = ("least(if(not {0}one and x.deep and y.deep, least(x.frequent, y.frequent), x.n), "
            "if(y.deep, x.most, x.n), if(x.deep, y.most, y.n))")
    fits = f"100 * {most} >= {percent} * (x.n + y.n - {most})"
    star = written(ends.join(x, F.expr("a = x.doc_id")).join(y, F.expr("b = y.doc_id")).filter(fits.format("")).select("a", "b").distinct())
    links = verified(docs, meta, star, k, percent)
    roots = components(links)

    # candidates whose ends are still apart, all of them
    apart = (live.select("sig", "doc_id", "one").join(bound, "doc_id").join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left")
             .withColumn("root", F.coalesce("root", "doc_id")))
    mixed = apart.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("sig")
    apart = written(apart.join(mixed, "sig"))
    rest = (apart.alias("x").join(apart.alias("y"), F.expr("x.sig = y.sig and x.doc_id < y.doc_id and x.root != y.root and " + fits.format("x.")))
            .select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
            .join(star, ["a", "b"], "left_anti"))
    rest = written(rest)
    dropped(live, bound, star, apart)
    if not rest.isEmpty():
        links = links.union(verified(docs, meta, rest, k, percent))
        roots = components(links)
    dropped(rest)
    labelled = (meta.join(copies, "doc_id", "left").select("doc_id", "n", node.alias("id"))
                .join(roots, "id", "left"))
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))


def _neighbours(postings: DataFrame) -> DataFrame:
    """Postings of signatures that two rows or more have, with the first and the previous document."""
    own = Window.partitionBy("sig").orderBy("doc_id")
    return (postings.select("*", F.first("doc_id").over(own).alias("first"), F.lag("doc_id").over(own).alias("before"),
                            F.lead("doc_id").over(own).alias("after"))
            .filter("before is not null or after is not null").drop("after"))
