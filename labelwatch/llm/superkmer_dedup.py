"""Substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words. Its minimiser is the smallest hash of its ``gram``-word
sequences; consecutive windows with one minimiser form a super-k-mer.

1. Only digests travel first: the places of each minimiser are counted. A minimiser that occurs once
   belongs to windows that occur once, so those never travel as text.
2. The rest travel as packed strings (their words joined by a space), partitioned by minimiser.
   A minimiser with more than 1/16384 of all super-k-mers is hot: its super-k-mers are cut again where
   a second hash order changes its minimiser, and both minimisers make the key. At most 16384 can be hot.
   Equal strings of one batch are decided before the shuffle; only the first goes on.
3. Inside a bucket the windows are sorted by a 128-bit digest of their words; all but the earliest
   place (document, start) repeat. Runs of repeating windows go back to their document.

Documents are told apart and ordered by doc_id, a null one last, and, where doc_ids are null or repeat, then by a
hash of the text. Rows that agree in both are one document: none of them loses words to another.

A bucket is read in blocks; only the digests of a key that continues into the next block are kept.
Lost executors: every step is a deterministic map over a scan, a shuffle or a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelwatch.llm.blocks import (U, dropped, gram_hashes, joined_words, list_rows, mix, ragged, rolling_min, row_bytes,
                                   slices, span_hash, spread, strings, word_bounds, word_hashes, written)

WINDOW, GRAM = 20, 5
HOT_SHARE = 1 << 14
SECOND = U(0xD6E8FEB86659FD93)
OTHER_ROOT = 0xA0761D6478BD642F | 1


def _minimisers(words: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Row and word index of each window, all gram hashes, and each window's minimiser. first: of each row's words."""
    counts = np.diff(first)
    n = np.maximum(counts - window + 1, 0)
    at = ragged(first[:-1], n)  # windows within rows
    rows = np.repeat(np.arange(len(n)), n)
    grams = gram_hashes(words, gram)
    return rows, at, grams, rolling_min(grams, window - gram + 1)[at] if len(at) else np.zeros(0, U)


def _runs(rows: np.ndarray, at: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run of consecutive windows with equal keys."""
    new = np.ones(len(at), bool)
    if len(at):
        new[1:] = (rows[1:] != rows[:-1]) | (at[1:] != at[:-1] + 1)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(at)))


def _document(part) -> tuple[np.ndarray, np.ndarray]:
    return tuple(part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "mark"))


def _counted(window: int, gram: int, with_place: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = strings(part.column("text"))
                starts, ends, first = word_bounds(data, offsets)
                rows, at, grams, one = _minimisers(word_hashes(data, starts, ends), first, window, gram)
                begin, size = _runs(rows, at, one)
                key = one[begin].view(np.int64)
                if with_place:
                    ids, marks = _document(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(ids[rows[begin]]), pa.array(marks[rows[begin]]),
                         pa.array((at[begin] - first[rows[begin]]).astype(np.int32)), pa.array(size.astype(np.int32))],
                        names=["minimiser", "doc_id", "mark", "start", "n"])
                else:
                    # a run may hold its minimiser twice, in periodic text: both places count
                    span = size + window - gram
                    hit = grams[ragged(at[begin], span)] == np.repeat(one[begin], span)
                    edge = np.concatenate([[0], np.cumsum(span)])
                    n = np.diff(np.concatenate([[0], np.cumsum(hit)])[edge])
                    key, back = np.unique(key, return_inverse=True)
                    n = np.bincount(back, weights=n).astype(np.int64) if len(key) else n
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))],
                                                     names=["minimiser", "c"])
    return run


def _packed(window: int, gram: int, hot: np.ndarray):
    """Super-k-mers of the listed runs as strings; a string met before in the batch only leaves its verdict."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = strings(part.column("text"))
                starts, ends, first = word_bounds(data, offsets)
                words = word_hashes(data, starts, ends)
                row, flat = list_rows(part.column("runs"))
                start = flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
                n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                at = ragged(start + first[row], n)
                rows = np.repeat(row, n)
                if not len(at):
                    continue
                grams = gram_hashes(words, gram)
                one = rolling_min(grams, window - gram + 1)[at]
                two = rolling_min(mix(grams ^ SECOND), window - gram + 1)[at]
                is_hot = np.isin(one, hot)
                key = np.where(is_hot, mix(one ^ (two * U(3))), one)
                begin, size = _runs(rows, at, key)
                w0 = at[begin]
                span = size + window - 1
                take = ragged(w0, span)
                owner = np.repeat(np.arange(len(begin)), span)
                bytes_, edges = joined_words(data, starts[take], ends[take], owner, len(begin))
                ids, marks = (x[rows[begin]] for x in _document(part))
                place = w0 - first[rows[begin]]
                text = pa.array(row_bytes(bytes_, edges), pa.binary())
                code = text.dictionary_encode().indices.to_numpy()
                order = np.lexsort((place, marks, ids, code))
                again, same_row = np.zeros(len(order), bool), np.zeros(len(order), bool)
                p, q = order[1:], order[:-1]
                again[p] = code[p] == code[q]
                same_row[p] = again[p] & (ids[p] == ids[q]) & (marks[p] == marks[q]) & (place[p] == place[q])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(again, mix(ids.view(U) + place.astype(U)), key[begin]).view(np.int64)), pa.array(ids),
                     pa.array(marks), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32)),
                     pc.if_else(pa.array(again), pa.scalar(None, pa.binary()), text)],
                    names=["key", "doc_id", "mark", "start", "n", "packed"]).filter(pa.array(~same_row))
    return run


class _Seen:
    """Window digests of the key that is still open, kept between blocks."""

    def __init__(self) -> None:
        self.key, self.digests = None, np.zeros((0, 2), U)
        self.last: tuple | None = None


def _repeats(window: int, block_bytes: int = 2_000_000):
    """Windows that also start earlier; rows come sorted by key, document, start; those of equal rows side by side."""
    def block(part: pa.Table, seen: _Seen) -> pa.RecordBatch | None:
        place_of = [part.column(c).to_numpy() for c in ("key", "doc_id", "mark", "start")]
        new = np.ones(len(part), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in place_of], 0)
        new[0] = tuple(x[0] for x in place_of) != seen.last
        seen.last = tuple(x[-1] for x in place_of)
        if not new.all():
            part = part.filter(pa.array(new))
            if not len(part):
                return None
        ids, marks = _document(part)
        place = part.column("start").to_numpy().astype(np.int64)
        n = part.column("n").to_numpy().astype(np.int64)
        packed = part.column("packed").combine_chunks()
        known = packed.is_null().to_numpy(zero_copy_only=False)
        data, offsets = strings(packed.cast(pa.string()))
        starts, ends, first = word_bounds(data, offsets)
        words = word_hashes(data, starts, ends)
        w = np.where(known, 0, n)
        at, owner = ragged(first[:-1], w), np.repeat(np.arange(len(w)), w)
        repeat = np.zeros(len(at), bool)
        keys = part.column("key").to_numpy()
        if len(at):
            digest = np.stack([span_hash(words, at, at + window), span_hash(words, at, at + window, OTHER_ROOT)], 1)
            carry = seen.digests if seen.key == keys[0] else seen.digests[:0]
            every = np.concatenate([carry, digest])
            order = np.lexsort((every[:, 1], every[:, 0]))  # stable: the earliest place comes first
            same = np.zeros(len(order), bool)
            same[1:] = (every[order[1:]] == every[order[:-1]]).all(1)
            flags = np.zeros(len(order), bool)
            flags[order] = same
            repeat = flags[len(carry):]
            last = keys[owner] == keys[-1]
            new = digest[last & ~repeat]
            seen.digests = np.concatenate([carry, new]) if seen.key == keys[-1] else new
            seen.key = keys[-1]
        hit = np.flatnonzero(repeat)
        begin, size = _runs(owner[hit], at[hit])
        o = owner[hit][begin]
        s = place[o] + at[hit][begin] - first[o]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids[o], ids[known]])), pa.array(np.concatenate([marks[o], marks[known]])),
             pa.array(np.concatenate([s, place[known]]).astype(np.int32)), pa.array(np.concatenate([size, n[known]]).astype(np.int32))],
            names=["doc_id", "mark", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = _Seen(), [], 0
        for batch in batches:
            for part in slices(batch, "packed", block_bytes):
                held.append(part)
                size += part.nbytes
                if size >= block_bytes:
                    out = block(pa.Table.from_batches(held), seen)
                    if out is not None:
                        yield out
                    held, size = [], 0
        if held:
            out = block(pa.Table.from_batches(held), seen)
            if out is not None:
                yield out
    return run


def _cut(window: int):
    """Remove covered words; the kept words joined by one space, with the numbers of words before and removed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = strings(part.column("text"))
                starts, ends, first = word_bounds(data, offsets)
                row, flat = list_rows(part.column("repeats"))
                s = flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64) + first[row]
                e = s + flat.field("n").to_numpy(zero_copy_only=False) + window - 1
                depth = np.zeros(len(starts) + 1, np.int64)
                np.add.at(depth, s, 1)
                np.add.at(depth, e, -1)
                keep = np.cumsum(depth[:-1]) == 0
                counts = np.diff(first)
                rows = np.repeat(np.arange(len(counts)), counts)
                kept, edges = joined_words(data, starts[keep], ends[keep], rows[keep], len(counts))
                removed = counts - np.bincount(rows[keep], minlength=len(counts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("text"), pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64)),
                     pa.array(row_bytes(kept, edges), pa.binary()).cast(pa.string())],
                    names=["row", "text", "n_words", "n_removed", "kept"])
    return run


def hashed_kept(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows (row, text, doc_id, mark): the other columns as one struct, and what tells documents apart, never null."""
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count("*").alias("c"))
    told_apart = ids.filter("id is null or c > 1").isEmpty()
    mark = F.lit(0).cast("long") if told_apart else F.xxhash64("text", F.col("doc_id").isNull())
    others = [c for c in docs.columns if c != "text"]
    last = F.lit(2**63 - 1)
    return docs.select(F.struct(*others).alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), last).alias("doc_id"), mark.alias("mark"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Runs (doc_id, mark, start, n) of windows whose words also start earlier. docs: doc_id and mark (not null), text.

    Null and empty texts have no window. The job counts minimisers before it returns; of the counts only the hot
    ones, at most 16384 by their definition, reach the driver.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    docs = docs.select("doc_id", "mark", "text")
    counts = (docs.mapInArrow(_counted(window, gram, False), "minimiser long, c long")
              .groupBy("minimiser").agg(F.sum("c").alias("c")))
    counts = written(counts.filter("c > 1"))
    total = counts.agg(F.sum("c")).first()[0] or 0
    hot = np.array([r[0] for r in counts.filter(F.col("c") > total / HOT_SHARE).select("minimiser").collect()],
                   np.int64).view(U)
    runs = docs.mapInArrow(_counted(window, gram, True), "minimiser long, doc_id long, mark long, start int, n int")
    live = (runs.join(counts.select("minimiser"), "minimiser").groupBy("doc_id", "mark")
            .agg(F.collect_set(F.struct("start", "n")).alias("runs")))
    packed = docs.join(live, ["doc_id", "mark"], "left").mapInArrow(
        _packed(window, gram, hot), "key long, doc_id long, mark long, start int, n int, packed binary")
    out = written(spread(packed, "key").sortWithinPartitions("key", "doc_id", "mark", "start")
                  .mapInArrow(_repeats(window), "doc_id long, mark long, start int, n int"))
    dropped(counts)
    return out


def _removed(docs: DataFrame, window: int, gram: int) -> DataFrame:
    rows = _keyed(docs)
    repeats = (repeated_windows(rows, window, gram).groupBy("doc_id", "mark")
               .agg(F.collect_list(F.struct("start", "n")).alias("repeats")))
    schema = StructType([rows.schema["row"], *StructType.fromDDL("text string, n_words long, n_removed long, kept string").fields])
    return rows.join(repeats, ["doc_id", "mark"], "left").select("row", "text", "repeats").mapInArrow(_cut(window), schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window that covers it also starts earlier (smaller doc_id, or same document and
    smaller start). Null or empty text: no words, kept_text is empty. Texts shorter than a window stay.
    Copies: the smallest doc_id keeps its words. Rows without doc_id come last. Texts of one doc_id come in
    order of a hash; rows equal in doc_id and text are one document, which keeps its words in each of them.
    Other columns of docs are not read. An empty table gives an empty result.
    """
    cut = _removed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window, gram)
    return cut.select("row.doc_id", "n_words", "n_removed", F.col("kept").alias("kept_text"))


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with all their columns, each text that loses words replaced by its kept words; other texts as they are."""
    return _removed(docs, window, gram).select(*[
        F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"row.`{c}`")
        for c in docs.columns])
