"""Incremental line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is its text without ASCII white space at both ends, A-Z lower-cased; keys of ``least`` code points and
more count. The state of an index is four sets of Parquet tables, only ever appended to:

* holders: (key digest, doc_id, version), one row per document and distinct key;
* counts: (key digest, number of documents, smallest doc_id, version), the row of the latest version holds;
* gone: (doc_id, version) of deleted documents;
* filters: one cuckoo filter per shard of the digest space, holding each key that has a document.

An insertion asks the filters first: a key that no filter knows is new for certain, so only the others are looked up
in the counts, exactly. A deletion lowers the counts of the document's keys, finds the next smallest document from the
holders, and takes keys without documents out of the filters. So after any insertions and deletions the kept lines are
those of a fresh run over the documents that are left. A filter never decides a line; it only saves look-ups.

An index object is a list of tables and never changes: a lost driver or a failed step leaves the index before it valid.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from labelwatch.llm.blocks import U, list_rows, mix, slices, spread, strings, written

LEAST = 10
SHARD_KEYS = 196_608  # three quarters of the slots of 65,536 buckets: a filter of half a MB
WHITE = b" \t\n\x0b\x0c\r"
BUCKET = 4
TURNS = 200
HOT_SHARE = 1 << 14


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; what finds no place after many moves waits in a stash.

    Keys are pairs of 64-bit digests. Every key is stored once, also if its fingerprint is there already, so a
    removal of a stored key never hides another one. All calls take arrays.
    """

    def __init__(self, buckets: int) -> None:
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets is a power of two")
        self.table = np.zeros((buckets, BUCKET), np.uint16)
        self.stash = np.zeros(0, U)

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (h1 & U(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (h2 & U(len(self.table) - 1)).astype(np.int64)

    def _other(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (mix(mark.astype(U)) & U(len(self.table) - 1)).astype(np.int64)

    def _code(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (np.minimum(at, self._other(mark, at)).astype(U) << U(16)) | mark.astype(U)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        mark, at = self._places(h1, h2)
        found = (self.table[at] == mark[:, None]).any(1) | (self.table[self._other(mark, at)] == mark[:, None]).any(1)
        return found | np.isin(self._code(mark, at), self.stash) if len(self.stash) else found

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Rounds in which every waiting mark tries one bucket; from the second on, one per full bucket evicts."""
        mark, at = self._places(h1, h2)
        for turn in range(TURNS):
            if not len(at):
                return
            order = np.argsort(at, kind="stable")
            mark, at = mark[order], at[order]
            opens = np.ones(len(at), bool)
            opens[1:] = at[1:] != at[:-1]
            begin = np.flatnonzero(opens)
            rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
            free = np.cumsum(self.table[at] == 0, 1)
            fits = rank < free[:, -1]
            slot = (free > rank[:, None]).argmax(1)
            self.table[at[fits], slot[fits]] = mark[fits]
            mark, at, opens = mark[~fits], at[~fits], opens[~fits]
            if turn:
                full, seat = at[opens], (turn + at[opens]) % BUCKET
                victim = self.table[full, seat].copy()
                self.table[full, seat] = mark[opens]
                mark[opens] = victim
            at = self._other(mark, at)
        self.stash = np.concatenate([self.stash, self._code(mark, at)])

    def remove(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Take out one stored copy per key; keys must have been inserted."""
        mark, at = self._places(h1, h2)
        code = self._code(mark, at)
        while len(code):
            once = np.zeros(len(code), bool)
            once[np.unique(code, return_index=True)[1]] = True
            left = np.flatnonzero(once)
            for spot in (at, self._other(mark, at)):
                hit = self.table[spot[left]] == mark[left][:, None]
                some = hit.any(1)
                self.table[spot[left][some], hit[some].argmax(1)] = 0
                left = left[~some]
            for c in code[left]:
                self.stash = np.delete(self.stash, np.flatnonzero(self.stash == c)[:1])
            mark, at, code = mark[~once], at[~once], code[~once]

    def to_bytes(self) -> bytes:
        return self.table.tobytes() + self.stash.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, buckets: int) -> CuckooFilter:
        out = cls(buckets)
        size = out.table.nbytes
        out.table = np.frombuffer(raw[:size], np.uint16).reshape(-1, BUCKET).copy()
        out.stash = np.frombuffer(raw[size:], U).copy()
        return out


def _lines(part: pa.RecordBatch) -> Iterator[list[bytes]]:
    data, offsets = strings(part.column("text"))
    raw, at = data.tobytes(), offsets.tolist()
    for a, b in zip(at, at[1:]):
        yield raw[a:b].split(b"\n")


def _digest(line: bytes, least: int) -> bytes | None:
    key = line.strip(WHITE).lower()  # of bytes: A-Z alone
    if len(key) < least or (len(key) < 4 * least and len(key.decode()) < least):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _keys(least: int):
    """Distinct keys of each document; rows without doc_id hold none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found, counts = [], []
                ids = part.column("doc_id")
                for known, lines in zip(ids.is_valid().to_pylist(), _lines(part)):
                    own = {_digest(line, least) for line in lines} - {None} if known else ()
                    found.extend(own)
                    counts.append(len(own))
                pair = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                owner = np.repeat(ids.fill_null(0).to_numpy(), counts)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(owner)],
                                                 names=["h1", "h2", "doc_id"])
    return run


def _cut(least: int):
    """Drop the lines whose digest is listed; the others joined by a newline, with the numbers of lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, flat = list_rows(part.column("drops"))
                pair = np.stack([flat.field(n).to_numpy(zero_copy_only=False) for n in ("h1", "h2")], 1).astype(np.int64)
                gone: dict[int, set[bytes]] = {}
                for r, d in zip(row.tolist(), pair):
                    gone.setdefault(r, set()).add(d.tobytes())
                kept, total, dropped = [], [], []
                for r, lines in enumerate(_lines(part)):
                    own = gone.get(r)
                    stay = [x for x in lines if _digest(x, least) not in own] if own else lines
                    kept.append(b"\n".join(stay))
                    total.append(len(lines))
                    dropped.append(len(lines) - len(stay))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("text"), pa.array(kept, pa.binary()).cast(pa.string()),
                     pa.array(total, pa.int64()), pa.array(dropped, pa.int64())],
                    names=["row", "text", "kept", "n_lines", "n_dropped"])
    return run


def _sharded(buckets: int, step):
    """Run ``step(filter, rows) -> columns`` over rows sorted by shard, the filter of a shard before its keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = None, None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(shards) else []
            for a, b in zip(cuts, [*cuts[1:], len(shards)]):
                part = batch.slice(a, b - a)
                if shards[a] != shard:
                    if own is not None:
                        yield from step(shard, own, None)
                    shard, own = int(shards[a]), CuckooFilter(buckets)
                blob = part.column("filter")
                if len(part) and blob[0].is_valid:
                    own = CuckooFilter.from_bytes(blob[0].as_py(), buckets)
                    part = part.slice(1)
                if len(part):
                    yield from step(shard, own, part)
        if own is not None:
            yield from step(shard, own, None)
    return run


def _digests(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(part.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(U) for c in ("h1", "h2"))


def _probed(shard: int, own: CuckooFilter, part: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
    if part is not None:
        maybe = pa.array(own.contains(*_digests(part)))
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("h1", "h2", "n", "first")), maybe],
                                         names=["h1", "h2", "n", "first", "maybe"])


def _changed(shard: int, own: CuckooFilter, part: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
    if part is None:
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([own.to_bytes()], pa.binary())],
                                         names=["shard", "filter"])
        return
    h1, h2 = _digests(part)
    stays = part.column("n").to_numpy(zero_copy_only=False) > 0
    own.insert(h1[stays], h2[stays])
    own.remove(h1[~stays], h2[~stays])


@dataclass(frozen=True)
class LineIndex:
    """Lines of the documents inserted and not deleted. Start with ``LineIndex(spark)``."""

    spark: SparkSession
    least: int = LEAST
    shard_keys: int = SHARD_KEYS
    version: int = 0
    n_keys: int = 0
    shard_bits: int = 0
    holders: tuple[DataFrame, ...] = field(default=())
    counts: tuple[DataFrame, ...] = field(default=())
    gone: tuple[DataFrame, ...] = field(default=())
    filters: DataFrame | None = None

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the rows of docs (doc_id, text; other columns are not read).

        Rows of one doc_id are one document; rows without doc_id hold no line. Null and empty texts are one empty
        line, which has no key. A doc_id that the index holds already is an error: delete it first.
        """
        new = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                      .mapInArrow(_keys(self.least), "h1 long, h2 long, doc_id long").distinct())
        if self.version and not new.select("doc_id").join(self._live().select("doc_id"), "doc_id", "left_semi").isEmpty():
            raise ValueError("documents of the batch are in the index already")
        own = new.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
        if self.filters is None:
            counts = written(self._stamped(own))
            fresh = counts
        else:
            asked = written(self._by_shard(own, self.filters, self.shard_bits)
                            .mapInArrow(_sharded(self._buckets(), _probed), "h1 long, h2 long, n long, first long, maybe boolean"))
            maybe = asked.filter("maybe")
            known = self._current(maybe).select("h1", "h2", F.col("n").alias("n0"), F.col("first").alias("first0"))
            met = maybe.join(known, ["h1", "h2"], "left").select(
                "h1", "h2", (F.col("n") + F.coalesce("n0", F.lit(0))).alias("n"), F.least("first", "first0").alias("first"),
                (F.coalesce("n0", F.lit(0)) == 0).alias("fresh"))
            both = written(self._stamped(asked.filter("not maybe").select("h1", "h2", "n", "first", F.lit(True).alias("fresh"))
                                         .union(met), "fresh"))
            counts, fresh = both.drop("fresh"), both.filter("fresh").drop("fresh")
        n_keys = self.n_keys + fresh.count()
        grown = replace(self, version=self.version + 1, n_keys=n_keys, holders=(*self.holders, self._stamp(new)),
                        counts=(*self.counts, counts))
        return grown._filtered(fresh)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of ids (doc_id); ids it does not hold are passed over."""
        ids = written(ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct())
        live = self._live()
        touched = written(live.join(ids, "doc_id", "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("less")))
        left = (live.join(ids, "doc_id", "left_anti").join(touched.select("h1", "h2"), ["h1", "h2"], "left_semi")
                .groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")))
        counts = written(self._stamped(touched.join(left, ["h1", "h2"], "left")
                                       .select("h1", "h2", F.coalesce("n", F.lit(0)).alias("n"), "first")))
        out = counts.filter("n = 0")
        shrunk = replace(self, version=self.version + 1, n_keys=self.n_keys - out.count(), counts=(*self.counts, counts),
                         gone=(*self.gone, self._stamp(ids)))
        return shrunk._filtered(out)

    def kept(self, docs: DataFrame, text: str = "text", n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
        """docs (documents of the index) with all their columns, texts without the lines that an earlier one holds.

        A line goes if another document, with a smaller doc_id, holds its key. Texts that lose nothing, and rows
        without doc_id, stay as they are. n_lines, n_dropped: names of columns to add, numbers of lines before
        and lost. A null text has one empty line and stays null.
        """
        repeated = written(self._current().filter("n > 1").select("h1", "h2", "n", "first"))
        total = repeated.agg(F.sum("n")).first()[0] or 0
        # a key of this share: at most HOT_SHARE of them, so their table may be broadcast and their rows stay put
        hot, rest = repeated.filter(F.col("n") > total / HOT_SHARE), repeated.filter(F.col("n") <= total / HOT_SHARE)
        held = self._live()
        hits = (held.join(F.broadcast(hot), ["h1", "h2"]).unionByName(held.join(rest, ["h1", "h2"]))
                .filter("doc_id != first").groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("drops")))
        others = [c for c in docs.columns if c != text]
        rows = docs.select(F.struct(*others).alias("row"), F.col(text).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
        rows = rows.join(hits, "doc_id", "left").select("row", "text", "drops")
        schema = StructType([StructField("row", rows.schema["row"].dataType)]
                            + StructType.fromDDL("text string, kept string, n_lines long, n_dropped long").fields)
        cut = rows.mapInArrow(_cut(self.least), schema)
        shown = [F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text")).alias(text) if c == text else F.col(f"row.`{c}`")
                 for c in docs.columns]
        return cut.select(*shown, *[F.col(c).alias(name) for c, name in (("n_lines", n_lines), ("n_dropped", n_dropped)) if name])

    def _filtered(self, keys: DataFrame) -> LineIndex:
        """Bring the filters up to date with the keys that came or went; more shards once they are full."""
        bits = max(self.shard_bits, math.ceil(math.log2(max(1, self.n_keys / self.shard_keys))))
        if bits != self.shard_bits:
            keys = self._current().filter("n > 0")
        old = self.filters if bits == self.shard_bits else None
        filters = written(self._by_shard(keys, old, bits).mapInArrow(_sharded(self._buckets(), _changed), "shard int, filter binary"))
        return replace(self, filters=filters, shard_bits=bits)

    def _by_shard(self, keys: DataFrame, filters: DataFrame | None, bits: int) -> DataFrame:
        shard = (F.shiftrightunsigned("h1", 64 - bits) if bits else F.lit(0)).cast("int")
        rows = keys.select(shard.alias("shard"), "h1", "h2", "n", "first", F.lit(None).cast("binary").alias("filter"))
        if filters is not None:
            none = F.lit(None).cast("long")
            rows = rows.unionByName(filters.select("shard", *[none.alias(c) for c in ("h1", "h2", "n", "first")], "filter"))
        return spread(rows, "shard").sortWithinPartitions("shard", F.col("filter").isNull())

    def _buckets(self) -> int:
        return 1 << max(1, math.ceil(math.log2(self.shard_keys / 3)))

    def _stamp(self, df: DataFrame) -> DataFrame:
        return df.withColumn("version", F.lit(self.version))

    def _stamped(self, df: DataFrame, *more: str) -> DataFrame:
        return self._stamp(df.select("h1", "h2", "n", "first", *more))

    def _current(self, keys: DataFrame | None = None) -> DataFrame:
        """The latest counts, of all keys or of those listed."""
        every = _union(self.counts)
        if keys is not None:
            every = every.join(keys.select("h1", "h2"), ["h1", "h2"], "left_semi")
        if len(self.counts) == 1:
            return every
        last = every.groupBy("h1", "h2").agg(F.max_by(F.struct("n", "first"), "version").alias("last"))
        return last.select("h1", "h2", "last.n", "last.first")

    def _live(self) -> DataFrame:
        """Holders whose document has not been deleted after it came."""
        every = _union(self.holders)
        if not self.gone:
            return every.drop("version")
        gone = _union(self.gone).select("doc_id", F.col("version").alias("left"))
        last = gone.groupBy("doc_id").agg(F.max("left").alias("left"))
        return every.join(last, "doc_id", "left").filter("left is null or left < version").drop("version", "left")


def _union(parts: tuple[DataFrame, ...]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dedup_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_text, from an index of these documents alone.

    Null and empty texts: one empty line, nothing dropped, empty kept_text. An empty table gives an empty result.
    Rows without doc_id keep all lines and cost no other row any. Rows of one doc_id are one document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kept = LineIndex(docs.sparkSession, least).insert(docs).kept(docs, n_lines="n_lines", n_dropped="n_dropped")
    return kept.select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit("")).alias("kept_text"))


def hashed(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
