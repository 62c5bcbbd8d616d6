"""Array helpers for Arrow batches of texts, and written intermediate tables.

Words are maximal runs of bytes other than space, tab, newline, vertical tab, form feed and
carriage return. A batch is worked on in slices of whole texts of some 700 KB, so a task holds a
few hundred MB however many rows a batch has; a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from labelwatch.session import scratch_folder

SLICE_BYTES = 700_000
ROOT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def written(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder; later reads prune columns and push filters."""
    path = f"{scratch_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads; the plans behind them are let go, and with them their shuffle files."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()  # the context cleaner removes shuffles whose plans are gone


def spread(df: DataFrame, *keys) -> DataFrame:
    """Repartition by keys into the session's number of shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each, texts left whole."""
    if not batch.num_rows:
        return
    ends = strings(batch.column(batch.schema.get_field_index(text)))[1][1:]
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and for each row the index of its first word (one more at the end)."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] |= inside[cuts]
        last[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache(maxsize=3)  # two bytes-sized or word-sized tables and one more: tens of MB
def _powers(size: int, root: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        one = np.ones(1, U)
        up = np.concatenate([one, np.cumprod(np.full(size, U(root)))])
        down = np.concatenate([one, np.cumprod(np.full(size, U(pow(root, -1, 1 << 64))))])
    return up, down


def powers(size: int, root: int = ROOT) -> tuple[np.ndarray, np.ndarray]:
    """root**i and root**-i modulo 2**64 for i up to at least size."""
    return _powers(1 << max(16, int(size).bit_length()), root)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U(33))
        h = h * U(0xFF51AFD7ED558CCD)
        h ^= h >> U(33)
        h *= U(0xC4CEB9FE1A85EC53)
        h ^= h >> U(33)
    return h


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, root: int = ROOT) -> np.ndarray:
    """Polynomial hashes of values[start:end] modulo 2**64, all from one prefix sum."""
    up, down = powers(len(values) + 1, root)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U), np.cumsum((values.astype(U) + U(1)) * up[: len(values)])])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(data, starts, ends)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i .. i+k-1 for each i that has so many words behind it."""
    if len(words) < k:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        out = words[: len(words) - k + 1].copy()
        for j in range(1, k):
            out *= U(ROOT)
            out += words[j: len(words) - k + 1 + j]
    return mix(out)


def rolling_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling spans."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:]) if len(values) > span else values[:0]
        span *= 2
    if span < width:
        rest = width - span
        values = np.minimum(values[:-rest], values[rest:]) if len(values) > rest else values[:0]
    return values


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of several spans, one span after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray,
                 n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The given words of each row joined by one space: bytes and row offsets. rows: of each word, ascending."""
    lengths = ends - starts + 1
    take = np.concatenate([data, np.zeros(1, np.uint8)])[ragged(starts, lengths)]
    stops = np.cumsum(lengths)
    take[stops - 1] = 32
    counts = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    last = np.cumsum(counts)
    edges = np.concatenate([[0], stops])[np.concatenate([[0], last])]
    return take, edges


def list_rows(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row of each element of a list column, and the elements; a null list has none."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(counts)), counts), lists.flatten()


def row_bytes(data: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Rows of joined_words without the space that ends each row with words."""
    raw = data.tobytes()
    at = edges.tolist()
    return [raw[a: b - 1] if b > a else b"" for a, b in zip(at, at[1:])]
