"""Best-fit packing planned on a histogram of lengths.

Documents become pieces of at most ``size`` tokens. Only the number of pieces of each length reaches the
driver (at most ``size`` numbers). Best-fit decreasing runs on these counts: all pieces of one length that
fit the same kind of open sequence are placed at once, so the plan has a bounded number of slot ranges,
whatever the number of documents. Then each piece takes the planned slot of its rank within its length.
Ranks come from counts by (length, bucket) and a sort inside buckets, so a length that a third of all
pieces have is still ranked in many tasks.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelwatch.llm.blocks import slices, written
from labelwatch.llm.pretokens import PieceEncoder

SIZE = 2048
BUCKET_ROWS = 50_000
KNOWN_WORDS = 200_000  # kept by a task, some 150 bytes each


@lru_cache(maxsize=2)
def _tokenizer(described: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(described)
    made.no_truncation()
    made.no_padding()
    ends = np.zeros(made.get_vocab_size(with_added_tokens=True), bool)
    for name, i in made.get_vocab().items():
        ends[i] = name.endswith("</w>")
    return made, ends


def _normal(text: str) -> str:
    """The tokenizer's own normal form: NFC, then each character in lower case by itself."""
    text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def _pieces(described, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, ends = _tokenizer(described.value)

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids, counts = [], []
            for at in range(0, len(words), 2000):
                # words of a text do not influence each other, and a word's last token says that it ends
                text = b" \n".join(words[at: at + 2000]).decode()
                found = np.array(made.encode(text, add_special_tokens=False).ids, np.int32)
                stops = np.flatnonzero(ends[found]) + 1
                if len(stops) != len(words[at: at + 2000]):  # a word that is cut again in other company
                    alone = [made.encode(w.decode(), add_special_tokens=False).ids for w in words[at: at + 2000]]
                    found = np.array([i for x in alone for i in x], np.int32)
                    stops = np.cumsum([len(x) for x in alone])
                ids.append(found)
                counts.append(np.diff(np.concatenate([[0], stops])))
            return np.concatenate(ids), np.concatenate(counts).astype(np.int64)

        specials = {t.content: i for i, t in made.get_added_tokens_decoder().items()}
        encoder = PieceEncoder(encode, specials, byte_level=False, limit=KNOWN_WORDS, normal=_normal)
        for batch in batches:
            for part in slices(batch):
                ids, edges = encoder([t or "" for t in part.column("text").to_pylist()])
                docs = part.column("doc_id").to_pylist()
                raw = ids.astype("<u4").tobytes()
                end = int(end_id).to_bytes(4, "little")
                rows = []
                for doc, a, b in zip(docs, edges.tolist(), edges[1:].tolist()):
                    own = raw[4 * a: 4 * b] + end
                    for piece, start in enumerate(range(0, b - a + 1, size)):
                        bytes_ = own[4 * start: 4 * (start + size)]
                        rows.append((doc, piece, start, len(bytes_) // 4, zlib.crc32(bytes_)))
                doc, piece, start, length, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """Pieces of each document's ids and the end id: doc_id, piece, start, length, ids_crc32."""
    with open(tokenizer_path, encoding="utf-8") as f:
        described = docs.sparkSession.sparkContext.broadcast(f.read())
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(_pieces(described, size, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"))


def plan_slots(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on counts: (length, first rank, number, first sequence, offset) of each range of slots."""
    open_by_room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of sequences
    plan, sequences = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = min((r for r in open_by_room if r >= length), default=None)
            if room is None:  # fresh sequences
                room, n = size, left
                first = sequences
            else:
                first, n = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
            # the sequence that took one has the tightest room for the next, until this length no longer fits
            per = room // length
            full = min(n, left // per)
            rest = left - full * per if full < n and left - full * per < per else 0
            used = full + (rest > 0)
            if first == sequences:
                n = used
                sequences += used
            for at, many, times in ((first, full, per), (first + full, 1, rest)):
                if many and times:
                    for j in range(times):
                        plan.append((length, rank, many, at, size - room + j * length))
                        rank += many
                    left -= many * times
                    if room > times * length:
                        open_by_room.setdefault(room - times * length, []).append((at, many))
            if n > used:
                open_by_room.setdefault(room, []).append((first + used, n - used))
    return plan


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces with sequence_id and offset. pieces: doc_id, piece, length (1 to size) and any other columns.

    Sequences hold at most ``size`` tokens and are gapless from offset 0. Equal lengths go by bucket, doc_id,
    piece; equal rows may swap places. Columns sequence_id and offset of the pieces are replaced, all others stay,
    whatever their names. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    # the caller's row travels as one value, so no name of a step can meet one of its own
    given = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    pieces = written(pieces.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("row")))
    rows = pieces.count()
    buckets = max(1, rows // BUCKET_ROWS)
    pieces = pieces.select("row", F.col("row.length").alias("length"),
                           F.pmod(F.xxhash64("row.doc_id", "row.piece"), F.lit(buckets)).alias("bucket"))
    sizes = written(pieces.groupBy("length", "bucket").agg(F.count("*").alias("c")))
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("c")).collect()}
    if not rows:
        return pieces.select("row.*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    if None in counts or min(counts) < 1 or max(counts) > size:
        raise ValueError(f"lengths must be from 1 to {size}")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("row.doc_id", "row.piece")
    ranked = (pieces.withColumn("nth", F.row_number().over(own) - 1).join(offsets, ["length", "bucket"])
              .select("row", "length", (F.col("nth") + F.col("before")).alias("rank")))
    # ranges of one length as one sorted array: a piece finds its range by counting the first ranks up to its own
    slots = spark.createDataFrame(plan_slots(counts, size), "length long, rank long, n long, sequence long, offset long")
    slots = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("rank", "sequence", "offset"))).alias("slots"))
    hit = F.expr("element_at(filter(slots, s -> s.rank <= rank), -1)")
    placed = ranked.join(F.broadcast(slots), "length").withColumn("slot", hit)
    return placed.select("row.*", F.expr("slot.sequence + rank - slot.rank").alias("sequence_id"), F.col("slot.offset").alias("offset"))


def packed_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    docs: doc_id, text; other columns are not read. Null and empty texts: the end id alone. Only documents of
    more than ``size`` tokens are cut. An empty table gives an empty result.
    """
    return pack(token_pieces(docs, tokenizer_path, size, end_id), size).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
