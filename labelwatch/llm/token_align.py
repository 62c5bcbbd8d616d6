"""Alignment of two tokenizations of one text by diagonal run skipping, and counts of linked ids over the corpus.

Both tokenizations become arrays of byte ends. While token i of one ends where token i + shift of the other does,
tokens stand one to one: a stretch is found by comparing slices of both arrays at the current shift, each twice as
long as the one before, and halving back at the first difference. What follows is an irregular group: the side that
ends first takes another token until both end together; then the shift is updated and the next stretch begins.
A slice of documents is aligned as one sequence, since both sides end together at every document's end.

Counts: a pair of ids that overlap counts once a document. Each task adds up its documents' pairs before the shuffle.
A link's count is looked up in the map where the pair has more than 1/2**18 of all counts (at most 2**18 pairs), and
by a join on the pair otherwise, so no join key has more than that share. The highest count of each id of the first
vocabulary is a table of the size of that vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwatch.llm.blocks import list_rows, ragged, slices, written
from labelwatch.llm.bpe_codec import _printable_bytes, vocabulary
from labelwatch.llm.pretokens import PieceEncoder

SLICE = 1_000_000
HOT_PAIRS = 1 << 18
WIDE_GAP = re.compile(r"\s{1000}")  # the regular expressions of pre-tokens overflow their stack on long white space
HELD = 4_000_000  # pairs a task holds before it adds them up


class ByteTokens:
    """A byte-level BPE vocabulary whose ids follow the merge order: ids of texts, and the bytes of each id.

    described: the JSON text of its tokenizer; pattern: of its pre-tokens. Special tokens' strings are plain text.
    """

    def __init__(self, described: str, pattern: str) -> None:
        import tiktoken

        spec = json.loads(described)
        special = {a["content"] for a in spec["added_tokens"]}
        to_byte = _printable_bytes()
        names = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        merged = [names["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError("ids must follow the order of merges")
        ranks = {bytes(to_byte[c] for c in t): i for t, i in names.items()}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = 1 + max(i for i in spec["model"]["vocab"].values())
        texts = [b""] * self.size
        for t, i in ranks.items():
            texts[i] = t
        self.pieces, self.described = texts, described

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [self.gapped(" " + t) if WIDE_GAP.search(t) else self.encoding.encode_ordinary(" " + t) for t in texts]

    def gapped(self, text: str) -> list[int]:
        return PieceEncoder(vocabulary(self.described).encode_pieces, {}, byte_level=True)([text])[0].tolist()


class Pieces:
    """A SentencePiece vocabulary: ids of texts, and the bytes of each id."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.model.get_piece_size()
        names = self.model.id_to_piece(list(range(self.size)))
        self.pieces = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in enumerate(names)]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def _byte_tokens(described: str, pattern: str) -> ByteTokens:
    return ByteTokens(described, pattern)


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def align(ends_a: list[int], ends_b: list[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]], list[int], list[int]]:
    """One-to-one stretches (i, j, length), irregular groups (i, i end, j, j end), and the links inside the latter.

    Both lists ascend to the same last end.
    """
    n = len(ends_a)
    runs, groups, left, right = [], [], [], []
    i = j = 0
    while i < n:
        size, step = 0, 1
        while i + size < n and ends_a[i + size: i + size + step] == ends_b[j + size: j + size + step]:
            size = min(size + step, n - i)
            step *= 2
        while step > 1 and i + size < n:
            step //= 2
            if ends_a[i + size: i + size + step] == ends_b[j + size: j + size + step]:
                size = min(size + step, n - i)
        if size:
            runs.append((i, j, size))
            i += size
            j += size
            if i == n:
                break
        i0, j0, x, y = i, j, ends_a[i], ends_b[j]
        while True:
            left.append(i)
            right.append(j)
            if x < y:
                i += 1
                x = ends_a[i]
            elif y < x:
                j += 1
                y = ends_b[j]
            else:
                break
        i += 1
        j += 1
        groups.append((i0, i, j0, j))
    return runs, groups, left, right


def _flags(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True where a group begins: everywhere but behind the first token of an irregular group."""
    out = np.ones(n, bool)
    out[ragged(begin + 1, end - begin - 1)] = False
    return out


@lru_cache(maxsize=1)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. n-1 from the left, with one place to spare, and how many there are."""
    names = [str(i).encode() for i in range(n)]
    sizes = np.array([len(x) for x in names])
    width = int(sizes.max()) + 1
    return np.frombuffer(b"".join(x.ljust(width) for x in names), np.uint8).reshape(n, width), sizes


def _spelled(ids_a, ids_b, flag_a, flag_b, edges_a, edges_b, most: int) -> tuple[bytes, np.ndarray]:
    """`a1,a2|b1;a3|b2` of all documents one after the other, and the end of each document."""
    group_a, group_b = np.cumsum(flag_a) - 1, np.cumsum(flag_b) - 1
    n_a, n_b = np.bincount(group_a), np.bincount(group_b)
    at_a = np.arange(len(ids_a)) + (np.cumsum(n_b) - n_b)[group_a]
    at_b = np.arange(len(ids_b)) + np.cumsum(n_a)[group_b]
    values, mark = np.zeros(len(at_a) + len(at_b), np.int64), np.full(len(at_a) + len(at_b), ord(","), np.uint8)
    values[at_a], values[at_b] = ids_a, ids_b
    mark[at_a[np.append(flag_a[1:], True)]] = ord("|")
    mark[at_b[np.append(flag_b[1:], True)]] = ord(";")
    digits, sizes = _decimals(most)
    size = sizes[values] + 1
    ends = edges_a[1:] + edges_b[1:]
    size[ends[ends > np.append(0, ends[:-1])] - 1] -= 1  # nothing behind a document's last group
    cells = digits[values]
    cells[np.arange(len(values)), sizes[values]] = mark
    text = cells[np.arange(cells.shape[1]) < size[:, None]].tobytes()
    return text, np.append(0, np.cumsum(size))[np.append(0, ends)]


def _joined(tokens: list[list[int]], table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Ids of all texts, the first id of each, byte sizes of the ids, and each text's joined bytes."""
    raw, at = table
    counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
    edges = np.append(0, np.cumsum(counts))
    ids = np.fromiter((i for t in tokens for i in t), np.int64, int(edges[-1]))
    sizes = at[ids + 1] - at[ids]
    joined = raw[ragged(at[ids], sizes)].tobytes()
    cut = np.append(0, np.cumsum(sizes))[edges].tolist()
    return ids, edges, sizes, [joined[a:b] for a, b in zip(cut, cut[1:])]


def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(pieces), np.uint8), np.append(0, np.cumsum([len(p) for p in pieces]))


def _only(ids: np.ndarray, edges: np.ndarray, sizes: np.ndarray, ok: np.ndarray):
    """The tokens of the texts that are ok; the others have none."""
    counts = np.diff(edges)
    keep = np.repeat(ok, counts)
    return ids[keep], np.append(0, np.cumsum(np.where(ok, counts, 0))), sizes[keep]


def _aligned(described, pattern: str, model, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _byte_tokens(described.value, pattern), _pieces(model.value)
        table_a, table_b = _table(a.pieces), _table(b.pieces)
        most = max(a.size, b.size)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids_a, edges_a, sizes_a, bytes_a = _joined(a(texts), table_a)
                ids_b, edges_b, sizes_b, bytes_b = _joined(b(texts), table_b)
                ok = np.array([bool(t) and x == y == (" " + t).encode() for t, x, y in zip(texts, bytes_a, bytes_b)], bool)
                ids_a, edges_a, sizes_a = _only(ids_a, edges_a, sizes_a, ok)
                ids_b, edges_b, sizes_b = _only(ids_b, edges_b, sizes_b, ok)
                runs, groups, left, right = align(np.cumsum(sizes_a).tolist(), np.cumsum(sizes_b).tolist())
                runs = np.array(runs, np.int64).reshape(-1, 3)
                groups = np.array(groups, np.int64).reshape(-1, 4)
                flag_a = _flags(len(ids_a), groups[:, 0], groups[:, 1])
                flag_b = _flags(len(ids_b), groups[:, 2], groups[:, 3])
                link_a = np.concatenate([ragged(runs[:, 0], runs[:, 2]), np.array(left, np.int64)])
                link_b = np.concatenate([ragged(runs[:, 1], runs[:, 2]), np.array(right, np.int64)])
                doc = np.searchsorted(edges_a, link_a, "right") - 1
                n = len(texts)
                pair = ids_a[link_a] * b.size + ids_b[link_b]
                order = np.lexsort((pair, doc))
                doc, pair = doc[order], pair[order]
                new = np.ones(len(pair), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
                begin = np.flatnonzero(new)
                times = np.diff(np.append(begin, len(pair)))
                lists = np.append(0, np.cumsum(np.bincount(doc[begin], minlength=n))).astype(np.int32)
                text, cuts = _spelled(ids_a, ids_b, flag_a, flag_b, edges_a, edges_b, most)
                cuts = cuts.tolist()
                digest = [hashlib.sha256(text[p:q]).hexdigest() if q > p else "" for p, q in zip(cuts, cuts[1:])]
                n_groups = np.diff(np.append(0, np.cumsum(flag_a))[edges_a])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in (
                        np.diff(edges_a), np.diff(edges_b), n_groups, np.bincount(doc, minlength=n))], pa.array(digest),
                     pa.ListArray.from_arrays(pa.array(lists), pa.array(pair[begin].astype(np.int64 if wide else np.int32))),
                     pa.ListArray.from_arrays(pa.array(lists), pa.array(times.astype(np.int32)))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of documents of each pair in a task's documents, in parts of bounded size."""
    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pairs, back = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        return pairs, np.bincount(back, weights=np.concatenate([c for _, c in held]), minlength=len(pairs)).astype(np.int64)

    def out(pairs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], names=["pair", "c"])
    held, size = [], 0
    for batch in batches:
        pairs = batch.column("pairs").flatten().to_numpy(zero_copy_only=False)
        held.append((pairs, np.ones(len(pairs), np.int64)))
        size += len(pairs)
        if size > HELD:
            held = [merged(held)]
            size = len(held[0][0])
            if size > HELD // 2:
                yield out(*held[0])
                held, size = [], 0
    if held:
        yield out(*merged(held))


def _looked_up(part: pa.RecordBatch, hot: tuple[np.ndarray, np.ndarray]):
    """Row, pair and times of every distinct link, and its count (0: not among the hot ones)."""
    pairs, counts = hot
    row, flat = list_rows(part.column("pairs"))
    pair = flat.to_numpy(zero_copy_only=False).astype(np.int64)
    times = part.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.searchsorted(pairs, pair)
    at[at == len(pairs)] = 0
    count = np.where(pairs[at] == pair, counts[at], 0) if len(pairs) else np.zeros(len(pair), np.int64)
    return row, pair, times, count


def _scored(hot, best, size_b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            row, pair, times, count = _looked_up(part, hot.value)
            top = best.value[pair // size_b]
            add = lambda x: pa.array(np.bincount(row, weights=x, minlength=len(part)).astype(np.int64))
            # sums of a part stay below 2**53, where doubles are exact
            yield pa.RecordBatch.from_arrays([part.column("row_id"), add(times * (count == top)), add(times * count)],
                                             names=["row_id", "n_best", "count_sum"])
    return run


def _rest(hot, best, size_b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            row, pair, times, count = _looked_up(part, hot.value)
            cold = count == 0
            ids = part.column("row_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[row[cold]]), pa.array(pair[cold]), pa.array(times[cold]),
                                              pa.array(best.value[pair[cold] // size_b])], names=["row_id", "pair", "times", "top"])
    return run


def linked_tokens(docs: DataFrame, byte_path: str, pattern: str, piece_path: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    docs: doc_id, text; other columns are not read. byte_path: JSON description of a byte-level BPE tokenizer, which
    encodes space + text; pattern: of its pre-tokens; piece_path: SentencePiece model, which encodes the text. Both
    files are read on the driver and broadcast. Texts null, empty, or whose tokens do not spell space + text have no
    tokens: zeros and an empty digest. Rows are documents, whatever their doc_id (null and repeated ones too). An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    with open(byte_path, encoding="utf-8") as f:
        described = f.read()
    with open(piece_path, "rb") as f:
        model = f.read()
    size_a, size_b = ByteTokens(described, pattern).size, Pieces(model).size
    wide = size_a * size_b >= 1 << 31
    cast = lambda x: spark.sparkContext.broadcast(x)
    schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              f"pairs array<{'long' if wide else 'int'}>, times array<int>")
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                   .mapInArrow(_aligned(cast(described), pattern, cast(model), wide), schema)
                   .withColumn("row_id", F.monotonically_increasing_id()))
    counts = written(rows.select("pairs").mapInArrow(_counted, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")))
    tops = counts.groupBy(F.expr(f"int(pair div {size_b})").alias("a")).agg(F.max("c").alias("c")).toArrow()
    best = np.zeros(size_a, np.int64)
    best[tops.column("a").to_numpy()] = tops.column("c").to_numpy()
    total = counts.agg(F.sum("c")).first()[0] or 0
    hot = counts.filter(F.col("c") > total / hot_pairs).toArrow()  # at most hot_pairs rows
    pairs = hot.column("pair").to_numpy()
    order = np.argsort(pairs)
    hot, best = cast((pairs[order], hot.column("c").to_numpy()[order])), cast(best)
    listed = rows.select("row_id", "pairs", "times")
    near = listed.mapInArrow(_scored(hot, best, size_b), "row_id long, n_best long, count_sum long")
    far = (listed.mapInArrow(_rest(hot, best, size_b), "row_id long, pair long, times long, top long")
           .join(counts.filter(F.col("c") <= total / hot_pairs), "pair")
           .select("row_id", F.expr("if(c = top, times, 0)").alias("n_best"), (F.col("times") * F.col("c")).alias("count_sum")))
    sums = near.union(far).groupBy("row_id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return (rows.select("row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row_id")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
