"""Exact byte-level BPE by a backtracking encoder, and decoding by an offset table.

A merge sequence leaves the one segmentation whose neighbours are all compatible: no merge across their
border would have come before the merges that closed it off. So a pre-token is encoded by an Aho-Corasick
automaton that finds all tokens in it; from each place the longest token is tried first that is compatible
with the token before, and a place from which the rest cannot be reached is not entered again. Each place is
entered once. Compatibility of two tokens follows from their merge trees and is kept in a bounded table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwatch.llm.blocks import ragged, slices
from labelwatch.llm.pretokens import ENCODED_BYTES, PieceEncoder

PAIRS_KEPT = 1_000_000


def _printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 ones for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge trees and decoding table of a tokenizer description (JSON text)."""

    def __init__(self, described: str) -> None:
        spec = json.loads(described)
        model = spec["model"]
        to_byte = _printable_bytes()
        names = {t: i for t, i in model["vocab"].items()}
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> rank, token
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> rank, left, right
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, token = names[left], names[right], names[left + right]
            self.merged.setdefault((a, b), (rank, token))
            self.parts.setdefault(token, (rank, a, b))
        texts = [b""] * (1 + max([*names.values(), *self.specials.values()]))
        self.finder = ahocorasick.Automaton()
        for name, i in names.items():
            if name in self.specials:
                continue
            texts[i] = bytes(to_byte[c] for c in name)
            if i in self.parts or len(texts[i]) == 1:
                self.finder.add_word(texts[i].decode("latin-1"), (len(texts[i]), i))
        self.finder.make_automaton()
        for name, i in self.specials.items():
            texts[i] = name.encode()
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stood at one border of a token (1: left, 2: right) and the rank that ended each."""
        if (token, side) not in self.spines:
            out, end, at = [], float("inf"), token
            while True:
                out.append((at, end))
                if at not in self.parts:
                    break
                end, at = self.parts[at][0], self.parts[at][side]
            self.spines[token, side] = out
        return self.spines[token, side]

    def compatible(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            known = True
            for a, a_end in self.spine(left, 2):
                for b, b_end in self.spine(right, 1):
                    met = self.merged.get((a, b))
                    if met and met[0] < a_end and met[0] <= b_end:  # equal ranks merge from the left
                        known = False
            if len(self.fits) >= PAIRS_KEPT:
                self.fits.clear()
            self.fits[left, right] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, found in self.finder.iter(piece.decode("latin-1")):
            starts[end + 1 - found[0]].append(found)  # shorter tokens come first
        fits, dead = self.fits, set()
        path, choices, at, before = [], [reversed(starts[0])], 0, -1
        while at < n:
            for size, token in choices[-1]:
                if at + size in dead:
                    continue
                ok = before < 0 or fits.get((before, token))
                if ok is None:
                    ok = self.compatible(before, token)
                if ok:
                    path.append(token)
                    before = token
                    at += size
                    choices.append(reversed(starts[at]))
                    break
            else:
                if not path:
                    raise ValueError("the vocabulary does not cover all bytes")
                dead.add(at)
                choices.pop()
                token = path.pop()
                at -= int(self.offsets[token + 1] - self.offsets[token])
                before = path[-1] if path else -1
        return path

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.encode_piece(p) for p in pieces]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int32, int(counts.sum())), counts

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[str]:
        sizes = self.offsets[ids + 1] - self.offsets[ids]
        raw = self.bytes[ragged(self.offsets[ids], sizes)].tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])[edges].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


@lru_cache(maxsize=2)
def vocabulary(described: str) -> Vocabulary:
    return Vocabulary(described)


def _coded(described):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(described.value)
        encoder = PieceEncoder(vocab.encode_pieces, vocab.specials, byte_level=True)
        for batch in batches:
            for part in slices(batch, limit=ENCODED_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, edges = encoder(texts)
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(vocab.decode(ids, edges), pa.string())],
                                                 names=["doc_id", "ids", "decoded"])
    return run


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string of every whole text; docs: doc_id, text, other columns are not read.

    tokenizer_path: JSON description of a byte-level BPE tokenizer (read on the driver, a fixed 2 MB broadcast).
    Ids equal those of the tokenizers library without added special tokens; the string of a special token in a
    text is that token. Null and empty texts: no ids, empty decoded text. Equal rows give equal rows.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        described = docs.sparkSession.sparkContext.broadcast(f.read())
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(_coded(described), "doc_id long, ids array<int>, decoded string"))


def digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
