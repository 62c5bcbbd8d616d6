"""Pre-tokens of many texts at once, as slices of one UTF-8 buffer.

Both public tokenizers used here cut a text by character class before they merge bytes. Classes come from
one table over code points; cuts are found on arrays. Texts stand between separators that cannot occur in
them, so no token spans two texts.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from labelwatch.llm.blocks import ragged

LETTER, NUMBER, SPACE, OTHER, EDGE = range(5)
ENCODED_BYTES = 4_000_000  # of text at once: distinct pre-tokens are looked up once each time
SEPARATOR = 0xD800  # a lone surrogate
_WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_TAILS = ("s", "t", "m", "d", "re", "ve", "ll")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
    table[list(_WHITE)] = SPACE
    table[SEPARATOR] = EDGE
    return table


def _contractions(points: np.ndarray, kinds: np.ndarray, bare_only: bool) -> list[tuple[np.ndarray, int]]:
    """Places of apostrophes that open 's, 't, ... with the length of the token."""
    at = np.flatnonzero(points[:-2] == 39)
    at = at[at > 0]
    before = kinds[at - 1]
    ok = before != OTHER
    if bare_only:
        ok &= points[at - 1] != 32  # a space before it belongs to the apostrophe
    # the apostrophe after a contraction's tail follows a letter, so it opens a token too
    at = at[ok]
    out = []
    for tail in _TAILS:
        hit = points[at + 1] == ord(tail[0])
        if len(tail) > 1:
            hit &= points[np.minimum(at + 2, len(points) - 1)] == ord(tail[1])
        out.append((at[hit], 1 + len(tail)))
    return out


def cut(texts: list[str], byte_level: bool) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """All pieces of the joined texts, which of them are pre-tokens, and the first piece after each text's separator.

    byte_level: a single space joins the run behind it and white space is kept (else it is dropped and every
    number stands alone).
    """
    joined = chr(SEPARATOR) + "".join(t + chr(SEPARATOR) for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = joined.encode("utf-8", "surrogatepass")
    kinds = classes()[points]
    n = len(points)
    opens = np.ones(n, bool)
    opens[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == EDGE)
    if byte_level:
        # the last of several white space characters stands apart when a text goes on behind it
        last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & (kinds[1:] != EDGE))
        opens[last] = True
        glue = last[points[last] == 32] + 1
        opens[glue] = False
    else:
        opens[kinds == NUMBER] = True
    for at, size in _contractions(points, kinds, byte_level):
        opens[at] = True
        for j in range(1, size):
            opens[at + j] = False
        opens[at + size] = True
    width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    first = np.flatnonzero(opens)
    place = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    offsets = place[np.append(first, n)]
    pieces = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
    kind = kinds[first]
    real = kind != EDGE
    if not byte_level:
        real &= kind != SPACE
    edges = np.flatnonzero(kind == EDGE)
    return pieces, real, edges


def split_special(texts: list[str], specials: dict[str, int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Segments between special tokens, the row of each, and the id behind it (-1: none)."""
    if not any(s in t for t in texts for s in specials):
        return texts, np.arange(len(texts)), np.full(len(texts), -1)
    parts, rows, after = [], [], []
    for row, text in enumerate(texts):
        while True:
            found = min(((text.find(s), -len(s), s) for s in specials if s in text), default=None)
            parts.append(text[: found[0]] if found else text)
            rows.append(row)
            after.append(specials[found[2]] if found else -1)
            if not found:
                break
            text = text[found[0] + len(found[2]):]
    return parts, np.array(rows), np.array(after)


class PieceEncoder:
    """Ids of texts by way of their distinct pre-tokens; ``encode`` gives ids and counts of new ones.

    Known pre-tokens are kept per task up to ``limit``, then forgotten, so memory is bounded.
    """

    def __init__(self, encode, specials: dict[str, int], byte_level: bool, limit: int = 800_000,
                 normal=None) -> None:
        self.encode, self.specials, self.byte_level, self.limit = encode, specials, byte_level, limit
        self.normal = normal or (lambda text: text)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the first id of each (one more at the end)."""
        parts, rows, after = split_special(texts, self.specials)
        pieces, real, edges = cut([self.normal(p) for p in parts], self.byte_level)
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy()
        wanted = np.zeros(len(coded.dictionary), bool)
        wanted[codes[real]] = True
        names = coded.dictionary.filter(pa.array(wanted)).to_pylist()
        if len(self.known) > self.limit:
            self.clear()
        found = list(map(self.known.get, names))
        new = [x for x, i in zip(names, found) if i is None]
        if new:
            ids, counts = self.encode(new)
            base = len(self.starts)
            self.known.update(zip(new, range(base, base + len(new))))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, ids])
            fresh = iter(range(base, base + len(new)))
            found = [next(fresh) if i is None else i for i in found]
        place = np.zeros(len(coded.dictionary), np.int64)
        place[wanted] = found
        which = place[codes[real]]
        counts = self.counts[which]
        ids = self.ids[ragged(self.starts[which], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(real)[edges]]
        sizes = np.diff(ends)
        if (after >= 0).any():
            ids = np.insert(ids, ends[1:][after >= 0], after[after >= 0])
            sizes = sizes + (after >= 0)
        per_row = np.bincount(rows, weights=sizes, minlength=len(texts)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_row)])
