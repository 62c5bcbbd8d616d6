"""Spelling variants: words one edit apart, found with bit-sliced position indexes of parts of the vocabulary.

A block of index words of one length m is kept as bitsets: for each position and letter, the words with that letter
there. For a query the set of words that agree with it so far (zero errors) and the sets with one error so far, a
replaced letter (same position) or a letter too many in the query (position shifted by one), are carried from letter
to letter with a few word-parallel operations for all index words at once. Queries have m or m + 1 letters, so each
near pair is found from its longer word, or from both words of one length.

Which words meet: one edit leaves the first half or the rest of the shorter word's letters as they are. So words are
grouped by (m, first half) and by (m, rest). A group with more than ``GROUP`` words is split again: of the letters that
are still open, the half that the edit leaves alone joins the key, twice. With one open letter a group holds at most as
many index words as there are letters (90), and the square of that in longer ones, so every group ends up bounded,
whatever the words. Several groups share a block; a query starts with the bits of its own group.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwatch.llm.blocks import U, spread, written

LETTERS = "a-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, RATIO, EVERY = 6, 5, 5, 199
HELD_WORDS = 400_000
GROUP, BLOCK = 4096, 1024


def _occurrences(least: int, every: int):
    """Words of a task's documents with their counts, in parts of bounded size."""
    run_of_letters = re.compile(f"[{LETTERS}]{{{least},}}")  # a deletion only shortens, so shorter runs give no word

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                          names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                lowered = text.encode().lower().decode()  # of bytes: A-Z alone
                own = Counter(map(re.Match.group, run_of_letters.finditer(lowered)))
                if doc_id is None:
                    counts.update(own)
                    continue
                head = zlib.crc32(f"{doc_id}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), head)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    counts[word] += n
                if len(counts) > HELD_WORDS:
                    yield out(counts)
                    counts = Counter()
        if counts:
            yield out(counts)
    return run


def vocabulary(docs: DataFrame, least: int = LEAST_LETTERS, often: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """word, n: runs of letters of whole texts, lower-cased in A-Z, of ``least`` code points and ``often`` occurrences.

    In a document a run loses one letter where ``every`` divides the CRC-32 of '<doc_id>:<run>', the letter at that
    number modulo the run's length. A row without doc_id loses none. Rows of equal doc_id and text count each.
    """
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_occurrences(least, every), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.expr(f"length(word) >= {least} and n >= {often}"))


def _split(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, head, tail) twice, with half of the open letters added to the head, or the others to the tail."""
    half = "int((m - head - tail) / 2)"
    return rows.select("word", "n", "m", F.expr(
        f"inline(array(struct(head + {half} as head, tail as tail), struct(head as head, m - head - {half} as tail)))"))


def groups(words: DataFrame, least: int = LEAST_LETTERS, limit: int = GROUP) -> DataFrame:
    """Rows (word, n, m, key): words with one key meet. Keys of one word are left out."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m"), F.lit(0).alias("head"), F.lit(0).alias("tail"))
    rows = rows.filter(F.col("m") >= least)
    done = []
    while True:
        rows = _split(rows)
        key = "format_string('%06d %d %d %s %s', m, head, tail, left(word, head), right(word, tail))"
        rows = written(rows.withColumn("key", F.expr(key)))
        sizes = written(rows.groupBy("key").agg(F.count("*").alias("c"), F.first(F.expr("m - head - tail")).alias("open")).filter("c > 1"))
        big = F.expr(f"c > {limit} and open > 1")
        done.append(rows.join(sizes.filter(~big).select("key"), "key", "left_semi").select("word", "n", "m", "key"))
        more = sizes.filter(big)
        if more.isEmpty():
            break
        rows = rows.join(more.select("key"), "key", "left_semi")
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    packed = np.packbits(flags, axis=1, bitorder="little")
    wide = np.zeros((len(flags), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(U)


def _set_bits(sets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    row = np.flatnonzero(sets.any(1))
    hit, word = np.nonzero(np.unpackbits(np.ascontiguousarray(sets[row]).view(np.uint8), axis=1, count=n, bitorder="little"))
    return row[hit], word


def one_edit(words: list[str], group: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (longer or equal, other) of the pairs of one group, exactly one edit apart; words have m or m + 1 letters.

    Pairs of words of m letters come in both orders, pairs of words of m + 1 letters not at all.
    """
    points = np.array(words).view(np.uint32).reshape(len(words), -1)
    size = np.array([len(w) for w in words])
    inside = np.flatnonzero(size == m)
    if not len(inside):
        return inside, inside
    longer = np.flatnonzero(size == m + 1)
    letters, code = np.unique(points, return_inverse=True)
    code = code.reshape(points.shape)
    own = code[inside]
    labels = np.unique(group, return_inverse=True)[1]
    members = np.zeros((labels.max() + 1, len(inside)), bool)
    members[labels[inside], np.arange(len(inside))] = True
    exact = _bits(members)[labels]
    replaced, extra = np.zeros_like(exact), np.zeros_like(exact)
    before = None
    for i in range(m + 1):
        here = None
        if i < m:
            flags = np.zeros((len(letters), len(inside)), bool)
            flags[own[:, i], np.arange(len(inside))] = True
            here = _bits(flags)
        ask = code[:, i] if i < code.shape[1] else None
        if i == m:  # the last letter of the longer queries
            ask = code[longer, m] if len(longer) else ask
            extra = (extra[longer] & before[ask]) | exact[longer] if len(longer) else extra[:0]
            break
        same = here[ask]
        extra = (extra & before[ask]) | exact if i else exact.copy()
        replaced = (replaced & same) | (exact & ~same)
        exact = exact & same
        before = here
    q, v = _set_bits(replaced[inside], len(inside))
    r, w = _set_bits(extra, len(inside))
    return np.concatenate([inside[q], longer[r]]), np.concatenate([inside[v], inside[w]])


def _near(block: int):
    """Near pairs of rows sorted by key, a block of whole groups of one m at a time; each pair in both orders."""
    def pairs(held: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
        words = [h[0] for h in held]
        n = np.array([h[1] for h in held], np.int64)
        group = np.cumsum([i > 0 and held[i][3] != held[i - 1][3] for i in range(len(held))])
        a, b = one_edit(words, group, held[0][2])
        back = np.array([len(w) for w in words])[a] > held[0][2] if len(a) else np.zeros(0, bool)
        x, y = np.concatenate([a, b[back]]), np.concatenate([b, a[back]])
        names = pa.array(words, pa.string())
        return pa.RecordBatch.from_arrays([names.take(pa.array(x)), names.take(pa.array(y)), pa.array(n[y])], names=["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # whole groups, and the one that is still open from ``start``
        start = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "m", "key"))):
                if held and row[3] != held[-1][3]:
                    if len(held) >= block or row[2] != held[-1][2]:
                        yield pairs(held)
                        held, start = [], 0
                    else:
                        start = len(held)
                elif len(held) > block and start:
                    yield pairs(held[:start])
                    held, start = held[start:], 0
                held.append(row)
        if held:
            yield pairs(held)
    return run


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain word -> form, by doubling the step; counts rise, so chains end."""
    steps = written(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return steps


def variant_groups(docs: DataFrame, least: int = LEAST_LETTERS, often: int = LEAST_COUNT, ratio: int = RATIO, every: int = EVERY,
                   limit: int = GROUP, block: int = BLOCK) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    docs: doc_id, text; other columns are not read. Words: see ``vocabulary``. Two words are near if one inserted,
    deleted or replaced letter makes one of the other. form: the near word of largest n (ties: the smallest), if its n
    is at least ``ratio`` times the word's, else null; root: the last form of the chain that begins at the word, itself
    without a form; n_near: how many words are near; form_n: n of the form. Null and empty texts hold no word, an
    empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words")
    words = written(vocabulary(docs, least, often, every))
    met = spread(groups(words, least, limit), "key").sortWithinPartitions("key").mapInArrow(_near(block), "word string, near string, near_n long")
    near = (spread(met, "word").groupBy("word", "near").agg(F.first("near_n").alias("near_n"))
            .groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")))
    fits = F.expr(f"-best.less >= {ratio} * n")
    table = written(words.join(near, "word", "left").select(
        "word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, -F.col("best.less")).alias("form_n")))
    roots = _roots(table.filter("form is not null"))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
