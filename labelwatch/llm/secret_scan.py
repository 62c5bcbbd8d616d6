"""Secret scan in DataFrame functions only: fixed patterns, and Markov models of random and ordinary strings.

Positions of pattern matches: the text is split by the pattern and its matches are extracted; running sums of the
lengths of parts and matches give each start in code points. All steps take time in proportion to a text, up to the
logarithm of its number of matches: sums double their steps, substrings are taken from chunks of bounded length.

Markov part: candidates are runs of 20 and more characters of A-Z a-z 0-9 + / _ = - . Two first-order character
models are compared by the log-likelihood ratio over a candidate's character pairs. The model of random strings is
trained from the values that the fixed patterns found, the model of ordinary identifiers from words of 8 to 19 such
characters, both in all documents. Both back off to single characters. A candidate is a secret if the ratio
exceeds the prior odds against it and its span meets no pattern match.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwatch.llm.blocks import written

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a greedy run of 16 and more
HEX = r"[0-9a-f]{32,}"  # the whole run, since a match starts where the run does
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,19}(?![A-Za-z0-9+/_=-])"  # too short for a candidate
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
ODDS = math.log(10_000)
BACK_OFF = 16
CHUNK = 4096
FAR = 2**31 - 1


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once: an expression inside a lambda would be computed again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, merge, rest: int) -> Column:
    """Running sums, maxima or minima by ``merge``; ``rest`` changes nothing. Steps double, so n log n operations."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda j: F.pow(F.lit(2), j).cast("int"))

    def step(done: Column, k: Column) -> Column:
        return F.transform(done, lambda x, i: merge(x, F.when(i >= k, F.get(done, i - k)).otherwise(F.lit(rest))))
    return F.aggregate(F.filter(steps, lambda k: k < F.size(values)), values, step)


def _matches(text: str, pattern: str, value: int, kind: int) -> Column:
    """Array of (start, kind, end, value) of all matches; value: the group that holds the secret."""
    whole = F.lit(pattern)
    found = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, whole, F.lit(0)).alias("hits"),
                     F.regexp_extract_all(text, whole, F.lit(value)).alias("values"))

    def spans(f: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(f["hits"], lambda h: F.length(h)))
        gaps = F.zip_with(F.slice(f["parts"], F.lit(1), F.size(f["hits"])), F.slice(before, F.lit(1), F.size(f["hits"])),
                          lambda p, n: F.length(p) + n)
        starts = _bound(gaps, lambda g: _running(g, lambda x, y: x + y, 0))
        return F.transform(F.arrays_zip(starts.alias("start"), f["hits"].alias("hit"), f["values"].alias("value")), lambda z: F.struct(
            z["start"].alias("start"), F.lit(kind).alias("kind"), (z["start"] + F.length(z["hit"])).alias("end"), z["value"].alias("value")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.when(F.col(text).rlike(pattern), _bound(found, spans)).otherwise(none)


def base_spans(docs: DataFrame) -> DataFrame:
    """row (all columns of docs but the text), text, base (pattern spans) and candidates (Markov candidates), as a written table."""
    others = [c for c in docs.columns if c != "text"]
    found = docs.select(F.struct(*others).alias("row"), "text", F.coalesce("text", F.lit("")).alias("whole"))
    found = found.select("row", "text", _matches("whole", ASSIGN, 2, 0).alias("a"), _matches("whole", ACCESS, 0, 1).alias("b"),
                         _matches("whole", HEX, 0, 2).alias("c"), _matches("whole", CANDIDATE, 0, 3).alias("candidates"))
    return written(found.select("row", "text", F.array_sort(F.concat(F.filter("a", lambda s: F.length(s["value"]) >= 8), "b", "c")).alias("base"),
                                "candidates"))


def _letters(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def _neighbours(letters: Column, merge) -> Column:
    """merge(x, y) of each two neighbours of an array."""
    n = F.size(letters) - 1
    return F.zip_with(F.slice(letters, F.lit(1), n), F.slice(letters, F.lit(2), n), merge)


def _pair_counts(strings: DataFrame) -> np.ndarray:
    """Counts of character pairs of a column of strings; the alphabet's square is what reaches the driver."""
    n = len(ALPHABET)
    pairs = strings.filter("length(s) > 1").select(F.explode(_bound(_letters(F.col("s")), lambda c: _neighbours(c, lambda x, y: F.concat(x, y)))).alias("p"))
    counts = np.zeros((n, n))
    for pair, c in pairs.groupBy("p").count().collect():
        counts[ALPHABET.index(pair[0]), ALPHABET.index(pair[1])] += c
    return counts


def _transitions(counts: np.ndarray) -> np.ndarray:
    """Probability of the second character after the first, backed off to its own frequency."""
    n = len(ALPHABET)
    single = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * n)
    return (counts + BACK_OFF * single) / (counts.sum(1, keepdims=True) + BACK_OFF)


def pair_ratios(docs: DataFrame, base: DataFrame) -> list[float]:
    """Log-likelihood ratio (random against ordinary) of each character pair, by first and second character."""
    values = base.select(F.explode("base.value").alias("s"))
    # what the patterns call secret is no ordinary word; a match of HEX is too long to be one
    found = [F.regexp_extract_all("text", F.lit(pattern), F.lit(i)) for pattern, i in ((WORD, 0), (ASSIGN, 2), (ACCESS, 0))]
    words = docs.filter("text is not null").select(F.explode(F.array_except(found[0], F.concat(*found[1:]))).alias("s"))
    ratio = np.log(_transitions(_pair_counts(values))) - np.log(_transitions(_pair_counts(words)))
    return [round(x, 6) for x in ratio.ravel().tolist()]


def _scanned(docs: DataFrame) -> DataFrame:
    """row, text, base and spans of every row of docs, each from its own text alone but for the models."""
    base = base_spans(docs)
    ratios = F.array(*[F.lit(x) for x in pair_ratios(docs, base)])
    n, letters = len(ALPHABET), F.lit(ALPHABET)

    def surprise(s: Column) -> Column:
        codes = F.transform(_letters(s), lambda c: F.instr(letters, c) - 1)
        return F.aggregate(_bound(codes, lambda c: _neighbours(c, lambda x, y: F.element_at(ratios, x * n + y + 1))), F.lit(0.0), lambda t, x: t + x)

    def free(every: Column) -> Column:
        """Pattern spans, and the candidates that meet none of them and look random; every: all in order of start."""
        reach = F.transform(every, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(F.lit(0)))
        ahead = F.reverse(F.transform(every, lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(F.lit(FAR))))
        before = _bound(reach, lambda x: _running(x, F.greatest, 0))
        after = F.reverse(_bound(ahead, lambda x: _running(x, F.least, FAR)))
        beside = F.arrays_zip(every.alias("span"), before.alias("before"), after.alias("after"))
        kept = F.filter(beside, lambda z: (z["span"]["kind"] < 3) | ((z["before"] <= z["span"]["start"]) & (z["after"] >= z["span"]["end"])
                                                                  & (surprise(z["span"]["value"]) > ODDS)))
        return F.transform(kept, lambda z: z["span"])
    spans = F.when(F.size("candidates") == 0, F.col("base")).otherwise(_bound(F.array_sort(F.concat("base", "candidates")), free))
    return base.select("row", "text", "base", spans.alias("spans"))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end, value) in order of start, then kind; ends are exclusive.

    kind counts in KINDS. spans are the base spans and the Markov ones that meet no base span. docs: doc_id, text;
    other columns are not read. One row per row, whatever its doc_id. Null and empty texts have no spans. Without any
    base span the random model is uniform. An empty table gives an empty result.
    """
    return _scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("row.doc_id", "base", "spans")


def spelled(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _number(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")


def counted(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *map(_number, range(3)), F.sha2(spelled("base").cast("binary"), 256).alias("base_sha256"),
                        spelled("spans").alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with all their columns, every span of a secret replaced by the mark (overlapping spans by one).

    A row's text is redacted from its own spans, so null and repeated doc_ids make no difference.
    """
    def cut(chunks: Column, start: Column, end: Column) -> Column:
        """Characters start .. end of the text that the chunks hold."""
        a, b = (start / CHUNK).cast("int"), ((end - 1) / CHUNK).cast("int")
        head = lambda length: F.substring(F.get(chunks, a), start - a * CHUNK + 1, length)
        across = F.concat(head(F.lit(CHUNK)), F.array_join(F.slice(chunks, a + 2, b - a - 1), ""),
                          F.substring(F.get(chunks, b), F.lit(1), end - b * CHUNK))
        return F.when(end <= start, "").when(a == b, head(end - start)).otherwise(across)

    def pieces(chunks: Column) -> Column:
        ends = _bound(F.transform("spans", lambda s: s["end"]), lambda x: _running(x, F.greatest, 0))

        def joined(e: Column) -> Column:
            gaps = F.zip_with(F.concat(F.array(F.lit(0)), F.slice(e, F.lit(1), F.size(e) - 1)), F.col("spans"),
                              lambda x, s: F.struct(x.alias("start"), s["start"].alias("end")))
            tail = F.struct(F.element_at(e, -1).alias("start"), F.length("text").alias("end"))
            open_ = F.concat(F.filter(gaps, lambda g: g["end"] >= g["start"]), F.array(tail))
            return F.array_join(F.transform(open_, lambda g: cut(chunks, g["start"], g["end"])), mark)
        return _bound(ends, joined)
    clean = _bound(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), pieces)
    return _scanned(docs).select(*[
        F.when(F.size("spans") == 0, F.col("text")).otherwise(clean).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
