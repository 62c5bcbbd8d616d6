"""Line index, token alignment and spelling variants against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from labelwatch.llm import line_index, spelling_variants, token_align

LINES = ["The same footer line", "  the SAME footer line\r", "short", "", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "nine nine", "0123456789", "\t0123456789 \x0b"]


def line_texts():
    rng = random.Random(3)
    out = [None, "", "\n\n", "x" * 300_000 + "\n" + "x" * 300_000, "x" * 300_000, "twice in one\ntwice in one", "twice in one"]
    for i in range(60):
        own = [rng.choice(LINES) if rng.random() < 0.4 else f"a line of its own {rng.randint(0, 40)}" for _ in range(rng.randint(0, 12))]
        out.append("\n".join(own))
    return {7 * i + 2: t for i, t in enumerate(out)}


def fresh_run(texts):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return re.sub("[A-Z]", lambda m: m[0].lower(), k)
    first = {}
    for i in sorted(texts):
        for k in {key(x) for x in (texts[i] or "").split("\n")}:
            first.setdefault(k, i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def table(spark, texts):
    return spark.createDataFrame([(i, t, "u", 1) for i, t in texts.items()], "doc_id long, text string, row string, n_lines long").repartition(3)


def test_line_dedup(spark):
    texts = line_texts()
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_index.dedup_lines(table(spark, texts)).collect()}
    assert got == fresh_run(texts)


def test_insertions_and_deletions_equal_a_fresh_run(spark):
    """Small shards, so that filters are split while the index grows."""
    texts = line_texts()
    ids = sorted(texts)
    rng = random.Random(9)
    rng.shuffle(ids)
    index, live = line_index.LineIndex(spark, shard_keys=12), {}
    steps = [("in", ids[:20]), ("in", ids[20:]), ("out", [*ids[5:45], 10**6]), ("in", ids[10:12])]
    for what, own in steps:
        if what == "in":
            part = {i: texts[i] for i in own}
            live.update(part)
            index = index.insert(table(spark, part))
        else:
            index = index.delete(spark.createDataFrame([(i,) for i in own] + [(None,)], "doc_id long"))
            live = {i: t for i, t in live.items() if i not in own}
        docs = table(spark, live)
        kept = index.kept(docs, n_dropped="lost")
        assert kept.columns == [*docs.columns, "lost"]
        want = fresh_run(live)
        assert {r.doc_id: (r.lost, r.text) for r in kept.collect()} == {
            i: (want[i][1], want[i][2] if want[i][1] else live[i]) for i in live}
        keys = {k for t in live.values() for line in (t or "").split("\n") if (k := line_index._digest(line.encode(), 10))}
        assert index.n_keys == len(keys)
        pair = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2).view(np.uint64)
        filters = {r.shard: line_index.CuckooFilter.from_bytes(bytes(r.filter), index._buckets()) for r in index.filters.collect()}
        shard = (pair[:, 0] >> np.uint64(64 - index.shard_bits)).astype(int) if index.shard_bits else np.zeros(len(pair), int)
        assert all(filters[s].contains(p[:1], p[1:])[0] for s, p in zip(shard, pair))
        assert sum(int((f.table > 0).sum()) + len(f.stash) for f in filters.values()) == len(keys)
    assert index.shard_bits > 1
    with pytest.raises(ValueError):
        index.insert(table(spark, {next(i for i in live if "own" in (live[i] or "")): "a line to come again"}))


def test_rows_without_or_with_equal_doc_id(spark):
    line = "one line of many"
    rows = [(None, line), (None, line + "\nb"), (4, line), (4, line + "\nmore"), (9, "c\n" + line)]
    got = sorted((r.doc_id or 0, r.n_dropped, r.kept_text) for r in
                 line_index.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(0, 0, line), (0, 0, line + "\nb"), (4, 0, line), (4, 0, line + "\nmore"), (9, 1, "c")])


def test_cuckoo_filter():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 64, (4000, 2), dtype=np.uint64)
    keys[:40] = keys[0]  # more equal keys than two buckets hold: the rest waits in the stash
    full = line_index.CuckooFilter(1024)
    full.insert(keys[:, 0], keys[:, 1])
    assert full.contains(keys[:, 0], keys[:, 1]).all() and len(full.stash) >= 32
    assert int((full.table > 0).sum()) + len(full.stash) == len(keys)
    other = rng.integers(0, 1 << 64, (4000, 2), dtype=np.uint64)
    assert full.contains(other[:, 0], other[:, 1]).mean() < 0.01
    full.remove(keys[:3000, 0], keys[:3000, 1])
    assert full.contains(keys[3000:, 0], keys[3000:, 1]).all() and int((full.table > 0).sum()) + len(full.stash) == 1000
    assert full.contains(keys[:3000, 0], keys[:3000, 1]).mean() < 0.01
    back = line_index.CuckooFilter.from_bytes(full.to_bytes(), 1024)
    back.remove(keys[3000:, 0], keys[3000:, 1])
    assert not back.table.any() and not len(back.stash)


def test_alignment_finds_all_common_ends():
    rng = random.Random(2)
    for turn in range(300):
        n = rng.randint(1, 200)
        share = rng.choice([0.2, 0.6, 0.95])
        a = sorted({n} | {x for x in range(1, n) if rng.random() < share})
        b = sorted({n} | {x for x in range(1, n) if (x in a) == (rng.random() < share)})
        runs, groups, left, right = token_align.align(a, b)
        cover_a = [i for i, _, s in runs for i in range(i, i + s)] + [i for g in groups for i in range(g[0], g[1])]
        cover_b = [j for _, j, s in runs for j in range(j, j + s)] + [j for g in groups for j in range(g[2], g[3])]
        assert sorted(cover_a) == list(range(len(a))) and sorted(cover_b) == list(range(len(b)))
        ends = {a[i + k] for i, _, s in runs for k in range(s)} | {a[g[1] - 1] for g in groups}
        assert ends == set(a) & set(b)
        links = {(i + k, j + k) for i, j, s in runs for k in range(s)} | set(zip(left, right))
        spans = lambda e: list(zip([0, *e], e))
        assert links == {(i, j) for i, p in enumerate(spans(a)) for j, q in enumerate(spans(b)) if max(p[0], q[0]) < min(p[1], q[1])}
        assert not any(g[1] - g[0] == g[3] - g[2] == 1 for g in groups)


@pytest.mark.parametrize("hot_pairs", [token_align.HOT_PAIRS, 40])
def test_linked_tokens(spark, hot_pairs):
    """Against the two libraries and all overlaps; 40 hot pairs at most leave most links to the join."""
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    import public_tokenizers as P

    rng = random.Random(8)
    vocabulary = ["tokenization", "naïve", "日本語", "\U0001f600", "don't", "x1y2", "hello", "world", "antidisestablishment", "  ", "\n", "é", "Zürich"]
    texts = [None, "", " ", "a", "<|endoftext|> <s> </s> <unk> ▁ ▁x", "\x00\x01", "é", " " * 3000, "word " * 2000, "ab" * 4000]
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(40)] + ["same text"] * 3
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs int").repartition(3)
    a = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    own = token_align.ByteTokens(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read(), P.PATTERN)
    pieces = token_align.Pieces(open(P.path("piece_bpe_32k.model"), "rb").read())
    links, shown = [], []
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        bytes_a, bytes_b = [own.pieces[i] for i in ids_a], [pieces.pieces[i] for i in ids_b]
        if not t or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            links.append(Counter())
            shown.append((0, 0, 0, ""))
            continue
        spans = [list(zip(np.cumsum([0, *map(len, x)]).tolist(), np.cumsum([len(y) for y in x]).tolist())) for x in (bytes_a, bytes_b)]
        own_links, j = Counter(), 0
        for i, p in enumerate(spans[0]):
            while spans[1][j][1] <= p[0]:
                j += 1
            k = j
            while k < len(ids_b) and spans[1][k][0] < p[1]:
                own_links[ids_a[i], ids_b[k]] += 1
                k += 1
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        parts, before = [], 0
        for e in ends:
            parts.append("|".join(",".join(str(i) for i, s in zip(ids, span) if before <= s[0] < e) for ids, span in zip((ids_a, ids_b), spans)))
            before = e
        links.append(own_links)
        shown.append((len(ids_a), len(ids_b), len(ends), hashlib.sha256(";".join(parts).encode()).hexdigest()))
    counts = Counter(p for x in links for p in x)
    best = {}
    for (i, _), c in counts.items():
        best[i] = max(c, best.get(i, 0))
    want = []
    for row, x, s in zip(rows, links, shown):
        want.append((row[0], *s[:3], sum(x.values()), sum(n for p, n in x.items() if counts[p] == best[p[0]]),
                     sum(n * counts[p] for p, n in x.items()), s[3]))
    got = token_align.linked_tokens(docs, P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"), hot_pairs).collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(1 for s in shown if s[3]) > 45


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_one_edit_of_a_block():
    rng = random.Random(4)
    for m in (1, 2, 6, 9):
        words = sorted({"".join(rng.choices("abé", k=rng.choice([m, m + 1]))) for _ in range(150)})
        group = np.array([rng.randint(0, 2) for _ in words])
        a, b = spelling_variants.one_edit(words, group, m)
        want = {(i, j) for i, x in enumerate(words) for j, y in enumerate(words)
                if near(x, y) and group[i] == group[j] and (len(x), len(y)) in ((m, m), (m + 1, m))}
        assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


@pytest.mark.parametrize("limit,block", [(spelling_variants.GROUP, spelling_variants.BLOCK), (3, 5)])
def test_spelling_variants(spark, limit, block):
    """Groups of more than 3 words are split again and again in the second case."""
    rng = random.Random(6)
    texts = [None, "", "short ones only", "ÀÉÎÕÜ×÷ " * 30, "z" * 5000 + " " + "z" * 4999]
    base = ["".join(rng.choices("abcé", k=rng.randint(5, 8))) for _ in range(30)]
    for _ in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(base)
            if rng.random() < 0.3:
                at = rng.randint(0, len(w))
                w = w[:at] + rng.choice(["", "a", "b"]) + w[at + rng.randint(0, 1):]
            words.append(rng.choice([w, w.upper(), w]))
        texts.append(rng.choice([" ", "1", "\n"]).join(words))
    texts += ["z" * 5000 + " " + "z" * 4999] * 5
    rows = [(i if i != 10 else None, t, "x") for i, t in enumerate(texts)]
    counts = Counter()
    for i, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    want, form = {}, {}
    for w in n:
        beside = [v for v in n if near(w, v)]
        top = min(beside, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top and n[top] >= 5 * n[w] else None
        want[w] = len(beside)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.variant_groups(
        spark.createDataFrame(rows, "doc_id long, text string, word string"), limit=limit, block=block).collect()}

    def root(w):
        return root(form[w]) if form[w] else w
    assert got == {w: (form[w], root(w), n[w], want[w], n.get(form[w])) for w in n}
    assert sum(1 for w in n if form[w]) > 5


def test_empty_tables(spark):
    import public_tokenizers as P

    nothing = spark.createDataFrame([], "doc_id long, text string")
    for out in (line_index.dedup_lines(nothing), spelling_variants.variant_groups(nothing),
                token_align.linked_tokens(nothing, P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"))):
        assert out.count() == 0
    index = line_index.LineIndex(spark).insert(nothing).delete(nothing.select("doc_id"))
    assert index.kept(nothing).count() == 0
