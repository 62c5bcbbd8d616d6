"""Inputs at the edges: wide, null and repeated doc_ids, clashing column names, long and broken pages, ties of hashes."""

import random
import re
import time

import numpy as np
import pytest

from pyspark.sql import functions as F

from labelwatch.llm import bestfit_pack, html_region, winnow

PLAIN = html_region.Weights(0.5, {"link True": -4.0}, {"li": -1.0, "ul": -1.0, "a": -1.0})


def chosen_hashes(text):
    """Winnowing by its definition: (hash, position) of the rightmost smallest hash of each window."""
    xxhash = pytest.importorskip("xxhash")
    units = re.findall(winnow.UNIT, text or "")
    if not units:
        return []
    if len(units) < winnow.K:
        units = [" ".join(units)]
    codes = []
    for u in units:
        h = xxhash.xxh64(u.encode(), seed=42).intdigest()
        codes.append((h - (1 << 64) if h >> 63 else h) % winnow.PRIME)
    span = min(winnow.K, len(codes))
    hashes = []
    for i in range(len(codes) - span + 1):
        h = 0
        for c in codes[i: i + span]:
            h = (h * winnow.BASE + c) % winnow.PRIME
        hashes.append(h)
    out = []
    for i in range(max(1, len(hashes) - winnow.W + 1)):
        window = hashes[i: i + winnow.W]
        low = min(window)
        pick = (low, i + max(j for j, h in enumerate(window) if h == low))
        if pick not in out:
            out.append(pick)
    return out


def test_winnowing_is_its_definition(spark):
    rng = random.Random(11)
    texts = [None, "", " ", "one", "a b c", "a b c d", "a " * 40, "é ü ß 漢字 " * 5, "antidisestablishmentarianism " * 4]
    texts += [" ".join(rng.choices("abc", k=rng.randint(1, 60))) for _ in range(30)]  # few words: many equal hashes
    texts += [" ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(1, 200))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in winnow.fingerprints(df).collect():
        got = [(x >> 32, winnow.LOW - (x & winnow.LOW)) for x in r.chosen]
        assert got == chosen_hashes(texts[r.doc_id]), texts[r.doc_id]


@pytest.mark.parametrize("bucket_rows, cuts", [(2, 3), (1, 1000)])
@pytest.mark.parametrize("ids", [
    range(20), [5], [7, 7, 7, 7, 8, 8, 9], [-(1 << 63), -5, 0, 1, 2, 3, (1 << 63) - 1], [None, 3, None, 1, 2],
    [None], [*range(15), 1 << 62], [(1 << 62) + i for i in range(9)]], ids=str)
def test_next_document(spark, monkeypatch, bucket_rows, cuts, ids):
    monkeypatch.setattr(winnow, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(winnow, "CUTS", cuts)
    rows = [(k, f"t{i:03}") for i, k in enumerate(ids)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {t: order[(i + 1) % len(order)][1] for i, (_, t) in enumerate(order)}
    assert {r.text: r.next_text for r in winnow.with_next(df, ["text"]).collect()} == want


def test_pack_keeps_columns_of_any_name(spark):
    names = ["rank", "slot", "slots", "bucket", "nth", "before", "row", "_rank", "_bucket", "c", "a.b"]
    rows = [(i, 0, 1 + i % 7, *[f"{n}{i}" for n in names]) for i in range(50)]
    schema = "doc_id long, piece int, length long, " + ", ".join(f"`{n}` string" for n in names)
    got = bestfit_pack.pack(spark.createDataFrame(rows, schema), 10)
    assert got.columns == ["doc_id", "piece", "length", *names, "sequence_id", "offset"]
    assert sorted(tuple(r)[:-2] for r in got.collect()) == rows
    again = bestfit_pack.pack(got, 10)  # its own columns are replaced
    assert again.columns == got.columns and again.count() == 50


def test_pack_refuses_null_lengths(spark):
    with pytest.raises(ValueError):
        bestfit_pack.pack(spark.createDataFrame([(1, 0, None)], "doc_id long, piece int, length long"))


def article(*parts):
    menu = "<nav><ul>" + "<li><a href='x'>Menu entry</a></li>" * 8 + "</ul></nav>"
    return f"<body>{menu}<article>{''.join(parts)}</article><footer>Foot</footer></body>"


def test_lists_of_links_stay_in_the_article():
    lead, tail = "<p>" + "lead " * 30 + "</p>", "<p>" + "tail " * 40 + "</p>"
    links = "<ul>" + "<li><a href='y'>A linked reference</a></li>" * 6 + "</ul>"
    table = "<table>" + "<tr><td>1</td><td><a href='z'>two</a></td></tr>" * 30 + "</table>"
    for middle in (links, table, links * 5):
        lines = html_region.main_text(article("<h1>Head</h1>", links, lead, middle, tail, links), PLAIN).split("\n")
        assert lines[0] == "Head" and lines.count("A linked reference") == 12 + middle.count("linked") and lines[-1] == "A linked reference"
        assert any(x.startswith("lead") for x in lines) and any(x.startswith("tail") for x in lines)
        assert "Menu entry" not in lines and "Foot" not in lines


def test_other_articles_of_a_page_do_not_join():
    cards = "<section>" + "<article><a href='c'>Another story with a title</a></article>" * 6 + "</section>"
    page = f"<body><article><p>{'word ' * 50}</p></article>{cards}</body>"
    assert html_region.main_text(page, PLAIN) == ("word " * 50).strip()


def test_class_names_of_content():
    page = article("<p>Some words first.</p>", "<section class='related-work'><p>Earlier papers.</p></section>",
                   "<p class='tag-line'>A line.</p>", "<div class='related-posts'><p>No.</p></div>")
    assert html_region.main_text(page, PLAIN) == "Some words first.\nEarlier papers.\nA line."


def best_by_all_ranges(scores):
    return max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])


def test_scan_finds_the_best_of_all_ranges():
    rng = random.Random(4)
    for _ in range(60):
        page = "".join(rng.choice(["<p>one two</p>", "<a>link words</a>", "<li>", "</li>", "text ", "<b>x</b>", "<ul>"]) for _ in range(12))
        weights = html_region.Weights(rng.uniform(-1, 1), {"link True": rng.uniform(-3, 1), "block p": rng.uniform(-1, 2)},
                                      {t: rng.uniform(-1, 0) for t in ("p", "a", "li", "b", "ul")})
        found = html_region.runs(page)
        scores = [weights.of(r) for r in found]
        words = html_region.main_text(page, weights).split()
        spans = [(i, j) for i in range(len(found)) for j in range(i + 1, len(found) + 1)
                 if "".join(" " if r.tag in ("p", "li", "ul", "/p", "/li") else r.text for r in found[i:j]).split() == words]
        best = best_by_all_ranges(scores)
        assert not words and best < 1e-9 or any(abs(sum(scores[i:j]) - best) < 1e-9 for i, j in spans)


def pair_of_quotes(k):
    return '<a "x>y" ' * k + '"'


@pytest.mark.parametrize("make", [
    lambda k: "<a " * k, lambda k: "<!x" * k, lambda k: "<!--x" * k, lambda k: "<i>" * k + "</i>" * k, lambda k: "<i>" * k + "</b>" * k,
    lambda k: "<div>" + "<i>t" * k, lambda k: "<b '" * k, pair_of_quotes, lambda k: "<p class='" + "a " * k + "'>x", lambda k: "&#" + "9" * k,
    lambda k: "&#" + "0" * k + "65;", lambda k: "<script" * k, lambda k: "<article>" * k, lambda k: "<nav>" * k + "x"])
def test_broken_pages_take_linear_time(make):
    start = time.perf_counter()
    html_region.main_text(make(60_000), PLAIN)
    assert time.perf_counter() - start < 20


def test_ends_of_tags():
    text = {"<p>a</p><": "a\n<", "<p title='x>y'>a": "a", '<p title="x>y>a': "y>a", "a <b": "a <b", "1 < 2": "1 < 2", "<!doctype html>a": "a",
            "&#0000065;&#99999999999999999999;": "A�"}
    for page, want in text.items():
        assert html_region.main_text(page, html_region.Weights(1.0, {}, {})) == want, page


def test_texts_of_needed_documents_are_marked_without_a_shuffle_of_texts(spark):
    """Marks of first, last, negative and widest ids; every linked copy is found and no text crosses an exchange."""
    from labelwatch.llm import jaccard_join as jj

    ids = [0, 1, -1, 32768, 2**63 - 1, -2**63, *range(1000, 1500)]
    flags = jj.marked(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    slot = jj.id_slots(np.array(ids))
    assert (flags[slot >> 3] >> (slot & 7) & 1).all() and np.bitwise_count(flags).sum() == len(set(slot.tolist()))

    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(-5, words), (3, words + " x"), (2**62, "y " + words), (9, "other text " * 9), (11, None)], "doc_id long, text string")
    meta = spark.createDataFrame([(-5, 56), (3, 57), (2**62, 57)], "doc_id long, n int").withColumn("bits", F.unhex(F.lit("FF")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    seen, kept = [], jj.written
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    jj.written = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df)
    try:
        pairs = spark.createDataFrame([(-5, 3), (3, 2**62)], "a long, b long")
        links = {tuple(r) for r in jj.verified(docs, meta, pairs, 5, 80).collect()}
    finally:
        jj.written = kept
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert links == {(-5, 3), (3, 2**62)}
    assert not any("Exchange" in p and "text#" in p for p in seen) and any("text#" in p for p in seen)


def test_a_task_that_cuts_pieces_holds_little_of_a_large_batch():
    """Some 8 MB of text in one batch: arrays of a slice, not of the batch; every document has its pieces."""
    import tracemalloc
    from types import SimpleNamespace

    import public_tokenizers
    import pyarrow as pa

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=600)) for _ in range(2000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        run = bestfit_pack._pieces(SimpleNamespace(value=f.read()), 2048, 0)
    list(run([batch.slice(0, 1)]))  # the tokenizer and the table of classes are there once for all tasks
    tracemalloc.start()
    try:
        found = [i for part in run([batch]) for i in part.column("doc_id").to_pylist()]
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert set(found) == set(range(len(texts)))
    assert peak < 80, peak
