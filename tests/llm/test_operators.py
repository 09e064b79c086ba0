"""Each operator against a brute-force version, the library itself, or held-out rows; and its edge cases."""

import itertools
import random
import re

import brute
import numpy as np
import public_tokenizers
import pytest

from quern.llm import ann, decontaminate, graph, html_text, line_dedup, near_dedup, packing, quality, substring_dedup, suffix_dedup, token_counts

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, grp int, key string, n_words string"  # some names clash with inner ones
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus() -> list[tuple]:
    rng = random.Random(4)
    shared, line = words(rng, 60), "\n".join(words(rng, 8) for _ in range(12))
    base = words(rng, 120, 5000)
    texts = [None, "", " ", "x", "x", "one two", "one two", "\n\n\n", "é" * 300, "a" * 1500, "ab " * 700, base, base, base.upper(), base + " tail", words(rng, 5) + " " + base, shared, words(rng, 40) + " " + shared, shared + words(rng, 30) + "\t" + shared, line, words(rng, 9) + "\n" + line, line + "\n" + line]
    for k in range(30):
        near = base.split()
        near[k * 3 % 120] = f"changed{k}"
        texts.append(" ".join(near))
    texts += [words(rng, rng.randrange(1, 200)) + "\n" + words(rng, 20) for _ in range(30)]
    texts.append(" ".join(words(rng, 300, 10**6) for _ in range(60)))
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "k", "n") for i, t in rows], DOCS).repartition(5)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_substring(docs, rows):
    got = {r.doc_id: (r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept_text.encode())) for r in substring_dedup.remove_repeated_windows(docs).collect()}
    assert got == {r[0]: r for r in brute.substring(rows, 35)}
    assert sum(r[2] for r in got.values()) > 500


@pytest.mark.parametrize("bits", [3, 12])
def test_substring_tells_windows_of_one_short_hash_apart(docs, rows, bits):
    """With so few bits nearly all windows meet in the first count; the second one decides."""
    got = {r.doc_id: (r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept_text.encode())) for r in substring_dedup.remove_repeated_windows(docs, bits=bits).collect()}
    assert got == {r[0]: r for r in brute.substring(rows, 35)}


def test_equal_rows_of_null_id_spread_over_groups(spark, tmp_path):
    from pyspark.sql import functions as F

    from quern.llm.common import row_salted

    text = " ".join(f"word{k}" for k in range(40))
    same = spark.createDataFrame([(None, text)] * 10000, "doc_id long, text string").repartition(3)
    same.write.parquet(str(tmp_path / "same"))
    for df in (same, spark.read.parquet(str(tmp_path / "same"))):
        salted = row_salted(df, F.col("text"))
        assert salted.select("salt").distinct().count() == 10000
        most = salted.groupBy(F.pmod("salt", F.lit(32)).alias("grp")).count().agg(F.max("count")).first()[0]
        assert most < 500
        assert substring_dedup.remove_repeated_windows(df).filter("n_removed = 40").count() == 10000
        assert suffix_dedup.remove_repeated_bytes(df).filter("n_removed = n_bytes").count() == (10000 if len(text) >= 200 else 0)


@pytest.mark.parametrize("hot", [512, 1])
def test_suffix(docs, rows, hot):
    got = {r.doc_id: (r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in suffix_dedup.remove_repeated_bytes(docs, hot_groups=hot).collect()}
    assert got == {r[0]: r for r in brute.suffix(rows, 200)}


def test_suffix_of_a_very_long_text(spark, monkeypatch):
    rng = random.Random(1)
    part = words(rng, 500, 10**6)
    rows = [(1, words(rng, 6000, 10**6) + part + words(rng, 6000, 10**6) + part), (2, part)]
    monkeypatch.setattr(suffix_dedup, "MOST_SLICE", 1 << 12)
    column = __import__("pyarrow").array([t for _, t in rows])
    parts = suffix_dedup.slices(column, 200, 48)
    assert len(parts) > 3 and all(len(a.data) <= (4 << 12) + 199 for _, _, before, a in parts if before)
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeated_bytes(frame(spark, rows)).collect()}
    assert got == {r[0]: (r[2], r[4]) for r in brute.suffix(rows, 200)}


def test_deep_shallow_order():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 3, (600, 32)).astype(np.uint8)
    rows[100:400, :30] = rows[100, :30]
    for shallow in (0, 1, 3, 8):
        order = suffix_dedup.deep_shallow_sort(rows, shallow)
        assert sorted(order.tolist()) == list(range(600))
        assert [bytes(rows[i]) for i in order] == sorted(map(bytes, rows))
    texts = sorted({bytes(r) for r in rows}, key=hash)
    assert [texts[i] for i in suffix_dedup.blind_trie_order(texts)] == sorted(texts)


def test_repeated_strings_of_surroundings():
    """Every (row, d) against all pairs of rows."""
    rng = np.random.default_rng(3)
    length, gram = 24, 8
    reach = length - gram
    for _ in range(20):
        base = rng.integers(0, 2, (6, reach + length)).astype(np.uint8)
        full = base[rng.integers(0, 6, 40)]
        for row in full:
            for _ in range(rng.integers(0, 3)):
                row[rng.integers(0, reach + length)] ^= 1
        full = np.unique(full, axis=0)
        least = rng.integers(0, 6, len(full))
        most = least + rng.integers(0, reach - 5, len(full))
        got = suffix_dedup.repeated_strings(np.ascontiguousarray(full[:, :reach][:, ::-1]), np.ascontiguousarray(full[:, reach:]), gram, least, most)
        for i in range(len(full)):
            for d in range(reach + 1):
                own = full[i, reach - d : reach - d + length]
                others = (j for j in range(len(full)) if j != i and least[j] <= d <= most[j])
                assert got[i, d] == (least[i] <= d <= most[i] and any((full[j, reach - d : reach - d + length] == own).all() for j in others))


def near_of(df, **options):
    options = {"shingle": 3, "percent": 85, "bands": 32, "rows": 6} | options
    return {r.doc_id: (r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.find_near_duplicates(df, **options).collect()}


def test_near(docs, rows):
    got = near_of(docs)
    assert got == {r[0]: r for r in brute.near(rows)}
    assert sum(not r[3] for r in got.values()) > 25
    got = {r.doc_id: (r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.find_near_duplicates(docs).collect()}
    assert got == {r[0]: r for r in brute.near(rows, 80, 5)}


def beside_a_crowd():
    """Pairs of linked texts that all share most of their words with all others, but are not linked with them."""
    rng = random.Random(9)
    common = words(rng, 60, 10**6)
    rows = []
    for k in range(40):
        own = words(rng, 14, 10**6)
        rows += [(3 * k, f"{common} {own}"), (3 * k + 1, f"{common} {own} z{k}")]
    return rows


@pytest.mark.parametrize(("members", "shingles", "options"), [(2048, 1 << 19, {"rows": 2}), (16, 1 << 19, {"bands": 4, "rows": 1}), (2048, 900, {"bands": 4, "rows": 1}), (8, 100, {})])
def test_near_finds_links_beside_a_crowd(spark, monkeypatch, members, shingles, options):
    """Buckets of many components are compared exactly, whole or as a grid of blocks."""
    rows = beside_a_crowd()
    monkeypatch.setattr(near_dedup, "SIDE_MEMBERS", members)
    monkeypatch.setattr(near_dedup, "SIDE_SHINGLES", shingles)
    monkeypatch.setattr(near_dedup, "PLACES", 2)
    want = {r[0]: r for r in brute.near(rows)}
    assert len({r[2] for r in want.values()}) == 40
    assert near_of(frame(spark, rows), **options) == want


def test_near_on_a_dense_crowd(spark):
    """Texts with a few words changed, with similarities on both sides of the bound."""
    rng = random.Random(3)
    base = words(rng, 130, 10**6).split()
    rows = []
    for k in range(300):
        text = list(base)
        for _ in range(rng.randrange(1, 6)):
            text[rng.randrange(130)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    want = {r[0]: r for r in brute.near(rows)}
    assert 20 < len({r[2] for r in want.values()}) < 290
    assert near_of(frame(spark, rows)) == want


def test_shared_shingles():
    rng = np.random.default_rng(5)
    sets = [np.unique(np.append(rng.integers(0, 3000, 200), rng.integers(0, 40, 30))) for _ in range(70)]
    want = [[len(np.intersect1d(x, y)) for y in sets[30:]] for x in sets[:30]]
    assert (near_dedup._shared(sets[:30], sets[30:]) == np.array(want)).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 470)] + [(900, k) for k in range(901, 960)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    df = spark.createDataFrame(edges, "u long, v long")
    for bound in (1 << 20, 0):
        got = {r.node: r.root for r in graph.components(df, one_task=bound).collect()}
        assert {x: got.get(x, x) for x in parent} == {x: find(x) for x in parent}


def test_decontamination(spark, docs, rows):
    items = [(1, rows[16][1][:150]), (2, "one two"), (3, None), (4, ""), (5, words(random.Random(5), 12)), (None, "one two"), (2, rows[11][1]), (6, "É É")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {r[0]: r for r in brute.contamination(rows, items)}
    for size in (1 << 20, 20000):
        found = decontaminate.find_contamination(docs, bench, broadcast_bytes=size).collect()
        assert {r.doc_id: (r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found} == want
    whole = {r.doc_id: r for r in decontaminate.find_contamination(docs, bench, with_text=True).collect()}
    assert {i for i, r in whole.items() if r.clean_text is not None} == {i for i, r in want.items() if r[2]}
    for i, text in rows:
        if whole[i].clean_text is not None:
            # the words that are not hit stay, in their order, as they were written
            word = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
            own, gone = word.findall(text.encode()), [(s.start, s.end) for s in whole[i].hit_spans]
            kept = [w for k, w in enumerate(own) if not any(a <= k < b for a, b in gone)]
            assert word.findall(whole[i].clean_text.encode()) == kept
    # the same from many blocks, also for repeated rows
    twice = docs.unionByName(docs)
    for df, times in ((docs, 1), (twice, 2)):
        split = decontaminate.find_contamination(df, bench, with_text=True, broadcast_bytes=4000).collect()
        assert len(split) == times * len(rows)
        assert all((r.n_words, r.hit_spans, r["items"], r.clean_text) == (whole[r.doc_id].n_words, whole[r.doc_id].hit_spans, whole[r.doc_id]["items"], whole[r.doc_id].clean_text) for r in split)
    assert decontaminate.find_contamination(docs, bench.limit(0)).filter("contaminated").isEmpty()


def test_tokens_equal_the_library(spark, docs, rows, sample):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    special = [(1000, "a <s> </s> <unk> ▁ b"), (1001, "  two  spaces "), (1002, "日本語 テスト 🙂" * 300), (1003, "x" * 9000), (1004, "a\x00b")]
    for df, own in ((docs, rows), (frame(spark, special), special), (sample, plain(sample))):
        # small limits send most texts through the splicing of chunks
        for huge in (1 << 15, 500):
            got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, PIECES, huge_chars=huge, chunk_chars=300, overlap=16).collect()}
            assert got == {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t in own}


def test_tokens_of_repeated_huge_rows(spark):
    text = "many words here " * 60
    out = token_counts.count_tokens(frame(spark, [(1, text), (1, text), (None, text)]), PIECES, huge_chars=100, chunk_chars=100, overlap=20).collect()
    assert len(out) == 3 and len({r.n_tokens for r in out}) == 1


def pieces_of(rows, size):
    import zlib

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTES[0])
    out = {}
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), size)):
            out[i, k] = (s, n, zlib.crc32(ids[s : s + n].tobytes()))
    return out


def fewest(histogram, size):
    """A lower bound on sequences: pieces above size - k are alone, those above half never share."""
    best = -(-sum(k * n for k, n in histogram.items()) // size)
    for small in range(size // 2 + 1):
        alone = sum(n for k, n in histogram.items() if k > size - small)
        large = {k: n for k, n in histogram.items() if size // 2 < k <= size - small}
        rest = sum(k * n for k, n in histogram.items() if small <= k <= size // 2)
        room = sum((size - k) * n for k, n in large.items())
        best = max(best, alone + sum(large.values()) + max(0, -(-(rest - room) // size)))
    return best


def test_packing(spark, docs, rows, sample):
    special = [(2000, "a <|endoftext|> b"), (2001, "a\n\n\nb  c \n d"), (2002, "日本 x’s “q” 🙂"), (2003, "I'll we've\tx")]
    for df, own, size in ((docs, rows, 128), (sample, plain(sample), 2048), (frame(spark, special), special, 8)):
        out = packing.pack(df, *BYTES, size=size).collect()
        assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == pieces_of(own, size)
        fill = {}
        for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == fill.get(r.sequence_id, 0)
            fill[r.sequence_id] = r.offset + r.length
        lengths = {}
        for r in out:
            lengths[r.length] = lengths.get(r.length, 0) + 1
        assert max(fill.values()) <= size and len(fill) <= fewest(lengths, size) + 1


def test_packing_plan():
    rng = random.Random(2)
    for _ in range(5):
        histogram = {k: rng.randrange(1, 400) for k in rng.sample(range(1, 101), 40)}
        plan = packing.make_plan(histogram, 100)
        held = {}
        for n, config in plan.configurations:
            assert sum(k * c for k, c in config.items()) <= 100
            for k, c in config.items():
                held[k] = held.get(k, 0) + n * c
        assert held == histogram
        assert plan.sequences() <= 1.02 * fewest(histogram, 100) + 2
    # three of 34 do not fit, so the bound of the linear program is not the mean
    assert packing.make_plan({34: 10, 33: 10, 32: 10}, 100).sequences() <= 11
    lengths, prices = np.array([3, 5]), np.array([3.0, 6.0])
    best = packing.room_values(lengths, prices, 11)
    assert best.tolist() == [0, 0, 0, 3, 3, 6, 6, 6, 9, 9, 12, 12]
    assert packing.priced_configuration(1, lengths, prices, np.array([9, 9]), best, 0.0) == (12.0, {1: 2})
    assert packing.priced_configuration(1, lengths, prices, np.array([9, 1]), best, 0.0) == (12.0, {1: 1, 0: 2})
    assert packing.cut(4097, 2048) == [(0, 1), (1, 2048), (2049, 2048)]


def piece_histogram():
    """Lengths like those of the documents: many full pieces, a broad middle, few short ones."""
    rng = np.random.Generator(np.random.PCG64(8))
    lengths = np.clip(np.exp(rng.normal(6.2, 0.9, 11000)), 20, 2047).astype(int)
    values, counts = np.unique(lengths, return_counts=True)
    return {2048: 1500, **dict(zip(values.tolist(), counts.tolist(), strict=True))}


@pytest.mark.parametrize("times", [1, 1000])
def test_packing_comes_from_the_program(times):
    histogram = {k: n * times for k, n in piece_histogram().items()}
    cover = packing.multiplicative_weights(histogram, 2048)
    placed, plan = sum(n for n, _ in cover.taken), packing.make_plan(histogram, 2048)
    assert placed >= 0.9 * plan.sequences()
    assert cover.bound <= fewest(histogram, 2048)
    assert plan.sequences() <= 1.001 * cover.bound + 1


def test_lines(docs, rows):
    got = {r.doc_id: (r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.remove_repeated_lines(docs, chunks_only=True).collect()}
    assert got == {r[0]: r for r in brute.line_chunks(rows)}
    assert sum(r[2] for r in got.values()) > 5


def test_lines_of_sample(sample):
    got = {r.doc_id: (r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.remove_repeated_lines(sample, chunks_only=True).collect()}
    assert got == {r[0]: r for r in brute.line_chunks(plain(sample))}


def test_passages_of_sample(sample):
    got = {r.doc_id: (r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.remove_repeated_lines(sample).collect()}
    assert got == {r[0]: r for r in brute.line_passages(plain(sample))}


def test_short_runs_of_lines_inside_documents(spark, docs, rows):
    """Passages of two to four lines with other lines on both sides are found in full."""
    rng = random.Random(12)
    inside = []
    for size in (2, 3, 4):
        for _ in range(8):
            shared = "\n".join(words(rng, 30, 10**6) for _ in range(size))
            inside += ["\n".join([words(rng, 8, 10**6), shared, words(rng, 8, 10**6)]) for _ in range(2)]
    inside = list(enumerate([*inside, "a\na\na", "b\nb\nb\nb\nb", "c\nd\nc\nd"]))
    for some, given in ((frame(spark, inside), inside), (docs, rows)):
        got = {r.doc_id: (r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.remove_repeated_lines(some).collect()}
        assert got == {r[0]: r for r in brute.line_passages(given)}
    assert sum(r[2] for r in brute.line_passages(inside)) == 8 * (2 + 3 + 4) + 3 + 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use the cookies of this site and of others to do what we do, and you agree that it is so.</p></div>{body}
<div id="comments"><p>The reader says that it is a very good text, and that there is more of it to be read in the other one.</p></div><form><p>Your name</p></form><footer>&copy; all</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><header><h1>A &amp; B</h1></header><p>Short.<p>It was the best of times, it was the worst of times, and there is more of it.<br>Next &lt;line&gt;</p><aside>no</aside></article>", "A & B Short. It was the best of times, it was the worst of times, and there is more of it. Next <line>"),
        ("<main><p>one <b>t</b>wo</p>\n<p>  three\tfour </p></main>", "one two three four"),
        ("<div><h1>Head</h1><p>It was the best of times, it was the worst of times, and there is more of it here.</p><p>End.</p></div>", "Head It was the best of times, it was the worst of times, and there is more of it here. End."),
        ("<article></article>", ""),
    ],
)
def test_html(body, text):
    assert html_text.main_text(PAGE.format(body=body)) == text


@pytest.mark.parametrize("icon", ['<svg class="i" viewBox="0 0 1 1"/>', "<math />", "<svg><path d='M0'/>x</svg>", "<svg/><svg>x</svg>"])
def test_html_self_closed_icons(icon):
    assert html_text.main_text(f"<article><p>one {icon} two</p><p>three</p></article>") == "one two three"


GOOD = "It was the best of times, it was the worst of times, and there is more of it in the book that we have here."
MORE = "There was a king with a large jaw and a queen with a plain face, on the throne of the country, and it was so."
PAGES = [
 ('<body class="home no-sidebar"><article><p>%s</p></article>', GOOD),
 ('<html class="js cookie-consent-ok"><body><article><p>%s</p></article></body></html>', GOOD),
 ('<body><div class="content-with-sidebar"><article><p>%s</p></article></div>', GOOD),
 ('<body><article class="post hentry comment-open"><p>%s</p></article>', GOOD),
 ('<article><p>%s</p><section id="related-work"><p>Other text.</p></section></article>', GOOD + " Other text."),
 ('<article><h2 id="search">Search</h2><p>%s</p></article>', "Search " + GOOD),
 ('<article><p>%s <span class="ad">Buy now</span>end</p></article>', GOOD + " end"),
 ('<article><p>%s <span hidden>no</span>x<i style="display:none">no</i>y</p></article>', GOOD + " xy"),
 ('<article><p>%s</p><button>Like</button><label>Name</label><p>End</p></article>', GOOD + " End"),
 ('<article><p>%s</p></article><article class="comment"><p>The reader says that it is a very good text of the writer.</p></article>', GOOD),
 ('<article><p>%s</p><article><p>The reader says that it is a very good text.</p></article></article>', GOOD),
 ('<article><p>%s</p><section class="comments"><article><p>The reader says that it is a very good text.</p></article></section></article>', GOOD),
 ('<article><p>%s</p><div id="comments"><p>The reader says that it is a very good text of the writer, and more of it.</p></div></article>', GOOD),
 ('<form id="aspnetForm"><div class="page"><h1>Title</h1><p>%s</p></div></form>', "Title " + GOOD),
 ('<body><form><p>Your name</p><input name=x><p>The text that you write to us is for us only, and it will not be read by others.</p></form><div><p>%s</p><p>%s</p></div>' % ("%s", MORE), GOOD + " " + MORE),
 ('<div class="site-footer"><p>It is all of the text that we have on the site, and it is ours.</p></div><div><p>%s</p></div>', GOOD),
 ('<article><p>a<pre><code><span class="comment">// note</span> x = 1</code></pre><p>%s</p></article>', "a // note x = 1 " + GOOD),
 ('<article><p><span hidden>never closed<p>%s</p></article>', GOOD),
 ('<article><p>%s</p><div class="share-buttons"><a href="/">Share</a> it</div><ins class="adsbygoogle">Buy</ins></article>', GOOD),
 ('<div role="main"><p>%s</p></div><div><p>Outside of it is the text that is not of the article, and it is not to be read.</p></div>', GOOD),
 ('<main class="sidebar-layout"><article class="sponsored-post"><p>%s</p></article></main>', GOOD),
 ('<article><article><p>%s</p></article><article><p>x</p></article></article>', GOOD + " x"),
 ('<article><p>%s</p><form><p>Write to us what you think of it, and say it to all of the others who read it here. ' + "It is for you and for them, and for us. " * 8 + '</p></form></article>', GOOD),
 ('<article><p>%s</p><div class="comment-body"><p>' + "The reader says that it is a very good text of the writer. " * 6 + '</p></div></article>', GOOD),
 ('<article><form><p>%s</p></form></article>', GOOD),
 ('<div class="content-sidebar-wrap"><div><p>%s</p><p>%s</p></div><div class="sidebar"><p>It is all of the text that we have on the side, and it is ours.</p></div></div>' % ("%s", MORE), GOOD + " " + MORE),
 ('<div class="widget"><main><p>%s</p></main></div>', GOOD),
]


@pytest.mark.parametrize("case", range(len(PAGES)))
def test_html_hints(case):
    page, text = PAGES[case]
    assert html_text.main_text(page % GOOD) == text


def test_html_of_all_pages(spark):
    """Against a slow version for pages whose article element holds all of their text and nothing else."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: brute.article_text(r.html or "") for r in pages.collect()}
    got = html_text.extract_main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got) and len(want) >= 200


def test_html_edges(spark):
    pages = [(1, "u", None), (2, None, ""), (None, "u", "plain a < b"), (4, "u", "<p>open <b>never closed"), (5, "u", "<!-- open"), (6, "u", "<script>x"), (7, "u", "<article><p>" + "word of the " * 30000 + "</p></article>"), (8, "u", '<p title="a>b">t</p><a "')]
    out = {r.page_id: r for r in html_text.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [out[k].text for k in (1, 2, None, 4, 5, 6)] == ["", "", "plain a < b", "open never closed", "", ""]
    assert out[7].n_chars == len("word of the " * 30000) - 1 and out[8].text == "t"


def test_quality_held_out(spark, sample):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = {r.doc_id: r for r in quality.score_documents(big, labels).collect()}
    held = [(out[r.doc_id], r.quality) for r in labels.collect() if out[r.doc_id].held_out]
    assert len(held) > 40 and np.mean([s.predicted == q for s, q in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())


def test_quality_edges(spark, docs, rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {0.5}
    few = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] + [(None, 1), (5, None), (7, 0)], "doc_id long, quality int")
    assert quality.score_documents(docs, few, carry=docs.columns).count() == len(rows)
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert y.tolist() == [0, 0.5, 1]


def exact(rows, k=20):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in ids[ids % 20 == 0]:
        s = ann.exact_products(x, x[ids == q][0])
        s[ids == q] = -np.inf
        order = np.lexsort((ids, -s))[:k]
        out[int(q)] = [(int(ids[j]), float(s[j])) for j in order if s[j] > -np.inf]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=19).tolist()) for i in range(900)]
    good += [(i, good[40][1]) for i in range(900, 1300)]  # many equal vectors: ties go to smaller ids
    bad = [(2000, None), (2020, [0.0] * 19), (2040, [float("nan")] * 19), (2060, [None] + [1.0] * 18), (2080, [1.0] * 5), (None, [1.0] * 19), (2100, [float("inf")] * 19)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")
    found = {}
    for r in sorted(ann.search(df, candidate_block=256, query_block=16).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact(good)
    assert found.keys() == want.keys() and all(len(found[q]) == 20 for q in want)
    recall = np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9 and [i for i, _ in found[40]] == [i for i, _ in want[40]]
    scores = dict(good)
    assert all(s == list(itertools.accumulate(a * b for a, b in zip(scores[i], scores[q], strict=True)))[-1] for q, x in found.items() for i, s in x)
    assert len(ann.search(spark.createDataFrame(good[:5] + good[20:21], "vec_id long, embedding array<double>")).collect()) == 10


def test_neighbours_of_the_embeddings(spark):
    """Recall of the registered parameters against brute force; probed lists do not cover the table."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = exact([(r.vec_id, list(r.embedding)) for r in table.collect()])
    found = {}
    for r in ann.search(table).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert found.keys() == want.keys()
    assert np.mean([len(found[q] & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.95


def test_neighbours_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 0.5]), (1, [3.0, 0.5]), (2, [0.5, 3.0])]
    out = ann.search(spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id int, embedding array<float>, v int, list string")).collect()
    # of vec_id 0 the smaller vector counts
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == [(0, 1, 2, 3.0), (0, 2, 1, 0.5)]


def test_lists_to_probe():
    ranked = np.array([[2, 0, 1], [1, 2, 0]])
    assert ann.probes_needed(ranked, [np.array([2, 2, 0]), np.array([1, 0])], 1.0) == 3
    assert ann.probes_needed(ranked, [np.array([2, 2, 0]), np.array([1, 0])], 0.6) == 1


def test_empty_tables(spark):
    empty = frame(spark, []).coalesce(1)
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for out in (
        substring_dedup.remove_repeated_windows(empty), suffix_dedup.remove_repeated_bytes(empty), near_dedup.find_near_duplicates(empty), decontaminate.find_contamination(empty, bench), token_counts.count_tokens(empty, PIECES), packing.pack(empty, *BYTES),
        line_dedup.remove_repeated_lines(empty), html_text.extract_main_text(pages), quality.score_documents(empty, labels), ann.search(vectors),
    ):
        assert out.count() == 0


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(80))
    twice = frame(spark, [(1, text), (1, text), (None, text), (None, None), (2, text)])
    assert [r.n_removed for r in substring_dedup.remove_repeated_windows(twice).filter("n_words > 0").collect()] == [80] * 4
    assert all(r.n_removed == r.n_bytes for r in suffix_dedup.remove_repeated_bytes(twice).collect())
    near = near_dedup.find_near_duplicates(twice).collect()
    huge = frame(spark, [(1, words(random.Random(2), 200000, 10**6)), *[(7, text)] * 5000])
    assert {r[2] for r in near_of(huge).values()} == {1, 7}
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near if r.doc_id) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert all(r.kept and r.component_id is None for r in near if r.doc_id is None) and len(near) == 5
    assert line_dedup.remove_repeated_lines(twice).count() == 5
    assert packing.pack(twice, *BYTES).count() == 5
    assert quality.score_documents(twice, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 5


def test_quality_fit_equals_a_direct_computation(spark):
    """Ridge weights by least squares on all rows at once; calibration by the definition of isotonic regression."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels, fourier=32)
    import zlib

    import pyarrow as pa

    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = [(r.doc_id, float(r.quality), zlib.crc32(str(r.doc_id).encode()) % 5) for r in labels.collect()]
    rows = [r for r in rows if r[2] and r[0] in text]
    x = quality.column_statistics(pa.array([text[i] for i, _, _ in rows]), quality._stop_hashes())
    y, fold = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.where(x.std(axis=0) > 0, x.std(axis=0), 1))
    z = np.array([[*(np.sqrt(2 / 32) * np.cos(((row - model.mean) / model.scale) @ model.direction[:, k] + model.phase[k]) for k in range(32)), 1.0] for row in x])

    def ridge(some):
        weight = np.sqrt(1e-3 * some.sum() * np.array([*[1 / 32] * 32, 1e-9]))
        return np.linalg.lstsq(np.concatenate([z[some], np.diag(weight)]), np.concatenate([y[some], np.zeros(33)]), rcond=None)[0]

    assert np.allclose(model.weights, ridge(fold > 0), rtol=1e-5, atol=1e-6)
    # each row's raw score comes from the other folds
    raw = np.array([z[i] @ ridge((fold > 0) & (fold != fold[i])) if (fold != fold[i]).any() else 0 for i in range(len(z))])
    bins = np.round(np.clip(raw, -1, 2) * quality.BINS)
    points = sorted(set(bins.tolist()))
    mean = lambda a, b: y[(bins >= points[a]) & (bins <= points[b])].mean()
    for i in range(0, len(points), max(1, len(points) // 25)):
        want = max(min(mean(a, b) for b in range(i, len(points))) for a in range(i + 1))
        got = [p for r, p in zip(model.raw, model.probability, strict=True) if abs(p - want) < 1e-6]
        assert got, (i, want)


def test_quality_statistics():
    import pyarrow as pa

    texts = ["", "The THE cat cat.", "a  b\n\n9 !", "é É"]
    got = quality.column_statistics(pa.array(texts), quality._stop_hashes())
    name = {n: k for k, n in enumerate(quality.STATISTIC_NAMES)}
    for text, row in zip(texts, got, strict=True):
        words, raw = text.encode().split(), text.encode()
        assert np.isclose(row[name["log bytes"]], np.log1p(len(raw))) and np.isclose(row[name["log words"]], np.log1p(len(words)))
        assert np.isclose(row[name["mean word length"]], np.mean([len(w) for w in words]) if words else 0)
        assert np.isclose(row[name["upper"]], sum(65 <= c <= 90 for c in raw) / max(1, len(raw)))
        assert np.isclose(row[name["digit"]], sum(48 <= c <= 57 for c in raw) / max(1, len(raw)))


def test_clashing_names_in_other_tables(spark, rows):
    docs = frame(spark, rows[:12])
    bench = spark.createDataFrame([(1, "one two", 7, "x")], "item_id long, text string, window int, n_words string")
    assert decontaminate.find_contamination(docs, bench).filter("contaminated").count() == 2
    labels = spark.createDataFrame([(i, i % 2, 3, "t", 0.5) for i in range(30)], "doc_id long, quality int, fold int, text string, label double")
    assert quality.score_documents(docs, labels).count() == 12
    pages = spark.createDataFrame([(1, "u", "<p>a", "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert [(r.text, r.n_chars) for r in html_text.extract_main_text(pages).collect()] == [("a", 1)]
