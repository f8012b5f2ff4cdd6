"""Each corpus operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import html_text, line_dedup, minhash_dedup, mixing, quality_rules, sentencepiece_codec, substring_dedup, token_counts, toxicity, vector_search
from tests.llm import brute

LONG = " ".join(f"w{i * 7919 % 100003}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, PASSAGE + " tail one", "a"), (2, "head two " + PASSAGE, "a"), (3, None, "a"), (4, "", None), (5, "  \t\n ", "b"), (6, LONG, "b"), (7, LONG + " end", "b"), (7, LONG + " end", "b"),
    (None, PASSAGE + " tail one", None), (8, "short text", "b"), (9, "short text", "a"), (10, "é ü 日本  x 😀", "c"), (11, "x " * 200, "c"),
]
SP = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    # names that the operators use inside, too
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(3).withColumn("_id", F.lit("x")).withColumn("n", F.lit(1)).withColumn("component", F.lit(2)).withColumn("_size", F.lit("s"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_substring(docs, none):
    got = {(r.doc_id, r.kept_sha256): (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()}
    want = brute.substring([(d, t) for d, t, _ in ROWS if d is not None])
    assert {d: (n, g, s) for (d, s), (n, g) in got.items() if d is not None} == want
    assert [v for (d, _), v in got.items() if d is None] == [(62, 0)]
    assert substring_dedup.remove_repeats(docs).count() == len(ROWS)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_keeps_text(docs):
    kept = {r.doc_id: r.kept_text for r in substring_dedup.remove_repeats(docs).collect() if r.doc_id in (1, 2, 3)}
    assert kept == {1: PASSAGE + " tail one", 2: "head two", 3: ""}


def test_substring_hot_anchor(spark):
    """More different passages of one anchor than a shard takes: its windows go one by one."""
    rows = [(i, f"a{i} b{i} " + PASSAGE + f" c{i % 7} d{i}") for i in range(substring_dedup.HOT_PASSAGES + 60)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()}
    assert got == brute.substring(rows)


def test_near_duplicates(docs, none):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs, width=4).collect()]
    want = brute.near([(d, t) for d, t, _ in ROWS if d is not None])
    assert {d: (n, c, k) for d, n, c, k in got if d is not None} == want
    assert [g for g in got if g[0] is None] == [(None, 59, 1, True)] or [g[3] for g in got if g[0] is None] == [True]
    assert len(got) == len(ROWS)
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_near_group_around_the_limit(spark):
    """Copies with more and less changed words: those linked only over others are found."""
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(90):
        words = list(base)
        for j in range(i % 9):
            words[(i * 13 + j * 17) % 80] = f"x{i}_{j}"
        rows.append((i + 100, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == brute.near(rows)


def test_lines(spark, docs, none):
    rows = [(i, "s" if i < 40 else None, f"own {i}\n Menu \n\nown {i}" + ("\nrare" if i % 9 == 0 else "")) for i in range(80)] + [(99, "s", None), (98, "t", "Menu")]
    pages = spark.createDataFrame(rows, "doc_id long, site string, text string").withColumn("_site", F.lit(1)).withColumn("_lines", F.lit(1))
    fast = sorted((r.doc_id, r.text or "", r.text is None, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(pages, F.col("site"), ratio=0.5, counts=True).collect())
    other = sorted((r.doc_id, r.text or "", r.text is None, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(pages, F.col("site"), ratio=0.5, counts=True, broadcast_sites=0).collect())
    assert fast == other
    assert fast[0] == (0, "own 0\n\nown 0\nrare", False, 5, 1) and fast[-1] == (99, "", True, 1, 0) and fast[-2][1] == "Menu"
    assert line_dedup.drop_boilerplate(none, F.col("source")).columns == none.columns and line_dedup.drop_boilerplate(none, F.col("source")).count() == 0
    assert line_dedup.drop_boilerplate(docs, F.col("source")).count() == len(ROWS)


def test_host(spark):
    urls = [("https://User@Www.Example.com:80/x", "www.example.com"), ("no url", None), (None, None), ("http://a.b?q", "a.b")]
    df = spark.createDataFrame(urls, "u string, h string")
    assert all(r.a == r.h for r in df.select(line_dedup.host(F.col("u")).alias("a"), "h").collect())


def test_mixing(docs, none, spark):
    out = mixing.mix(docs, F.col("source")).collect()
    assert len(out) == len(ROWS) and all(0 <= r.copies <= 3 for r in out)
    assert mixing.mix(none, F.col("source")).count() == 0
    by = {}
    for r in out:
        s = r.sources[0]
        by.setdefault(s, [r.source_size, r.target, 0, 0])
        by[s][2] += r.copies * r["size"]
        by[s][3] = max(by[s][3], r["size"])
    for size, target, taken, largest in by.values():
        assert abs(taken - target) <= max(1, largest / 2 + 1) and target <= 3 * size + 1e-6


def test_mixing_targets(spark):
    sized = spark.createDataFrame([("a", 100), ("b", 1), ("c", 300), (None, 99)], "_source string, _size long")
    got = {r._source: r._target for r in mixing.source_targets(sized, (1, 2, 3), 3).collect()}
    # b stops at 3; the others share 497 by 1, 3, 1
    assert got == pytest.approx({"a": 99.4, "b": 3.0, "c": 298.2, None: 99.4})


def test_flow():
    flow = mixing.min_cost_flow([10, 10, 5], [[0], [0, 1], [1]], [12, 18], 3)
    out = [sum(f.values()) for f in flow]
    assert [sum(f.get(s, 0) for f in flow) for s in (0, 1)] == [12, 18] and all(n <= m for n, m in zip(out, [30, 30, 15]))
    # repetition is spread: nobody is used a third time while another isn't used a second time
    assert max(out) <= 20
    assert mixing.min_cost_flow([4], [[0]], [100], 3) == [{0: 12}]
    assert sum(sum(f.values()) for f in mixing.min_cost_flow([0, 3], [[0], [0]], [5], 3)) == 5


def test_mixing_overlap(spark):
    rows = [(i, "w " * 20, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b", "a", "b"]) for i in range(60)] + [(99, "w", None), (98, "w", [])]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, s array<string>"), F.col("s")).collect()
    assert len(out) == 62 and {tuple(r.sources) for r in out} == {("a", "b"), ("a",), ()}


def test_tokens(docs, none):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(BPE)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, BPE, 2048).collect())
    want = sorted((d or -1, len((t or "").encode()), n := len(tool.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t, _ in ROWS)
    assert got == want
    assert token_counts.token_counts(none, BPE, 10).count() == 0


def test_prefix_counts():
    from tokenizers import Tokenizer

    tool, own = Tokenizer.from_file(BPE), token_counts.counter(BPE)
    for word in ("unbelievable", "internationalisation", "zzzzqx"):
        want = [len(tool.encode(word[:n], add_special_tokens=False).ids) for n in range(1, len(word) + 1)]
        assert own.word_prefixes(word) == want
    text = "The quick <|endoftext|>brown fox's 12 legs, naïve İstanbul ΣΑΣ\x1cx"
    assert own.counts(text)[-1] == len(tool.encode(text, add_special_tokens=False).ids)
    cut = own.fits(text, 4)
    assert text[:cut] == "The quick" or len(tool.encode(text[:cut], add_special_tokens=False).ids) <= 4


def test_codec(docs, none, spark):
    import sentencepiece

    tool = sentencepiece.SentencePieceProcessor(model_file=SP)
    got = {(r.doc_id, r.n_tokens): (list(r.ids), r.decoded, r.ids_sha256) for r in sentencepiece_codec.encode_texts(docs, SP).collect()}
    for d, t, _ in ROWS:
        ids = [*tool.encode(t or ""), tool.eos_id()]
        assert got[d, len(ids)] == (ids, tool.decode(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert sentencepiece_codec.encode_texts(none, SP).count() == 0
    back = sentencepiece_codec.decode_ids(spark.createDataFrame([([264, 2],), (None,)], "ids array<int>"), SP).collect()
    assert [r.text for r in back] == [tool.decode([264, 2]), None]


@pytest.mark.parametrize("text", ["  a  b ", "▁▁ a▁b", "<0x0A><s></s>", "\x00", "ﬁ é 日本語 😀👨‍👩‍👧", "العربية हिन्दी", "\ttabs\r\n", "a" * 300])
def test_codec_strings(text):
    import sentencepiece

    tool, own = sentencepiece.SentencePieceProcessor(model_file=SP), sentencepiece_codec.codec(SP)
    assert own.encode(text) == tool.encode(text) and own.decode(own.encode(text)) == tool.decode(tool.encode(text))


def test_quality(docs, none):
    rows = quality_rules.quality(docs, SP, language=F.col("source")).collect()
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((d or -1, *brute.quality_base(t)) for d, t, _ in ROWS)
    assert not any(r.kept for r in rows if r.base_failed)
    assert quality_rules.quality(none, SP).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float((i * 37 + j * 11) % 23 - 11) / 7 for j in range(6)]) for i in range(400)]
    rows += [(400, [1.0] * 6), (401, [1.0] * 6), (500, [1.0] * 6), (600, None), (700, [nan] + [0.0] * 5), (800, [inf] * 6), (900, [None] * 6), (901, [1.0, 2.0]), (1000, []), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vector_search.top_k(df, F.col("vec_id") % 100 == 0).collect())
    import numpy as np

    plain = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows if i is not None]
    assert got == sorted(brute.top(plain))
    assert vector_search.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    few = df.where("vec_id IN (0, 1, 2)")
    assert vector_search.top_k(few, F.col("vec_id") % 100 == 0).count() == 2


def test_toxicity(spark, none):
    rows = [(i, f"All is well here {i}. Nothing to see {i % 7}." + (" You are a blorkish thing." if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "x"), (1002, "bare words " * 20_000)], "doc_id long, text string").withColumn("score", F.lit(9))
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (5, None), (1000, 0)], "doc_id long, toxic int")
    weights = toxicity.train_on(docs, labels)
    out = {r.doc_id: r for r in toxicity.toxicity_scores(docs, weights, worst=True).collect()}
    assert len(out) == 404 and all(0 <= r.score <= 1 for r in out.values())
    assert all(out[i].predicted == x for i, _, x in rows)
    assert out[0].worst == ["You are a blorkish thing"] and out[1].worst == []
    assert out[1000].predicted == out[1001].predicted == 0
    assert toxicity.toxicity_scores(none, weights).count() == 0
    assert isinstance(toxicity.train_on(docs.where("false"), labels), dict)


def test_held_out(spark):
    import zlib

    ids = [(i,) for i in range(200)]
    got = {r.doc_id: r.h for r in spark.createDataFrame(ids, "doc_id long").select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for (i,) in ids}


PAGE = "<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Home</ul></nav><div class='cookie-notice'>We use</div>%s<form>go</form><footer>f</footer></body></html>"


def test_html(spark):
    rows = [(i, f"https://a.example/{i}", PAGE % f"<article><h1>T&eacute; {i}</h1><p>One <b>bo</b>ld &amp; {i}<p>Two<br>lines<div class='comments'>no</div></article>") for i in range(12)]
    rows += [(20 + i, f"https://b.example/{i}", PAGE % f"<div class=x>same on all</div><div class=y>text number {i} {i * i}</div>") for i in range(8)]
    rows += [(40, None, "<p>a&nbsp;b</p>"), (41, "x", None), (42, "https://c.example", ""), (43, "https://d.example", "plain < text"), (44, "https://e.example", "<div>" * 30_000 + "deep"), (40, None, "<p>a&nbsp;b</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("_site", F.lit(1))
    for few in (html_text.BROADCAST_NODES, 0):
        out = {r.page_id: r for r in html_text.extract_text(pages, broadcast_nodes=few).collect()}
        assert out[3].text == "Té 3 One bold & 3 Two lines" and out[3].n_chars == len(out[3].text)
        assert out[24].text == "text number 4 16"
        assert (out[40].text, out[41].text, out[42].text, out[43].text, out[44].text) == ("a b", "", "", "plain < text", "deep")
    assert html_text.extract_text(pages.where("false")).count() == 0


def test_html_tree_inside_articles(spark):
    """Boilerplate that only the tree can tell goes from articles; wrappers, inline words and copies of a page stay."""
    own = lambda i: f"<h1>Head {i}</h1><p>Body {i} with <b>the same</b> words {i * i}"
    rows = [(i, f"https://a.example/{i}", f"<article><div><div>{own(i)}</div></div><div class=x7>Read our terms</div></article>") for i in range(8)]
    # one article thirty times and ten others: different pages count, not copies
    rows += [(20 + i, f"https://b.example/{i}", f"<!-- {i} --><article>{own(max(0, i - 29))}</article>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for few in (html_text.BROADCAST_NODES, 0):
        out = {r.page_id: r.text for r in html_text.extract_text(pages, broadcast_nodes=few).collect()}
        want = lambda i: f"Head {i} Body {i} with the same words {i * i}"
        assert all(out[i] == want(i) for i in range(8)) and all(out[20 + i] == want(max(0, i - 29)) for i in range(40))


def test_html_articles_that_are_not_the_main_part():
    body = "<div>" + "the main text of this page " * 9 + "</div>"
    text = lambda html: html_text.article_text(html_text.Dom(html), set())
    assert text(body + "<aside><article>teaser</article></aside>") == ("the main text of this page " * 9).strip()
    assert text(body + "<article>teaser</article>").startswith("the main text of this page ")
    assert text("<div>by line</div><article>" + body + "</article>") == ("the main text of this page " * 9).strip()


def test_quality_small_classes(spark):
    """Junk is rejected whatever its size, language or script; ordinary rows of small classes are kept."""
    words = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do".split()
    prose = lambda i, n: " ".join(words[(i * 7 + j * (1 + i % 5)) % len(words)] + "." * (j % 9 == 8) for j in range(n))
    junk = lambda n: " ".join(hashlib.sha256(str(j).encode()).hexdigest() for j in range(n))
    rows = [(i, "en", prose(i, 40 + i % 20)) for i in range(80)]
    rows += [(100, "en", junk(3000)), (101, "xx", junk(50)), (102, None, junk(50)), (103, "yy", prose(3, 45)), (104, "zz", junk(50) + " я" * 9)]
    out = {r.doc_id: r for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, lang string, text string"), SP, language=F.col("lang")).collect()}
    assert not any(out[i].base_failed for i in (100, 101, 102, 103, 104))
    assert [out[i].kept for i in (100, 101, 102, 103, 104)] == [False, False, False, True, False]
    assert all(out[i].kept for i in range(80) if not out[i].base_failed) and sum(out[i].kept for i in range(80)) >= 50
