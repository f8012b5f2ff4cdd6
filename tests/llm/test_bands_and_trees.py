"""Bands of the quality rules and entropies of style trees against plain computation."""

import math
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from corpusmill.llm import html_text, quality_rules

SP = public_tokenizers.path("piece_bpe_32k.model")


def plain_kept(rows, least=50, spread=4.0):
    """rows: dicts of the figures of ``quality_rules.figures``; the verdict of each by its definition, class by class."""
    good = [r for r in rows if not r["base_failed"]]
    size = lambda r: int(math.log2(max(1, r["n_words"])))

    def near(group, cls, always):
        far = sorted({abs(size(r) - cls) for r in group})
        for f in far:
            if len(taken := [r for r in group if abs(size(r) - cls) <= f]) >= least:
                return taken
        return group if always else None

    def kept(r):
        if r["base_failed"]:
            return False
        taken = near([x for x in good if x["_language"] == r["_language"]], size(r), False) or near([x for x in good if x["_script"] == r["_script"]], size(r), False) or near(good, size(r), True)
        for x in quality_rules.FIGURES:
            low, high = np.percentile([math.floor(t[x] * 1000 + 0.5) / 1000 for t in taken], [25, 75])
            if r[x] > high + (high - low) * spread + quality_rules.SLACK or (x != "byte_share" and r[x] < low - (high - low) * spread - quality_rules.SLACK):
                return False
        return True

    return {r["_id"]: kept(r) for r in rows}


def test_verdicts(spark):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in ("lo", "ma", "ter", "in") for b in ("n", "s", "ing", "ed", "a", "o")]
    rows = [(i, ("en", "fr", None)[i % 3 if i < 140 else 2], " ".join(rng.choice(words, int(rng.integers(12, 400))))) for i in range(150)]
    rows += [(200 + i, "xx", "".join(rng.choice(list("qzxjkvw9"), 300)) + " ab" * 12 + f" {i}") for i in range(5)] + [(300, "en", "日本語 " * 3 + " ".join(words * 2)), (301, "ja", "日本語の文です。" + " ".join(words)), (302, None, None), (303, "en", "")]
    rows += [(400 + i, "en", " ".join(words)) for i in range(60)]  # ties
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("_n", F.lit(1)).withColumn("figure", F.lit("x"))
    figures = [r.asDict() for r in quality_rules.figures(docs, SP, language=F.col("lang")).collect()]
    got = {r.doc_id: r.kept for r in quality_rules.quality(docs, SP, language=F.col("lang")).collect()}
    want = plain_kept(figures)
    assert got == want
    assert {True, False} == {k for i, k in want.items() if i < 300}


def test_importance(spark):
    """Entropies and importance of every node equal those of a plain count over the site's different pages."""
    rows = [(i, f"https://a.example/{i}", f"<div class=top><p>Same</p>{'<i>x</i>' * (i % 2)}</div><div class=body><p>Text {i}<p>More {i // 3}</div><ul><li>a<li>b {i % 4}</ul>") for i in range(9)]
    rows += [(20, "https://a.example/20", rows[0][2]), (21, "https://b.example/1", "<p>alone"), (22, "https://b.example/2", "<p>alone too"), (23, None, "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r._site, r._path): (r._pages, round(r._importance, 9)) for r in html_text.style_tree(html_text.style_nodes(pages, F.element_at(F.split("url", "/"), 3))).collect()}
    seen, above = {}, {}
    for _, url, html in rows:
        if url:
            held = html_text.observed(html_text.Dom(html))
            for path, (up, style, content) in held.items():
                seen.setdefault((url.split("/")[2], path), {})[held[0][2]] = (style, content)
                above[url.split("/")[2], path] = up

    def entropy(values):
        m = len(values)
        h = -sum(n / m * math.log(n / m) for n in Counter(values).values()) / math.log(m) if m > 1 else 1.0
        return (h * m + 1) / (m + 1)

    want = {}
    for (site, path), held in seen.items():
        style, content = (entropy([v[i] for v in held.values()]) for i in (0, 1))
        weight = html_text.DAMPING ** sum(1 for key, up in above.items() if key[0] == site and up == path)
        want[site, path] = (len(held), round(max(content, (1 - weight) * style + weight * content), 9))
    assert got == want
    assert min(x for _, x in want.values()) < html_text.LEAST_IMPORTANCE < max(x for _, x in want.values())


def test_deep_trees_keep_their_levels():
    """Nodes below any depth have paths of their own, and an emptied tree changes the text."""
    deep = html_text.Dom("<div>" * 500 + "<p class=a>one</p><p class=b>two</p>")
    paths = {n.name: n.path for n in html_text.nodes(deep.root)}
    assert len({n.path for n in html_text.nodes(deep.root)}) == 503
    assert html_text.article_text(deep, {paths["p.a"]}) == "two" and html_text.article_text(deep, set()) == "one two"
