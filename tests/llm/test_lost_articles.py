"""Pages whose main part bears a name of furniture, lists of teasers, and random sites against a plain extractor."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from corpusmill.llm import html_text

BODY = "The main text of this page goes on for a while and says what the page is about. " * 4


def text(html, low=frozenset()):
    return html_text.article_text(html_text.settle(html_text.Dom(html), low), low)


def test_names_that_hold_the_page():
    nav, foot = "<nav><a href=/>Home</a></nav>", "<footer>f</footer>"
    want = f"Head {BODY}".strip()
    for wrap in ('<div class="notice-board">{}</div>', "<form method=post>{}</form>", '<div class="promo"><div>{}</div></div>', '<div class="page-sidebar"><div class="sidebar">s</div><div>{}</div></div>', '<div id="share-page">{}</div>'):
        body = f"<article><h1>Head</h1><p>{BODY}</p></article>" if "share" in wrap or "sidebar" in wrap else f"<h1>Head</h1><p>{BODY}</p>"
        assert text(f"<body>{nav}{wrap.format(body)}{foot}</body>") == want, wrap
    assert text(f'<body><form>{nav}<div class="cookie-bar">We use</div><div>{BODY}</div><input name=q></form></body>') == BODY.strip()


def test_furniture_stays_furniture():
    assert text(f"<article></article><div class=notice>{BODY}</div>") == ""
    assert text(f"<div>short text</div><div class=comments><article>{BODY}</article></div>") == "short text"
    assert text(f"<div>short text</div><aside><h1>x</h1>{BODY}</aside>") == "short text"
    assert text("<div class=notice>Closed today</div>") == ""
    assert text(f"<p>short</p><div class=ad>{BODY}</div>") == "short"
    assert text(f"<header><h1>Site</h1></header><div>{BODY}</div>") == BODY.strip()
    # a part that the tree finds the same on all pages isn't the main one
    dom = html_text.Dom(f"<div class=notice>{BODY}</div>")
    assert text(f"<div class=notice>{BODY}</div>", {n.path for n in html_text.nodes(dom.root) if n.tag == "div"}) == ""


def test_lists_of_teasers():
    teasers = "".join(f"<article class=card><h3><a href=/{i}>Teaser {i} with some words</a></h3><p>{'word ' * 30}</p></article>" for i in range(6))
    assert text(f"<div><h1>Head</h1><p>{BODY}</p></div><section>{teasers}</section>") == f"Head {BODY}".strip()
    assert text(f"<article><h1>Head</h1><p>{BODY}</p></article><section>{teasers}</section>") == f"Head {BODY}".strip()
    # a page that is a list has the list for its text
    assert text(f"<h1>News</h1><section>{teasers}</section>").startswith("Teaser 0 with some words word")
    # articles that follow each other without links are no teasers
    plain = "".join(f"<article><h2>Part {i}</h2><p>{'word ' * 30}</p></article>" for i in range(3))
    assert text(f"<div>{BODY}</div>{plain}").count("Part") == 3


def test_what_only_this_page_says(spark):
    """Where nineteen pages hold the same and one differs, that one keeps its text."""
    page = lambda i, part: f"<div class=a>{part}</div><div class=b>Own words {i} {i * i}</div>"
    rows = [(i, f"https://a.example/{i}", page(i, "The same on most pages" if i else "Said here alone")) for i in range(20)]
    out = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[0] == "Said here alone Own words 0 0" and all(out[i] == f"Own words {i} {i * i}" for i in range(1, 20))


def plain_site(pages):
    """Texts of a site's pages of nested divs and paragraphs (tag, class, children or text), by plain counts."""

    def walk(node, path):
        path = (*path, f"{node[0]}.{node[1]}" if node[1] else node[0])
        yield node, path
        for c in node[2]:
            if not isinstance(c, str):
                yield from walk(c, path)

    def words(node):
        return "\n".join(x for x in (" ".join(c.split()) if isinstance(c, str) else words(c) for c in node[2]) if x)

    def known(page):
        held = {}
        for node, path in walk(page, ()):
            style, content = held.setdefault(path, ([], []))
            style.append(",".join(f"{c[0]}.{c[1]}" if c[1] else c[0] for c in node[2] if not isinstance(c, str)))
            content.append(words(node))
        return {p: (tuple(s), tuple(c)) for p, (s, c) in held.items()}

    each = [known(p) for p in pages]
    different = list({words(p): k for p, k in zip(pages, each)}.items())
    counts, kinds = {}, Counter()
    for _, held in different:
        for path, pair in held.items():
            counts.setdefault(path, []).append(pair)
    for path in counts:
        kinds[path[:-1]] += 1

    def entropy(values):
        m = len(values)
        h = -sum(n / m * math.log(n / m) for n in Counter(values).values()) / math.log(m) if m > 1 else 1.0
        return (h * m + 1) / (m + 1)

    low = {}
    for path, pairs in counts.items():
        style, content = (entropy([p[i] for p in pairs]) for i in (0, 1))
        weight = html_text.DAMPING ** kinds[path]
        if len(path) > 1 and max(content, (1 - weight) * style + weight * content) < html_text.LEAST_IMPORTANCE:
            low[path] = {c for c, n in Counter(p[1] for p in pairs).items() if n > 1}

    def left(node, path, held):
        path = (*path, f"{node[0]}.{node[1]}" if node[1] else node[0])
        if path in low and held[path][1] in low[path]:
            return ""
        return " ".join(c if isinstance(c, str) else left(c, path, held) for c in node[2])

    texts = [" ".join(left(p, (), h).split()) for p, h in zip(pages, each)]
    return [t or " ".join(words(p).split()) for t, p in zip(texts, pages)]


def test_random_sites(spark):
    r = random.Random(11)
    shared = ["All rights reserved", "Read our terms", "Follow us here", "One of two"]

    def tree(depth):
        if depth == 0 or r.random() < 0.3:
            said = r.choice(shared) if r.random() < 0.6 else f"own {r.randrange(10**6)} words"
            return ("p", r.choice(["", "x", "y"]), [said])
        return ("div", r.choice(["", "k", "l", "m"]), [tree(depth - 1) for _ in range(r.randrange(1, 4))])

    def html(node):
        inner = "".join(c if isinstance(c, str) else html(c) for c in node[2])
        return f"<{node[0]}{f' class={node[1]}' if node[1] else ''}>{inner}</{node[0]}>"

    rows, want, number = [], {}, 0
    for site in range(8):
        frame = [tree(3) for _ in range(r.randrange(1, 4))]
        pages = []
        for _ in range(r.randrange(2, 25)):
            page = ("html", "", [*(c if r.random() < 0.9 else tree(2) for c in frame), tree(2)])
            pages.append(page if not pages or r.random() < 0.85 else r.choice(pages))
        for page, said in zip(pages, plain_site(pages)):
            rows.append((number, f"https://s{site}.example/{number}", "".join(html(c) for c in page[2])))
            want[number] = said
            number += 1
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for few in (html_text.BROADCAST_NODES, 0):
        assert {x.page_id: x.text for x in html_text.extract_text(df, broadcast_nodes=few).collect()} == want
    whole = {i: html_text.article_text(html_text.Dom(h), set()) for i, _, h in rows}
    assert sum(whole[i] != want[i] for i in want) > 20
    assert df.select(F.count("*")).first()[0] == len(want)
