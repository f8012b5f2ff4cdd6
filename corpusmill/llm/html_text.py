"""HTML extraction by site style trees.

The DOMs of a site's pages are merged into one tree, in which a node is the path of tags and classes from the root. A
node's presentation is the sequence of its children's tags, its content the text in it and below. What is laid out and
worded the same on all pages of a site tells nothing: the entropy of both over the site's different pages is the node's
importance. From each page the branches of low importance go, inside articles too, where they hold what the site's pages
share; what only this page says stays. Branches whose tag or class names a page's furniture go as well, unless they hold
the page's main part; where marked articles hold most of what is left, they are the text. A node is known by a hash of its
path, so trees of any depth cost the same a node; the fewer different pages a site has, the less its tree's verdict weighs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import written
from corpusmill.llm.line_dedup import host

#: Importance below which a branch goes, and the number of pages that count as found to differ before any is seen.
LEAST_IMPORTANCE, PRIOR_PAGES = 0.2, 1.0
#: Share of a page's text that its articles have to hold to be the whole of its main part.
LEAST_SHARE = 0.5
#: Share of a node's importance that its content has, for each child kind (the rest is its presentation).
DAMPING = 0.9
#: Unimportant nodes up to which they are broadcast; beyond, they join the pages by site and path.
BROADCAST_NODES = 100_000

# HTML's elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select option textarea datalist".split())
FURNITURE = frozenset("nav footer button dialog menu menuitem".split())
ARTICLE = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NOISE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed)?|promo(?:tion)?|banner|menu|nav(?:bar|igation)?|breadcrumbs?|sidebar|side-?bar|footer"
    r"|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|reply|replies|disqus|widget|pagination|pager|toolbar|skip)(?:$|[\s_-])",
    re.I,
)
#: Outside of articles, also what heads a page.
HEAD_NAME = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])", re.I)


#: Names that a part of the page may bear that holds its main part, and those of parts that are long by nature and never do.
WEAK_NAME = re.compile(r"(?:^|[\s_-])(?:notices?|alert|banner|promo(?:tion)?|widget|overlay|toolbar|modal)(?:$|[\s_-])", re.I)
THREAD_NAME = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|disqus|related|recommended)(?:$|[\s_-])", re.I)
#: Letters without links that a part without headings has to have to be taken for the main part, whatever it is called.
LEAST_PART = 200
#: Articles of one kind side by side that make a list.
LIST = 3


class Node:
    __slots__ = ("tag", "name", "path", "above", "children", "noise", "named", "article", "inside", "plain", "holds")

    def __init__(self, tag: str, name: str, parent: Node | None):
        self.tag, self.name, self.children = tag, name, []
        # noise goes; what is only named so may turn out to hold the page
        self.noise, self.named, self.article = False, "", False
        self.inside = parent is not None and (parent.inside or parent.article)
        self.plain, self.holds = 0, frozenset()
        # the path's hash, from that of the path above: the root's is 0
        self.above = parent.path if parent else None
        self.path = xxhash.xxh3_64_intdigest(f"{self.above}/{name}") - (1 << 63) if parent else 0


class Dom(HTMLParser):
    """The tree of a page. Texts are strings among a node's children; end tags that are missing are implied where HTML implies them."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", "", None)
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            return
        closes = CLOSES.get(tag, frozenset()) | (frozenset(["p"]) if tag in CLOSES_P else frozenset())
        if closes:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in closes:
                    del self.open[i:]
                    break
                if self.open[i].tag not in INLINE and self.open[i].tag not in ("tbody", "thead", "tfoot") and self.open[i].tag not in closes:
                    break
        named = dict(attrs)
        label = f"{named.get('class') or ''} {named.get('id') or ''} {named.get('role') or ''}".strip()
        parent = self.open[-1]
        node = Node(tag, f"{tag}.{label}" if label else tag, parent)
        inside = node.inside
        node.article = tag in ARTICLE
        if tag in HIDDEN or tag in FURNITURE or "hidden" in named:
            node.noise = True
        elif tag == "aside" or (label and not node.article and THREAD_NAME.search(label)):
            node.named = "thread"
        elif tag == "form" or (label and not node.article and WEAK_NAME.search(label)):
            node.named = "weak"
        elif (tag == "header" and not inside) or bool(label and not node.article and (NOISE_NAME.search(label) or (not inside and HEAD_NAME.search(label)))):
            node.named = "strong"
        node.noise = node.noise or bool(node.named)
        parent.children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag in ("svg", "math", "path"):
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def nodes(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in node.children if isinstance(c, Node))


def judged(node: Node, parent: Node) -> bool:
    """Whether the tree may cut a node: inline elements are words of a block's text, unless they stand alone between blocks."""
    if node.tag not in INLINE:
        return True
    return any(isinstance(c, Node) and c.tag not in INLINE for c in parent.children) and not any(isinstance(c, str) and c.strip() for c in parent.children)


def settle(dom: Dom, low: set[int] | frozenset[int] = frozenset()) -> Dom:
    """``dom``, in which parts that only their tag or name calls furniture are kept if they hold the page's main part.

    While no article or main element stands outside of furniture, the outermost such part with most text (without links) is
    unwrapped, if it has more than all that stands outside and is not among the paths in ``low``. It has to have an article
    or main element; forms and weak names may have a heading or LEAST_PART letters instead; asides and threads of comments
    need a main element. Other furniture inside stays furniture.
    """
    order, stack = [], [(dom.root, False)]
    plain: dict[int, int] = {}
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        order.append(node)
        plain[id(node)] = 0 if linked else sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        stack.extend((c, linked) for c in node.children if isinstance(c, Node) and (c.named or not c.noise))
    for node in reversed(order):
        inner = [c for c in node.children if isinstance(c, Node) and (c.named or not c.noise)]
        node.plain = plain[id(node)] + sum(c.plain for c in inner)
        node.holds = frozenset([node.tag] if node.tag in ("article", "main", "h1") else []).union(*(c.holds for c in inner))
    while True:
        outside, parts, stack = 0, [], [dom.root]
        while stack:
            node = stack.pop()
            if node.named and node.noise:
                parts.append(node)
                continue
            if node.article:
                return dom
            outside += plain[id(node)]
            stack.extend(c for c in node.children if isinstance(c, Node) and (c.named or not c.noise))

        def main(n: Node) -> bool:
            if n.path in low or n.plain <= outside:
                return False
            if n.named == "thread":
                return "main" in n.holds
            return bool(n.holds & {"article", "main"}) or (n.named == "weak" and ("h1" in n.holds or n.plain >= LEAST_PART))

        found = max((n for n in parts if main(n)), key=lambda n: n.plain, default=None)
        if found is None:
            return dom
        found.noise, found.named = False, ""


def observed(dom: Dom) -> dict[int, tuple[int | None, int, int]]:
    """Of each path outside of what is hidden: the path above, and hashes of its presentation and of the text in it and below, over all its nodes of the page.

    Furniture doesn't count for what stands above it; parts that are only named so are nodes too, and those inside them.
    """
    order, stack = [], [dom.root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and (c.named or not c.noise))
    # children come after their parents; a branch without words counts for nothing
    below: dict[int, str] = {}
    for node in reversed(order):
        parts = [" ".join(c.split()) if isinstance(c, str) else "" if c.noise else below.get(id(c), "") for c in node.children]
        text = "\n".join(x for x in parts if x)
        below[id(node)] = xxhash.xxh3_64_hexdigest(text) if text else ""
    held: dict[int, tuple[int | None, list[str], list[str]]] = {}
    for node in order:
        _, style, content = held.setdefault(node.path, (node.above, [], []))
        style.append(",".join(c.name for c in node.children if isinstance(c, Node) and not c.noise))
        content.append(below[id(node)])
    return {p: (up, xxhash.xxh3_64_intdigest(";".join(s)) - (1 << 63), xxhash.xxh3_64_intdigest("\n".join(c)) - (1 << 63)) for p, (up, s, c) in held.items()}


def _teasers(articles: list[tuple[Node, Node]]) -> set[int]:
    """Of outermost articles and their parents, those of lists: LIST or more of one kind side by side that mostly are links or have their heading in one."""
    kinds: dict[tuple[int, str], list[Node]] = {}
    for node, parent in articles:
        kinds.setdefault((id(parent), node.name), []).append(node)

    def linked(article: Node) -> bool:
        stack, letters, links, heading = [(article, False, False)], 0, 0, False
        while stack:
            node, in_link, in_heading = stack.pop()
            in_link, in_heading = in_link or node.tag == "a", in_heading or node.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            heading = heading or (in_link and in_heading)
            for c in node.children:
                if isinstance(c, str):
                    letters, links = letters + len(c.strip()), links + (len(c.strip()) if in_link else 0)
                elif not c.noise:
                    stack.append((c, in_link, in_heading))
        return heading or 2 * links >= letters > 0

    return {id(n) for group in kinds.values() if len(group) >= LIST and all(map(linked, group)) for n in group}


def article_text(dom: Dom, low: frozenset[int] | set[int]) -> str:
    """The text of the page's main part without noise and without branches whose path is in ``low``.

    A list of linked articles (teasers) goes where what stands beside it has more letters than its longest, LEAST_PART at
    least. The articles that are left are the main part if they hold LEAST_SHARE of the text that is left; else it is all of that.
    """
    # pieces of text with the outermost article that they stand in; blocks are set off by blanks
    pieces: list[tuple[str, int | None]] = []
    articles: list[tuple[Node, Node]] = []
    stack: list[tuple[Node | str, Node, int | None]] = [(dom.root, dom.root, None)]
    while stack:
        node, parent, owner = stack.pop()
        if isinstance(node, str):
            pieces.append((node, owner))
            continue
        gone = node.noise or (node.path in low and judged(node, parent))
        if gone or node.tag not in INLINE:
            pieces.append((" ", -1))
        if gone:
            continue
        if node.article and owner is None:
            articles.append((node, parent))
            owner = id(node)
        if node.tag not in INLINE:
            stack.append((" ", node, -1))
        stack.extend((c, node, owner) for c in reversed(node.children))
    text = lambda keep: " ".join("".join(t for t, o in pieces if o == -1 or keep(o)).split())
    teasers = _teasers(articles) if len(articles) >= LIST else set()
    if teasers:
        beside = len(text(lambda o: o not in teasers))
        if beside < LEAST_PART or beside <= max(len(text(lambda o, t=t: o == t)) for t in teasers):
            teasers = set()
    whole, part = text(lambda o: o not in teasers), text(lambda o: o is not None and o not in teasers)
    return part if part and len(part) >= LEAST_SHARE * len(whole) else whole


def style_nodes(pages: DataFrame, site: Column, html_col: str = "html") -> DataFrame:
    """``_site``, ``_path``, ``_above``, ``_style``, ``_content`` and ``_n``: what the nodes of each site's pages look like and hold, and on how many different pages.

    Pages of the same text count once, so that copies don't make an article look like boilerplate. Equal rows are merged
    before the shuffle, by site, path and hashes, so a large site's nodes spread over all tasks.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = set()
            for name, html in zip(pdf["_site"], pdf["_html"]):
                held = observed(Dom(html))
                page = held[0][2]
                out.update((name, path, above, style, content, page) for path, (above, style, content) in held.items())
            frame = pd.DataFrame(list(out), columns=["_site", "_path", "_above", "_style", "_content", "_page"])
            yield frame.assign(_above=frame["_above"].astype("Int64"))

    once = pages.select(site.alias("_site"), F.col(html_col).alias("_html")).where("_html IS NOT NULL AND _site IS NOT NULL")
    seen = once.mapInPandas(look, "_site string, _path long, _above long, _style long, _content long, _page long").distinct()
    # written, so that pages are parsed once for all that follows
    return written(seen.groupBy("_site", "_path", "_above", "_style", "_content").agg(F.count("*").alias("_n")), "style_nodes")


def style_tree(seen: DataFrame) -> DataFrame:
    """``_site``, ``_path``, ``_pages`` and ``_importance`` of every node of each site's merged tree (``style_nodes``).

    The entropies are over a site's different pages and divided by their greatest possible value; PRIOR_PAGES draw them to 1.
    """

    def entropy(column: str) -> DataFrame:
        by = seen.groupBy("_site", "_path", "_above", column).agg(F.sum("_n").alias("_n"))
        both = by.groupBy("_site", "_path", "_above").agg(F.sum("_n").alias("_m"), F.sum(F.col("_n") * F.log("_n")).alias("_nlogn"))
        found = F.when(F.col("_m") > 1, (F.log("_m") - F.col("_nlogn") / F.col("_m")) / F.log("_m")).otherwise(1.0)
        drawn = (found * F.col("_m") + PRIOR_PAGES) / (F.col("_m") + PRIOR_PAGES)
        return both.select("_site", "_path", "_above", F.col("_m").alias("_pages"), drawn.alias(column))

    style, content = entropy("_style"), entropy("_content")
    own = style.join(content.drop("_pages", "_above"), ["_site", "_path"])
    # what is worded differently stays however it is laid out
    below = own.where("_above IS NOT NULL").groupBy("_site", F.col("_above").alias("_path")).agg(F.count("*").alias("_kinds"))
    weight = F.pow(F.lit(DAMPING), F.coalesce("_kinds", F.lit(0)))
    joined = own.join(below, ["_site", "_path"], "left")
    inner = (1 - weight) * F.col("_style") + weight * F.col("_content")
    return joined.select("_site", "_path", "_pages", F.greatest("_content", inner).alias("_importance"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """Id, url, text and n_chars (code points) of each page.

    The text is the main part's blocks in page order, with white space as single blanks and character references decoded.
    A node of low importance goes from a page where it holds what two of the site's pages or more hold there; where all of a
    page's text would go so, none does. Null and empty pages give an empty text; pages whose url has no host have no style
    tree and lose only what tags and classes name as furniture. Very long pages are read whole, repeated rows each for
    itself, and an empty table gives an empty result; other columns of ``pages``, whatever their names, are left out.
    """
    site = host(F.col(url_col))
    seen = style_nodes(pages, site, html_col)
    least = style_tree(seen).where((F.col("_importance") < LEAST_IMPORTANCE) & (F.col("_path") != 0)).select("_site", "_path")
    held = seen.groupBy("_site", "_path", "_content").agg(F.sum("_n").alias("_n")).where("_n > 1")
    low = written(held.join(least, ["_site", "_path"]).select("_site", F.struct("_path", "_content").alias("_node")), "low_nodes")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), site.alias("_site"))
    few = low.limit(broadcast_nodes + 1).count() <= broadcast_nodes
    table: dict[str, set[tuple[int, int]]] = {}
    if few:
        for r in low.collect():  # three short values each, at most BROADCAST_NODES
            table.setdefault(r["_site"], set()).add(tuple(r["_node"]))
        rows = rows.withColumn("_low", F.lit(None).cast("array<struct<_path:long,_content:long>>"))
    else:
        # as many as a site has nodes of low importance, which are the same on its pages
        mine = low.groupBy("_site").agg(F.collect_list("_node").alias("_low"))
        rows = rows.join(mine, "_site", "left")
    sent = pages.sparkSession.sparkContext.broadcast(table)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for name, html, nodes_ in zip(pdf["_site"], pdf["_html"], pdf["_low"]):
                if not isinstance(html, str):
                    texts.append("")
                    continue
                dom = Dom(html)
                common = sent.value.get(name, ()) if nodes_ is None else {(n["_path"], n["_content"]) for n in nodes_}
                paths = {path for path, (_, _, content) in observed(dom).items() if (path, content) in common} if common else set()
                settle(dom, paths)
                texts.append(article_text(dom, paths) or (article_text(dom, set()) if paths else ""))
            frame = pdf[["_id", "_url"]].assign(text=texts)
            yield frame.assign(n_chars=[len(t) for t in texts])

    kind = pages.schema[id_col].dataType.simpleString()
    out = rows.select("_id", "_url", "_html", "_site", "_low").mapInPandas(cut, f"_id {kind}, _url string, text string, n_chars long")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")
