"""Flows against all possible ones, mixes of overlapping sources, and lines near the ratio."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import line_dedup, mixing


def cheapest(capacity, members, quota, repeats):
    """Most flow and its least price, by trying every amount on every arc."""
    arcs = [(i, s) for i, ms in enumerate(members) for s in ms]
    best = (0, 0)
    for amounts in itertools.product(*[range(min(capacity[i] * repeats, quota[s]) + 1) for i, s in arcs]):
        out, into = Counter(), Counter()
        for (i, s), n in zip(arcs, amounts):
            out[i] += n
            into[s] += n
        if all(out[i] <= capacity[i] * repeats for i in out) and all(into[s] <= quota[s] for s in into):
            price = sum(sum(k // capacity[i] for k in range(n)) for i, n in out.items() if n)
            best = min(best, (-sum(amounts), price))
    return -best[0], best[1]


@pytest.mark.parametrize("seed", range(40))
def test_flow_is_largest_and_cheapest(seed):
    rng = np.random.default_rng(seed)
    m = int(rng.integers(1, 4))
    members = [sorted({int(x) for x in rng.integers(0, m, 2)}) for _ in range(int(rng.integers(1, 4)))]
    capacity, quota = [int(x) for x in rng.integers(0, 4, len(members))], [int(x) for x in rng.integers(0, 7, m)]
    flow = mixing.min_cost_flow(capacity, members, quota, 3)
    out = [sum(f.values()) for f in flow]
    assert all(n <= 3 * c for n, c in zip(out, capacity)) and all(set(f) <= set(ms) and min(f.values(), default=0) >= 0 for f, ms in zip(flow, members))
    assert all(sum(f.get(s, 0) for f in flow) <= q for s, q in enumerate(quota))
    price = sum(sum(k // c for k in range(n)) for n, c in zip(out, capacity) if n)
    assert (sum(out), price) == cheapest(capacity, members, quota, 3)


def test_flow_of_many_patterns():
    """Thousands of patterns are a matter of their arcs, not of patterns times sources."""
    rng = np.random.default_rng(0)
    members = [sorted({int(x) for x in rng.integers(0, 300, 3)}) for _ in range(4000)]
    capacity = [int(x) for x in rng.integers(1, 1000, 4000)]
    quota = [int(x) for x in rng.integers(1, 20_000, 300)]
    flow = mixing.min_cost_flow(capacity, members, quota, 3)
    into = Counter()
    for f in flow:
        into.update(f)
    assert all(into[s] <= q for s, q in enumerate(quota)) and sum(into.values()) > 0.95 * min(sum(quota), 3 * sum(capacity))


def test_mix_of_overlapping_sources(spark):
    """Quotas are met within a document for each pattern of a source; repetition is as even as they allow."""
    kinds = [["a"], ["a", "b"], ["b", "c"], [None, "c"], ["c"], ["d"], None, []]
    rows = [(i, "w " * (5 + i % 7), kinds[i % 8]) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s array<string>").withColumn("_size", F.lit("x")).withColumn("copies", F.lit(0))
    out = mixing.mix(docs, F.col("s"), weights=(1, 2, 3), repeats=3).collect()
    assert len(out) == 800 and all(0 <= r.copies <= 3 for r in out)
    # a document in no source is in the one without name
    of = lambda r: tuple(r.sources) or (None,)
    size, taken, copies = Counter(), Counter(), {}
    for r in out:
        size[tuple(r.sources)] += r["size"]
        taken[tuple(r.sources)] += r.copies * r["size"]
        copies.setdefault(tuple(r.sources), set()).add(r.copies)
    targets = mixing.source_targets(spark.createDataFrame([(s, r["size"]) for r in out for s in of(r)], "_source string, _size long"), (1, 2, 3), 3)
    quota = {r._source: r._target for r in targets.collect()}
    assert all(quota[of(r)[0]] == pytest.approx(r.target) for r in out)
    patterns = list(size)
    names = sorted(quota, key=str)
    flow = mixing.min_cost_flow([size[p] for p in patterns], [[names.index(s) for s in p or (None,)] for p in patterns], [round(quota[s]) for s in names], 3)
    assert sum(sum(f.values()) for f in flow) == min(sum(map(round, quota.values())), 3 * sum(size.values()))
    # a pattern's documents are whole, and taken equally often but for one
    assert abs(sum(taken.values()) - sum(quota.values())) <= 6 * len(patterns)
    assert all(max(c) - min(c) <= 1 for c in copies.values())


def test_lines_near_the_ratio(spark):
    """A line of 8 and one of 12 in a hundred pages go, one of 4 stays; copies of a page don't make its lines boilerplate."""
    text = lambda i: f"own {i}\n" + "menu\n" * (i % 100 < 12) + "foot\n" * (i % 100 < 8) + "some\n" * (i % 100 < 4) + f"end {i}"
    rows = [(i, "https://a.example:80/x", text(i)) for i in range(300)] + [(1000 + i, "https://A.example/y", "copied\nline") for i in range(200)] + [(2000, None, "menu\nfoot")]
    pages = spark.createDataFrame(rows, "doc_id long, url string, text string").withColumn("_h1", F.lit(1))
    for few in (line_dedup.BROADCAST_SITES, 0):
        out = {r.doc_id: r for r in line_dedup.drop_boilerplate(pages, line_dedup.host(F.col("url")), counts=True, broadcast_sites=few).collect()}
        assert out[0].text == "own 0\nsome\nend 0" and out[50].text == text(50) and out[110].text == "own 110\nend 110" and (out[0].n_lines, out[0].n_dropped) == (5, 2)
        assert out[1000].text == "copied\nline" and out[2000].text == "menu\nfoot" and len(out) == 501


def test_lines_by_host(spark):
    """Lines are boilerplate of the host that repeats them, and stay on others."""
    rows = [(i, f"https://User@{'a' if i < 20 else 'B'}.example:80/{i}", f"Menu\nown {i}\nTerms of {'a' if i < 20 else 'b'}") for i in range(40)] + [(99, "https://c.example/", "Menu\nTerms of a"), (98, None, "Menu")]
    pages = spark.createDataFrame(rows, "page_id long, url string, text string")
    got = {r.page_id: r.text for r in line_dedup.drop_boilerplate(pages, line_dedup.host(F.col("url"))).collect()}
    assert got == {i: f"own {i}" for i in range(40)} | {99: "Menu\nTerms of a", 98: "Menu"}
