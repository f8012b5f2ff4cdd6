"""The FM-index against plain search, and substring dedup on texts that repeat themselves."""

import numpy as np
import pytest

from corpusmill.llm import substring_dedup
from corpusmill.llm.fm_index import NOBODY, FMIndex
from tests.llm import brute


def plain(held, owners, streamed, depth):
    def length(at):
        return max(n for n in range(min(depth, len(at)) + 1) if n == 0 or any(p[i : i + n] == at[:n] for p in held for i in range(len(p) - n + 1)))

    def owner(at):
        return min((o for p, o in zip(held, owners) for i in range(len(p) - depth + 1) if len(at) >= depth and p[i : i + depth] == at[:depth]), default=NOBODY)

    return [length(streamed[i:]) for i in range(len(streamed))], [owner(streamed[i:]) for i in range(len(streamed))]


@pytest.mark.parametrize("seed", range(12))
def test_matching_statistics(seed):
    """Lengths that fall and rise, words that the index lacks, and owners, at every place of passages that aren't in the index."""
    rng = np.random.default_rng(seed)
    draw = lambda n, most: [b"%d" % x for x in rng.integers(0, most, n)]
    held = [draw(int(rng.integers(1, 30)), 3 + seed % 3) for _ in range(6)]
    owners = rng.permutation(6) * 10
    streamed = [draw(25, 4 + seed % 3) for _ in range(4)] + [held[0][:-1] + [b"new"] + held[1], []]
    depth = 3 + seed % 5
    index = FMIndex(held, owners, depth)
    lengths, found = index.matching_statistics([index.symbols(s) for s in streamed])
    pruned = index.matching_statistics([index.symbols(s) for s in streamed], least=depth)[1]
    for s, got_length, got_owner, got_pruned in zip(streamed, lengths, found, pruned):
        want = plain(held, owners, s, depth)
        assert got_length.tolist() == want[0]
        assert got_owner.tolist() == got_pruned.tolist() == want[1]


def test_search_decides(spark, monkeypatch):
    """Texts of few words, periods and equal passages inside; without the backward search nothing is found."""
    rng = np.random.default_rng(5)
    base = [f"v{x}" for x in rng.integers(0, 9, 400)]
    rows = [(i, " ".join(base[(i * 53) % 300 : (i * 53) % 300 + 30 + i % 60] + [f"own{i}"] * (i % 3))) for i in range(60)]
    rows += [(100, "a b " * 60), (101, "b a " * 60), (102, "x " + "a b " * 30), (99, "z " * 59)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for window in (12, 50):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, window=window, with_text=False).collect()}
        assert got == brute.substring(rows, window)
    words = [base[:60], base[5:70], base[20:80]]
    whole = lambda: [x.tolist() for x in substring_dedup.first_owners(np.zeros(3, dtype=np.int64), np.array([1, 2, 3]), [[w.encode() for w in p] for p in words], 50)]
    assert whole() == [[1] * 11, [1] * 6 + [2] * 10, [2] + [3] * 10]
    monkeypatch.setattr(FMIndex, "step", lambda self, symbol, low, high: (low * 0, low * 0))
    assert whole() == [[1] * 11, [2] * 16, [3] * 11]
