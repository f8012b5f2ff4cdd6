"""Links between the parts of a block, and components of texts around the limit, against all pairs."""

import numpy as np
import pytest

from corpusmill.llm import minhash_dedup
from tests.llm import brute


@pytest.mark.parametrize("seed", range(8))
def test_connecting(seed):
    rng = np.random.default_rng(seed)
    base = rng.choice(10**6, 60, replace=False)
    sets = []
    for _ in range(50):
        s = np.unique(np.concatenate((rng.choice(base, int(rng.integers(45, 60)), replace=False), rng.integers(0, 10**6, int(rng.integers(0, 6))))))
        sets.append(s.astype(np.uint64))
    part, out, ids = rng.integers(0, 20, 50), rng.random(50) < 0.4, np.arange(50) + 1000
    if out.all() or not out.any():
        return
    part[out] += 20 * (part[out] % 2)
    found = minhash_dedup.connecting(ids, part, out, sets, 80)
    links = [(i, j) for i in np.flatnonzero(out) for j in np.flatnonzero(~out) if part[i] != part[j] and 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - c)]
    assert {(i - 1000, j - 1000) for i, j in found} <= set(links)

    def reach(pairs):
        top = {p: p for p in part}
        for i, j in pairs:
            x, y = top[part[i]], top[part[j]]
            top = {p: y if t == x else t for p, t in top.items()}
        return {frozenset(p for p in top if top[p] == t) for t in set(top.values())}

    assert reach([(i - 1000, j - 1000) for i, j in found]) == reach(links)
    assert len(found) < len(set(part))


def test_exactly_at_the_limit(spark):
    """Pairs of 80 and of 79 in a hundred, in one crowd of texts that share buckets."""
    base = [f"b{i}" for i in range(123)]
    rows = [(0, " ".join(base))]
    # 120 shingles; a change at the end of k words takes k away and adds k: 120 - k common of 120 + k
    for k in range(1, 25):
        rows += [(10 * k + j, " ".join([*base[: 123 - k], *[f"x{k}_{j}_{i}" for i in range(k)]])) for j in range(3)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == brute.near(rows)
