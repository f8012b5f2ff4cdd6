"""Plain versions of the operators, for small inputs."""

import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def substring(docs, window=50):
    """docs: (id, text); returns id -> (n_words, n_removed, sha)."""
    words = {d: WORD.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                keep[i : i + window] = [False] * window
        out[d] = (len(w), keep.count(False), hashlib.sha256(" ".join(x for x, k in zip(w, keep) if k).encode()).hexdigest())
    return out


def near(docs, width=4, percent=80):
    """docs: (id, text); returns id -> (n_shingles, component, kept)."""
    sets = {}
    for d, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    holders = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    common = {}
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def quality_base(text, window=5):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
    again = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    covered = {j for i, g in enumerate(grams) if g in again for j in range(i, i + window)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def top(vectors, k=10, every=100):
    """vectors: (id, list or None); returns (query, rank, id, score) rows."""
    import math

    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return out
