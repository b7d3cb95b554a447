"""Plain versions of the operators for small inputs."""

import hashlib
import re
import string
from collections import Counter, defaultdict

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_words(text):
    return words((text or "").translate(LOWER))


def shingles(text, k):
    w = lower_words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def components(rows, k, percent):
    """{id: (set size, least id reachable)} of (id, text) rows."""
    ids = [i for i, _ in rows]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def substrings(rows, window=50):
    """{id: (words, removed, digest)}: windows that also start in a row with a smaller id go."""
    seen = {}
    split = {i: words(t) for i, t in rows}
    for i, w in split.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            seen[key] = min(seen.get(key, i), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def lines(rows, percent=80):
    """{id: text without lines similar to an earlier line}."""
    seen, out = [], {}
    for i, text in sorted(rows):
        if text is None:
            out[i] = None
            continue
        kept = []
        for line in text.split("\n"):
            w = frozenset(lower_words(line))
            if w and any(100 * len(w & v) >= percent * len(w | v) for v in seen):
                pass
            else:
                kept.append(line)
            if w:
                seen.append(w)
        out[i] = "\n".join(kept)
    return out


def quality(text):
    """(words, word characters, symbols, repeated lines, words in repeated 3-word windows)."""
    w = words(text)
    grams = list(zip(w, w[1:], w[2:]))
    counts, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered.update((i, i + 1, i + 2))
    own = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(own) - len(set(own)), len(covered)


def targets(sizes):
    """{source: target}: weights 1, 2, 3 by name (None last), three times the source at most, the excess dealt again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        left = sum(sizes.values()) - sum(target.values())
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            open_.discard(s)


def by_source(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out
