import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import hmm


def test_forward_is_exact():
    """Against the sum over all state paths."""
    rnd = np.random.default_rng(3)
    k = 3
    start, move = rnd.dirichlet(np.ones(k)), rnd.dirichlet(np.ones(k), k)
    emit = rnd.random((hmm.SYMBOLS + 1, k))
    c = hmm.Chain(start, move, emit / emit.sum(axis=0))
    lens = np.array([0, 3, 1, 5])
    symbols = rnd.integers(0, 50, lens.sum()).astype(np.int32)
    s = hmm.Sequences(lens, symbols, np.arange(4))
    ll, _, _ = hmm.forward(c, s)
    for d, got in zip(s.order, ll, strict=True):
        first = lens[:d].sum()
        seq = [*symbols[first : first + lens[d]], hmm.END]
        total = 0.0
        for path in itertools.product(range(k), repeat=len(seq)):
            p = c.start[path[0]] * c.emit[seq[0], path[0]]
            for t in range(1, len(seq)):
                p *= c.move[path[t - 1], path[t]] * c.emit[seq[t], path[t]]
            total += p
        assert got == pytest.approx(math.log(total), rel=1e-5)


def test_counts_add_up_and_passes_help():
    rnd = np.random.default_rng(5)
    lens = rnd.integers(0, 60, 80)
    symbols = np.concatenate([rnd.integers(0, 40, n) + 40 * (i % 2) for i, n in enumerate(lens)]).astype(np.int32)
    background = np.full(hmm.SYMBOLS + 1, 1 / (hmm.SYMBOLS + 1))
    first = np.concatenate(([0], np.cumsum(lens)))
    c = hmm.seed_chain([symbols[first[i] : first[i + 1]] for i in range(20) if lens[i]], background, 2)
    s = hmm.Sequences(lens, symbols, np.arange(80))
    last = -np.inf
    for _ in range(4):
        start, move, emit, ll = hmm.expected_counts(c, s)
        assert start.sum() == pytest.approx(80, rel=1e-4) and emit.sum() == pytest.approx(lens.sum() + 80, rel=1e-4) and move.sum() == pytest.approx(lens.sum(), rel=1e-3)
        assert ll > last - 1
        last = ll
        c = hmm.Chain(start / start.sum(), (move + 1e-9) / (move + 1e-9).sum(axis=1, keepdims=True), (emit + 1e-6) / (emit + 1e-6).sum(axis=0))


def corpus(n=150):
    rnd = random.Random(8)
    words = {"a": [f"a{i}" for i in range(300)], "b": [f"b{i}" for i in range(300)]}
    return [(i, " ".join(rnd.choice(words["ab"[i % 2]]).title() for _ in range(rnd.randrange(20, 90)))) for i in range(n)]


def check_base(rows, got):
    tokens = {i: [*(t or "").encode().lower().split(), b" "] for i, t in rows}
    out = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(x for i, w in tokens.items() if not out[i] for x in w)
    n, v = sum(c.values()), len(c)
    for r in got:
        w = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r["score"] < 0


def test_base_score_and_gain(spark, table, docs):
    rows = corpus()
    got = hmm.op5_hmm(spark, table(docs(rows))).collect()
    assert len(got) == len(rows)
    check_base(rows, got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_blocks_do_not_matter(docs):
    from pyspark.sql import functions as F

    rows = corpus(40)
    a, b = ({r["doc_id"]: r["base_score"] for r in hmm.score(docs(rows, parts=p), F.lit(False), block_words=w).collect()} for p, w in ((1, 10**6), (4, 100)))
    assert a == pytest.approx(b)


def test_odd_rows(spark, table, docs):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "x " * 20_000), (5, "y" * 5000)]
    got = hmm.op5_hmm(spark, table(docs(rows))).collect()
    check_base(rows, got)
    from pyspark.sql import functions as F

    assert hmm.op5_hmm(spark, table(docs([]))).count() == 0
    untrained = hmm.score(docs([(1, "a b"), (1, "a b")]), F.lit(True)).collect()
    assert len(untrained) == 2 and untrained[0]["n_known"] == 0 and untrained[0]["base_score"] == 0
