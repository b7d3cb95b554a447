import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language

SOUNDS = {"aa": "ka lo mi ta ro ".split(), "bb": "schu wei ung lich zt ".split(), "cc": "eau oix que ille ent ".split()}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choice(SOUNDS[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def corpus(n=240):
    rnd = random.Random(4)
    return [(i, text(rnd, lang := rnd.choice(list(SOUNDS)), rnd.randrange(20, 80)), lang) for i in range(n)]


def test_held_out_accuracy(spark, table, docs):
    rows = corpus()
    got = language.op4_language(spark, table(docs(rows))).collect()
    lang = {i: x for i, _, x in rows}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    out = [r for r in got if r["held_out"]]
    assert len(got) == len(rows) and out and all(r["lang_pred"] == lang[r["doc_id"]] for r in out)


def test_mixtures(docs):
    rnd = random.Random(6)
    model = language.train(docs(corpus()))
    half = " ".join([text(rnd, "aa", 300), text(rnd, "bb", 100)])
    got = {r["doc_id"]: r for r in language.predict(docs([(1, half), (2, text(rnd, "cc", 50)), (3, text(rnd, "aa", 2))]), model).collect()}
    shares = {x["lang"]: x["share"] for x in got[1]["lang_shares"]}
    assert set(shares) == {"aa", "bb"} and 0.6 < shares["aa"] < 0.9 and got[1]["lang_pred"] == "aa"
    assert [x["lang"] for x in got[2]["lang_shares"]] == ["cc"] and got[2]["score"] == 1
    assert got[3]["lang_pred"] == "aa"


def test_em_raises_the_likelihood():
    rnd = np.random.default_rng(1)
    p = rnd.random((3, 200)).astype(np.float32)
    c = rnd.integers(1, 5, 200).astype(np.float32)
    last = -np.inf
    for passes in (0, 1, 2, 5, 20, 200):
        pi, ll, gap = language._em(p, c, np.array([0]), np.array([200]), np.full((3, 1), 1 / 3, np.float32), passes)
        assert ll[0] >= last - 1e-2 and pi.sum() == pytest.approx(1, abs=1e-4)
        last = ll[0]
    assert gap.max() < 1


def test_odd_rows(docs):
    model = language.train(docs([*corpus(60), (900, None, "aa"), (901, "ka lo", None)]))
    odd = docs([(1, None), (2, ""), (3, "12 !? \n"), (4, "中文"), (None, "ka lo mi ta"), (4, "中文"), (5, "ka lo " * 40_000)]).withColumn("score", F.lit("mine"))
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["_score"]) for r in language.predict(odd, model).where("score = 'mine'").collect()}
    assert got[1, None] == got[2, ""] == got[3, "12 !? \n"] == ("und", 0.0)
    assert got[4, "中文"][0] in SOUNDS and got[None, "ka lo mi ta"][0] == "aa" and got[5, "ka lo " * 40_000] == ("aa", 1.0)
    none = language.train(docs([(1, None, None)]))
    assert none.languages == [] and language.predict(docs([(1, "abc")]), none).first()["lang_pred"] == "und"
    assert language.predict(docs([]), model).count() == 0


def test_rejecting_keeps_clean_documents(docs):
    rows = corpus(80)
    df = docs([*rows, (1000, "12 34", "aa"), (1001, None, "bb")]).withColumn("lang_pred", F.lit("mine"))
    kept = language.keep_known(df.drop("lang_pred"))
    assert kept.columns == df.columns[:-1] and {r["doc_id"] for r in kept.collect()} == {i for i, *_ in rows}


def test_very_many_languages(docs):
    """Buckets are folded; the model stays as large."""
    name = lambda i: f"{chr(97 + i // 26)}{chr(97 + i % 26)}" * 3
    model = language.train(docs([(i, f"{name(i)} " * 40, f"l{i:03d}") for i in range(300)]))
    assert len(model.languages) == 300 and model.p.size <= language.NUMBERS and model.folded == 2
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs([(7, f"{name(7)} " * 30), (250, f"{name(250)} " * 30)]), model).collect()}
    assert got == {7: "l007", 250: "l250"}


def test_sets_against_all_sets():
    """Forward selection finds the set of best penalised likelihood among all sets, and its proportions."""
    rnd = np.random.default_rng(8)
    p = rnd.dirichlet(np.full(3000, 0.05), 5) + 1e-7
    p /= p.sum(axis=1, keepdims=True)
    model = language.Model(list("abcde"), p.astype(np.float32))
    for _ in range(12):
        shares = rnd.dirichlet(np.ones(5)) * (rnd.random(5) < 0.5)
        if not shares.sum():
            continue
        n = rnd.multinomial(3000, shares / shares.sum() @ p)
        at = np.flatnonzero(n)
        c = n[at] / language.GRAM
        penalty = np.log(c.sum()) + 1
        best = (-np.inf, None, None)
        for size in range(1, 6):
            for own in combinations(range(5), size):
                pi = np.full(size, 1 / size)
                for _ in range(200):
                    pi = pi * (p[list(own)][:, at] * (c / (pi @ p[list(own)][:, at]))).sum(axis=1) / c.sum()
                value = (c * np.log(pi @ p[list(own)][:, at])).sum() - (size - 1) * penalty
                if value > best[0]:
                    best = value, own, pi
        got = language.infer(model, [(at, n[at].astype(np.float32))])[:, 0]
        assert tuple(np.flatnonzero(got)) == best[1]
        assert np.abs(got[list(best[1])] - best[2]).max() < 0.02


def test_sets_of_more_than_three_languages():
    """Shares 40/20/20/20 and five equal ones are found whole."""
    rnd = np.random.default_rng(3)
    p = rnd.dirichlet(np.full(language.BUCKETS, 0.01), 6)
    model = language.Model(list("abcdef"), ((p + 1e-7) / (p + 1e-7).sum(axis=1, keepdims=True)).astype(np.float32))
    grams = []
    for shares in ([0.4, 0.2, 0.2, 0.2, 0, 0], [0, 0.2, 0.2, 0.2, 0.2, 0.2], [1, 0, 0, 0, 0, 0]):
        n = rnd.multinomial(4000, np.array(shares) @ p)
        at = np.flatnonzero(n)
        grams.append((at, n[at].astype(np.float32)))
    pi = language.infer(model, grams)
    assert (pi > 0).sum(axis=0).tolist() == [4, 5, 1]
    assert abs(pi[0, 0] - 0.4) < 0.05 and pi[0, 0] < language.MIN_SHARE
