import math
import random
import re
import unicodedata
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
from conftest_sf import SF
from tidemark.llm import quality

ODD = [(1, None, "en"), (2, "", "en"), (3, " \n\t\n", None), (4, "a b c a b c", "en"), (5, "x x x x x", None), (6, "one\none\n \n one", "xx"), (7, "é中 #*$%&|<> A1", "en"), (8, "p q r " * 20_000, "en"), (8, "p q r " * 3, "en")]


def test_base_counts(docs):
    rnd = random.Random(2)
    rows = ODD[:-1] + [(100 + i, "\n".join(" ".join(rnd.choice("abcdefg#") for _ in range(rnd.randrange(9))) for _ in range(6)), "en") for i in range(60)]
    for r in quality.judge(docs(rows)).collect():
        want = brute.quality(next(t for i, t, *_ in rows if i == r["doc_id"]))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_js_distance(spark):
    a, b = [3, 0, 1], [1, 1, 2]
    p, q = [x / 4 for x in a], [x / 4 for x in b]
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    kl = lambda u: sum(x * math.log2(x / y) for x, y in zip(u, m, strict=True) if x)
    df = spark.createDataFrame([(a, b), (a, a), ([1, 0, 0], [0, 0, 1]), ([0, 0, 0], a)], "a array<long>, b array<long>")
    got = [r[0] for r in df.select(quality.js_distance(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2)) and got[1:3] == pytest.approx([0, 1]) and got[3] is None


def test_divergent_text_goes_and_clean_text_stays(spark):
    got = quality.op3_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    own = got[~got.base_failed].merge(labels, on="doc_id")
    assert own[own.quality == 1].kept.mean() == 1.0
    assert own[own.quality == 0].kept.mean() < 0.2


def test_short_texts_pass(docs):
    rows = [(i, " ".join(f"word{j} the of and" for j in range(60)), "en") for i in range(20)] + [(90, "## %% " * 26, "en")]
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judge(docs(rows)).collect()}
    assert kept[90][0] and not kept[90][1]


def test_odd_rows(docs):
    df = docs(ODD).withColumn("n_words", F.lit("mine")).withColumn("m", F.lit(1)).withColumn("common", F.lit(1))
    out = quality.judge(df)
    assert "_n_words" in out.columns and out.count() == len(ODD)
    assert quality.judge(docs([])).count() == 0


def test_any_number_of_languages(docs, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_LANGUAGES", 20)
    rows = [(i, "a b " * 30 + f"c{i}", f"l{i}") for i in range(150)]
    got = quality.judge(docs(rows)).collect()
    assert len(got) == 150 and all(r["char_distance"] == pytest.approx(0, abs=1e-6) for r in got)


def brute_judge(rows):
    """{id: kept, character distance, word distance} by the rules of the module."""

    def chars(text):
        kinds = [sum(unicodedata.category(c) == "Lu" for c in text), sum(unicodedata.category(c)[0] == "N" for c in text), *(len(re.findall(quality.CLASSES[k], text)) for k in ("stop", "symbol"))]
        letters = sum(map(len, brute.words(text)))
        return [*kinds, len(text) - letters, letters - sum(kinds)]

    def distance(a, b):
        if not sum(a) or not sum(b):
            return None
        p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
        part = lambda u, v: sum(x * math.log2(x / ((x + y) / 2)) / 2 for x, y in zip(u, v, strict=True) if x)
        return math.sqrt(max(0.0, part(p, q) + part(q, p)))

    common, out = {}, {}
    for lang in {r[2] for r in rows}:
        seen = Counter(w for _, t, x in rows if x == lang for w in brute.words((t or "").lower()))
        common[lang] = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON_WORDS]]

    def commons(text, lang):
        seen = Counter(w.lower() for w in brute.words(text))
        own = [seen[w] for w in common[lang]]
        return [*own, len(brute.words(text)) - sum(own)]

    refs = {lang: ([sum(x) for x in zip(*(chars(t or "") for _, t, y in rows if y == lang), strict=True)], [sum(x) for x in zip(*(commons(t or "", lang) for _, t, y in rows if y == lang), strict=True)]) for lang in common}
    for i, t, lang in rows:
        t = t or ""
        n, _, _, _, repeats = brute.quality(t)
        cd, wd = distance(chars(t), refs[lang][0]), distance(commons(t, lang), refs[lang][1])
        failed = n < 50 or 100 * repeats > 50 * n
        ok = (len(t) < quality.MIN_CHARS or (cd or 0) <= quality.MAX_CHAR_DISTANCE) and (n < quality.MIN_WORDS or (wd or 0) <= quality.MAX_WORD_DISTANCE)
        out[i] = not failed and ok, cd, wd
    return out


def test_kept_and_distances_against_brute_force(docs):
    rnd = random.Random(7)
    rows = []
    for i in range(90):
        lang = rnd.choice(["en", "fr", None])
        words = [rnd.choice(["the", "of", "and", "a"] if rnd.random() < 0.4 else [f"w{rnd.randrange(300)}", "Éclair", "x#y", "z?"]) for _ in range(rnd.choice([10, 80, 200]))]
        if i % 7 == 0:
            words = [rnd.choice("#*$%&") * 4 + str(rnd.randrange(10**6)) for _ in range(120)]
        rows.append((i, " ".join(words), lang))
    want = brute_judge(rows)
    got = {r["doc_id"]: r for r in quality.judge(docs(rows)).collect()}
    for i, (kept, cd, wd) in want.items():
        assert got[i]["kept"] == kept
        assert got[i]["char_distance"] == pytest.approx(cd, abs=1e-6) and got[i]["word_distance"] == pytest.approx(wd, abs=1e-6)
    assert 0 < sum(k for k, _, _ in want.values()) < len(rows)


def test_windows_of_equal_hash_are_told_apart(docs, monkeypatch):
    monkeypatch.setattr(quality.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    rnd = random.Random(3)
    rows = [(1, "a b c d e f g", "en"), *[(10 + i, " ".join(rnd.choice("abcd") for _ in range(40)), "en") for i in range(20)]]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.judge(docs(rows)).collect()}
    assert got[1] == 0 and got == {i: brute.quality(t)[4] for i, t, _ in rows}


def test_query_columns(spark):
    assert quality.op3_quality(spark, SF).columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
