import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle


def corpus(n=60):
    rnd = random.Random(2)
    say = lambda: " ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(1, 9))) + rnd.choice([". ", ", ", "! "])
    return [(i * 5 - 40, "\n".join("".join(say() for _ in range(rnd.randrange(5))) for _ in range(rnd.randrange(1, 14)))) for i in range(n)]


def test_query(spark, table, docs, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_BYTES", 1000)  # many ranges
    rows = sorted(corpus())
    got = {r["doc_id"]: r for r in merkle.op8_merkle(spark, table(docs(rows))).collect()}
    assert len(got) == len(rows)
    prints = {i: r["fingerprint"] for i, r in got.items()}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        assert (got[i]["edited_fingerprint"] == prints[i]) == (edited == text)
    assert sum(r["near_edited"] for r in got.values()) > 5 * sum(r["near_next"] for r in got.values())


def test_equal_roots_mean_equal_texts(docs):
    texts = ["a\nb", "a\n\nb", "ab", "a. b", "a.b", "", None, "a\nb", "a, b\nc", "a, b\n c"]
    got = merkle.fingerprints(docs(list(enumerate(texts)))).collect()
    by_root = {}
    for r in got:
        by_root.setdefault(r["fingerprint"][:64], set()).add(r["text"] or "")
    assert all(len(v) == 1 for v in by_root.values()) and len(by_root) == len({t or "" for t in texts})


def test_branches_locate_edits(spark):
    lines = [f"line {i} has some words, and more." for i in range(30)]
    other = list(lines)
    other[17] = "line 17 is another one."
    other.insert(3, "a new line.")
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    got = df.select(merkle.changed_paragraphs(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("x"), merkle.likeness(merkle.to_string(merkle.tree(F.col("a"))), merkle.to_string(merkle.tree(F.col("b")))).alias("n")).first()
    assert got["x"] == [3, 18] and 0.9 < got["n"] < 1


def brute_tree(text):
    """[(section digest, [(paragraph digest, [leaf])])] and the fingerprint, by the rules of the module."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    sections, own = [], []
    lines = text.split("\n")
    for k, line in enumerate(lines):
        leaves = [md5(c) for c in re.split(r"(?<=[.,;:!?] )", line)]
        own.append((md5("".join(leaves)), [x[:8] for x in leaves] if line else []))
        if own[-1][0][0] < "4" or k == len(lines) - 1:
            sections.append((md5("".join(d for d, _ in own)), own))
            own = []
    root = hashlib.sha256("".join(d for d, _ in sections).encode()).hexdigest()
    return sections, "/".join([root, *(d[:8] + ":" + " ".join(p[:8] + "." + "".join(leaves) for p, leaves in own) for d, own in sections)])


def brute_likeness(a, b):
    (ta, fa), (tb, fb) = brute_tree(a), brute_tree(b)
    if fa[:64] == fb[:64]:
        return 1.0
    as_set = lambda t: {(d[:8], tuple((p[:8], tuple(x)) for p, x in own)) for d, own in t}
    sa, sb = as_set(ta), as_set(tb)
    count = lambda secs: sum(len(x) for _, own in secs for _, x in own)
    pa, pb = ({p for _, own in one - two for p in own} for one, two in ((sa, sb), (sb, sa)))
    la, lb = ({x for _, own in one - two for x in own} for one, two in ((pa, pb), (pb, pa)))
    shared = count(sa & sb) + sum(len(x) for _, x in pa & pb) + len(la & lb)
    return 2 * shared / total if (total := count(sa) + count(sb)) else 0.0


def test_fingerprints_and_likeness_against_brute_force(spark):
    rows = sorted(corpus(40))
    pairs = [(a, b) for (_, a), (_, b) in zip(rows, rows[1:], strict=False)] + [(a, a[: len(a) // 2] + b[:40]) for (_, a), (_, b) in zip(rows, rows[7:], strict=False)] + [("", "x. y"), ("", ""), ("a\na", "a")]
    print_of = lambda c: merkle.to_string(merkle.tree(F.col(c)))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string").select("i", print_of("a").alias("fa"), print_of("b").alias("fb"))
    for r in df.select("i", "fa", "fb", merkle.likeness(F.col("fa"), F.col("fb")).alias("x")).collect():
        a, b = pairs[r["i"]]
        assert (r["fa"], r["fb"]) == (brute_tree(a)[1], brute_tree(b)[1])
        assert r["x"] == pytest.approx(brute_likeness(a, b)) and 0 <= r["x"] <= 1


def test_odd_rows(spark, table, docs):
    long = "word. " * 30_000
    rows = [(None, "null id"), (1, None), (1, "one"), (1, "one"), (9, ""), (7, long)]
    got = merkle.op8_merkle(spark, table(docs(rows))).collect()
    assert len(got) == 6 and max(r["n_chars"] for r in got) == len(long)
    one = merkle.op8_merkle(spark, table(docs([(5, "only one. text here.")]))).first()
    assert one["near_next"] == 1.0
    assert merkle.op8_merkle(spark, table(docs([]))).count() == 0
    clash = docs([(1, "a"), (2, "b")]).withColumn("range_no", F.lit("mine")).withColumn("next_text", F.lit("mine"))
    out = merkle.with_next(clash, "doc_id", "text")
    assert {r["doc_id"]: r["_next_text"] for r in out.collect()} == {1: "b", 2: "a"} and out.where("range_no = 'mine'").count() == 2


@pytest.mark.parametrize("n", [0, 1, 2, 7, 63, 64, 200])
def test_range_search(spark, n):
    bounds = list(range(0, 10 * n, 10))
    keys = [-5, 0, 5, 10, 335, 10 * n, 10**6]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").coalesce(1).select(merkle._range_of(F.col("k"), bounds)).collect()]
    assert got == [sum(b <= k for b in bounds) for k in keys]
