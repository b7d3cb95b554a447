import random

import brute
from tidemark.llm import bits, substring
from tidemark.llm.common import ensure_checkpoint_dir


def corpus(seed, n=40):
    rnd = random.Random(seed)
    passages = [[f"p{j}x{i}" for i in range(rnd.choice([10, 12, 30]))] for j in range(4)]
    out, first = [], [f"f{i}" for i in range(40)]
    for i in range(n):
        w = []
        for _ in range(rnd.randrange(4)):
            w += [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(12))] + rnd.choice(passages)
        out.append((i * 2, " ".join(first if i % 13 == 0 else w)))
    return out


def collect(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_against_brute_force(docs):
    for seed, window, gram, batches in ((1, 10, 3, 1), (2, 10, 4, 3), (3, 5, 5, 2), (4, 12, 1, 2)):
        rows = corpus(seed)
        assert collect(substring.dedup_substrings(docs(rows), batches=batches, window=window, gram=gram)) == brute.substrings(rows, window)


def test_index_grows_and_compacts(spark, docs):
    rows = corpus(7, 60)
    index = substring.FingerprintIndex(spark, f"{ensure_checkpoint_dir(spark)}/idx", 10, 3, fanout=3)
    got = {}
    for i in range(5):
        part = rows[i * 12 : i * 12 + 12]
        got |= collect(index.add(docs(part), docs(rows[: i * 12]) if i else None))
        assert all(len(index.run_paths(k)) < 3 for k in index.KINDS)
    assert got == brute.substrings(rows, 10)
    index.drop()
    assert index.runs("spans") is None


def test_copies_need_no_history(spark, docs):
    """Copies of indexed texts are told by the runs alone: the history given here has lost its texts."""
    rows = [(i, " ".join(f"u{i}x{j}" for j in range(40))) for i in range(8)]
    index = substring.FingerprintIndex(spark, f"{ensure_checkpoint_dir(spark)}/idx2", 10, 3)
    index.add(docs(rows))
    lost = docs([(i, None) for i, _ in rows])
    again = [(20, rows[3][1]), (21, " ".join(f"v{j}" for j in range(40)))]
    assert {k: v[1] for k, v in collect(index.add(docs(again), lost)).items()} == {20: 40, 21: 0}
    index.drop()


def test_query_compacts(spark, docs, monkeypatch):
    seen = []
    plain = substring.FingerprintIndex.compact
    monkeypatch.setattr(substring.FingerprintIndex, "compact", lambda self, kind: (seen.append((kind, len(self.run_paths(kind)))), plain(self, kind)))
    rows = corpus(9, 50)
    assert collect(substring.dedup_substrings(docs(rows), window=10, gram=3)) == brute.substrings(rows, 10)
    assert seen == [(k, substring.FANOUT) for k in substring.FingerprintIndex.KINDS]


def test_kept_text(docs):
    a = " ".join(f"a{i}" for i in range(60))
    rows = {r["doc_id"]: r for r in substring.dedup_substrings(docs([(1, a), (2, f"x\n{a}  y"), (3, a), (4, "short")]), window=50).collect()}
    assert rows[1]["kept"] is None and rows[2]["kept"] == "x y" and rows[3]["kept"] == "" and rows[4]["n_removed"] == 0


def test_odd_rows(docs):
    a, same = " ".join(f"a{i}" for i in range(60)), "z " * 3000
    rows = [(None, a), (1, None), (2, ""), (5, a), (5, a), (6, same), (7, same + "q"), (8, "é中 " * 70), (9, "é中 " * 60)]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring.dedup_substrings(docs(rows)).collect())
    assert got == [(0, 60, 0), (1, 0, 0), (2, 0, 0), (5, 60, 0), (5, 60, 0), (6, 3000, 0), (7, 3001, 3000), (8, 70, 0), (9, 60, 60)]
    assert substring.dedup_substrings(docs([])).count() == 0


def test_query(spark, table, docs):
    rows = corpus(11, 20) + [(100 + i, " ".join(f"k{j}" for j in range(i % 2, 70))) for i in range(6)]
    assert collect(substring.op7_substring(spark, table(docs(rows)))) == brute.substrings(rows)


def test_jobs_stay_few(spark, docs):
    """Each job of a batch costs as many tasks as there are partitions: 348 jobs before, 148 now."""
    rows = corpus(5, 40)
    sc = spark.sparkContext
    sc.setJobGroup("op7-jobs", "")
    try:
        assert collect(substring.dedup_substrings(docs(rows), window=10, gram=3)) == brute.substrings(rows, 10)
        assert len(sc.statusTracker().getJobIdsForGroup("op7-jobs")) < 200
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_texts_of_one_id_are_told_apart(docs):
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(1, a), (5, a), (5, f"x {a} y z"), (5, "short"), (7, f"q {a}"), (7, None)]
    for batches in (1, 3):
        got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"] or "") for r in substring.dedup_substrings(docs(rows), batches=batches).collect())
        assert got == [(1, 60, 0, ""), (5, 1, 0, ""), (5, 60, 60, ""), (5, 63, 60, "x y z"), (7, 0, 0, ""), (7, 61, 60, "q")]


def test_bit_sets_lose_no_key(spark):
    rows = spark.range(3000).selectExpr("id * 7919 - 10000 as a", "id % 5 as b", "xxhash64(id * 7919 - 10000) as h")
    keys = rows.toPandas()
    assert (bits.xxhash64(keys["a"].to_numpy()).view("int64") == keys["h"].to_numpy()).all()
    a, b = (bits.bit_table(x) for x in bits.bit_sets(rows.select("a", "b")))
    assert bits.among(*a, keys["a"].to_numpy()).all() and bits.among(*b, keys["b"].to_numpy()).all()
    assert bits.among(*a, keys["a"].to_numpy() + 1).sum() < 60 and bits.among(*b, keys["b"].to_numpy() + 5).sum() == 0
    (none,) = bits.bit_sets(rows.where("a is null").select("a"))
    assert not bits.among(*bits.bit_table(none), keys["a"].to_numpy()).any()
