import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from tidemark.llm import neardup
from tidemark.llm.components import connected_components

VOCAB = [f"w{i}" for i in range(400)]


def corpus(seed, n=60):
    rnd = random.Random(seed)
    base = [[rnd.choice(VOCAB) for _ in range(rnd.choice([2, 8, 40, 120]))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            w[rnd.randrange(len(w))] = rnd.choice(VOCAB)
        out.append((i * 3, " ".join(w).title() if i % 2 else "\n".join(w)))
    return out


@pytest.mark.parametrize(("seed", "k"), [(1, 2), (2, 5), (3, 1)])
def test_against_brute_force(docs, seed, k):
    rows = corpus(seed) + [(1, None), (4, ""), (5, " \n\t"), (7, "one"), (8, "ONE"), (10, "two words")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_components(docs(rows), shingle=k, percent=80).collect()}
    assert got == brute.components(sorted(rows), k, 80)


def test_small_limits_lose_nothing(docs):
    """Hot nodes and large groups are dealt out."""
    rows = corpus(5, 80)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_components(docs(rows), shingle=2, percent=80, group_shingles=300).collect()}
    assert got == {i: c for i, (_, c) in brute.components(rows, 2, 80).items()}
    rnd = random.Random(9)
    base = [rnd.choice(VOCAB) for _ in range(200)]
    hot = [(i, " ".join([*base, *(f"x{i}",) * (i % 3)])) for i in range(40)]
    got = neardup.near_components(docs(hot), shingle=2, percent=80, node_rows=8).select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0]


def test_hot_template_loses_no_pair(docs, monkeypatch):
    """Pairs near 0.8 among documents that share boilerplate, too little to be linked by any third one."""
    monkeypatch.setattr(neardup, "trees", lambda *_: 2)
    base = [f"b{i}" for i in range(57)]
    rows = []
    for i in range(100):
        own = [f"o{i}x{j}" for j in range(43)]
        rows += [(2 * i, " ".join(base + own)), (2 * i + 1, " ".join(base + own[:32] + [f"p{i}x{j}" for j in range(11)]))]
    whole, dealt = ({r["doc_id"]: r["component_id"] for r in neardup.near_components(docs(rows), shingle=1, percent=80, node_rows=n).collect()} for n in (4096, 8))
    assert dealt == whole
    assert sum(whole[i] != i for i in whole) > 50


def test_members_of_a_hot_node_meet(spark):
    """Each pair of a dealt node shares a key, or both are linked to the first member."""
    rnd = random.Random(4)
    rows = [(5, i, bytearray(64) if i % 3 == 0 else bytearray(rnd.randbytes(64))) for i in range(40)] + [(6, 1, bytearray(64)), (6, 2, bytearray(64))]
    nodes, edges = neardup._deal_hot(spark.createDataFrame(rows, "node long, member long, tokens binary"), 8)
    together = {}
    for r in nodes.collect():
        together.setdefault(r["node"], set()).add(r["member"])
    assert together[6] == {1, 2}
    linked = {0} | {r["b"] for r in edges.collect()}
    assert linked == set(range(0, 40, 3))
    for i in range(40):
        for j in range(i):
            assert {i, j} <= linked or any({i, j} <= m for m in together.values())


def test_odd_rows(docs):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, long), (8, long + " end"), (2, "A B C D E F")]
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in neardup.near_components(docs(rows), shingle=2).collect())
    assert got == [(-1, None), (2, 2), (3, 2), (3, 2), (8, 8), (9, 8)]
    kept = neardup.drop_near_duplicates(docs(rows).withColumn("node", F.lit(1)).withColumn("digest", F.lit("x")), shingle=2).collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, 2, 8] and kept[0]["node"] == 1
    assert neardup.near_components(docs([])).count() == 0
    assert neardup.drop_near_duplicates(docs([])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 90, 90: 90, 95: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(80)] + [(500, i) for i in range(300, 320)]
    forest = neardup.Forest()
    for a, b in edges:
        forest.join(a, b)
    want = {x: forest.root(x) for a, b in edges if a != b for x in (a, b)}
    got = [(r["node"], r["component"]) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_a_task_sends_one_edge_a_member():
    """However many nodes of the trees hold a group, its task spans it once."""
    tokens = bytes(neardup.COORDINATES)
    nodes = [(node, member) for node in range(12) for member in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array([n for n, _ in nodes]), pa.array([m for _, m in nodes]), pa.array([tokens] * len(nodes))], names=["node", "member", "tokens"])
    out = [(a, b) for got in neardup._node_rows(iter([batch])) for a, b in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True) if a != b]
    assert sorted(out) == [(0, i) for i in range(1, 50)]


def test_trees_follow_from_the_target_recall():
    assert neardup.trees(80, 0.99999) == 12 and neardup.trees(80, 0.9) < neardup.trees(50, 0.9) and neardup.trees(100) == 1


def test_recall_against_exact_links(docs):
    """1200 texts that share most of their words: 600 pairs at Jaccard 0.817, all others at 0.43, in nodes that are dealt."""
    shared = [f"s{i}" for i in range(120)]
    rows = []
    for i in range(600):
        own = [f"o{i}x{j}" for j in range(60)]
        rows += [(2 * i, " ".join([*shared, *own, *(f"a{i}x{j}" for j in range(20))])), (2 * i + 1, " ".join([*shared, *own, *(f"b{i}x{j}" for j in range(20))]))]
    for limit in (4096, 16):
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_components(docs(rows), shingle=1, percent=80, node_rows=limit).collect()}
        assert got == {i: i - i % 2 for i, _ in rows}


def test_query(spark, table, docs):
    rows = corpus(8, 40)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.op6_minhash(spark, table(docs(rows))).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute.components(rows, 2, 80).items()}
