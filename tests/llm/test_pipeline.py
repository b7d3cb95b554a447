import hashlib
import random

import brute
import corpus_pipeline
from tidemark.llm import bpe, queries

SOUNDS = {"aa": "ka lo mi ta ro".split(), "bb": "schu wei ung lich zt".split()}


def corpus():
    rnd = random.Random(12)

    def line(lang, n):
        return " ".join("".join(rnd.choice(SOUNDS[lang]) for _ in range(3)) + str(rnd.randrange(10**6)) for _ in range(n))

    rows = []
    for i in range(60):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, "\n".join(line(lang, rnd.randrange(20, 40)) for _ in range(4)), lang, f"s{i % 3}"))
    rows += [(100 + i, *rows[i][1:]) for i in range(5)]  # copies
    rows += [(200 + i, rows[i][1].replace("\n", " ") + " tail", *rows[i][2:]) for i in range(5, 9)]  # near copies on one line
    rows += [(300, "12 34 !!", "aa", "s0"), (301, None, "aa", "s0")]
    rows += [(400 + i, "shared notice of all sites\n" + line("aa", 30), "aa", "s1") for i in range(5)]
    return rows


def test_stages_against_brute_force(spark, table, docs):
    rows = corpus()
    folder = table(docs(rows))
    inputs, frame = [], spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        frame = stage(spark, frame, folder)
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        inputs.append(sorted((r["doc_id"], r["text"], r["source"]) for r in frame.collect()))
    known, lined, near, mixed = inputs
    assert [i for i, *_ in known] == sorted(i for i, *_ in rows if i not in (300, 301))
    want = brute.lines([(i, t) for i, t, _ in known])
    assert {i: t for i, t, _ in lined} == {i: t for i, t in want.items() if t.strip()}
    comps = brute.components([(i, t) for i, t, _ in lined], 5, 80)
    assert [i for i, *_ in near] == sorted(i for i, (_, c) in comps.items() if i == c)
    assert 205 not in {i for i, *_ in near} and 5 in {i for i, *_ in near}
    sizes = {s: sum(len(brute.words(r[1])) for r in own) for s, own in brute.by_source(near, 2).items()}
    target = brute.targets(sizes)
    taken = {s: sum(len(brute.words(r[1])) for r in own) for s, own in brute.by_source(mixed, 2).items()}
    assert all(abs(taken[s] - target[s]) <= max(len(brute.words(t)) for _, t, _ in near) for s in sizes)
    coder = bpe.TreeBPE(bpe.tokenizer_spec(bpe.default_tokenizer_path()))
    want = sorted((i, hashlib.sha256(",".join(map(str, coder.encode_batch([t])[0])).encode()).hexdigest()) for i, t, _ in mixed)
    got = corpus_pipeline.run(spark, folder)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in got.collect()) == want


def test_empty_table(spark, table, docs):
    assert corpus_pipeline.run(spark, table(docs([]))).count() == 0


def test_registry():
    import __spark_entry__

    assert sorted(q.split("_")[0] for q in queries.QUERIES) == sorted(f"op{i}" for i in range(1, 11))
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
