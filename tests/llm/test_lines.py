import random
import zlib

import pytest

from pyspark.sql import functions as F

import brute
from tidemark.llm import lines


def corpus(seed, n=30):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(rnd.choice([8, 60]))]
    base = [[rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 6, 12, 120, 260]))] for _ in range(12)]
    out = []
    for i in range(n):
        own = []
        for _ in range(rnd.randrange(6)):
            w = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 2])):
                w[rnd.randrange(len(w))] = rnd.choice([*vocab, f"n{rnd.randrange(10**6)}"])
            own.append(rnd.choice([" ", "  "]).join(w).title() if rnd.random() < 0.3 else " ".join(w))
        out.append((i, "\n".join(own + [""] * rnd.randrange(2))))
    return out


def collect(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_against_brute_force(docs):
    for seed in range(4):
        rows = corpus(seed)
        assert collect(lines.drop_repeated_lines(docs(rows))) == brute.lines(rows)


def test_first_candidates_may_all_fail(docs, monkeypatch):
    """Pairs beyond the first round, long runs in squares, and several flushes of a task."""
    monkeypatch.setattr(lines, "STEPS", 1)
    monkeypatch.setattr(lines, "SQUARE", 3)
    for seed in (11, 12):
        rows = corpus(seed, 40)
        assert collect(lines.drop_repeated_lines(docs(rows), first=1)) == brute.lines(rows)


def test_other_threshold(docs):
    rows = corpus(21)
    assert collect(lines.drop_repeated_lines(docs(rows), percent=60)) == brute.lines(rows, 60)


@pytest.mark.parametrize("n", [300, 1200])
def test_many_variants_make_one_pair_a_line(docs, monkeypatch, n):
    """However large the group of near copies, each line is verified against one other."""
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(n)]
    sent = []
    verified = lines._verified
    monkeypatch.setattr(lines, "_verified", lambda rows, pairs, percent: sent.append(pairs.count()) or verified(rows, pairs, percent))
    got = collect(lines.drop_repeated_lines(docs(rows)))
    assert [i for i, t in got.items() if t] == [0]
    assert sent == [n - 1]


def test_template_lines_leave_no_pairs(docs, monkeypatch):
    """Lines that look alike and aren't: all candidates of the second round are verified within their tasks."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(9)]
    rows = [(i, " ".join([*base, f"x{rnd.randrange(90)}", f"y{rnd.randrange(90)}"])) for i in range(400)]
    sent = []
    verified = lines._verified
    monkeypatch.setattr(lines, "_verified", lambda rows, pairs, percent: sent.append(pairs.count()) or verified(rows, pairs, percent))
    assert collect(lines.drop_repeated_lines(docs(rows), percent=85)) == brute.lines(rows, 85)
    assert len(sent) == 1 and sent[0] < len(rows)


def test_rows_of_one_id_are_told_apart(docs):
    """Texts whose checksums agree in their lower 16 bits."""
    texts = {}
    for n in range(100_000):
        a = f"alpha beta gamma delta epsilon number {n}\nend of row {n} here now"
        b = texts.setdefault(zlib.crc32(a.encode()) & 0xFFFF, (n, a))
        if b[0] != n:
            break
    rows = [(0, f"end of row {n} here now"), (1, a), (1, b[1])]
    got = sorted((r["doc_id"], r["text"]) for r in lines.drop_repeated_lines(docs(rows)).collect())
    kept = {t for i, t in got if i == 1}
    assert f"end of row {b[0]} here now" in {x for t in kept for x in t.split("\n")}
    assert f"end of row {n} here now" not in {x for t in kept for x in t.split("\n")}


def test_odd_rows(docs):
    long = "\n".join(f"line {i} of the long text number {i * 7}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, "same line"), (3, "same line"), (4, "SAME line\n\nmy own words"), (None, "same line"), (5, "\n\n"), (6, long)]
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in lines.drop_repeated_lines(docs(rows)).where("doc_id is null or doc_id <> 6").collect() if r["doc_id"] != 1)
    assert got == [(0, "same line"), (2, ""), (3, "same line"), (3, "same line"), (4, "\nmy own words"), (5, "\n\n")]
    clash = docs(rows).withColumn("gone", F.lit(1)).withColumn("n_gone", F.lit(2)).withColumn("loses_lines", F.lit(3))
    out = lines.drop_repeated_lines(clash, drop_emptied=True)
    assert out.columns == clash.columns and out.count() == len(rows)
    assert lines.drop_repeated_lines(docs([(1, "a b"), (2, "a b")]), drop_emptied=True).count() == 1
    assert lines.drop_repeated_lines(docs([])).count() == 0


def test_query(spark, table, docs):
    import hashlib

    rows = corpus(31)
    want = {i: (len(t.split("\n")), hashlib.sha256(k.encode()).hexdigest()) for (i, t), k in zip(rows, brute.lines(rows).values(), strict=True)}
    got = {r["doc_id"]: (r["n_lines"], r["kept_sha256"]) for r in lines.op10_lines(spark, table(docs(rows))).collect()}
    assert got == want


def test_second_round_sends_lines_of_wanted_words_and_sizes():
    """Texts hold one line with the wanted word and a size like the open line's, one of another size, and many without the word."""
    import numpy as np
    import pyarrow as pa

    from tidemark.llm.hashing import Words

    class Sent:
        def __init__(self, value):
            self.value = value

    levels = Sent(np.zeros(lines.COUNTERS, np.uint8))
    key = lines.word_keys(Words([b"wanted"]).hash, levels.value)
    sizes = np.searchsorted(lines.size_edges(80), [10], side="right") if hasattr(lines, "size_edges") else None
    keys = key if sizes is None else np.concatenate([lines.class_keys(key, sizes), key & np.uint64((1 << lines._HASH_BITS) - 1)])
    table = np.zeros(1 << 20, np.uint8)
    table[(lines.mix(keys) & np.uint64((1 << 20) - 1)).astype(np.int64)] = 1
    wanted = Sent(np.packbits(table, bitorder="little").tobytes())
    # All levels are equal, so words stand in order of their hash; fill with words that stand behind.
    later = [f"v{i}" for i in range(2000) if lines.word_keys(Words([f"v{i}".encode()]).hash, levels.value)[0] > key[0]]
    texts = [" ".join(["other", *later[:9]]) + "\n" + " ".join(["Wanted", *later[n : n + 9]]) + "\n\n" + " ".join(["wanted", *later[n : n + 60]]) for n in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(texts), pa.array([0] * 20, pa.int64())], names=["doc_id", "text", "tie"])
    got = [(int(d), int(n), int(s)) for b in lines._prefix_rows(80, levels, 8, wanted)(iter([batch])) for raw in b.column(1) for x in [lines.from_block(raw.as_py())] for d, n, s, w in zip(x["doc"], x["line"], x["size"], x["word"], strict=True) if w == key[0]]
    assert sorted(got) == [(i, 1, 10) for i in range(20)]


def test_texts_of_any_column():
    """Nulls, slices, empty columns and letters beyond ASCII come out as from Python's strings."""
    import pyarrow as pa

    values = ["ÄB c", None, "", "X\nY", "é" * 3, None]
    for kind in (pa.string(), pa.large_string()):
        for a, b in ((0, 6), (1, 4), (2, 2), (5, 6)):
            want = [(v or "").translate(brute.LOWER).encode() for v in values[a:b]]
            assert lines._texts(pa.array(values, kind)[a:b]) == want


def test_second_round_sends_open_lines_and_their_candidates():
    """Lines of one size share a word; one of them is open, and one other has most of its words."""
    import numpy as np
    import pyarrow as pa

    from tidemark.llm.hashing import Words

    class Sent:
        def __init__(self, value):
            self.value = value

    def bits(keys):
        table = np.zeros(1 << 20, np.uint8)
        table[(lines.mix(keys) & np.uint64((1 << 20) - 1)).astype(np.int64)] = 1
        return Sent(np.packbits(table, bitorder="little").tobytes())

    levels = Sent(np.zeros(lines.COUNTERS, np.uint8))
    key = lines.word_keys(Words([b"wanted"]).hash, levels.value)
    later = [f"v{i}" for i in range(2000) if lines.word_keys(Words([f"v{i}".encode()]).hash, levels.value)[0] > key[0]]
    texts = ["other line\n" + " ".join(["wanted", *later[9 * n : 9 * n + 9]]) for n in range(20)]
    texts[19] = "other line\n\n" + " ".join(["wanted", *later[27:35], later[900]])
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(texts), pa.array([0] * 20, pa.int64())], names=["doc_id", "text", "tie"])
    wanted = bits(lines.class_keys(key, np.searchsorted(lines.size_edges(80), [10], side="right")))
    zero = np.zeros(1, np.int64)
    open_lines = bits(lines.place_key(zero + 19, zero + 2, zero))
    blocks = list(lines._prefix_rows(80, levels, 1)(iter([batch])))
    found = [tuple(r[c] for c in lines.PLACE) for b in lines._match_rows(80, 4, open_lines, wanted)(iter(blocks)) for r in b.to_pylist()]
    assert found == [(3, 1, 0)]
    places = bits(np.array([3, 19], np.uint64)), bits(lines.place_key(np.array([3, 19]), np.array([1, 2]), np.zeros(2, np.int64)))
    second = list(lines._prefix_rows(80, levels, 1, wanted, places)(iter([batch])))
    sent = sorted((int(d), int(n)) for b in second for raw in b.column(1) for x in [lines.from_block(raw.as_py())] for d, n in zip(x["doc"], x["line"], strict=True))
    assert sent == [(3, 1), (19, 2)]
    gone = [tuple(r[c] for c in lines.PLACE) for b in lines._match_rows(80, 4, open_lines)(iter(second)) for r in b.to_pylist()]
    assert gone == [(19, 2, 0)]
