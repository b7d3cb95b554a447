"""Tables against golden histories and a random model."""

import gc
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.operators.batch import WriteBatch, group_commit, group_size, sequence
from tidemark.operators.table import VersionedTable, merge_tables, repair
from tidemark.plans.compaction import LevelPolicy
from tidemark.schema import NUMERIC, REVERSED_BYTES, Options
from tidemark.sources.dump import dump
from tidemark.sources.manifest import Manifest


@pytest.fixture
def make(spark, tmp_path):
    opened = []

    def open_(name="t", **options):
        t = VersionedTable.open(spark, str(tmp_path / name), Options(**{"create_if_missing": True} | options))
        opened.append(t)
        return t

    yield open_
    for t in opened:
        t.close()


def content(table, snapshot=None):
    return sorted((bytes(r["key"]), bytes(r["value"])) for r in table.scan(snapshot=snapshot).collect())


def test_empty_keys_and_values(make):
    t = make()
    t.put(b"", b"v1")
    assert t.get(b"") == b"v1"
    t.put(b"", b"v2")
    assert t.get(b"") == b"v2"
    t.put(b"key", b"")
    assert t.get(b"key") == b""
    with pytest.raises(errors.NotFoundError) as e:
        t.get(b"none")
    assert errors.is_not_found(e.value) and str(e.value).startswith("NotFound: ")


def test_overwrite_delete_and_reopen(spark, make):
    t = make()
    t.write(WriteBatch().put(b"foo", b"v1").put(b"bar", b"v2").put(b"foo", b"v3"))
    assert (t.get(b"foo"), t.get(b"bar")) == (b"v3", b"v2")
    t.delete(b"foo")
    t.delete(b"missing")
    t.close()
    t = make(create_if_missing=False)
    with pytest.raises(errors.NotFoundError):
        t.get(b"foo")
    assert content(t) == [(b"bar", b"v2")] and t.last_seq() == 5


def test_snapshots(make):
    t = make()
    s0 = t.snapshot()
    seen = []
    for v in (b"v1", b"v2", b"v3"):
        t.put(b"foo", v)
        seen.append((t.snapshot(), v))
    t.put(b"foo", b"v4")
    assert content(t, s0) == []
    for s, v in seen:
        assert t.get(b"foo", s) == v
    t.release(seen[0][0])
    with pytest.raises(errors.InvalidArgumentError):
        t.get(b"foo", seen[0][0])
    assert t.get(b"foo", seen[1][0]) == b"v2" and t.get(b"foo") == b"v4"


def test_compaction_keeps_what_snapshots_see(make):
    t = make()
    t.put(b"foo", b"big" * 100)
    s = t.snapshot()
    t.put(b"foo", b"tiny")
    t.compact_range()
    assert [v for _, _, v in t.versions(b"foo")] == [b"tiny", b"big" * 100]
    t.release(s)
    t.compact_level(1)
    assert [v for _, _, v in t.versions(b"foo")] == [b"tiny"]
    with pytest.raises(errors.InvalidArgumentError):
        t.scan(snapshot=1)


def test_tombstones_stay_above_deeper_data(make):
    t = make()
    t.put(b"foo", b"v1")
    t.compact_level(0)
    t.compact_level(1)
    t.write(WriteBatch().put(b"a", b"begin").put(b"z", b"end"))
    t.compact_level(0)
    t.delete(b"foo")
    t.compact_level(0)
    assert [op for _, op, _ in t.versions(b"foo")] == [0, 1]
    assert content(t) == [(b"a", b"begin"), (b"z", b"end")]
    t.compact_level(1)
    assert t.versions(b"foo") == []
    assert content(t) == [(b"a", b"begin"), (b"z", b"end")]


def test_cursor_moves(make):
    t = make()
    t.write(WriteBatch().put(b"a", b"va").put(b"b", b"vb").put(b"c", b"vc"))
    for size in (1, 2, 10):
        with t.cursor(page=size) as c:
            for target, want in ((b"", b"a"), (b"a", b"a"), (b"ax", b"b"), (b"b", b"b"), (b"z", None)):
                c.seek(target)
                assert (c.key() if c.valid() else None) == want
            assert c.seek_to_last().prev().prev().next().key() == b"b"
            assert c.seek_to_first().next().next().prev().key() == b"b"
            c.seek_to_first().prev()
            assert not c.valid()
            with pytest.raises(errors.InvalidArgumentError):
                c.next()
            assert [k for k, _ in c] == [b"a", b"b", b"c"]
    c = t.cursor()
    t.write(WriteBatch().put(b"a", b"va2").put(b"a2", b"va3").delete(b"b"))
    t.compact_range()
    assert list(c) == [(b"a", b"va"), (b"b", b"vb"), (b"c", b"vc")]
    c.close()
    d = t.cursor()
    assert d.seek(b"c").key() == b"c" and d.prev().key() == b"a2"


def test_cursor_of_nothing(make):
    c = make().cursor()
    assert not c.seek_to_first().valid() and not c.seek_to_last().valid() and not c.seek(b"foo").valid()


def test_open_errors(spark, make, tmp_path):
    with pytest.raises(errors.InvalidArgumentError, match="does not exist"):
        make("none", create_if_missing=False)
    t = make("x")
    with pytest.raises(errors.StorageError, match="lock"):
        make("x")
    with pytest.raises(errors.StorageError):
        VersionedTable.destroy(spark, t.path)
    t.put(b"k", b"v")
    t.close()
    with pytest.raises(errors.InvalidArgumentError, match="exists"):
        make("x", error_if_exists=True)
    with pytest.raises(errors.InvalidArgumentError, match="does not match"):
        make("x", key_order=NUMERIC)
    assert content(make("x")) == [(b"k", b"v")]


def test_destroy_keeps_foreign_files(spark, make, tmp_path):
    t = make("d")
    t.put(b"k", b"v")
    t.close()
    (tmp_path / "d" / "mine.txt").write_text("x")
    VersionedTable.destroy(spark, t.path)
    assert [p.name for p in (tmp_path / "d").iterdir() if not p.name.endswith(".crc")] == ["mine.txt"]
    VersionedTable.destroy(spark, str(tmp_path / "nothing"))


def test_missing_file_is_corruption(spark, make):
    t = make("m")
    t.put(b"k", b"v")
    t.flush()
    t.storage.delete(next(iter(t.state().files)))
    t.close()
    with pytest.raises(errors.CorruptionError, match="issing"):
        make("m")


def test_numeric_order(make):
    t = make("n", key_order=NUMERIC)
    t.write(WriteBatch().put(b"[10]", b"ten").put(b"[0x14]", b"twenty"))
    for _ in range(2):
        assert t.get(b"[0xa]") == t.get(b"[10]") == b"ten"
        assert t.get(b"[20]") == t.get(b"[0x14]") == b"twenty"
        with pytest.raises(errors.NotFoundError):
            t.get(b"[15]")
        t.compact_range()


def test_reversed_order(make):
    t = make("r", key_order=REVERSED_BYTES)
    t.write(WriteBatch().put(b"ab", b"1").put(b"ba", b"2").put(b"\x00z", b"3"))
    assert [k for k, _ in t.cursor()] == [b"ba", b"ab", b"\x00z"]


def test_properties_and_sizes(make):
    t = make("p")
    t.write(WriteBatch([(1, f"key{i:06d}".encode(), random.Random(i).randbytes(1000)) for i in range(500)]))
    assert int(t.property("approximate-memory-usage")) > 0
    t.flush()
    n = int(t.property("num-files-at-level0"))
    assert n >= 1 and t.property("num-files-at-level9") is None and t.property("foo") is None
    assert "level 0" in t.property("sstables") and "Size(MB)" in t.property("stats")
    half, all_, none = t.approximate_sizes([(b"", b"key000250"), (b"", b"z"), (b"x", b"y")])
    assert 200_000 < half < 300_000 and 480_000 < all_ < 560_000 and none == 0
    assert t.files().count() == n


def test_move_and_automatic_compaction(make):
    t = make("c")
    t.put(b"a", b"1")
    t.flush()
    path = next(iter(t.state().files))
    assert t.move_down(path) and t.state().files[path].level == 1 and t.get(b"a") == b"1"
    for i in range(4):
        t.put(b"k%d" % i, b"x")
        t.flush()
    assert t.maybe_compact(LevelPolicy()) == 0
    assert t.property("num-files-at-level0") == "0" and len(content(t)) == 5
    assert t.maybe_compact(LevelPolicy()) is None


def test_repair(spark, make):
    t = make("f")
    t.write(WriteBatch().put(b"a", b"1").put(b"b", b"2"))
    t.flush()
    t.write(WriteBatch().delete(b"a").put(b"c", b"3"))
    t.close()
    t.storage.write("data/bad/part-x.parquet", b"not parquet")
    t.storage.delete("manifest")
    got = repair(spark, t.path)
    assert got["lost"] == 1 and got["last_seq"] == 4
    t = make("f")
    assert content(t) == [(b"b", b"2"), (b"c", b"3")]
    t.verify()
    assert t.put(b"d", b"4") == 5


def test_frames_merge_and_dump(spark, make):
    t, u = make("a"), make("b")
    rows = spark.range(300).select(F.col("id").alias("idx"), F.lpad(F.col("id").cast("string"), 4, "0").cast("binary").alias("key"), F.lit(1).cast("byte").alias("op"), F.lit(b"v").alias("value"))
    assert t.write_frame(rows) == 300
    u.put(b"0000", b"other")
    assert merge_tables(t, u).count() == 301
    keys = spark.createDataFrame([(b"0005",), (b"none",)], "key binary")
    assert [bytes(r["key"]) for r in t.multi_get(keys).collect()] == [b"0005"]
    assert dump(spark, t.path).count() == t.state().version
    assert "'0000' @ 1 : put => 'v'" in [r["line"] for r in dump(spark, t.storage.url(next(iter(t.state().files)))).collect()]
    t.options = Options(paranoid_checks=True)
    t.verify()


def test_two_writers_one_commit(spark, make):
    t = make("w")
    t.put(b"a", b"1")
    t.flush()
    m = Manifest(t.storage)
    calls = []

    def edit(s):
        from tidemark.sources.manifest import Edit

        calls.append(s.version)
        if len(calls) == 1:
            m.commit(lambda s: Edit(take={"other": 1}))
        return Edit(take={"mine": 1})

    s = m.commit(edit)
    assert len(calls) == 2 and {"other", "mine"} <= set(s.snapshots)


def test_batches():
    b = WriteBatch().put(b"foo", b"bar").delete(b"box").put(b"baz", b"boo")
    raw = b.encode(100)
    seq, back, error = WriteBatch.decode(raw)
    assert (seq, back.ops, error) == (100, b.ops, None) and len(b) == 3
    _, part, error = WriteBatch.decode(raw[:-1], strict=False)
    assert part.ops == b.ops[:2] and "bad put" in error
    with pytest.raises(errors.CorruptionError, match="too small"):
        WriteBatch.decode(b"x")
    with pytest.raises(errors.CorruptionError, match="unknown"):
        WriteBatch.decode(raw + b"\x09")
    with pytest.raises(errors.CorruptionError, match="count"):
        WriteBatch.decode(raw[:8] + b"\x09\x00\x00\x00" + raw[12:])
    c = WriteBatch().put(b"x", b"y")
    c.append(b)
    assert len(c) == 4 and c.approximate_size() > b.approximate_size()
    got = []
    c.iterate(lambda k, v: got.append((k, v)), lambda k: got.append(k))
    assert got[2] == b"box"
    c.clear()
    assert len(c) == 0
    assert group_size([100, 100, 1 << 20], [False] * 3) == 2
    assert group_size([100, 100], [False, True]) == 1
    assert group_size([], []) == 0


def test_random_model(make):
    rnd = random.Random(301)
    t, history = make("model"), []
    alphabet = [b"\x00", b"\x01", b"a", b"b", b"c", b"d", b"e", b"\xfd", b"\xfe", b"\xff"]
    snaps = []

    def state(seq):
        out = {}
        for s, op, k, v in history:
            if s <= seq:
                out.pop(k, None)
                if op:
                    out[k] = v
        return sorted(out.items())

    def key():
        return b"".join(rnd.choice(alphabet) for _ in range(1 if rnd.randrange(3) == 0 else rnd.randrange(9)))

    for step in range(1, 601):
        b = WriteBatch()
        for _ in range(rnd.randrange(8) if rnd.randrange(10) == 0 else 1):
            b.put(key(), rnd.randbytes(rnd.randrange(8))) if rnd.random() < 0.5 else b.delete(key())
        before = t.last_seq()
        t.write(b)
        history += [(before + 1 + i, op, k, v) for i, (op, k, v) in enumerate(b.ops)]
        if step % 150 == 0:
            assert content(t) == state(t.last_seq())
            for s in snaps:
                assert content(t, s) == state(s.seq)
            if step == 300:
                t.compact_range()
            if step == 450:
                t.close()
                t = make("model")
                t.release(snaps.pop(0))
                t.compact_range(b"a", b"c")
            snaps.append(t.snapshot())
    assert [k for k, _ in t.cursor(page=37)] == [k for k, _ in state(t.last_seq())]


def crash(table):
    """Drops a handle without closing it, as a dead process would leave its table."""
    table.storage.write("LOCK", b'{"host": "elsewhere", "pid": 1, "began": "1", "token": "x", "until": 0}')


def test_writes_survive_a_crash(make):
    t = make("crash")
    assert t.put(b"k", b"v") == 1
    t.write(WriteBatch().put(b"l", b"w").delete(b"k"), sync=True)
    crash(t)
    u = make("crash")
    assert u.last_seq() == 3 and content(u) == [(b"l", b"w")]
    assert u.put(b"m", b"x") == 4
    crash(u)
    v = make("crash")
    assert content(v) == [(b"l", b"w"), (b"m", b"x")]
    v.flush()
    assert v.storage.names("log") == [] and v.state().last_seq == 4
    with pytest.raises(errors.StorageError, match="lock"):
        t.put(b"late", b"v")
    t._closed = u._closed = True


def test_a_record_cut_off_by_a_crash_is_no_write(make):
    t = make("torn")
    t.put(b"a", b"1")
    t.put(b"b", b"2" * 100)
    name = t.storage.names("log")[0]
    raw = t.storage.read(f"log/{name}")
    t.storage.write(f"log/{name}", raw[:-10])
    crash(t)
    u = make("torn")
    assert content(u) == [(b"a", b"1")] and u.last_seq() == 1
    t._closed = True


def test_a_lost_handle_frees_its_lock(spark, tmp_path):
    path = str(tmp_path / "lost")
    t = VersionedTable.open(spark, path, Options(create_if_missing=True))
    t.put(b"k", b"v")
    with pytest.raises(errors.StorageError, match="lock"):
        VersionedTable.open(spark, path)
    del t
    gc.collect()
    u = VersionedTable.open(spark, path)
    assert u.get(b"k") == b"v"
    u.close()


def test_pending_writes_are_read_without_a_flush(make):
    t = make("pending")
    t.write(WriteBatch().put(b"a", b"1").put(b"c", b"3"))
    t.compact_range()
    t.put(b"b", b"2")
    t.delete(b"a")
    assert content(t) == [(b"b", b"2"), (b"c", b"3")] and t.get(b"b") == b"2"
    assert [k for k, _ in t.cursor()] == [b"b", b"c"] and len(t.state().files) == 1


def test_repair_keeps_the_floor_and_the_log(spark, make):
    t = make("floor")
    t.put(b"a", b"1")
    t.put(b"a", b"2")
    t.compact_range()
    with pytest.raises(errors.InvalidArgumentError):
        t.get(b"a", 1)
    t.put(b"b", b"3")
    crash(t)
    got = repair(spark, t.path)
    assert got["last_seq"] == 3 and got["lost"] == 0
    u = make("floor")
    with pytest.raises(errors.InvalidArgumentError):
        u.get(b"a", 1)
    assert content(u) == [(b"a", b"2"), (b"b", b"3")]
    u.close()
    u.storage.delete("manifest")
    repair(spark, t.path)
    u = make("floor")
    with pytest.raises(errors.InvalidArgumentError):
        u.get(b"a", 1)
    assert content(u) == [(b"a", b"2"), (b"b", b"3")]
    t._closed = True


@pytest.mark.parametrize("manifest", [True, False])
def test_repair_leaves_runs_that_were_never_committed(spark, make, manifest):
    t = make(f"twice{manifest}")
    t.write(WriteBatch().put(b"a", b"1").put(b"b", b"2"))
    t.flush()
    time.sleep(1.1)
    t._write_run(WriteBatch().put(b"x", b"9").put(b"y", b"9").to_log(spark, 0), 0)
    t.close()
    if not manifest:
        t.storage.delete("manifest")
    assert repair(spark, t.path)["lost"] >= 1
    u = make(f"twice{manifest}")
    assert content(u) == [(b"a", b"1"), (b"b", b"2")] and u.last_seq() == 2


def test_a_compacted_table_is_scanned_without_a_shuffle(spark, make):
    t = make("plain")
    rows = spark.range(2000).select(F.col("id").alias("idx"), (F.col("id") % 700).cast("string").cast("binary").alias("key"), F.when(F.col("id") % 11 == 0, 0).otherwise(1).cast("byte").alias("op"), F.col("id").cast("string").cast("binary").alias("value"))
    t.write_frame(rows)
    before = content(t)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan(t.scan())
    t.compact_range()
    assert content(t) == before and len(before) > 600
    assert "Exchange" not in plan(t.scan()) and "Exchange" not in plan(t.scan(b"1", b"5"))
    keys = spark.createDataFrame([(b"5",), (b"none",)], "key binary")
    assert [bytes(r["key"]) for r in t.multi_get(keys).collect()] == [b"5"]
    s = t.snapshot()
    t.put(b"5", b"new")
    t.flush()
    assert content(t, s) == before and t.get(b"5") == b"new" and len(content(t)) == len(before)


def test_offsets_and_stats(make):
    t = make("o")
    t.write(WriteBatch([(1, f"key{i:06d}".encode(), random.Random(i).randbytes(1000)) for i in range(500)]))
    t.compact_range()
    assert t.approximate_offset(b"a") == 0 and 200_000 < t.approximate_offset(b"key000250") < 300_000
    assert t.approximate_offset(b"z") == sum(f.bytes for f in t.state().files.values())
    line = [x.split() for x in t.property("stats").splitlines() if x.split()[0] == "1"][0]
    assert float(line[3]) > 0 and float(line[4]) > 0.4 and float(line[5]) > 0.4


def test_compaction_after_commits(make):
    t = make("auto", auto_compact=True, level0_trigger=2)
    for i in range(6):
        t.put(b"k%d" % (i % 3), b"%d" % i)
        t.flush()
    assert int(t.property("num-files-at-level0")) < 2 and content(t) == [(b"k0", b"3"), (b"k1", b"4"), (b"k2", b"5")]
    u = make("deep", flush_level=2)
    u.put(b"a", b"1")
    u.flush()
    u.put(b"b", b"1")
    u.flush()
    u.put(b"a", b"2")
    u.flush()
    assert sorted(f.level for f in u.state().files.values()) == [1, 2, 2] and content(u) == [(b"a", b"2"), (b"b", b"1")]


def test_manifest_is_pruned(make):
    t = make("prune")
    for _ in range(60):
        t.release(t.snapshot())
    names = t.storage.names("manifest")
    assert len(names) < 60 and t.state().version == 121 and not t.state().snapshots


def test_numbers_of_a_batch_of_many_ranges(spark):
    rows = spark.range(9000).select((F.col("id") * 7919 % 9000).alias("idx"), F.lit(b"k").alias("key"), F.lit(1).cast("byte").alias("op"), F.col("id").cast("string").cast("binary").alias("value"))
    got = sequence(rows, 10, per_part=2)
    assert got.agg(F.count_distinct("seq"), F.min("seq"), F.max("seq")).first()[:] == (9000, 11, 9010)
    twos = group_commit([rows, rows], 0).agg(F.count_distinct("seq"), F.max("seq")).first()
    assert twos[:] == (18000, 18000)
