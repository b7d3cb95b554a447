import random

import pytest
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.operators.batch import WriteBatch
from tidemark.plans import files
from tidemark.plans.compaction import merge_ranges
from tidemark.sources import wal
from tidemark.sources.dump import dump
from tidemark.sources.manifest import DataFile, Edit, fold
from tidemark.sources.storage import parse_file_name


def good(raw):
    return [r for r, e in wal.read_records(raw) if r is not None]


@pytest.mark.parametrize("sizes", [[], [0], [1, 0, 5], [wal.BLOCK - 7], [wal.BLOCK - 8, 3], [wal.BLOCK - 14, 100], [100_000, 10, 200_000]])
def test_log_round_trip(sizes):
    rnd = random.Random(1)
    records = [rnd.randbytes(n) for n in sizes]
    assert good(wal.write_records(records)) == records


def test_log_damage():
    records = [b"a" * 100, b"b" * 50_000, b"c" * 10]
    raw = bytearray(wal.write_records(records))
    raw[20] ^= 0x80
    assert good(bytes(raw)) == records[2:]  # the rest of the damaged block is left, and with it the start of the second record
    with pytest.raises(errors.CorruptionError):
        list(wal.read_records(bytes(raw), strict=True))
    assert [e for _, e in wal.read_records(bytes(raw)) if e][0] == "checksum mismatch"
    whole = wal.write_records(records)
    assert good(whole[:-4]) == records[:2]
    assert good(whole[: wal.BLOCK + 5]) == records[:1]


def test_read_logs(spark, tmp_path):
    b = WriteBatch().put(b"k", b"v").delete(b"x")
    (tmp_path / "000005.log").write_bytes(wal.write_records([b.encode(7), b"bad"]))
    rows = wal.read_logs(spark, str(tmp_path)).collect()
    assert [(r["seq"], r["op"], bytes(r["key"])) for r in rows if r["error"] is None] == [(7, 1, b"k"), (8, 0, b"x")]
    assert any("too small" in r["error"] for r in rows if r["error"])
    lines = [r["line"] for r in dump(spark, str(tmp_path / "000005.log")).collect()]
    assert lines[:2] == ["7: put 'k' 'v'", "8: del 'x'"] and lines[2].startswith("damaged")


@pytest.mark.parametrize(
    ("name", "want"),
    [("100.log", ("log", 100)), ("0.ldb", ("table", 0)), ("7.sst", ("table", 7)), ("CURRENT", ("current", 0)), ("LOCK", ("lock", 0)), ("MANIFEST-2", ("manifest", 2)), ("LOG.old", ("info-log", 0)), ("18446744073709551615.log", ("log", 2**64 - 1)), ("18446744073709551616.log", None), ("MANIFEST-3x", None), ("CURRENTX", None), ("foo", None), (".log", None), ("100.lop", None)],
)
def test_file_names(name, want):
    assert parse_file_name(name) == want


def test_manifest_fold():
    f = DataFile("a", 0, b"k", b"z", 1, 1, 1, 1)
    e = Edit(added=[f], last_seq=3, take={"s": 2})
    assert Edit.from_json(e.to_json()).to_json() == e.to_json()
    s = fold([e, Edit(removed=["a"], added=[DataFile("b", 1, 5, 9, 1, 1, 1, 1)], release=["s"]), Edit(moved={"b": 2})])
    assert list(s.files) == ["b"] and s.files["b"].level == 2 and s.last_seq == 3 and not s.snapshots and s.version == 3
    with pytest.raises(errors.CorruptionError):
        fold([Edit(removed=["none"])])


def test_file_ranges(spark):
    disjoint = [("150", "200"), ("200", "250"), ("300", "350"), ("400", "450")]
    df = spark.createDataFrame([(i, 1, a, b, 10) for i, (a, b) in enumerate(disjoint)], "number long, level int, smallest string, largest string, bytes long")
    for key, want in (("100", 0), ("150", 0), ("201", 1), ("251", 2), ("350", 2), ("451", 4)):
        assert files.find_file(df, key).first()[0] == want
    assert files.overlapping(df, "251", "299").count() == 0
    assert files.overlapping(df, "375", "400").count() == 1
    assert files.overlapping(df, None, "100").count() == 0 and files.overlapping(df, None, None).count() == 4
    got = {r["key"]: r["number"] for r in files.find_files(df, spark.createDataFrame([("150",), ("260",), ("450",), ("999",)], "key string")).collect()}
    assert got == {"150": 0, "260": None, "450": 3, "999": None}
    over = spark.createDataFrame([("150", "600"), ("400", "500"), ("700", "800")], "smallest string, largest string")
    assert sorted(map(tuple, merge_ranges(over).collect())) == [("150", "600"), ("700", "800")]


def test_more_ranges_than_literals(spark, monkeypatch):
    monkeypatch.setattr(files, "LITERALS", 4)
    ranges = [(f"{i:04d}".encode(), f"{i + 5:04d}".encode(), i) for i in range(0, 300, 10)]
    keys = spark.range(310).select(F.format_string("%04d", "id").cast("binary").alias("key"), "id")
    got = {r["id"]: r["n"] for r in files.locate(keys, F.col("key"), ranges, "n", "int").collect()}
    assert got == {i: i // 10 * 10 if i < 300 and i % 10 <= 5 else None for i in range(310)}
    few = files.locate(keys, F.col("key"), ranges[:3], "n", "int")
    assert {r["id"]: r["n"] for r in few.collect()} == {i: i // 10 * 10 if i < 30 and i % 10 <= 5 else None for i in range(310)}
    assert "Python" not in few._jdf.queryExecution().executedPlan().toString()


def test_files_apart():
    fs = [DataFile(n, 0, a, b, 1, 1, 1, 1) for n, a, b in (("a", 1, 5), ("b", 4, 9), ("c", 11, 12), ("d", 20, 30), ("e", 30, 31))]
    alone, others = files.apart(fs)
    assert [f.path for f in alone] == ["c"] and [f.path for f in others] == ["a", "b", "d", "e"]
    assert files.apart(fs, (12, 12))[0] == [] and files.apart([]) == ([], [])
    wide = [DataFile(n, 0, a, b, 1, 1, 1, 1) for n, a, b in (("a", 1, 50), ("b", 2, 3), ("c", 10, 12))]
    assert files.apart(wide)[0] == []


def test_log_grows_in_place():
    rnd = random.Random(3)
    raw, records = b"", [rnd.randbytes(n) for n in (10, 32_700, 40, 70_000, 0, 5)]
    for r in records:
        raw += wal.write_records([r], len(raw))
    assert good(raw) == records


def test_closure_and_cuts():
    fs = [{"smallest": 1, "largest": 5}, {"smallest": 4, "largest": 9}, {"smallest": 8, "largest": 12}, {"smallest": 20, "largest": 30}]
    assert len(files.closure(fs, 1, 2, grow=True)) == 3
    assert len(files.closure(fs, 1, 2, grow=False)) == 1
    assert len(files.closure(fs, None, None, grow=True)) == 4
    assert files.cut_points([5, 5, 5, 5], [0, 0, 0, 0], 10, 100) == [2, 4]
    assert files.cut_points([1, 1, 1], [60, 60, 60], 100, 100) == [1, 2, 3]
    assert files.cut_points([], [], 1, 1) == []


def test_stream_into_table(spark, tmp_path):
    from tidemark.operators.table import VersionedTable
    from tidemark.schema import Options
    from tidemark.streaming.ingest import ingest, running_state

    rows = spark.createDataFrame([(i, f"k{i % 3}".encode(), 0 if i == 7 else 1, str(i).encode()) for i in range(9)], "idx long, key binary, op tinyint, value binary")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    t = VersionedTable.open(spark, str(tmp_path / "t"), Options(create_if_missing=True))
    ingest(stream, t, str(tmp_path / "ckpt")).awaitTermination()
    assert sorted(bytes(r["value"]) for r in t.scan().collect()) == [b"6", b"8"]
    q = running_state(stream.withColumnRenamed("idx", "seq")).writeStream.outputMode("update").format("memory").queryName("newest").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {bytes(r["key"]): r["live"] for r in spark.table("newest").collect()} == {b"k0": True, b"k1": False, b"k2": True}
    t.close()
