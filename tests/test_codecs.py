from decimal import Decimal

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import bloom, codecs, histogram

ISCSI = bytes.fromhex("01c00000000000000000000000000000140000000000040000000014000000182800000000000000") + bytes.fromhex("0200000000000000")
HASHES = {b"": 0xBC9F1D34, b"\x62": 0xEF1345C4, b"\xc3\x97": 0x5B663814, b"\xe2\x99\xa5": 0x323C078F, b"\xe1\x80\xb9\x32": 0xED21633A}
CRCS = {bytes(32): 0x8A9136AA, b"\xff" * 32: 0x62A8AB43, bytes(range(32)): 0x46DD794E, bytes(range(31, -1, -1)): 0x113FDB5C, ISCSI: 0xD9963A56}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_hash_goldens(spark):
    for raw, want in HASHES.items():
        assert codecs.hash32(raw, 0xBC9F1D34) == want
        assert one(spark, codecs.hash32_column()(F.lit(raw))) == want
    assert codecs.hash32(ISCSI, 0x12345678) == 0xF333DABB


def test_crc_goldens(spark):
    for raw, want in CRCS.items():
        assert codecs.crc32c(raw) == want
        assert one(spark, codecs.crc32c_column(F.lit(raw))) == want
    assert codecs.crc32c(b"world", codecs.crc32c(b"hello ")) == codecs.crc32c(b"hello world")


def test_crc_column_of_mixed_rows(spark):
    rows = [(b"",), (None,), (b"a" * 100,), (b"xyz",)]
    got = [r[0] for r in spark.createDataFrame(rows, "v binary").coalesce(1).select(codecs.crc32c_column("v")).collect()]
    assert got == [codecs.crc32c(b""), None, codecs.crc32c(b"a" * 100), codecs.crc32c(b"xyz")]


@given(st.integers(0, 2**32 - 1))
def test_mask_round_trip(c):
    assert codecs.unmask_crc(codecs.mask_crc(c)) == c != codecs.mask_crc(c)


@given(st.integers(0, 2**64 - 1))
def test_varint_round_trip(n):
    raw = codecs.varint(n)
    assert codecs.read_varint(raw + b"x") == (n, len(raw))
    assert codecs.read_varint(raw[:-1]) is None
    assert codecs.read_fixed(codecs.fixed64(n)) == n


def test_varint_limits(spark):
    assert codecs.read_varint(b"\xff" * 5 + b"\x01", 32) is None
    assert codecs.read_varint(codecs.varint(2**32), 32) is None
    assert codecs.read_varint(b"") is None
    got = [r[0] for r in spark.createDataFrame([(codecs.varint(2**64 - 1),), (b"\x80",), (None,)], "v binary").select(codecs.read_varint_column()("v")).collect()]
    assert got == [Decimal(2**64 - 1), None, None]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 16383, 16384, 2**31, 2**56, 2**62])
def test_varint_columns(spark, n):
    assert bytes(one(spark, codecs.varint_column(F.lit(n)))) == codecs.varint(n)
    assert one(spark, codecs.varint_length(F.lit(n))) == len(codecs.varint(n))
    assert bytes(one(spark, codecs.fixed64_column(F.lit(n)))) == codecs.fixed64(n)


def test_length_prefixed(spark):
    assert codecs.read_length_prefixed(codecs.length_prefixed(b"ab") + b"rest") == (b"ab", b"rest")
    assert codecs.read_length_prefixed(b"\x05ab") is None
    assert bytes(one(spark, codecs.length_prefixed_column(F.lit(b"abc")))) == b"\x03abc"


def test_escape(spark):
    raw = b"a\\b\x00\x7f\xff~ "
    assert codecs.escape(raw) == "a\\b\\x00\\x7f\\xff~ "
    assert one(spark, codecs.escape_column(F.lit(raw))) == codecs.escape(raw)


@pytest.mark.parametrize("text", ["", "x", "0", "00012a", "18446744073709551615", "18446744073709551616", "99999999999999999999999", "7 8"])
def test_consume_decimal(spark, text):
    want = codecs.consume_decimal(text)
    got = one(spark, codecs.consume_decimal_column(F.lit(text)))
    assert (got is None) if want is None else int(got) == want[0]


def test_separators():
    ik = lambda k: codecs.internal_key(k, 100, 1)
    top = lambda k: codecs.internal_key(k, (1 << 56) - 1, 1)
    assert codecs.internal_separator(ik(b"foo"), ik(b"hello")) == top(b"g")
    assert codecs.internal_separator(ik(b"foo"), ik(b"foobar")) == ik(b"foo")
    assert codecs.internal_separator(ik(b"foobar"), ik(b"foo")) == ik(b"foobar")
    assert codecs.internal_separator(ik(b"foo"), ik(b"bar")) == ik(b"foo")
    assert codecs.internal_successor(ik(b"foo")) == top(b"g")
    assert codecs.internal_successor(ik(b"\xff\xff")) == ik(b"\xff\xff")


@given(st.binary(max_size=6), st.binary(max_size=6))
def test_separator_lies_between(a, b):
    k = codecs.short_separator(a, b)
    assert a <= k and (k < b or k == a)
    assert codecs.short_successor(a) >= a


def test_internal_keys(spark):
    raw = codecs.internal_key(b"k\x00", 2**55, 1)
    assert codecs.parse_internal_key(raw) == (b"k\x00", 2**55, 1)
    assert codecs.parse_internal_key(raw[:7]) is None and codecs.parse_internal_key(b"\x02" + bytes(7)) is None
    got = one(spark, codecs.split_internal_key_column(F.lit(raw)))
    assert (bytes(got["key"]), got["seq"], got["op"]) == (b"k\x00", 2**55, 1)
    assert one(spark, codecs.split_internal_key_column(F.lit(b"short"))) is None
    assert bytes(one(spark, codecs.internal_key_column(F.lit(b"k"), F.lit(7), F.lit(1)))) == codecs.internal_key(b"k", 7, 1)


@pytest.mark.parametrize("n", [0, 1, 10, 100, 1000, 10000])
def test_bloom(n):
    keys = [codecs.fixed32(i) for i in range(n)]
    made = bloom.build(keys)
    assert len(made) <= n * 10 // 8 + 40
    assert all(bloom.may_contain(made, k) for k in keys)
    wrong = sum(bloom.may_contain(made, codecs.fixed32(i + 10**9)) for i in range(2000))
    assert wrong <= 40
    assert not bloom.may_contain(b"", b"x") and bloom.may_contain(b"\x00\x00\x1f", b"x")


@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=200), st.lists(st.floats(0, 1e6), max_size=50))
def test_histogram(xs, ys):
    a, b, both = histogram.Histogram(), histogram.Histogram(), histogram.Histogram()
    for x in xs:
        a.add(x)
        both.add(x)
    for y in ys:
        b.add(y)
        both.add(y)
    a.merge(b)
    assert a.counts == both.counts and a.n == len(xs) + len(ys)
    assert min(xs + ys) <= a.percentile(50) <= max(xs + ys)
    assert str(a).startswith(f"Count: {a.n}")


def test_histogram_column(spark):
    xs = [0.0, 0.5, 1.0, 9.99, 10.0, 11.9, 12.0, 1e11, 250.0]
    got = {r["bucket"]: r["n"] for r in histogram.histogram(spark.createDataFrame([(x,) for x in xs], "v double"), "v").collect()}
    h = histogram.Histogram()
    for x in xs:
        h.add(x)
    assert got == {i: n for i, n in enumerate(h.counts) if n}
    row = histogram.summary(spark.createDataFrame([(x,) for x in xs], "v double"), "v").first()
    assert row["n"] == len(xs) and abs(row["p50"] - h.percentile(50)) < 1e-9


def test_hash_of_arrow_slices():
    keys = [None, b"", b"a", b"abcd", b"\xff" * 5, None, b"0000000042", b"x" * 33]
    want = [None if k is None else codecs.hash32(k) for k in keys]
    for kind in (pa.binary(), pa.large_binary()):
        assert codecs.hash32_arrow(pa.array(keys, kind)).to_pylist() == want
        assert codecs.hash32_arrow(pa.array(keys, kind).slice(2, 5)).to_pylist() == want[2:7]
        assert codecs.hash32_arrow(pa.array([], kind)).to_pylist() == []


def test_large_groups_have_bounded_filters(spark):
    """A group of any size is split: no filter, and so no task's Python, takes all its keys; repeats count once."""
    large, small = 5 * bloom.GROUP_KEYS + 1, 10
    key = F.lpad(F.col("id").cast("string"), 10, "0").alias("key")
    rows = spark.range(large).select(F.lit(1).alias("file"), key).unionByName(spark.range(small).select(F.lit(2).alias("file"), key))
    rows = rows.unionByName(spark.range(3 * bloom.GROUP_KEYS).select(F.lit(3).alias("file"), F.lit("hot").alias("key")))
    odd = spark.createDataFrame([(None, "0000000001"), (1, None), (9, "0000000001")], "file int, key string")
    built = bloom.filters(rows.unionByName(odd.where("file is null or file = 1")), "file")
    table = {(r["file"], r["part"]): r for r in built.table.collect()}
    assert sorted({f for f, _ in table}) == [1, 2, 3] and len([f for f, _ in table if f == 1]) == 6
    assert max(r["keys"] for r in table.values()) < 1.2 * bloom.GROUP_KEYS
    assert abs(sum(r["keys"] for (f, _), r in table.items() if f == 1) - large) <= 2  # keys whose hashes are equal
    assert bytes(table[2, 0]["filter"]) == bloom.build([b"%010d" % i for i in range(small)])
    assert [(r["keys"], bytes(r["filter"])) for (f, _), r in table.items() if f == 3] == [(1, bloom.build([b"hot"]))]

    assert bloom.probe(rows, built).where("not hit").count() == 0
    assert [r["hit"] for r in bloom.probe(odd, built).collect()] == [False] * 3
    misses = rows.where("file < 3").withColumn("key", F.concat("key", F.lit("x")))
    got = bloom.probe(misses, built)
    assert got.columns == ["file", "key", "hit"] and got.count() == large + small
    assert got.where("hit").count() <= 0.02 * (large + small)
    plain = [k.encode() for (k,) in misses.where("file = 2").select("key").collect()]
    want = dict(zip(plain, bloom.may_contain_many(bytes(table[2, 0]["filter"]), plain).tolist(), strict=True))
    assert {r["key"].encode(): r["hit"] for r in got.where("file = 2").collect()} == want


@pytest.mark.parametrize("bits_per_key", [1, 4, 10, 50])
def test_probe_reads_bits_as_may_contain(spark, bits_per_key):
    rows = spark.range(500).select(F.lit("f").alias("file"), F.col("id").cast("string").cast("binary").alias("key"))
    built = bloom.filters(rows, "file", bits_per_key=bits_per_key)
    made = bytes(built.table.first()["filter"])
    asked = [str(i).encode() for i in range(2000)]
    got = {bytes(r["key"]): r["hit"] for r in bloom.probe(spark.range(2000).select(F.lit("f").alias("file"), F.col("id").cast("string").cast("binary").alias("key")), built).collect()}
    assert [got[k] for k in asked] == bloom.may_contain_many(made, asked).tolist()
