"""Bloom filters over keys."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.codecs import U32, hash32_arrow, hash32_many

#: Least bits of a filter and the range of its number of probes (fixed values).
LEAST_BITS = 64
PROBES = (1, 30)
#: Keys of a group for each of its filters.
GROUP_KEYS = 8192


def probes_for(bits_per_key: int) -> int:
    """About ln 2 x bits per key, rounded down."""
    return min(PROBES[1], max(PROBES[0], int(bits_per_key * 0.69)))


def _positions(hashes: np.ndarray, n_bits: int, probes: int) -> np.ndarray:
    """Keys x probes bit positions: each next probe adds the hash turned by 17 bits (32-bit arithmetic)."""
    h = hashes.astype(np.uint64)[:, None]
    step = (h >> np.uint64(17)) | (h << np.uint64(15) & np.uint64(U32))
    return ((h + step * np.arange(probes, dtype=np.uint64)) & np.uint64(U32)) % np.uint64(n_bits)


def _from_hashes(hashes: np.ndarray, bits_per_key: int) -> bytes:
    probes = probes_for(bits_per_key)
    size = -(-max(LEAST_BITS, len(hashes) * bits_per_key) // 8)
    bits = np.zeros(size * 8, np.uint8)
    if len(hashes):
        bits[_positions(hashes, size * 8, probes).astype(np.int64).ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes() + bytes([probes])


def build(keys: Iterable[bytes], bits_per_key: int = 10) -> bytes:
    """A filter of all keys; its last byte is the number of probes."""
    keys = list(keys)
    return _from_hashes(hash32_many(keys), bits_per_key)


def may_contain_many(filter_: bytes, keys: list[bytes]) -> np.ndarray:
    """For each key: False only if it was not among the filter's keys."""
    if len(filter_) < 2:
        return np.zeros(len(keys), bool)
    n_bits, probes = (len(filter_) - 1) * 8, filter_[-1]
    if probes > PROBES[1]:  # a format of the future: may hold anything
        return np.ones(len(keys), bool)
    at = _positions(hash32_many(keys), n_bits, probes).astype(np.int64)
    raw = np.frombuffer(filter_, np.uint8)
    return (raw[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)


def may_contain(filter_: bytes, key: bytes) -> bool:
    """False only if ``key`` was not among the filter's keys."""
    return bool(may_contain_many(filter_, [key])[0])


@dataclass(frozen=True)
class Filters:
    """Filters of groups, such as files. A group of more than ``GROUP_KEYS`` keys has several parts, each with its own filter.

    ``table`` has (group, part, filter, words, keys): ``words`` are the filter's
    bits again, 64 in each, ``keys`` its distinct hashes. ``parts`` has (group,
    parts) of the groups with more than one.
    """

    table: DataFrame
    parts: DataFrame
    group: str
    bits_per_key: int


def _placed(rows: DataFrame, parts: DataFrame, group: str, key: str) -> DataFrame:
    """``rows`` with __part, of their group's parts. Parts go by another hash, so that a part's keys fill its filter like any keys."""
    found = rows.join(F.broadcast(parts.select(F.col(group).alias("__of"), F.col("parts").alias("__parts"))), F.col(group) == F.col("__of"), "left")
    part = F.pmod(F.xxhash64(F.col(key).cast("binary")), F.coalesce("__parts", F.lit(1).cast("long"))).cast("int")
    return found.withColumn("__part", part).drop("__of", "__parts")


@F.arrow_udf(T.LongType())
def _hash(keys: pa.Array) -> pa.Array:
    return hash32_arrow(keys)


def filters(keys: DataFrame, group: str, key: str = "key", bits_per_key: int = 10) -> Filters:
    """The filters of each group; rows without a group or key are in none.

    No task holds more than a part's distinct keys: a part's share of the
    group's rows is about ``GROUP_KEYS``, and a key that repeats is dropped
    within batches before the shuffle.
    """
    kind = keys.schema[group]
    own = keys.select(group, key).where(F.col(group).isNotNull() & F.col(key).isNotNull())
    parts = own.groupBy(group).agg(F.ceil(F.count("*") / GROUP_KEYS).alias("parts")).where("parts > 1")
    placed = _placed(own, parts, group, key).select(group, "__part", F.col(key).cast("binary").alias("__key"))
    hashed = T.StructType([kind, T.StructField("__part", T.IntegerType()), T.StructField("__hash", T.LongType())])
    schema = T.StructType(
        [kind, T.StructField("part", T.IntegerType()), T.StructField("filter", T.BinaryType()), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("keys", T.LongType())]
    )

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.table([*batch.columns[:2], hash32_arrow(batch.column(2))], names=hashed.names)
            yield from found.group_by(hashed.names).aggregate([]).to_batches()

    def run(table: pa.Table) -> pa.Table:
        hashes = np.unique(table.column("__hash").to_numpy())
        made = _from_hashes(hashes, bits_per_key)
        words = np.frombuffer(made[:-1] + bytes(-(len(made) - 1) % 8), "<i8")
        cells = [table.column(group)[:1], pa.array([table.column("__part")[0].as_py()], pa.int32()), pa.array([made], pa.binary()), pa.array([words], pa.list_(pa.int64())), pa.array([len(hashes)], pa.int64())]
        return pa.table(cells, names=schema.names)

    return Filters(placed.mapInArrow(distinct, hashed).groupBy(group, "__part").applyInArrow(run, schema), parts, group, bits_per_key)


def probe(rows: DataFrame, built: Filters, key: str = "key", name: str = "hit") -> DataFrame:
    """``rows`` with ``name``: whether the filter of the row's group may contain its key; False without a filter or key.

    Rows meet the filter of their part in a join, whose large partitions Spark
    can split, and bits are tested within the plan: Python sees the keys alone,
    to hash them, batch by batch.
    """
    group = built.group
    table = built.table.select(F.col(group).alias("__group"), F.col("part").alias("__of_part"), F.col("words").alias("__words"), (8 * (F.octet_length("filter") - 1)).cast("long").alias("__bits"))
    joined = _placed(rows, built.parts, group, key).withColumn("__hash", _hash(F.col(key).cast("binary"))).join(table, (F.col(group) == F.col("__group")) & (F.col("__part") == F.col("__of_part")), "left")
    h, mask = F.col("__hash"), F.lit(U32).cast("long")
    step = F.shiftright(h, 17).bitwiseOR(F.shiftleft(h, 15).bitwiseAND(mask))
    tests = []
    for i in range(probes_for(built.bits_per_key)):
        at = (h + step * F.lit(i).cast("long")).bitwiseAND(mask) % F.col("__bits")
        tests.append(F.getbit(F.get("__words", F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)
    hit = functools.reduce(lambda a, b: a & b, tests)
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("__part", "__hash", "__group", "__of_part", "__words", "__bits")
