"""Bit sets of hashed keys that tasks look up.

A set has 16 bits or more for each key where that many fit in ``MAX_BITS``;
beyond, it fills up and tells less. A false hit must do no harm to whoever asks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hashing import mix

MIN_BITS, MAX_BITS = 20, 26


def bit_set(keys: DataFrame, column: str, bits_per_key: int = 16):
    """A broadcast bit set of the column's hashes, sized by their number within fixed bounds."""
    spark = keys.sparkSession
    n = keys.count()
    size = min(MAX_BITS, max(MIN_BITS, (bits_per_key * max(1, n)).bit_length()))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64((1 << size) - 1)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (h & np.uint64(63))).view(np.int64))], names=["w", "b"])

    got = keys.select(F.col(column).cast("long")).mapInArrow(words_of, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros((1 << size) // 64, np.int64)
    table[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return spark.sparkContext.broadcast(table.tobytes())


def bit_table(bits) -> tuple[np.ndarray, np.uint64]:
    table = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").view(bool)
    return table, np.uint64(len(table) - 1)


def has(table: np.ndarray, mask: np.uint64, keys: np.ndarray) -> np.ndarray:
    return table[(mix(keys) & mask).astype(np.int64)]


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def xxhash64(keys: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of each long."""

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return x << np.uint64(n) | x >> np.uint64(64 - n)

    h = turned(keys.view(np.uint64) * _P2, 31) * _P1 ^ np.uint64(42 + 8 + int(_P5))
    h = turned(h, 27) * _P1 + _P4
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def bit_sets(keys: DataFrame) -> list:
    """A broadcast bit set for each of the long columns, for ``among``: one pass within the plan, without a count.

    Keys meet at ``MAX_BITS``; each set is folded to 16 bits or more for each key.
    """
    spark, n, shift = keys.sparkSession, len(keys.columns), MAX_BITS - 6
    bit = [f"xxhash64(`{c}`) & {(1 << MAX_BITS) - 1}L" for c in keys.columns]
    rows = ", ".join(f"struct(shiftright({b}, 6) + {i << shift}L as w, shiftleft(1L, cast({b} & 63L as int)) as b)" for i, b in enumerate(bit))
    got = keys.select(F.expr(f"inline(array({rows}))")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros((n, 1 << shift), np.int64)
    table.reshape(-1)[got.column("w").to_numpy()] = got.column("b").to_numpy()
    out = []
    for row in table:
        size = min(MAX_BITS, max(MIN_BITS, (16 * int(np.bitwise_count(row.view(np.uint64)).sum())).bit_length()))
        out.append(spark.sparkContext.broadcast(np.bitwise_or.reduce(row.reshape(-1, (1 << size) // 64), axis=0).tobytes()))
    return out


def among(table: np.ndarray, mask: np.uint64, keys: np.ndarray) -> np.ndarray:
    return table[(xxhash64(keys) & mask).astype(np.int64)]
