"""Atomic batches of writes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import CorruptionError
from tidemark.functions.codecs import fixed32, fixed64, length_prefixed, read_fixed, read_length_prefixed
from tidemark.plans.files import LITERALS, lower_bound
from tidemark.schema import DEL, LOG_SCHEMA, PUT

#: Sequence number (8 bytes) and count (4 bytes) stand before the records (fixed value).
HEADER = 12
#: Limits of a merged group: a small first batch isn't held up by much more than its size (fixed values).
GROUP_BYTES, SMALL_BYTES = 1 << 20, 128 << 10


@dataclass
class WriteBatch:
    """Puts and deletes in order; of several on one key the last one wins."""

    ops: list[tuple[int, bytes, bytes | None]] = field(default_factory=list)

    def put(self, key: bytes, value: bytes) -> WriteBatch:
        self.ops.append((PUT, bytes(key), bytes(value)))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self.ops.append((DEL, bytes(key), None))
        return self

    def clear(self) -> None:
        self.ops.clear()

    def append(self, other: WriteBatch) -> None:
        self.ops.extend(other.ops)

    def __len__(self) -> int:
        return len(self.ops)

    def approximate_size(self) -> int:
        return len(self.encode())

    def encode(self, seq: int = 0) -> bytes:
        """The batch as bytes: header, then tag, key and value of each operation."""
        body = b"".join(bytes([op]) + length_prefixed(k) + (length_prefixed(v) if op == PUT else b"") for op, k, v in self.ops)
        return fixed64(seq) + fixed32(len(self.ops)) + body

    @staticmethod
    def decode(raw: bytes, strict: bool = True) -> tuple[int, WriteBatch, str | None]:
        """(seq, batch, error). Operations before the damage are kept; ``strict`` raises instead."""
        batch, error, seq = WriteBatch(), None, 0
        try:
            seq = read_fixed(raw[:8]) if len(raw) >= HEADER else 0
            for op, key, value in read_ops(raw):
                batch.ops.append((op, key, value))
        except CorruptionError as e:
            if strict:
                raise
            error = str(e)
        return seq, batch, error

    def iterate(self, put: Callable[[bytes, bytes], None], delete: Callable[[bytes], None]) -> None:
        for op, key, value in self.ops:
            put(key, value) if op == PUT else delete(key)

    def to_log(self, spark: SparkSession, last_seq: int) -> DataFrame:
        """Log rows with consecutive sequence numbers after ``last_seq``."""
        rows = [(k, last_seq + 1 + i, op, v) for i, (op, k, v) in enumerate(self.ops)]
        return spark.createDataFrame(rows, LOG_SCHEMA)


def read_ops(raw: bytes) -> Iterator[tuple[int, bytes, bytes | None]]:
    """Operations of an encoded batch; raises at the first that is damaged."""
    if len(raw) < HEADER:
        raise CorruptionError("malformed batch", "too small")
    rest, seen = raw[HEADER:], 0
    while rest:
        tag, rest = rest[0], rest[1:]
        if tag not in (PUT, DEL):
            raise CorruptionError("unknown batch tag")
        what = "bad put" if tag == PUT else "bad delete"
        key = read_length_prefixed(rest)
        value = read_length_prefixed(key[1]) if key and tag == PUT else None
        if key is None or (tag == PUT and value is None):
            raise CorruptionError(what)
        rest = value[1] if value else key[1]
        seen += 1
        yield tag, key[0], value[0] if value else None
    if seen != read_fixed(raw[8:12]):
        raise CorruptionError("batch has wrong count")


def sequence(batch: DataFrame, last_seq: int, index: str = "idx", per_part: int = 100_000) -> DataFrame:
    """(idx, key, op, value) -> log rows numbered by ``idx`` after ``last_seq``.

    Numbers within id ranges are offset by the ranges' counts, so a batch of any
    size is numbered without one task for all of it.
    """
    n = batch.count()
    parts = max(1, min(LITERALS, n // per_part))
    marks = batch.agg(F.percentile_approx(index, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    part = lower_bound(F.array(*[F.lit(m) for m in marks]), F.col(index), len(marks).bit_length()) if marks else F.lit(0)
    cells = batch.withColumn("__part", F.coalesce(part, F.lit(0)))
    counts = {r[0]: r[1] for r in cells.groupBy("__part").count().collect()}
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    starts = batch.sparkSession.createDataFrame(offsets, "__p int, __before long")
    numbered = cells.withColumn("__rn", F.row_number().over(Window.partitionBy("__part").orderBy(index))).join(F.broadcast(starts), F.col("__part") == F.col("__p"))
    return numbered.withColumn("seq", F.lit(last_seq).cast("long") + F.col("__before") + F.col("__rn")).drop("__part", "__p", "__before", "__rn", index)


def group_commit(batches: list[DataFrame], last_seq: int, index: str = "idx") -> DataFrame:
    """Several batches as one, in order: each continues where the one before ended, numbered within its index ranges."""
    out = []
    for b in batches:
        out.append(sequence(b, last_seq, index))
        last_seq += b.count()
    return reduce(DataFrame.unionByName, out)


def group_size(sizes: list[int], syncs: list[bool]) -> int:
    """How many queued batches the first one takes along: up to a size, and no durable batch behind one that isn't."""
    if not sizes:
        return 0
    most = sizes[0] + SMALL_BYTES if sizes[0] <= SMALL_BYTES else GROUP_BYTES
    total, n = sizes[0], 1
    while n < len(sizes) and not (syncs[n] and not syncs[0]) and total + sizes[n] <= most:
        total += sizes[n]
        n += 1
    return n


BATCH_SCHEMA = T.StructType([T.StructField("idx", T.LongType()), *[LOG_SCHEMA[c] for c in ("key", "op", "value")]])
