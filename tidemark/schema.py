"""The change log, key orders and options."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import InvalidArgumentError

DEL, PUT = 0, 1
#: Sequence numbers have 56 bits; the rest of a packed trailer is the operation.
MAX_SEQ = (1 << 56) - 1
N_LEVELS = 7

LOG_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)


@dataclass(frozen=True)
class KeyOrder:
    """An order (and equality) of keys, as a function to something Spark sorts.

    ``column`` maps a key column to a sortable column, ``value`` one key to the
    same thing in Python. Keys with equal images are one key.
    """

    name: str
    column: Callable[[Column], Column]
    value: Callable[[object], object]


BYTEWISE = KeyOrder("bytewise", lambda c: c, lambda k: k)
REVERSED_BYTES = KeyOrder(
    "reversed-bytes",
    lambda c: F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(c), F.lit("(..)"), F.lit(1))), "")),
    lambda k: bytes(reversed(k)),
)


def _number(text: object) -> int:
    raw = text.decode() if isinstance(text, bytes) else str(text)
    body = raw.strip("[]")
    return int(body, 16) if body.lower().startswith("0x") else int(body)


#: Keys like ``[10]`` and ``[0xa]`` are numbers; equal numbers are one key.
NUMERIC = KeyOrder(
    "bracketed-number",
    lambda c: F.when(
        F.lower(F.regexp_extract(c.cast("string"), r"^\[(0[xX])", 1)) == "0x",
        F.conv(F.regexp_extract(c.cast("string"), r"^\[0[xX]([0-9a-fA-F]+)\]$", 1), 16, 10).cast("long"),
    ).otherwise(F.regexp_extract(c.cast("string"), r"^\[([0-9]+)\]$", 1).try_cast("long")),
    _number,
)

KEY_ORDERS = {o.name: o for o in (BYTEWISE, REVERSED_BYTES, NUMERIC)}


@dataclass(frozen=True)
class Options:
    """Settings of a table; ``sanitised`` clips sizes to their ranges."""

    key_order: KeyOrder = BYTEWISE
    create_if_missing: bool = False
    error_if_exists: bool = False
    #: Check files and sequence order on open and fail on damage.
    paranoid_checks: bool = False
    #: Batches held in memory are written at this size (bytes).
    write_buffer_size: int = 4 << 20
    max_open_files: int = 1000
    block_size: int = 4 << 10
    block_restart_interval: int = 16
    #: Target bytes of a data file after compaction.
    max_file_size: int = 2 << 20
    compression: str = "snappy"
    reuse_logs: bool = False
    bloom_filter: bool = False
    #: Level-0 files that make a level-0 compaction due.
    level0_trigger: int = 4
    #: Compact what is due after each commit.
    auto_compact: bool = False
    #: The deepest level that a new run may start on, where it meets no file above it.
    flush_level: int = 0

    #: (least, most) of each size (fixed values).
    RANGES = {
        "write_buffer_size": (64 << 10, 1 << 30),
        "max_open_files": (74, 50000),
        "block_size": (1 << 10, 4 << 20),
        "max_file_size": (1 << 20, 1 << 30),
    }

    def sanitised(self) -> Options:
        if self.compression not in ("snappy", "none", "zstd", "uncompressed"):
            raise InvalidArgumentError("unknown compression", self.compression)
        return replace(self, **{k: min(hi, max(lo, getattr(self, k))) for k, (lo, hi) in self.RANGES.items()})
