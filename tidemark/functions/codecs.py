"""Integer codecs, checksums, hashes and text forms of byte strings.

Each function exists for one Python value and as a column function. Column
functions are SQL expressions where SQL has the parts, else Arrow-batched.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

U32, U64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF


# -- fixed width, little endian -----------------------------------------------
def fixed32(n: int) -> bytes:
    return (n & U32).to_bytes(4, "little")


def fixed64(n: int) -> bytes:
    return (n & U64).to_bytes(8, "little")


def read_fixed(raw: bytes) -> int:
    return int.from_bytes(raw, "little")


def fixed32_column(n: Column) -> Column:
    """4 bytes, least first, of a non-negative number below 2^32."""
    parts = [F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * i).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for i in range(4)]
    return F.unhex(F.concat(*parts))


def fixed64_column(n: Column) -> Column:
    parts = [F.lpad(F.hex(F.shiftrightunsigned(n.cast("long"), 8 * i).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for i in range(8)]
    return F.unhex(F.concat(*parts))


def read_fixed_column(raw: Column) -> Column:
    """The number in up to 7 bytes, least first (8 bytes if below 2^63)."""
    flipped = F.array_join(F.reverse(F.regexp_extract_all(F.hex(raw), F.lit("(..)"), F.lit(1))), "")
    return F.conv(flipped, 16, 10).try_cast("long")


# -- variable width: 7 bits a byte, least first, the high bit means more ------
def varint(n: int) -> bytes:
    out = bytearray()
    n &= U64
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, bits: int = 64) -> tuple[int, int] | None:
    """(number, bytes used); None if it is cut off or too large for ``bits``."""
    n = 0
    for i in range(min(len(raw), -(-bits // 7))):
        n |= (raw[i] & 127) << 7 * i
        if raw[i] < 128:
            return (n, i + 1) if n >> bits == 0 else None
    return None


def varint_length(n: Column) -> Column:
    """Bytes of the varint of a non-negative number."""
    out = F.lit(1)
    for k in range(1, 9):
        out = F.when(n >= F.lit(1 << 7 * k).cast("long"), k + 1).otherwise(out)
    return out


def varint_column(n: Column) -> Column:
    """The varint of a non-negative long, as an expression."""
    groups = F.transform(F.sequence(F.lit(0), varint_length(n) - 1), lambda i: F.call_function("shiftright", n.cast("long"), 7 * i).bitwiseAND(F.lit(127).cast("long")))
    last = varint_length(n) - 1
    return F.unhex(F.array_join(F.transform(groups, lambda g, i: F.lpad(F.hex(F.when(i < last, g + 128).otherwise(g)), 2, "0")), ""))


def read_varint_column(bits: int = 64) -> Callable[[Column], Column]:
    """Null for truncated or overflowing input; the number as a decimal, since it may be 2^63 and more."""
    most = -(-bits // 7)

    def run(raw: Column) -> Column:
        pairs = F.regexp_extract_all(F.hex(F.substring(raw, F.lit(1), F.lit(most))), F.lit("(..)"), F.lit(1))
        values = F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("long"))
        # The first byte without the high bit ends the number.
        used = F.slice(values, F.lit(1), F.greatest(F.lit(0), F.array_position(F.transform(values, lambda b: b < 128), F.lit(True)).cast("int")))
        low = F.aggregate(F.transform(used, lambda b, i: F.call_function("shiftleft", b.bitwiseAND(F.lit(127).cast("long")), 7 * i)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
        whole = F.when(low < 0, low.cast("decimal(20,0)") + F.lit(str(U64 + 1)).cast("decimal(20,0)")).otherwise(low.cast("decimal(20,0)"))
        last = F.element_at(used, -1)
        fits = (F.size(used) < most) | (last < F.lit(1 << bits - 7 * (most - 1)).cast("long"))
        return F.when((F.size(used) > 0) & fits, whole).cast("decimal(20,0)")

    return run


def length_prefixed(raw: bytes) -> bytes:
    return varint(len(raw)) + raw


def read_length_prefixed(raw: bytes) -> tuple[bytes, bytes] | None:
    """(slice, rest), None if it is cut off."""
    got = read_varint(raw, 32)
    if got is None or got[1] + got[0] > len(raw):
        return None
    return raw[got[1] : got[1] + got[0]], raw[got[1] + got[0] :]


def length_prefixed_column(raw: Column) -> Column:
    return F.concat(varint_column(F.octet_length(raw).cast("long")), raw)


# -- checksums ----------------------------------------------------------------
#: Castagnoli polynomial, reflected (fixed value).
CASTAGNOLI = 0x82F63B78
#: Added to a rotated checksum (fixed value).
MASK_DELTA = 0xA282EAD8


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CASTAGNOLI), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32c(raw: bytes, start: int = 0) -> int:
    """CRC-32C of ``raw`` after data with checksum ``start``."""
    c, table = start ^ U32, _CRC.tolist()
    for b in raw:
        c = table[(c ^ b) & 255] ^ (c >> 8)
    return c ^ U32


def _crc_batch(rows: list[bytes | None]) -> list[int | None]:
    """CRC-32C of many rows, a byte position of all rows at a time."""
    at = [i for i, r in enumerate(rows) if r is not None]
    at.sort(key=lambda i: -len(rows[i]))
    lens = np.array([len(rows[i]) for i in at], np.int64)
    flat = np.frombuffer(b"".join(rows[i] for i in at), np.uint8)
    offset = np.concatenate(([0], np.cumsum(lens)[:-1])).astype(np.int64) if len(lens) else lens
    c = np.full(len(at), U32, np.uint32)
    live = len(at)
    for p in range(int(lens[0]) if len(lens) else 0):
        while live and lens[live - 1] <= p:
            live -= 1
        own = c[:live]
        c[:live] = _CRC[(own ^ flat[offset[:live] + p]) & 255] ^ (own >> np.uint32(8))
    out: list[int | None] = [None] * len(rows)
    for i, v in zip(at, (c ^ np.uint32(U32)).tolist(), strict=True):
        out[i] = v
    return out


@F.pandas_udf(T.LongType())
def crc32c_column(s: pd.Series) -> pd.Series:
    return pd.Series(_crc_batch([None if x is None else bytes(x) for x in s]), dtype="Int64")


def mask_crc(c: int) -> int:
    return ((c >> 15 | c << 17) + MASK_DELTA) & U32


def unmask_crc(c: int) -> int:
    r = (c - MASK_DELTA) & U32
    return (r >> 17 | r << 15) & U32


def mask_crc_column(c: Column) -> Column:
    c = c.cast("long")
    turned = F.shiftright(c, 15).bitwiseOR(F.shiftleft(c, 17)).bitwiseAND(F.lit(U32))
    return (turned + F.lit(MASK_DELTA)).bitwiseAND(F.lit(U32))


def unmask_crc_column(c: Column) -> Column:
    r = (c.cast("long") - F.lit(MASK_DELTA)).bitwiseAND(F.lit(U32))
    return F.shiftright(r, 17).bitwiseOR(F.shiftleft(r, 15)).bitwiseAND(F.lit(U32))


# -- hash ---------------------------------------------------------------------
#: Multiplier and shift of the seeded 32-bit hash, and the seed of filters (fixed values).
HASH_FACTOR, HASH_SHIFT = 0xC6A4A793, 24
FILTER_SEED = 0xBC9F1D34


def hash32(raw: bytes, seed: int = FILTER_SEED) -> int:
    """Seeded 32-bit hash over little-endian words, the tail added byte by byte."""
    h = seed ^ (len(raw) * HASH_FACTOR & U32)
    whole = len(raw) & ~3
    for w in np.frombuffer(raw[:whole], "<u4").tolist():
        h = (h + w) * HASH_FACTOR & U32
        h ^= h >> 16
    tail = int.from_bytes(raw[whole:], "little")
    if whole < len(raw):
        h = (h + tail) * HASH_FACTOR & U32
        h ^= h >> HASH_SHIFT
    return h


def _hash32_flat(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int) -> np.ndarray:
    """``hash32`` of slices of one buffer, those of one length together."""
    out = np.empty(len(starts), np.uint64)
    factor, mask = np.uint64(HASH_FACTOR), np.uint64(U32)
    words = np.ndarray(max(0, len(flat) - 3), "<u4", flat, strides=(1,))  # the word at each byte
    for n in np.unique(lens).tolist():
        at = np.flatnonzero(lens == n)
        own, whole = starts[at], n & ~3
        h = np.full(len(at), seed ^ (n * HASH_FACTOR & U32), np.uint64)
        for i in range(0, whole, 4):
            h = (h + words[own + i]) * factor & mask
            h ^= h >> np.uint64(16)
        if whole < n:
            tail = np.zeros(len(at), np.uint64)
            for j in range(whole, n):
                tail |= flat[own + j].astype(np.uint64) << np.uint64(8 * (j - whole))
            h = (h + tail) * factor & mask
            h ^= h >> np.uint64(HASH_SHIFT)
        out[at] = h
    return out


def hash32_many(keys: list[bytes], seed: int = FILTER_SEED) -> np.ndarray:
    """``hash32`` of many keys."""
    lens = np.array([len(k) for k in keys], np.int64)
    return _hash32_flat(np.frombuffer(b"".join(keys), np.uint8), np.cumsum(lens) - lens, lens, seed)


def hash32_arrow(keys: pa.Array, seed: int = FILTER_SEED) -> pa.Array:
    """``hash32`` of an array of binary, null for null, read where it lies."""
    ends = np.frombuffer(keys.buffers()[1], np.int64 if pa.types.is_large_binary(keys.type) else np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
    found = _hash32_flat(np.frombuffer(keys.buffers()[2] or b"", np.uint8), ends[:-1], np.diff(ends), seed) if len(keys) else np.empty(0, np.uint64)
    return pa.array(found.astype(np.int64), pa.int64(), mask=keys.is_null().to_numpy(zero_copy_only=False))


def hash32_column(seed: int = FILTER_SEED) -> Callable[[Column], Column]:
    @F.pandas_udf(T.LongType())
    def run(s: pd.Series) -> pd.Series:
        there = s.notna()
        out = pd.Series(pd.NA, index=s.index, dtype="Int64")
        out[there] = hash32_many([bytes(x) for x in s[there]], seed).astype(np.int64)
        return out

    return run


# -- text ---------------------------------------------------------------------
def escape(raw: bytes) -> str:
    r"""Printable ASCII as it is (backslash too), other bytes as \xNN."""
    return "".join(chr(b) if 32 <= b <= 126 else f"\\x{b:02x}" for b in raw)


def escape_column(raw: Column) -> Column:
    pairs = F.regexp_extract_all(F.lower(F.hex(raw)), F.lit("(..)"), F.lit(1))
    return F.array_join(
        F.transform(
            pairs,
            lambda h: F.when((h >= "20") & (h <= "7e"), F.unhex(h).cast("string")).otherwise(F.concat(F.lit("\\x"), h)),
        ),
        "",
    )


def consume_decimal(text: str) -> tuple[int, str] | None:
    """(number, rest) of the digits that ``text`` starts with; None without any or above 2^64 - 1."""
    digits = text[: len(text) - len(text.lstrip("0123456789"))]
    if not digits or int(digits) > U64:
        return None
    return int(digits), text[len(digits) :]


def consume_decimal_column(text: Column) -> Column:
    """The number as decimal(20, 0), or null."""
    digits = F.regexp_extract(text, "^[0-9]+", 0)
    short = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    n = F.when(F.length(short) <= 20, short).try_cast("decimal(20,0)")
    return F.when(n <= F.lit(str(U64)).cast("decimal(20,0)"), n)


# -- separators ---------------------------------------------------------------
def short_separator(start: bytes, limit: bytes) -> bytes:
    """A short key k with start <= k < limit, where there is one; else ``start``."""
    n = next((i for i, (a, b) in enumerate(zip(start, limit, strict=False)) if a != b), None)
    if n is None or start[n] == 255 or start[n] + 1 >= limit[n]:
        return start
    return start[:n] + bytes([start[n] + 1])


def short_successor(key: bytes) -> bytes:
    """A short key not below ``key``; a key of 0xff bytes stays."""
    n = next((i for i, b in enumerate(key) if b != 255), None)
    return key if n is None else key[:n] + bytes([key[n] + 1])


def _byte(raw: Column, i: Column) -> Column:
    """The byte at position ``i`` from 0."""
    return F.conv(F.hex(F.substring(raw, i + 1, F.lit(1))), 16, 10).cast("int")


def _with_greater(raw: Column, n: Column) -> Column:
    """The first ``n`` bytes and the next one, greater by one."""
    return F.concat(F.substring(raw, F.lit(1), n), F.unhex(F.lpad(F.hex((_byte(raw, n) + 1).cast("long")), 2, "0")))


def short_separator_column(start: Column, limit: Column) -> Column:
    """``short_separator`` as an expression."""
    common = F.least(F.octet_length(start), F.octet_length(limit))
    n = F.get(F.filter(F.sequence(F.lit(0), common), lambda i: (i == common) | (F.substring(start, i + 1, F.lit(1)) != F.substring(limit, i + 1, F.lit(1)))), F.lit(0))
    same = (n == common) | (_byte(start, n) == 255) | (_byte(start, n) + 1 >= _byte(limit, n))
    return F.when(start.isNotNull() & limit.isNotNull(), F.when(same, start).otherwise(_with_greater(start, n)))


def short_successor_column(key: Column) -> Column:
    """``short_successor`` as an expression."""
    size = F.octet_length(key)
    n = F.get(F.filter(F.sequence(F.lit(0), size), lambda i: (i == size) | (F.hex(F.substring(key, i + 1, F.lit(1))) != "FF")), F.lit(0))
    return F.when(n == size, key).otherwise(_with_greater(key, n))


# -- internal keys ------------------------------------------------------------
def pack_trailer(seq: int, op: int) -> int:
    return seq << 8 | op


def internal_key(key: bytes, seq: int, op: int) -> bytes:
    return key + fixed64(pack_trailer(seq, op))


def parse_internal_key(raw: bytes) -> tuple[bytes, int, int] | None:
    """(key, seq, op); None if it is too short or has an unknown operation."""
    if len(raw) < 8 or raw[-8] > 1:
        return None
    n = read_fixed(raw[-8:])
    return raw[:-8], n >> 8, n & 255


def internal_separator(start: bytes, limit: bytes) -> bytes:
    """A separator of internal keys: a shorter user key sorts first with the greatest trailer."""
    user = short_separator(start[:-8], limit[:-8])
    return start if len(user) >= len(start) - 8 or user <= start[:-8] else internal_key(user, (1 << 56) - 1, 1)


def internal_successor(raw: bytes) -> bytes:
    user = short_successor(raw[:-8])
    return raw if len(user) > len(raw) - 8 or user <= raw[:-8] else internal_key(user, (1 << 56) - 1, 1)


def pack_trailer_column(seq: Column, op: Column) -> Column:
    return F.shiftleft(seq.cast("long"), 8).bitwiseOR(op.cast("long"))


def internal_key_column(key: Column, seq: Column, op: Column) -> Column:
    return F.concat(key, fixed64_column(pack_trailer_column(seq, op)))


def split_internal_key_column(raw: Column) -> Column:
    """struct(key, seq, op), null for keys that can't be parsed."""
    n = F.octet_length(raw)
    tail = F.substring(raw, n - 7, F.lit(8))
    trailer = F.array_join(F.reverse(F.regexp_extract_all(F.hex(tail), F.lit("(..)"), F.lit(1))), "")
    op = F.conv(F.substring(trailer, 15, 2), 16, 10).cast("int")
    return F.when(
        (n >= 8) & (op <= 1),
        F.struct(F.substring(raw, F.lit(1), n - 8).alias("key"), F.conv(F.substring(trailer, 1, 14), 16, 10).cast("long").alias("seq"), op.cast("byte").alias("op")),
    )


def debug_column(key: Column, seq: Column, op: Column) -> Column:
    """``'key' @ seq : op``"""
    return F.format_string("'%s' @ %d : %d", key.cast("string"), seq, op.cast("int"))
