"""The block format of write-ahead logs, for exchange with embedded stores.

A log is blocks of 32 KiB. A record has a 7-byte header: masked CRC-32C of type
and data (4 bytes), length (2), type (1). A record that doesn't fit is cut into
first, middle and last parts; fewer than 7 bytes at the end of a block are zero.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import CorruptionError
from tidemark.functions.codecs import crc32c, fixed32, mask_crc, read_fixed
from tidemark.operators.batch import WriteBatch

#: Sizes and record types (fixed values).
BLOCK, HEADER = 32768, 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4


def write_records(records: Iterable[bytes], start: int = 0) -> bytes:
    """Records as they stand in a log after its first ``start`` bytes."""
    out = bytearray()
    for record in records:
        at, begun = 0, False
        while True:
            room = BLOCK - (start + len(out)) % BLOCK
            if room < HEADER:
                out += bytes(room)
                room = BLOCK
            part = record[at : at + room - HEADER]
            at += len(part)
            done = at == len(record)
            kind = (LAST if done else MIDDLE) if begun else (FULL if done else FIRST)
            out += fixed32(mask_crc(crc32c(bytes([kind]) + part))) + len(part).to_bytes(2, "little") + bytes([kind]) + part
            begun = True
            if done:
                break
    return bytes(out)


def read_records(raw: bytes, strict: bool = False) -> Iterator[tuple[bytes | None, str | None]]:
    """(record, None) of each whole record, (None, what was wrong) of each damaged stretch.

    A block is left at a bad checksum or length; ``strict`` raises instead. A
    record cut off by the end of the log is an unfinished write, not damage.
    """
    held: bytearray | None = None

    def bad(what: str) -> tuple[None, str]:
        if strict:
            raise CorruptionError("log", what)
        return None, what

    for start in range(0, len(raw), BLOCK):
        block, at = raw[start : start + BLOCK], 0
        whole = len(block) == BLOCK
        while len(block) - at >= HEADER:
            size, kind = read_fixed(block[at + 4 : at + 6]), block[at + 6]
            if kind == 0 and size == 0:
                break
            end = at + HEADER + size
            if end > len(block):
                if whole:
                    yield bad("bad record length")
                held = None
                break
            data = block[at + HEADER : end]
            if read_fixed(block[at : at + 4]) != mask_crc(crc32c(bytes([kind]) + data)):
                yield bad("checksum mismatch")
                held = None
                break
            at = end
            if kind in (FULL, FIRST):
                if held:
                    yield bad("partial record without end")
                held = bytearray(data)
                if kind == FULL:
                    yield bytes(held), None
                    held = None
            elif kind in (MIDDLE, LAST):
                if held is None:
                    yield bad("missing start of fragmented record")
                    continue
                held += data
                if kind == LAST:
                    yield bytes(held), None
                    held = None
            else:
                yield bad(f"unknown record type {kind}")
                held = None


def read_logs(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(path, record, seq, op, key, value, error) of the batches in all log files under ``path``: a task reads whole files."""
    schema = "path string, record long, seq long, op byte, key binary, value binary, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for name, content in zip(f["path"], f["content"], strict=True):
                for n, (record, error) in enumerate(read_records(bytes(content), strict)):
                    if record is None:
                        rows.append((name, n, None, None, None, None, error))
                        continue
                    seq, batch, error = WriteBatch.decode(record, strict)
                    rows += [(name, n, seq + i, op, k, v, None) for i, (op, k, v) in enumerate(batch.ops)]
                    if error:
                        rows.append((name, n, None, None, None, None, error))
            yield pd.DataFrame(rows, columns=["path", "record", "seq", "op", "key", "value", "error"]).astype({"seq": "Int64", "op": "Int8"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, schema)
