"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.workspace import ship

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one of our own only where none is named."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name = "_" + name
    return name


def bound(value: Column, body) -> Column:
    """``let value in body(value)``: evaluates ``value`` once per row, also within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sealed(df: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns renamed in_0, in_1, ... so that no name of an operator can clash.

    Also gives a function from names to the new names, and one that gives a result
    its names back; new columns get underscores in front where they clash.
    """
    inner = {c: f"in_{i}" for i, c in enumerate(df.columns)}
    outer = {v: k for k, v in inner.items()}

    def restore(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(f"`{c}`").alias(outer[c] if c in outer else free_name(df, c)) for c in out.columns])

    return df.toDF(*inner.values()), inner.__getitem__, restore


def keep_memory() -> None:
    """Lets a Python worker use its freed memory again within a task, where the C library would return it and fault it in anew. It holds for the worker's life; ``give_back`` returns what is left."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD, its greatest value
        libc.mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        return


def give_back(generation: int = 2) -> None:
    """Returns a Python worker's unused memory to the machine; workers live on between tasks.

    Generation 1 leaves out old objects, mostly the libraries': to look through them can take longer than a small task.
    """
    import pyarrow as pa

    gc.collect(generation)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
