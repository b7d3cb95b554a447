"""Text dumps."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.codecs import escape_column
from tidemark.schema import DEL
from tidemark.sources.manifest import FOLDER
from tidemark.sources.storage import Storage, parse_file_name


def dump_log(log: DataFrame) -> DataFrame:
    """(line): a line for each row, in internal order: ``'key' @ seq : put => 'value'`` or ``: del``."""
    value = F.coalesce(F.col("value").cast("binary"), F.lit(b""))
    text = F.when(F.col("op") == DEL, F.format_string("'%s' @ %d : del", escape_column(F.col("key").cast("binary")), F.col("seq"))).otherwise(
        F.format_string("'%s' @ %d : put => '%s'", escape_column(F.col("key").cast("binary")), F.col("seq"), escape_column(value))
    )
    return log.orderBy("key", F.desc("seq")).select(text.alias("line"))


def dump_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(version, edit): the edits of a table."""
    storage = Storage(spark, path)
    rows = [(int(n[:-5]), json.dumps(json.loads(storage.read(f"{FOLDER}/{n}")), sort_keys=True)) for n in storage.names(FOLDER) if n[:-5].isdigit() and n.endswith(".json")]
    return spark.createDataFrame(rows, "version long, edit string")


def dump(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a file by its kind: a table folder, a Parquet file or folder of log rows, or a log of batches."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    kind = parse_file_name(name)
    if kind and kind[0] == "log":
        from tidemark.sources.wal import read_logs

        rows = read_logs(spark, path)
        key = escape_column(F.col("key"))
        put = F.format_string("%d: put '%s' '%s'", F.col("seq"), key, escape_column(F.coalesce("value", F.lit(b""))))
        return rows.select(F.when(F.col("error").isNotNull(), F.concat(F.lit("damaged: "), F.col("error"))).when(F.col("op") == DEL, F.format_string("%d: del '%s'", F.col("seq"), key)).otherwise(put).alias("line"))
    if Storage(spark, path).exists(FOLDER):
        return dump_manifest(spark, path).select(F.format_string("%d: %s", "version", "edit").alias("line"))
    return dump_log(spark.read.parquet(path))
