"""The engine's queries over the test tables, with the SQL that must give the same rows.

Views: EV is the events table as a change log (a key for each user, errors are
deletes), OR the orders as a log of puts, FM the orders dealt to eight files.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import bloom, codecs, histogram
from tidemark.operators.batch import WriteBatch, group_commit, sequence
from tidemark.operators.table import VersionedTable, repair
from tidemark.plans import compaction, files, ordered, visibility
from tidemark.schema import NUMERIC, REVERSED_BYTES, KeyOrder, Options
from tidemark.sources.dump import dump_log
from tidemark.sources.manifest import DataFile, Edit, fold
from tidemark.workspace import scratch, ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Snapshots of the queries: before the last and near the middle.
S1, S2 = 5000, 7000

EV = """EV AS (SELECT 'user' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, event_id + 1 AS seq,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS TINYINT) AS op, value FROM events)"""
OR = """ORD AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, o_orderkey + 1 AS seq, CAST(1 AS TINYINT) AS op,
  o_totalprice AS value, o_orderstatus AS status FROM orders)"""
FM = """FMR AS (SELECT *, CAST(floor((seq - 1) * 8 / (SELECT max(seq) FROM ORD)) AS INT) AS number, CAST(octet_length(encode(key)) + 8 AS BIGINT) AS size FROM ORD),
FM AS (SELECT number, CAST(CASE WHEN number < 2 THEN 1 WHEN number < 5 THEN 2 ELSE 3 END AS INT) AS level, min(key) AS smallest, max(key) AS largest,
  CAST(sum(size) AS BIGINT) AS bytes, count(*) AS entries, max(seq) AS max_seq FROM FMR GROUP BY number)"""
NEW = "NEWEST AS (SELECT * FROM EV QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1), VIS AS (SELECT key, seq, value FROM NEWEST WHERE op = 1)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


def ev(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(
        F.concat(F.lit("user"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).cast("tinyint").alias("op"),
        "value",
    )


def orders(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("key"),
        (F.col("o_orderkey") + 1).alias("seq"),
        F.lit(1).cast("tinyint").alias("op"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderstatus").alias("status"),
    )


def sized(spark: SparkSession, d: str) -> DataFrame:
    """OR rows with a file number and a size."""
    o = orders(spark, d)
    top = o.agg(F.max("seq")).first()[0]
    return o.withColumns({"number": F.floor((F.col("seq") - 1) * 8 / F.lit(top)).cast("int"), "size": (F.octet_length("key") + 8).cast("long")})


def file_table(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("number") < 2, 1).when(F.col("number") < 5, 2).otherwise(3).cast("int")
    return files.describe(sized(spark, d), F.col("number"), level, F.col("size"))


def _out(df: DataFrame) -> DataFrame:
    return df.select("key", "seq", "value")


# -- scans ----------------------------------------------------------------------
@query("scan_visible", f"WITH {EV}, {NEW} SELECT key, seq, value FROM VIS")
def scan_visible(s, d):
    return _out(ordered.in_order(visibility.visible(ev(s, d))))


@query("scan_reverse", f"WITH {EV}, {NEW} SELECT key, seq, value, row_number() OVER (ORDER BY key DESC) AS pos FROM VIS")
def scan_reverse(s, d):
    state = visibility.visible(ev(s, d))
    return _number(state.select("key", "seq", "value"), reverse=True)


def _number(state: DataFrame, reverse: bool, ranges: int = 32) -> DataFrame:
    """Adds pos from 1 along the key order: within key ranges, offset by the ranges' counts."""
    placed = ordered.split_by_keys(state, ranges)
    counts = placed.groupBy("__part").count()
    order = Window.orderBy(F.desc("__p") if reverse else F.asc("__p"))
    starts = counts.withColumnRenamed("__part", "__p").withColumn("__start", F.coalesce(F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(F.desc("key") if reverse else F.asc("key")))
    joined = placed.join(F.broadcast(starts), F.col("__part") == F.col("__p"))
    return joined.withColumn("pos", F.col("__start") + rank).drop("__part", "__p", "__start")


@query("snapshot_read", f"WITH {EV} SELECT key, seq, value FROM (SELECT * FROM EV WHERE seq <= {S1} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 1")
def snapshot_read(s, d):
    return _out(visibility.visible(ev(s, d), S1))


@query(
    "snapshot_pair",
    f"WITH {EV} " + " UNION ALL ".join(f"SELECT CAST({x} AS BIGINT) AS snapshot, key, seq, value FROM (SELECT * FROM EV WHERE seq <= {x} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 1" for x in (S1, S2)),
)
def snapshot_pair(s, d):
    log = ev(s, d)
    at = [_out(visibility.visible(log, x)).withColumn("snapshot", F.lit(x).cast("long")) for x in (S1, S2)]
    return at[0].unionByName(at[1])


@query("point_get", f"WITH {EV}, {NEW} SELECT key, seq, value FROM VIS WHERE key = 'user000007'")
def point_get(s, d):
    return _out(visibility.point_get(ev(s, d), "user000007"))


@query(
    "point_get_tombstone",
    f"""WITH {EV}, {NEW}, K AS (SELECT 'user000003' AS key UNION ALL SELECT 'user000007' UNION ALL SELECT 'user000005' UNION ALL SELECT 'nobody')
    SELECT K.key, CASE WHEN op = 1 THEN 'found' WHEN op = 0 THEN 'deleted' ELSE 'absent' END AS outcome FROM K LEFT JOIN NEWEST ON K.key = NEWEST.key""",
)
def point_get_tombstone(s, d):
    log = ev(s, d)
    got = [visibility.probe(log, k) for k in ("user000003", "user000007", "user000005", "nobody")]
    return got[0].unionByName(got[1]).unionByName(got[2]).unionByName(got[3])


@query("multi_get", f"WITH {EV}, {NEW} SELECT key, seq, value FROM VIS WHERE key IN (SELECT 'user' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') FROM customer)")
def multi_get(s, d):
    keys = s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("user"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"))
    return _out(visibility.multi_get(ev(s, d), keys))


@query("versions_of_key", f"WITH {EV} SELECT key, seq, op, value, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS version FROM EV")
def versions_of_key(s, d):
    return visibility.versions(ev(s, d))


@query("tombstones", f"WITH {EV}, {NEW} SELECT key, seq FROM NEWEST WHERE op = 0")
def tombstones(s, d):
    return visibility.tombstones(ev(s, d)).select("key", "seq")


@query(
    "snapshot_changes",
    f"""WITH {EV}, A AS (SELECT key, max(seq) AS seq, arg_max(op, seq) AS op FROM EV WHERE seq <= {S1} GROUP BY key), B AS (SELECT key, max(seq) AS seq, arg_max(op, seq) AS op FROM EV WHERE seq <= {S2} GROUP BY key)
    SELECT key, change FROM (SELECT B.key, CASE WHEN coalesce(A.op, 0) = 0 AND B.op = 1 THEN 'added' WHEN A.op = 1 AND B.op = 0 THEN 'removed' WHEN A.op = 1 AND B.op = 1 AND A.seq < B.seq THEN 'changed' END AS change FROM B LEFT JOIN A ON A.key = B.key) WHERE change IS NOT NULL""",
)
def snapshot_changes(s, d):
    return visibility.changes(ev(s, d), S1, S2)


# -- order ------------------------------------------------------------------------
@query("seek_lower_bound", f"WITH {EV}, {NEW} SELECT key, seq, value FROM VIS WHERE key >= 'user000050x' ORDER BY key LIMIT 1")
def seek_lower_bound(s, d):
    return _out(ordered.seek(visibility.visible(ev(s, d)), "user000050x"))


@query("seek_for_prev", f"WITH {EV}, {NEW} SELECT key, seq, value FROM VIS WHERE key < 'user000050' ORDER BY key DESC LIMIT 1")
def seek_for_prev(s, d):
    return _out(ordered.seek_before(visibility.visible(ev(s, d)), "user000050"))


@query("first_last", f"WITH {EV}, {NEW} (SELECT 'first' AS place, key, seq, value FROM VIS ORDER BY key LIMIT 1) UNION ALL (SELECT 'last', key, seq, value FROM VIS ORDER BY key DESC LIMIT 1)")
def first_last(s, d):
    state = _out(visibility.visible(ev(s, d)))
    return ordered.first(state).withColumn("place", F.lit("first")).unionByName(ordered.last(state).withColumn("place", F.lit("last")))


@query("next_prev_keys", f"WITH {EV}, {NEW} SELECT key, lag(key) OVER (ORDER BY key) AS prev_key, lead(key) OVER (ORDER BY key) AS next_key FROM VIS")
def next_prev_keys(s, d):
    return ordered.neighbours(visibility.visible(ev(s, d)).select("key"), 16)


@query("range_scan", f"WITH {OR} SELECT key, seq, value, status FROM ORD WHERE key >= '0000000100' AND key < '0000000900'")
def range_scan(s, d):
    return ordered.key_range(visibility.visible(orders(s, d)), "0000000100", "0000000900").drop("op")


@query("keyset_page", f"WITH {OR} SELECT key, seq, value FROM ORD WHERE key > '0000000500' ORDER BY key LIMIT 100")
def keyset_page(s, d):
    return _out(ordered.page(visibility.visible(orders(s, d)), "0000000500", 100))


@query("keyset_page_reverse", f"WITH {OR} SELECT key, seq, value FROM ORD WHERE key < '0000000500' ORDER BY key DESC LIMIT 100")
def keyset_page_reverse(s, d):
    return _out(ordered.page(visibility.visible(orders(s, d)), "0000000500", 100, reverse=True))


@query("key_projection", f"WITH {EV}, {NEW} SELECT key FROM VIS")
def key_projection(s, d):
    return visibility.visible(ev(s, d)).select("key")


# -- writes -----------------------------------------------------------------------
_BATCH_SQL = "BT AS (SELECT c_custkey AS idx, 'user' || lpad(CAST(c_custkey % 90 AS VARCHAR), 6, '0') AS key, CAST(CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1 END AS TINYINT) AS op, c_acctbal AS value FROM customer)"


def _batch(s, d) -> DataFrame:
    c = s.read.parquet(f"{d}/customer.parquet")
    return c.select(
        F.col("c_custkey").alias("idx"),
        F.concat(F.lit("user"), F.lpad((F.col("c_custkey") % 90).cast("string"), 6, "0")).alias("key"),
        F.when(F.col("c_custkey") % 7 == 0, 0).otherwise(1).cast("tinyint").alias("op"),
        F.col("c_acctbal").alias("value"),
    )


@query("write_batch_sequence", f"WITH {_BATCH_SQL} SELECT key, op, value, (SELECT max(event_id) + 1 FROM events) + row_number() OVER (ORDER BY idx) AS seq FROM BT")
def write_batch_sequence(s, d):
    last = ev(s, d).agg(F.max("seq")).first()[0]
    return sequence(_batch(s, d), last)


@query(
    "batch_last_wins",
    f"""WITH {EV}, {_BATCH_SQL}, ALLROWS AS (SELECT key, seq, op, value FROM EV UNION ALL SELECT key, (SELECT max(seq) FROM EV) + row_number() OVER (ORDER BY idx), op, value FROM BT)
    SELECT key, seq, value FROM (SELECT * FROM ALLROWS QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 1""",
)
def batch_last_wins(s, d):
    log = ev(s, d)
    last = log.agg(F.max("seq")).first()[0]
    return _out(visibility.visible(log.unionByName(sequence(_batch(s, d), last))))


@query(
    "group_commit",
    f"""WITH {_BATCH_SQL}, G AS (SELECT 0 AS b, idx, key, op, value FROM BT WHERE idx % 2 = 0 UNION ALL SELECT 1, idx, key, op, value FROM BT WHERE idx % 2 = 1)
    SELECT key, op, value, CAST(100 + row_number() OVER (ORDER BY b, idx) AS BIGINT) AS seq FROM G""",
)
def group_commit_query(s, d):
    b = _batch(s, d)
    return group_commit([b.where("idx % 2 = 0"), b.where("idx % 2 = 1")], 100)


@query("merge_runs", f"WITH {EV} SELECT key, seq, op, value FROM EV")
def merge_runs(s, d):
    log = ev(s, d)
    return visibility.merge_runs(*[log.where(F.col("seq") % 4 == i) for i in range(4)])


# -- compaction -------------------------------------------------------------------
def _gc_sql(floor: str, base: str = "TRUE") -> str:
    return f"""SELECT key, seq, op, value FROM (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq DESC) AS newer FROM EV)
      WHERE (newer IS NULL OR newer > {floor}) AND NOT (op = 0 AND seq <= {floor} AND {base})"""


@query("gc_full", f"WITH {EV} {_gc_sql('(SELECT max(seq) FROM EV)')}")
def gc_full(s, d):
    log = ev(s, d)
    return compaction.gc(log, log.agg(F.max("seq")).first()[0])


@query("gc_with_snapshot", f"WITH {EV} {_gc_sql(str(S1))}")
def gc_with_snapshot(s, d):
    return compaction.gc(ev(s, d), S1)


@query("gc_preserves_state", f"WITH {EV} SELECT key, seq, value FROM (SELECT * FROM EV WHERE seq <= {S2} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 1")
def gc_preserves_state(s, d):
    return _out(visibility.visible(compaction.gc(ev(s, d), S1), S2))


@query("compaction_partial_keep_tombstone", f"WITH {EV} {_gc_sql(str(S2), '(key < $$user000040$$ OR key > $$user000080$$)').replace('$$', chr(39))}")
def compaction_partial_keep_tombstone(s, d):
    deeper = s.createDataFrame([("user000040", "user000060"), ("user000055", "user000080")], "smallest string, largest string")
    log = compaction.with_base_level(ev(s, d), deeper)
    return compaction.gc(log, S2, F.col("base_level")).select("key", "seq", "op", "value")


@query("level_stats", f"WITH {OR}, {FM} SELECT level, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM FM GROUP BY level")
def level_stats(s, d):
    return files.level_stats(file_table(s, d))


@query(
    "compaction_scores",
    f"WITH {OR}, {FM} SELECT level, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(bytes) / (1000.0::DOUBLE * pow(10.0::DOUBLE, level - 1)) AS DOUBLE) AS score FROM FM GROUP BY level",
)
def compaction_scores(s, d):
    return compaction.LevelPolicy(base_bytes=1000).scores(file_table(s, d))


_RANGES = [("0000000000", "0000000100"), ("0000000100", "0000001000"), ("0000000990", "9"), ("5", "4")]


@query(
    "approximate_sizes",
    f"WITH {OR}, {FM}, R AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _RANGES) + ") AS t(start, \"limit\")) SELECT start, \"limit\", CAST(coalesce((SELECT sum(size) FROM FMR WHERE key >= start AND key < \"limit\"), 0) AS BIGINT) AS bytes FROM R",
)
def approximate_sizes(s, d):
    return files.approximate_sizes(sized(s, d), _RANGES, F.col("size"))


@query(
    "approximate_offset",
    f"WITH {OR}, {FM} SELECT number, CAST(sum(bytes) OVER (ORDER BY smallest) - bytes AS BIGINT) AS start_offset FROM FM",
)
def approximate_offset(s, d):
    before = F.sum("bytes").over(Window.orderBy("smallest"))  # a row for each file
    return file_table(s, d).select("number", (before - F.col("bytes")).alias("start_offset"))


@query("file_overlap", f"WITH {OR}, {FM} SELECT number, level, smallest, largest FROM FM WHERE largest >= '0000000400' AND smallest <= '0000001100'")
def file_overlap(s, d):
    return files.overlapping(file_table(s, d), "0000000400", "0000001100").select("number", "level", "smallest", "largest")


@query("find_file", f"WITH {OR}, {FM} SELECT count(*) AS position FROM FM WHERE largest < '0000000777'")
def find_file(s, d):
    return files.find_file(file_table(s, d), "0000000777")


@query(
    "find_files",
    f"WITH {OR}, {FM}, K AS (SELECT lpad(CAST(c_custkey * 11 AS VARCHAR), 10, '0') AS key FROM customer) SELECT K.key, FM.number FROM K LEFT JOIN FM ON K.key BETWEEN FM.smallest AND FM.largest",
)
def find_files(s, d):
    keys = s.read.parquet(f"{d}/customer.parquet").select(F.lpad((F.col("c_custkey") * 11).cast("string"), 10, "0").alias("key"))
    return files.find_files(file_table(s, d), keys)


@query(
    "max_next_level_overlap",
    f"""WITH {OR}, {FM}, M AS (SELECT number, CASE WHEN number % 2 = 0 THEN 1 ELSE 2 END AS level, smallest, largest, bytes FROM FM),
    W AS (SELECT number, level, smallest, CASE WHEN level = 1 THEN lpad(CAST(CAST(largest AS BIGINT) + 300 AS VARCHAR), 10, '0') ELSE largest END AS largest, bytes FROM M)
    SELECT CAST(coalesce(max(s), 0) AS BIGINT) AS max_overlap FROM (SELECT a.number, sum(b.bytes) AS s FROM W a JOIN W b ON a.level = 1 AND b.level = 2 AND b.largest >= a.smallest AND b.smallest <= a.largest GROUP BY a.number)""",
)
def max_next_level_overlap(s, d):
    f = file_table(s, d).withColumn("level", F.when(F.col("number") % 2 == 0, 1).otherwise(2))
    wider = F.lpad((F.col("largest").cast("long") + 300).cast("string"), 10, "0")
    return files.next_level_overlap(f.withColumn("largest", F.when(F.col("level") == 1, wider).otherwise(F.col("largest"))))


@query("manifest_fold", f"WITH {OR}, {FM} SELECT number, level FROM FM WHERE number NOT IN (1, 3) UNION ALL SELECT number + 100, level + 1 FROM FM WHERE number IN (1, 3)")
def manifest_fold(s, d):
    """A version that adds all files and one that rewrites two of them a level deeper, folded."""
    made = [DataFile(str(r["number"]), r["level"], r["smallest"], r["largest"], r["bytes"], r["entries"], 1, r["max_seq"]) for r in file_table(s, d).collect()]
    moved = [f for f in made if f.path in ("1", "3")]
    edits = [Edit(added=made), Edit(removed=[f.path for f in moved], added=[replace(f, path=str(int(f.path) + 100), level=f.level + 1) for f in moved])]
    state = fold([Edit.from_json(e.to_json()) for e in edits])
    return s.createDataFrame([(int(f.path), f.level) for f in state.files.values()], "number int, level int")


# -- orders of keys -------------------------------------------------------------
@query(
    "custom_comparator_equality",
    "WITH L AS (SELECT c_custkey % 50 AS k, c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN '[0x' || lower(to_hex(c_custkey % 50)) || ']' ELSE '[' || CAST(c_custkey % 50 AS VARCHAR) || ']' END AS key FROM customer) SELECT key, seq, k FROM L QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1",
)
def custom_comparator_equality(s, d):
    n = F.col("c_custkey") % 50
    hexed = F.concat(F.lit("[0x"), F.lower(F.hex(n)), F.lit("]"))
    plain = F.concat(F.lit("["), n.cast("string"), F.lit("]"))
    log = s.read.parquet(f"{d}/customer.parquet").select(F.when(F.col("c_custkey") % 3 == 0, hexed).otherwise(plain).alias("key"), F.col("c_custkey").alias("seq"), F.lit(1).alias("op"))
    return visibility.newest(log, None, NUMERIC).select("key", "seq", NUMERIC.column(F.col("key")).alias("k"))


@query("reverse_comparator", f"WITH {OR} SELECT key, value FROM ORD WHERE reverse(key) >= '5'")
def reverse_comparator(s, d):
    text = KeyOrder("reversed-text", F.reverse, lambda k: k[::-1])
    return ordered.in_order(ordered.key_range(orders(s, d), "5", None, text), text).select("key", "value")


# -- functions --------------------------------------------------------------------
@query("mask_crc", "SELECT o_orderkey AS n, ((((o_orderkey >> 15) | (o_orderkey << 17)) & 4294967295) + 2726488792) & 4294967295 AS masked FROM orders")
def mask_crc(s, d):
    n = F.col("o_orderkey")
    return s.read.parquet(f"{d}/orders.parquet").select(n.alias("n"), codecs.mask_crc_column(n).alias("masked"))


@query("unmask_crc", "SELECT o_orderkey AS n, o_orderkey AS back FROM orders")
def unmask_crc(s, d):
    n = F.col("o_orderkey")
    return s.read.parquet(f"{d}/orders.parquet").select(n.alias("n"), codecs.unmask_crc_column(codecs.mask_crc_column(n)).alias("back"))


_POWERS = " ".join(f"WHEN n >= {1 << 7 * k} THEN {k + 1}" for k in range(8, 0, -1))


@query("varint_length", f"WITH N AS (SELECT DISTINCT CAST(o_orderkey * o_orderkey * (o_orderkey % 1000) AS BIGINT) AS n FROM orders) SELECT n, CAST(CASE {_POWERS} ELSE 1 END AS INT) AS bytes FROM N")
def varint_length(s, d):
    k = F.col("o_orderkey")
    n = s.read.parquet(f"{d}/orders.parquet").select((k * k * (k % 1000)).alias("n")).distinct()
    return n.select("n", codecs.varint_length(F.col("n")).alias("bytes"))


_VARINT = "CASE " + " ".join(
    f"WHEN n < {1 << 7 * k} THEN " + " || ".join(f"lpad(to_hex(n // {1 << 7 * i} % 128{' + 128' if i < k - 1 else ''}), 2, '0')" for i in range(k)) for k in range(1, 9)
) + " ELSE " + " || ".join(f"lpad(to_hex(n // {1 << 7 * i} % 128{' + 128' if i < 8 else ''}), 2, '0')" for i in range(9)) + " END"


@query("varint_codec", f"SELECT n, CAST(n AS BIGINT) AS back, upper({_VARINT}) AS encoded FROM (SELECT o_orderkey AS n FROM orders)")
def varint_codec(s, d):
    n = F.col("o_orderkey")
    df = s.read.parquet(f"{d}/orders.parquet").select(n.alias("n"), codecs.varint_column(n).alias("raw"))
    return df.select("n", codecs.read_varint_column()(F.col("raw")).cast("long").alias("back"), F.hex("raw").alias("encoded"))


@query("fixed_codec", "SELECT o_orderkey AS n, upper(lpad(to_hex(o_orderkey % 256), 2, '0') || lpad(to_hex(o_orderkey // 256 % 256), 2, '0') || lpad(to_hex(o_orderkey // 65536 % 256), 2, '0') || lpad(to_hex(o_orderkey // 16777216), 2, '0')) AS encoded, CAST(o_orderkey AS BIGINT) AS back FROM orders")
def fixed_codec(s, d):
    n = F.col("o_orderkey")
    df = s.read.parquet(f"{d}/orders.parquet").select(n.alias("n"), codecs.fixed32_column(n).alias("raw"))
    return df.select("n", F.hex("raw").alias("encoded"), codecs.read_fixed_column(F.col("raw")).alias("back"))


@query("internal_key", f"WITH {EV} SELECT key, seq, op, CAST(seq * 256 + op AS BIGINT) AS trailer FROM EV")
def internal_key(s, d):
    raw = ev(s, d).select(codecs.internal_key_column(F.col("key").cast("binary"), F.col("seq"), F.col("op")).alias("raw"), codecs.pack_trailer_column(F.col("seq"), F.col("op")).alias("trailer"))
    parts = raw.select(codecs.split_internal_key_column(F.col("raw")).alias("k"), "trailer")
    return parts.select(F.col("k.key").cast("string").alias("key"), "k.seq", "k.op", "trailer")


@query("consume_decimal", "SELECT p_partkey AS id, TRY_CAST(nullif(regexp_extract(CAST(p_partkey AS VARCHAR) || p_name, '^[0-9]+'), '') AS DECIMAL(20,0)) AS n FROM part")
def consume_decimal(s, d):
    text = F.concat(F.col("p_partkey").cast("string"), F.col("p_name"))
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), codecs.consume_decimal_column(text).alias("n"))


@query("number_to_string", "SELECT o_orderkey AS n, CAST(o_orderkey AS VARCHAR) AS text FROM orders")
def number_to_string(s, d):
    return s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("n"), F.col("o_orderkey").cast("string").alias("text"))


@query("escape_string", "SELECT o_orderkey AS n, '\\x00k\\' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '\\xc3\\xa9' AS text FROM orders")
def escape_string(s, d):
    raw = F.concat(F.lit(b"\x00k\\"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").cast("binary"), F.lit("é".encode()))
    return s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("n"), codecs.escape_column(raw).alias("text"))


#: The seeded hash of 10-byte keys: two words of four bytes, then two bytes (SQL of the rule in codecs.hash32).
_WORD = " + ".join("ascii(substr(key, {at} + %d, 1))::HUGEINT * %d" % (i, 1 << 8 * i) for i in range(4))
_MUL = f"::HUGEINT * {codecs.HASH_FACTOR} & {codecs.U32}::HUGEINT"
_HASH_SQL = f"""WITH {OR}, K AS (SELECT key, ({codecs.FILTER_SEED ^ (10 * codecs.HASH_FACTOR & codecs.U32)})::HUGEINT AS h FROM ORD),
  A AS (SELECT key, (h + {_WORD.format(at=1)}){_MUL} AS h FROM K), A2 AS (SELECT key, xor(h, h >> 16) AS h FROM A),
  B AS (SELECT key, (h + {_WORD.format(at=5)}){_MUL} AS h FROM A2), B2 AS (SELECT key, xor(h, h >> 16) AS h FROM B),
  C AS (SELECT key, (h + ascii(substr(key, 9, 1))::HUGEINT + ascii(substr(key, 10, 1))::HUGEINT * 256){_MUL} AS h FROM B2)
  SELECT key, CAST(xor(h, h >> {codecs.HASH_SHIFT}) AS BIGINT) AS hash FROM C"""


@query("hash32", _HASH_SQL)
def hash32(s, d):
    return orders(s, d).select("key", codecs.hash32_column()(F.col("key").cast("binary")).alias("hash"))


_CRC_BIT = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, {codecs.CASTAGNOLI} * (x & 1)))"


@query("crc32c", f"WITH {OR} SELECT key, CAST(xor(list_reduce(list_prepend({codecs.U32}::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {_CRC_BIT}), {codecs.U32}) AS BIGINT) AS crc FROM ORD")
def crc32c(s, d):
    return orders(s, d).select("key", codecs.crc32c_column(F.col("key").cast("binary")).alias("crc"))


_DIFF = "coalesce(list_position(list_transform(range(1, 11), lambda i: substr(key, i, 1) <> substr(next_key, i, 1)), TRUE), 0)"


@query(
    "short_separator",
    f"""WITH {OR}, N AS (SELECT key, lead(key) OVER (ORDER BY key) AS next_key FROM ORD), P AS (SELECT *, CAST({_DIFF} AS INT) AS n FROM N WHERE next_key IS NOT NULL)
    SELECT key, next_key, CASE WHEN n = 0 OR ascii(substr(key, n, 1)) + 1 >= ascii(substr(next_key, n, 1)) THEN key ELSE substr(key, 1, n - 1) || chr(ascii(substr(key, n, 1)) + 1) END AS separator FROM P""",
)
def short_separator(s, d):
    pairs = ordered.neighbours(orders(s, d).select("key"), 16).where("next_key is not null")
    return pairs.select("key", "next_key", codecs.short_separator_column(F.col("key").cast("binary"), F.col("next_key").cast("binary")).cast("string").alias("separator"))


@query("short_successor", f"WITH {OR} SELECT key, chr(ascii(substr(key, 1, 1)) + 1) AS successor FROM ORD")
def short_successor(s, d):
    return orders(s, d).select("key", codecs.short_successor_column(F.col("key").cast("binary")).cast("string").alias("successor"))


@query("bloom_no_false_negative", f"WITH {OR}, {FM} SELECT number, key, TRUE AS hit FROM FMR")
def bloom_no_false_negative(s, d):
    rows = sized(s, d).select("number", "key")
    return bloom.probe(rows, bloom.filters(rows, "number"))


@query("bloom_false_positives", "SELECT TRUE AS rare")
def bloom_false_positives(s, d):
    rows = sized(s, d).select("number", "key")
    misses = bloom.probe(rows.withColumn("key", F.concat("key", F.lit("x"))), bloom.filters(rows, "number"))
    return misses.agg((F.avg(F.col("hit").cast("int")) <= 0.02).alias("rare"))


_BUCKETS = " ".join(f"WHEN value < {x!r} THEN {i}" for i, x in enumerate(histogram.LIMITS[:-1]))
_LOWER = "CASE bucket WHEN 0 THEN 0.0::DOUBLE " + " ".join(f"WHEN {i + 1} THEN {x!r}::DOUBLE" for i, x in enumerate(histogram.LIMITS[:-1])) + " END"
_UPPER = "CASE bucket " + " ".join(f"WHEN {i} THEN {x!r}::DOUBLE" for i, x in enumerate(histogram.LIMITS)) + " END"


@query("latency_histogram", f"WITH B AS (SELECT CAST(CASE {_BUCKETS} ELSE {len(histogram.LIMITS) - 1} END AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1) SELECT bucket, {_LOWER} AS lower, {_UPPER} AS upper, n, CAST(n AS DOUBLE) / (SELECT sum(n) FROM B) AS share FROM B")
def latency_histogram(s, d):
    return histogram.histogram(s.read.parquet(f"{d}/events.parquet"), "value")


def _percentile_sql(p: float) -> str:
    return f"least(most, greatest(least, (SELECT lower + (upper - lower) * (total * {p} / 100 - (upto - n)) / n FROM Q WHERE upto >= total * {p} / 100 AND upto - n < total * {p} / 100))) AS p{p:g}"


@query(
    "latency_summary",
    f"""WITH B AS (SELECT CAST(CASE {_BUCKETS} ELSE {len(histogram.LIMITS) - 1} END AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1),
    Q AS (SELECT *, {_LOWER} AS lower, {_UPPER} AS upper, CAST(sum(n) OVER (ORDER BY bucket) AS DOUBLE) AS upto, CAST(sum(n) OVER () AS DOUBLE) AS total FROM B),
    S AS (SELECT count(value) AS n, avg(value) AS average, stddev_pop(value) AS deviation, min(value) AS least, max(value) AS most FROM events)
    SELECT n, round(average, 6) AS average, round(deviation, 6) AS deviation, least, most, {", ".join(_percentile_sql(p) for p in (50.0, 90.0, 99.0))} FROM S""",
)
def latency_summary(s, d):
    got = histogram.summary(s.read.parquet(f"{d}/events.parquet"), "value")
    return got.withColumns({c: F.round(c, 6) for c in ("average", "deviation")})


@query("dump_entries", f"WITH {EV} SELECT CASE WHEN op = 0 THEN '''' || key || ''' @ ' || CAST(seq AS VARCHAR) || ' : del' ELSE '''' || key || ''' @ ' || CAST(seq AS VARCHAR) || ' : put => ''v' || CAST(seq AS VARCHAR) || '''' END AS line FROM EV")
def dump_entries(s, d):
    return dump_log(ev(s, d).withColumn("value", F.concat(F.lit("v"), F.col("seq").cast("string"))))


@query("debug_keys", f"WITH {EV} SELECT '''' || key || ''' @ ' || CAST(seq AS VARCHAR) || ' : ' || CAST(op AS VARCHAR) AS text FROM EV")
def debug_keys(s, d):
    return ev(s, d).select(codecs.debug_column(F.col("key"), F.col("seq"), F.col("op")).alias("text"))


# -- tables -----------------------------------------------------------------------
def _fresh(s: SparkSession) -> str:
    return f"{scratch(s)}/table-{uuid.uuid4().hex}"


def _loaded(s: SparkSession, d: str, parts: int = 2, stop: int | None = None):
    """The event log written to a new table in batches by arrival; with ``stop``, so many of them, and the next one unwritten."""
    table = VersionedTable.open(s, _fresh(s), Options(create_if_missing=True))
    log = ev(s, d).select(F.col("seq").alias("idx"), F.col("key").cast("binary").alias("key"), "op", F.when(F.col("op") == 1, F.col("seq").cast("string").cast("binary")).alias("value"))
    top = log.agg(F.max("idx")).first()[0]
    for i in range(parts):
        own = log.where((F.col("idx") > top * i // parts) & (F.col("idx") <= top * (i + 1) // parts))
        if i == stop:
            return table, own
        table.write_frame(own)
    return table


def _text(state: DataFrame) -> DataFrame:
    return state.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").cast("long").alias("seq"))


@query("table_write_scan", f"WITH {EV}, {NEW} SELECT key, seq FROM VIS")
def table_write_scan(s, d):
    return _text(_loaded(s, d).scan())


@query("table_compact_scan", f"WITH {EV}, {NEW} SELECT key, seq FROM VIS WHERE key >= 'user000010' AND key < 'user000060'")
def table_compact_scan(s, d):
    table = _loaded(s, d)
    table.compact_range()
    return _text(table.scan(b"user000010", b"user000060"))


@query("table_snapshot_scan", f"WITH {EV} SELECT key, seq FROM (SELECT * FROM EV WHERE seq <= {S1} // 10 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 1")
def table_snapshot_scan(s, d):
    table = _loaded(s, d)
    return _text(table.scan(snapshot=S1 // 10))


@query("table_repair_scan", f"WITH {EV}, {NEW} SELECT key, seq FROM VIS")
def table_repair_scan(s, d):
    table = _loaded(s, d)
    table.close()
    table.storage.delete("manifest")
    repair(s, table.path)
    return _text(VersionedTable.open(s, table.path).scan())


@query("repair_metadata", f"WITH {EV} SELECT count(*) AS entries, CAST(min(key) AS VARCHAR) AS smallest, CAST(max(key) AS VARCHAR) AS largest, CAST(max(seq) AS BIGINT) AS max_seq FROM EV")
def repair_metadata(s, d):
    """What repair finds out about the files, after the manifest is gone."""
    table = _loaded(s, d)
    table.close()
    table.storage.delete("manifest")
    repair(s, table.path)
    found = list(VersionedTable.open(s, table.path).state().files.values())
    rows = s.createDataFrame([(f.entries, f.smallest.decode(), f.largest.decode(), f.max_seq) for f in found], "entries long, smallest string, largest string, max_seq long")
    return rows.agg(F.sum("entries").alias("entries"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.max("max_seq").alias("max_seq"))


@query("table_snapshots", f"WITH {EV}, {NEW}, H AS (SELECT max(seq) // 2 AS half FROM EV) SELECT 'old' AS snapshot, key, seq FROM (SELECT * FROM EV WHERE seq <= (SELECT half FROM H) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 1 UNION ALL SELECT 'new', key, seq FROM VIS")
def table_snapshots(s, d):
    """A snapshot taken between two batches, read after the table was compacted; another one released."""
    table, rest = _loaded(s, d, 2, stop=1)
    old, gone = table.snapshot(), table.snapshot()
    table.release(gone)
    table.write_frame(rest)
    table.compact_range()
    return _text(table.scan(snapshot=old)).withColumn("snapshot", F.lit("old")).unionByName(_text(table.scan()).withColumn("snapshot", F.lit("new")))


@query("table_recovery", f"WITH {EV} SELECT key, CAST(max(seq) AS BIGINT) AS seq FROM EV WHERE op = 1 GROUP BY key")
def table_recovery(s, d):
    """The newest put of each key by single writes, read by a handle that was opened after the first was lost."""
    table = VersionedTable.open(s, _fresh(s), Options(create_if_missing=True))
    batch = WriteBatch()
    for r in ev(s, d).where("op = 1").groupBy("key").agg(F.max("seq").alias("seq")).orderBy("key").collect():  # a row for each user
        batch.put(r["key"].encode(), str(r["seq"]).encode())
    table.write(batch, sync=True)
    path = table.path
    del table
    return _text(VersionedTable.open(s, path).scan())


@query(
    "key_offsets",
    f"WITH {OR}, {FM}, K AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}')" for k in ("0000000100", "0000000990", "5", "9")) + ") AS t(key)) SELECT K.key, CAST(coalesce((SELECT sum(size) FROM FMR WHERE FMR.key < K.key), 0) AS BIGINT) AS start_offset FROM K",
)
def key_offsets(s, d):
    """The bytes before each of some keys."""
    return files.approximate_sizes(sized(s, d), [("", k) for k in ("0000000100", "0000000990", "5", "9")], F.col("size")).select(F.col("limit").alias("key"), F.col("bytes").alias("start_offset"))


@query("reversed_bytes_scan", f"WITH {OR} SELECT key, value FROM ORD WHERE reverse(key) >= '70' AND reverse(key) < '72'")
def reversed_bytes_scan(s, d):
    rows = orders(s, d).withColumn("key", F.col("key").cast("binary"))
    return ordered.key_range(rows, b"07", b"27", REVERSED_BYTES).select(F.col("key").cast("string").alias("key"), "value")
