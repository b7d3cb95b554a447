"""A versioned key-value table: immutable Parquet runs under a manifest of atomic commits."""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
import weakref
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import CorruptionError, InvalidArgumentError, NotFoundError, StorageError
from tidemark.operators.batch import WriteBatch, sequence
from tidemark.operators.cursor import PAGE, Cursor
from tidemark.plans import compaction, files, ordered, visibility
from tidemark.schema import LOG_SCHEMA, N_LEVELS, PUT, KeyOrder, Options
from tidemark.sources.manifest import DataFile, Edit, Manifest, State
from tidemark.sources.storage import Storage
from tidemark.sources.wal import read_logs, read_records, write_records

DATA, LOST, LOCK, LOG = "data", "lost", "LOCK", "log"
#: Seconds after which a lock of another host that nobody renews is free.
LEASE = 3600
#: Times the greatest file that a flushed run may meet of the level after next (fixed value).
MEETS = 10
#: Handles of this process by the token in their lock.
_HANDLES: weakref.WeakValueDictionary[str, VersionedTable] = weakref.WeakValueDictionary()


def _began(pid: int) -> str | None:
    """When a process of this host began, so that a number used again isn't taken for it; None if there's none."""
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return None
    except PermissionError:
        pass
    try:
        with open(f"/proc/{pid}/stat") as f:
            return f.read().rpartition(")")[2].split()[19]
    except OSError:
        return ""


def _is_free(raw: bytes) -> bool:
    """Whether a lock's owner is gone: a handle lost in this process, a dead process of this host, or a lease that ran out."""
    try:
        owner = json.loads(raw)
        host, pid, began, token, until = (owner[k] for k in ("host", "pid", "began", "token", "until"))
    except (ValueError, KeyError, TypeError):
        return False
    if host != socket.gethostname():
        return until < time.time()
    if pid == os.getpid() and began == _began(pid):
        return token not in _HANDLES
    return _began(pid) != began


def _take_lock(storage: Storage) -> str:
    token = uuid.uuid4().hex
    for _ in range(3):
        if storage.create(LOCK, _lock(token)):
            return token
        try:
            old = storage.read(LOCK)
        except NotFoundError:
            continue
        if not _is_free(old):
            break
        storage.delete(LOCK)
    raise StorageError(storage.url(), "lock is held by another handle")


def _lock(token: str) -> bytes:
    return json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "began": _began(os.getpid()), "token": token, "until": time.time() + LEASE}).encode()


@dataclass(frozen=True)
class Snapshot:
    """A state that stays readable until it is released."""

    id: str
    seq: int


class VersionedTable:
    """Open with :meth:`open`. Reads are DataFrames over a fixed list of files and what is pending.

    A write stands in the log before it is answered, and so survives a crash of
    the process; with ``sync`` also one of the machine. Pending writes become a
    run when they fill the buffer.
    """

    def __init__(self, spark: SparkSession, path: str, options: Options, state: State, token: str = ""):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self.order: KeyOrder = options.key_order
        self.storage, self._closed = Storage(spark, path), False
        self.manifest = Manifest(self.storage)
        self._pinned: dict[str, frozenset[str]] = {}
        self._version = state.version
        self._pending: list[tuple[int, bytes, bytes | None]] = []
        self._pending_bytes, self._last = 0, state.last_seq
        self._token, self._until = token, time.time() + LEASE
        self._log_name, self._log_bytes = "", 0
        #: Level -> seconds, bytes read and bytes written by compactions into it.
        self._work: dict[int, list[float]] = {}
        if token:
            _HANDLES[token] = self

    # -- life -------------------------------------------------------------------
    @staticmethod
    def open(spark: SparkSession, path: str, options: Options | None = None) -> VersionedTable:
        options = (options or Options()).sanitised()
        storage = Storage(spark, path)
        manifest = Manifest(storage)
        there = bool(manifest.versions()) if storage.exists() else False
        if not there and not options.create_if_missing:
            raise InvalidArgumentError(path, "does not exist (create_if_missing is false)")
        if there and options.error_if_exists:
            raise InvalidArgumentError(path, "exists (error_if_exists is true)")
        storage.make()
        token = _take_lock(storage)
        try:
            name = options.key_order.name
            if not there:
                manifest.commit(lambda s: Edit(key_order=name, last_seq=0) if s.version == 0 else None)
            state = manifest.read()
            if state.key_order != name:
                raise InvalidArgumentError(state.key_order, f"key order does not match {name}")
            missing = [p for p in state.files if not storage.exists(p)]
            if missing:
                raise CorruptionError(f"{len(missing)} missing files", missing[0])
            table = VersionedTable(spark, path, options, state, token)
            if options.paranoid_checks:
                table.verify()
            table._recover(state)
            return table
        except BaseException:
            storage.delete(LOCK)
            raise

    def close(self) -> None:
        """Writes what is pending and gives the lock back. Snapshots stay in the manifest."""
        if not self._closed:
            self.flush()
            self._closed = True
            if self._owns_lock():
                self.storage.delete(LOCK)

    def __enter__(self) -> VersionedTable:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @staticmethod
    def destroy(spark: SparkSession, path: str) -> None:
        """Deletes a table's own files; others stay. A missing folder is fine, a locked table isn't."""
        storage = Storage(spark, path)
        if not storage.exists():
            return
        if storage.exists(LOCK):
            _take_lock(storage)
        for name in (DATA, LOST, LOG, "manifest", LOCK):
            storage.delete(name)
        if not storage.names():
            storage.delete("")

    def _open(self) -> None:
        if self._closed:
            raise StorageError(self.path, "table is closed")

    def state(self) -> State:
        self._open()
        return self.manifest.read()

    def _owns_lock(self) -> bool:
        try:
            return json.loads(self.storage.read(LOCK)).get("token") == self._token
        except (NotFoundError, ValueError):
            return False

    def _hold(self) -> None:
        """Before a commit: the lock is still ours, and is renewed in time."""
        if not self._owns_lock():
            raise StorageError(self.path, "lock was taken by another handle")
        if time.time() > self._until - LEASE / 2:
            self.storage.write(LOCK, _lock(self._token))
            self._until = time.time() + LEASE

    # -- the log ------------------------------------------------------------------
    def _recover(self, state: State) -> None:
        """Takes back what the log holds beyond the manifest; a record cut off by a crash was never answered."""
        for name, _ in self.storage.files(LOG):
            if not name.endswith(".log"):
                continue
            for record, _ in read_records(self.storage.read(f"{LOG}/{name}")):
                if record is None:
                    continue
                seq, batch, _ = WriteBatch.decode(record, strict=False)
                new = batch.ops[max(0, self._last + 1 - seq) :]
                if new and seq > self._last + 1:
                    raise CorruptionError("log", f"writes {self._last + 1} to {seq - 1} are missing; repair takes the rest")
                self._keep(new)

    def _keep(self, ops: list[tuple[int, bytes, bytes | None]]) -> None:
        self._pending.extend(ops)
        self._pending_bytes += sum(len(k) + len(v or b"") + 16 for _, k, v in ops)
        self._last += len(ops)

    def _log(self, batch: WriteBatch, sync: bool) -> None:
        """Adds a batch to the log: to one growing file where files can grow, else in a file of its own."""
        first = self._last + 1
        raw = batch.encode(first)
        if not self._log_name:
            self.storage.make(LOG)
            self._log_name, self._log_bytes = f"{LOG}/{first:020d}-{uuid.uuid4().hex[:8]}.log", 0
        data = write_records([raw], self._log_bytes)
        if self.storage.append(self._log_name, data, sync):
            self._log_bytes += len(data)
        else:
            self.storage.create(f"{LOG}/{first:020d}-{uuid.uuid4().hex[:8]}.log", write_records([raw]))

    # -- writing ----------------------------------------------------------------
    def put(self, key: bytes, value: bytes) -> int:
        return self.write(WriteBatch().put(key, value))

    def delete(self, key: bytes) -> int:
        return self.write(WriteBatch().delete(key))

    def write(self, batch: WriteBatch | None, sync: bool = False) -> int:
        """Applies a batch atomically and returns the last sequence number; None writes out what is pending.

        The batch stands in the log first, on the disk with ``sync``. Small batches
        wait in memory, in order, and become one run when they reach the buffer's size.
        """
        self._open()
        if batch is not None and batch.ops:
            self._hold()
            self._log(batch, sync)
            self._keep(list(batch.ops))
        if batch is None or self._pending_bytes >= self.options.write_buffer_size:
            self.flush()
        return self.last_seq()

    def last_seq(self) -> int:
        self._open()
        return self._last

    def flush(self) -> None:
        """Commits pending batches as one run, then drops their log."""
        if self._pending:
            batch = WriteBatch(self._pending)
            self._commit_rows(lambda last: batch.to_log(self.spark, last), len(self._pending))
            self._pending, self._pending_bytes, self._log_name = [], 0, ""
            self.storage.delete(LOG)
            if self.options.auto_compact:
                self.compact_due()

    def write_frame(self, rows: DataFrame) -> int:
        """Applies a DataFrame (idx, key, op, value) of any size as one atomic batch, in the order of idx."""
        self._open()
        self.flush()
        n = rows.count()
        if n:
            self._commit_rows(lambda last: sequence(rows, last), n)
            if self.options.auto_compact:
                self.compact_due()
        return self.last_seq()

    def _commit_rows(self, make, n: int) -> None:
        """Writes ``n`` rows after the newest number and commits them; numbers anew if another writer came first."""
        for _ in range(100):
            base = self.manifest.read()
            added = self._write_run(make(base.last_seq), 0)
            for f, level in zip(added, self._levels_for(added, base), strict=True):
                f.level = level
            self._hold()
            done = []

            def edit(s: State, base=base, added=added, done=done) -> Edit | None:
                if s.version != base.version and s.last_seq != base.last_seq:
                    return None
                done.append(True)
                return Edit(added=added, last_seq=base.last_seq + n)

            self.manifest.commit(edit)
            if done:
                self._last = base.last_seq + n
                return
            for f in added:
                self.storage.delete(f.path)
        raise StorageError(self.path, "too many writers")

    def _levels_for(self, added: list[DataFile], state: State) -> list[int]:
        """The level of each new file: as deep as ``flush_level`` lets it where it meets nothing on the way.

        It stays above a level of which it would meet too much when compacted further.
        """
        out = []
        for f in added:
            meets = lambda n: [g for g in state.levels().get(n, []) if g.smallest <= f.largest and f.smallest <= g.largest]  # noqa: B023, E731
            level = 0
            while level < self.options.flush_level and not meets(level) and not meets(level + 1):
                if sum(g.bytes for g in meets(level + 2)) > MEETS * self.options.max_file_size:
                    break
                level += 1
            out.append(level)
        return out

    def _write_run(self, log: DataFrame, level: int, parts: int | None = None, single: bool = False) -> list[DataFile]:
        """Writes log rows as Parquet files in key order and describes each file."""
        name = f"{DATA}/{uuid.uuid4().hex}"
        key = self.order.column(F.col("key"))
        rows = log.select("key", "seq", "op", "value", key.alias("sort_key"))
        # A key's versions share a range, so they stay in one file.
        rows = rows.repartitionByRange("sort_key") if parts is None else rows.repartitionByRange(max(1, parts), "sort_key")
        writer = rows.sortWithinPartitions("sort_key", F.desc("seq")).write
        codec = "uncompressed" if self.options.compression == "none" else self.options.compression
        writer = writer.option("compression", codec).option("parquet.page.size", self.options.block_size)
        if self.options.bloom_filter:
            writer = writer.option("parquet.bloom.filter.enabled#sort_key", "true")
        writer.parquet(self.storage.url(name))
        return self._describe(name, level, single)

    def _describe(self, folder: str, level: int, single: bool = False) -> list[DataFile]:
        """One DataFile for each file of a folder: bounds and counts from one pass over keys and numbers."""
        sizes = dict(self.storage.files(folder))
        if not any(n.endswith(".parquet") for n in sizes):
            return []
        df = self.spark.read.parquet(self.storage.url(folder))
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        got = df.groupBy(name.alias("name")).agg(F.min("sort_key").alias("lo"), F.max("sort_key").alias("hi"), F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last")).collect()
        plain = lambda x: bytes(x) if isinstance(x, (bytes, bytearray)) else x
        return [DataFile(f"{folder}/{r['name']}", level, plain(r["lo"]), plain(r["hi"]), sizes[r["name"]], r["n"], r["first"], r["last"], single) for r in sorted(got, key=lambda r: r["name"])]

    # -- snapshots --------------------------------------------------------------
    def snapshot(self) -> Snapshot:
        self.flush()
        name = uuid.uuid4().hex
        s = self.manifest.commit(lambda s: Edit(take={name: s.last_seq}))
        return Snapshot(name, s.snapshots[name])

    def release(self, snapshot: Snapshot) -> None:
        self._open()
        self.manifest.commit(lambda s: Edit(release=[snapshot.id]) if snapshot.id in s.snapshots else None)

    # -- reading ----------------------------------------------------------------
    def _files(self, files_: list[DataFile]) -> DataFrame:
        """Log rows of some files."""
        paths = [self.storage.url(f.path) for f in files_]
        if not paths:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(*paths)

    def _read(self, state: State, keep=lambda f: True) -> DataFrame:
        """Log rows of the state's files that ``keep`` wants, and what is pending; files are pruned by their bounds here."""
        rows = self._files([f for f in state.files.values() if keep(f)])
        return rows.unionByName(WriteBatch(self._pending).to_log(self.spark, state.last_seq)) if self._pending else rows

    def _visible(self, state: State, seq: int, keep=lambda f: True, narrow=lambda rows: rows) -> DataFrame:
        """The state as of ``seq`` of the rows that ``narrow`` leaves.

        A file of single keys whose range meets no other's needs no newest-wins: its
        rows are read where they are, without a shuffle. All others go together.
        """
        images = [self.order.value(k) for _, k, _ in self._pending]
        alone, others = files.apart([f for f in state.files.values() if keep(f)], (min(images), max(images)) if images else None)
        plain = [f for f in alone if f.single]
        others += [f for f in alone if not f.single]
        out = [visibility.as_of(narrow(self._files(plain)), seq).where(F.col("op") == PUT)] if plain else []
        if others or images or not plain:
            rows = self._files(others)
            rows = rows.unionByName(WriteBatch(self._pending).to_log(self.spark, state.last_seq)) if images else rows
            out.append(visibility.visible(narrow(rows), seq, self.order))
        return out[0] if len(out) == 1 else out[0].unionByName(out[1])

    def _at(self, snapshot: Snapshot | int | None) -> tuple[State, int]:
        state = self.state()
        seq = self._last if snapshot is None else snapshot if isinstance(snapshot, int) else snapshot.seq
        if isinstance(snapshot, Snapshot) and snapshot.id not in state.snapshots:
            raise InvalidArgumentError("snapshot was released")
        if seq < state.floor:
            raise InvalidArgumentError(f"state {seq}", f"compacted away; the oldest is {state.floor}")
        return state, seq

    def log(self) -> DataFrame:
        """All rows that the files hold."""
        return self._read(self._at(None)[0])

    def get(self, key: bytes, snapshot: Snapshot | int | None = None) -> bytes:
        state, seq = self._at(snapshot)
        k = self.order.value(key)
        rows = self._read(state, lambda f: f.smallest <= k <= f.largest and f.min_seq <= seq)
        found = visibility.point_get(rows, key, seq, self.order).select("value").collect()
        if not found:
            raise NotFoundError(str(key))
        return bytes(found[0][0])

    def multi_get(self, keys: DataFrame, snapshot: Snapshot | int | None = None) -> DataFrame:
        state, seq = self._at(snapshot)
        wanted = keys.select(self.order.column(F.col("key")).alias("__wanted")).distinct()
        narrow = lambda rows: rows.join(wanted, self.order.column(F.col("key")) == F.col("__wanted"), "left_semi")
        return self._visible(state, seq, narrow=narrow).select("key", "value")

    def scan(self, start: bytes | None = None, limit: bytes | None = None, snapshot: Snapshot | int | None = None) -> DataFrame:
        """(key, value) of the state with start <= key < limit, not sorted."""
        state, seq = self._at(snapshot)
        lo = None if start is None else self.order.value(start)
        hi = None if limit is None else self.order.value(limit)
        meets = lambda f: (lo is None or f.largest >= lo) and (hi is None or f.smallest < hi)
        return self._visible(state, seq, meets, lambda rows: ordered.key_range(rows, start, limit, self.order)).select("key", "value")

    def cursor(self, snapshot: Snapshot | int | None = None, page: int = PAGE) -> Cursor:
        """A cursor over the state of now. Its files stay until it is closed, whatever is written or compacted."""
        state, seq = self._at(snapshot)
        name = uuid.uuid4().hex
        self._pinned[name] = frozenset(state.files)
        return Cursor(self._visible(state, seq), self.order, page, lambda: self._pinned.pop(name, None))

    def versions(self, key: bytes) -> list[tuple[int, int, bytes | None]]:
        """(seq, op, value) of a key, newest first, from all files."""
        k = self.order.value(key)
        rows = self._read(self._at(None)[0], lambda f: f.smallest <= k <= f.largest)
        mine = rows.where(self.order.column(F.col("key")) == F.lit(k)).orderBy(F.desc("seq")).collect()
        return [(r["seq"], r["op"], None if r["value"] is None else bytes(r["value"])) for r in mine]

    # -- facts ------------------------------------------------------------------
    def files(self) -> DataFrame:
        """(number, level, smallest, largest, bytes, entries, path) of the current files."""
        rows = [(i, f.level, f.smallest, f.largest, f.bytes, f.entries, f.path) for i, f in enumerate(self._at(None)[0].files.values())]
        kind = "bigint" if rows and isinstance(rows[0][2], int) else "binary"
        return self.spark.createDataFrame(rows, f"number bigint, level int, smallest {kind}, largest {kind}, bytes bigint, entries bigint, path string")

    def property(self, name: str) -> str | None:
        """``num-files-at-level<N>``, ``stats``, ``sstables`` or ``approximate-memory-usage``; None for others."""
        levels = self.state().levels()
        if name.startswith("num-files-at-level"):
            digits = name.removeprefix("num-files-at-level")
            return str(len(levels.get(int(digits), []))) if digits.isdigit() and int(digits) < N_LEVELS else None
        if name == "stats":
            rows = []
            for n in sorted({*levels, *self._work}):
                seconds, read, written = self._work.get(n, (0.0, 0, 0))
                rows.append(f"{n:5d} {len(levels.get(n, [])):8d} {sum(f.bytes for f in levels.get(n, [])) / 1048576:8.2f} {seconds:9.3f} {read / 1048576:8.2f} {written / 1048576:9.2f}")
            return "\n".join(["Level    Files Size(MB) Time(sec) Read(MB) Write(MB)", *rows])
        if name == "sstables":
            return "\n".join(line for n in range(N_LEVELS) for line in [f"--- level {n} ---", *[f"{f.path}: {f.bytes} [{f.smallest!r} .. {f.largest!r}]" for f in levels.get(n, [])]])
        return str(self._pending_bytes) if name == "approximate-memory-usage" else None

    def approximate_sizes(self, ranges: list[tuple[bytes, bytes]]) -> list[int]:
        """File bytes of each [start, limit). Pending writes don't count."""
        offsets = self._offsets([self.order.value(k) for r in ranges for k in r])
        return [max(0, b - a) for a, b in zip(offsets[::2], offsets[1::2], strict=True)]

    def approximate_offset(self, key: bytes) -> int:
        """File bytes before a key."""
        return self._offsets([self.order.value(key)])[0]

    def _offsets(self, images: list[object]) -> list[int]:
        """File bytes before each key: files that end before it, and of those that hold it a part by rows; one job for all keys."""
        state = self.state()
        out = [sum(f.bytes for f in state.files.values() if f.largest < k) for k in images]
        edge = {f.path: f for k in images for f in state.files.values() if f.smallest < k <= f.largest}
        if edge:
            by_name = {p.rsplit("/", 1)[-1]: f for p, f in edge.items()}
            rows = self._files(list(edge.values())).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), self.order.column(F.col("key")).alias("k"))
            counted = rows.groupBy("name").agg(*[F.count_if(F.col("k") < F.lit(k)).alias(f"n{i}") for i, k in enumerate(images)]).collect()
            for r in counted:
                f = by_name[r["name"]]
                for i, k in enumerate(images):
                    if f.smallest < k <= f.largest:
                        out[i] += f.bytes * r[f"n{i}"] // f.entries
        return out

    def verify(self) -> None:
        """Reads every file; raises at damage: unreadable files, rows out of bounds, numbers used twice or above the last."""
        state = self.state()
        try:
            rows = self._files(list(state.files.values()))
            key = self.order.column(F.col("key"))
            n, top = rows.agg(F.count(F.hash("key", "seq", "op", "value")), F.max("seq")).first()
            twice = rows.groupBy(key, "seq").count().where("count > 1").limit(1).count()
        except CorruptionError:
            raise
        except Exception as e:
            raise CorruptionError("unreadable data", str(e).splitlines()[0]) from e
        if n != sum(f.entries for f in state.files.values()):
            raise CorruptionError("rows are missing", str(n))
        if twice or (top or 0) > state.last_seq:
            raise CorruptionError("sequence numbers")

    # -- compaction -------------------------------------------------------------
    def _compact(self, inputs: list[DataFile], target: int, state: State) -> State:
        """Merges files into ``target`` and drops what no snapshot sees. Reads the floor in the commit that it holds for."""
        deeper = [f for f in state.files.values() if f.level > target]
        floor, began = state.oldest(), time.time()
        rows = self._files(inputs)
        base: object = True
        if deeper:
            kind = "bigint" if isinstance(deeper[0].smallest, int) else "binary"
            meta = self.spark.createDataFrame([(f.smallest, f.largest) for f in deeper], f"smallest {kind}, largest {kind}")
            rows = compaction.with_base_level(rows, meta, self.order)
            base = F.col("base_level")
        kept = compaction.gc(rows, floor, base, self.order).select("key", "seq", "op", "value")
        size = sum(f.bytes for f in inputs)
        # At or below the floor, compaction leaves a key's newest row only.
        single = floor >= max(f.max_seq for f in inputs)
        added = [f for f in self._write_run(kept, target, max(1, round(size / self.options.max_file_size)), single) if f.entries]
        self._hold()
        gone = [f.path for f in inputs]

        def edit(s: State) -> Edit | None:
            if any(p not in s.files for p in gone) or s.oldest() < floor:
                return None
            return Edit(added=added, removed=gone, floor=max(s.floor, floor))

        after = self.manifest.commit(edit)
        if gone and gone[0] in after.files:
            for f in added:
                self.storage.delete(f.path)
            raise StorageError(self.path, "another writer changed the files; compact again")
        work = self._work.get(target, (0.0, 0, 0))
        self._work[target] = [work[0] + time.time() - began, work[1] + size, work[2] + sum(f.bytes for f in added)]
        self.vacuum()
        return after

    def compact_range(self, begin: bytes | None = None, end: bytes | None = None) -> None:
        """Flushes, then compacts [begin, end] (None: no bound) down through each level that has files of it."""
        self.flush()
        lo = None if begin is None else self.order.value(begin)
        hi = None if end is None else self.order.value(end)
        state = self.state()
        deepest = max([f.level for f in state.files.values() if (lo is None or f.largest >= lo) and (hi is None or f.smallest <= hi)], default=0)
        for level in range(max(1, deepest)):
            self.compact_level(level, lo, hi)

    def compact_level(self, level: int, lo: object | None = None, hi: object | None = None) -> bool:
        """Files of ``level`` that meet [lo, hi], with all of the next level that they meet, into the next level."""
        self.flush()
        if not 0 <= level < N_LEVELS - 1:
            raise InvalidArgumentError("level", str(level))
        state = self.state()
        as_rows = lambda n: [{"smallest": f.smallest, "largest": f.largest, "file": f} for f in state.levels().get(n, [])]
        mine = files.closure(as_rows(level), lo, hi, grow=True)
        if not mine:
            return False
        low, high = min(f["smallest"] for f in mine), max(f["largest"] for f in mine)
        below = files.closure(as_rows(level + 1), low, high, grow=True)
        self._compact([f["file"] for f in mine + below], level + 1, state)
        return True

    def move_down(self, path: str) -> bool:
        """Moves a file one level down without rewriting it, where it meets nothing on either level."""
        done = []

        def edit(s: State) -> Edit | None:
            f = s.files[path]
            others = [g for g in s.files.values() if g is not f and g.level in (f.level, f.level + 1)]
            if f.level + 1 >= N_LEVELS or any(g.smallest <= f.largest and f.smallest <= g.largest for g in others):
                return None
            done.append(True)
            return Edit(moved={path: f.level + 1})

        self.manifest.commit(edit)
        return bool(done)

    def maybe_compact(self, policy: compaction.LevelPolicy | None = None) -> int | None:
        """Compacts the level that is most overdue; its number, or None if none is. A file that meets no other is moved."""
        policy = policy or compaction.LevelPolicy(level0_files=self.options.level0_trigger)
        levels = self.state().levels()
        level = policy.pick([(n, len(fs), sum(f.bytes for f in fs)) for n, fs in levels.items()])
        if level is not None and not (len(levels[level]) == 1 and self.move_down(levels[level][0].path)):
            self.compact_level(level)
        return level

    def compact_due(self) -> list[int]:
        """Compacts until no level is overdue; the levels, in order."""
        out = []
        while (level := self.maybe_compact()) is not None:
            out.append(level)
        return out

    def vacuum(self) -> list[str]:
        """Deletes data files that neither the newest state nor an open cursor needs."""
        live = set(self.state().files) | {p for s in self._pinned.values() for p in s}
        gone = []
        for folder in self.storage.names(DATA):
            own = [f"{DATA}/{folder}/{n}" for n, _ in self.storage.files(f"{DATA}/{folder}") if n.endswith(".parquet")]
            dead = [p for p in own if p not in live]
            if len(dead) == len(own):
                self.storage.delete(f"{DATA}/{folder}")
            else:
                for p in dead:
                    self.storage.delete(p)
            gone += dead
        return gone


def merge_tables(*tables: VersionedTable) -> DataFrame:
    """The rows of several tables as one bag in key order."""
    return visibility.merge_runs(*[t.log() for t in tables])


def _described(spark: SparkSession, urls: list[str]) -> dict[str, tuple]:
    """File name -> bounds, rows read whole, numbers. Raises if any can't be read."""
    df = spark.read.parquet(*urls)
    if not {"key", "seq", "op", "value", "sort_key"} <= set(df.columns):
        raise CorruptionError("columns are missing")
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    plain = lambda x: bytes(x) if isinstance(x, (bytes, bytearray)) else x
    got = df.groupBy(name.alias("name")).agg(F.min("sort_key"), F.max("sort_key"), F.count(F.hash("key", "seq", "op", "value")), F.min("seq"), F.max("seq"))
    return {r[0]: (plain(r[1]), plain(r[2]), *r[3:]) for r in got.collect()}


def repair(spark: SparkSession, path: str, options: Options | None = None) -> dict[str, int]:
    """Makes a new state from the data files and logs that can be read; damaged files go to ``lost``.

    Newest-wins goes by sequence number, so all files may stand on level 0. Where
    the manifest can be read it tells which files were committed, the floor and
    the snapshots; else no state below the newest surviving one is promised, and
    of runs that number different rows alike, the later written go to ``lost``.
    The old manifest goes after the new state is there.
    """
    options = (options or Options()).sanitised()
    storage = Storage(spark, path)
    if not storage.exists():
        raise NotFoundError(path)
    storage.delete(LOCK)
    manifest = Manifest(storage)
    try:
        old: State | None = manifest.read()
    except (CorruptionError, NotFoundError):
        old = None
    lost = 0

    def lose(file: str) -> None:
        nonlocal lost
        storage.make(LOST)
        storage.rename(file, f"{LOST}/{file.removeprefix(DATA + '/').replace('/', '-')}")
        lost += 1

    every = [f"{DATA}/{folder}/{name}" for folder in storage.names(DATA) for name, _ in storage.files(f"{DATA}/{folder}") if name.endswith(".parquet")]
    if old is not None:
        for file in [f for f in every if f not in old.files]:
            lose(file)
        every = [f for f in every if f in old.files]
    # All files in one job; one by one only where some can't be read.
    facts: dict[str, tuple] = {}
    try:
        named = _described(spark, [storage.url(f) for f in every]) if every else {}
        facts = {f: named[f.rsplit("/", 1)[-1]] for f in every if f.rsplit("/", 1)[-1] in named}
    except Exception:
        for file in every:
            try:
                facts |= {file: x for x in _described(spark, [storage.url(file)]).values()}
            except Exception:
                lose(file)
    found = [DataFile(f, 0, x[0], x[1], storage.size(f), *x[2:]) for f, x in facts.items() if x[2]]
    if old is None and found:
        for folder in _clashes(spark, storage, found):
            for f in [f for f in found if f.path.startswith(f"{DATA}/{folder}/")]:
                lose(f.path)
                found.remove(f)
    top = max([f.max_seq for f in found] + ([old.last_seq] if old else []), default=0)
    floor = top if old is None else old.floor
    state = State(last_seq=top, floor=floor, key_order=options.key_order.name if old is None else old.key_order, files={f.path: f for f in found}, snapshots={} if old is None else old.snapshots)
    probe = VersionedTable(spark, path, options, state)
    if storage.names(LOG):
        rows = read_logs(spark, storage.url(LOG)).where(F.col("op").isNotNull() & (F.col("seq") > top)).select("key", "seq", "op", "value").dropDuplicates(["seq"])
        for f in probe._write_run(rows, 0):
            if f.entries:
                state.files[f.path] = f
                state.last_seq = max(state.last_seq, f.max_seq)
    if old is None:
        state.floor = state.last_seq
    manifest.restart(state)
    storage.delete(LOG)
    return {"files": len(state.files), "lost": lost, "last_seq": state.last_seq}


def _clashes(spark: SparkSession, storage: Storage, found: list[DataFile]) -> list[str]:
    """Folders of runs that were never committed: another, earlier one gives the same numbers to other rows."""
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    rows = spark.read.schema(LOG_SCHEMA).parquet(*[storage.url(f.path) for f in found]).select(folder.alias("folder"), "seq", F.xxhash64("key", "op", "value").alias("row"))
    pairs = rows.groupBy("seq").agg(F.count_distinct("row").alias("rows"), F.collect_set("folder").alias("folders")).where("rows > 1").select("folders").distinct().collect()
    when = {n: storage.modified(f"{DATA}/{n}") for r in pairs for n in r["folders"]}
    gone: set[str] = set()
    for r in pairs:
        there = sorted((n for n in r["folders"] if n not in gone), key=lambda n: (when[n], n))
        gone.update(there[1:])
    return sorted(gone)
