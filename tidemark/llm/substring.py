"""Substring deduplication over a log-structured fingerprint index.

The unit is a window of ``window`` words. A window is filed under its anchor,
the least hash among its runs of ``gram`` words; equal windows have equal
anchors, and neighbouring windows mostly share theirs, so the index of anchors
has about two entries for each ``window - gram`` words. The index is a list of
immutable runs, each sorted by hash:

* ``texts``: digest of a whole word sequence -> least document,
* ``spans``: anchor and digest of a span -> least document. A span is all windows
  in a row under one anchor.

A batch merge-joins its digests with the runs, texts and spans in one round; of
the spans' runs only rows whose anchor is in a bit set of the batch's are
shuffled. Equal 128-bit digests repeat each other as a whole, which the runs tell
without the history. Only where spans of several documents share an anchor
but not the digest, one document of each gives its single windows, which are
compared by digests of their own; the texts of these documents alone are hashed
again. Digests that no run has are added as a run, and runs of one kind are
compacted into one when there are ``fanout`` of them.

Candidates reach the tasks as bit sets of at most 2^``MAX_BITS`` bits. A false hit
only adds rows that match nothing, so results don't depend on it. Within a task
all but the least document of a text, span or window are known to repeat it;
only that one goes through the shuffle, so a passage that a third of all rows
share costs a row for each task.

Defined cases: null or empty texts have no words; texts with fewer words than a
window lose none; a null id is neither matched nor indexed; rows with one id
don't count against each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bits import among, bit_sets, bit_table
from tidemark.llm.common import cut, ensure_checkpoint_dir, give_back, read_table
from tidemark.llm.hashing import Words, mix, powers, slices

WINDOW = 50
GRAM = 8
FANOUT = 4
#: Ranges of ids that ``dedup_substrings`` indexes one after another; with more than ``FANOUT`` of them, runs are compacted.
BATCHES = 5
#: Spans or windows that a task holds before it sends them on.
TASK_ROWS = 1_000_000
#: Digests of texts that a task remembers to tell copies.
TASK_TEXTS = 200_000
MAX_SPAN = 1 << 20

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _times(a: np.uint64, b: np.uint64) -> np.uint64:
    return np.uint64(int(a) * int(b) & 0xFFFFFFFFFFFFFFFF)


def _rolling(h: np.ndarray, n: int, c: np.uint64) -> np.ndarray:
    """Polynomial hash of each run of ``n`` values, by doubling."""
    out, have = None, 0
    part, width, factor = h, 1, c
    while True:
        if n & width:
            if out is None:
                out, have, shift = part, width, factor
            else:
                m = len(part) - have
                if m <= 0:
                    return np.empty(0, np.uint64)
                out = out[: max(0, m)] + shift * part[have : have + len(out[:m])]
                have += width
                shift = _times(shift, factor)
        if width * 2 > n:
            break
        if len(part) <= width:
            return np.empty(0, np.uint64)
        part = part[:-width] + factor * part[width:]
        factor = _times(factor, factor)
        width *= 2
    k = len(h) - n + 1
    return out[:k] if k > 0 else np.empty(0, np.uint64)


def _sliding_min(a: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while width * 2 <= n:
        a = np.minimum(a[:-width], a[width:])
        width *= 2
    r = n - width
    return np.minimum(a[:-r], a[r:]) if r else a


class Windows:
    """Windows of some texts: anchor, text and start word of each."""

    def __init__(self, texts: list[bytes], window: int, gram: int):
        self.words = w = Words(texts)
        k = len(w.hash) - window + 1
        if k <= 0:
            self.anchor, self.text, self.start, self.at = (np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
            return
        ok = np.flatnonzero(w.text[:k] == w.text[window - 1 :])
        anchors = _sliding_min(mix(_rolling(w.hash, gram, _C1)), window - gram + 1)
        self.at, self.anchor, self.text = ok, anchors[ok], w.text[ok]
        self.start = ok - w.first[self.text]

    def digests(self, pick: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.at[pick]
        return mix(_rolling(self.words.hash, window, _C1)[at] ^ np.uint64(1)), mix(_rolling(self.words.hash, window, _C2)[at])

    def spans(self, pick: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
        """Of the windows ``pick``: first window of each span, windows in it, two digests of its words."""
        at, anchor, text = self.at[pick], self.anchor[pick], self.text[pick]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (at[1:] - at[:-1] > 1)))
        begin = np.flatnonzero(new)
        # A stretch under one anchor ends after MAX_SPAN windows.
        begin = np.flatnonzero(new | ((np.arange(len(pick)) - np.repeat(begin, np.diff(np.append(begin, len(pick))))) % MAX_SPAN == 0))
        count = np.diff(np.append(begin, len(pick)))
        lo = at[begin]
        hi = lo + count + window - 1
        out = []
        for c in (_C1, _C2):
            up = np.full(len(self.words.hash) + 1, c, np.uint64)
            up[0] = 1
            down = np.full(len(self.words.hash) + 1, np.uint64(pow(int(c), -1, 1 << 64)), np.uint64)
            down[0] = 1
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(down, out=down)
            sums = np.concatenate(([np.uint64(0)], np.cumsum(self.words.hash * up[:-1], dtype=np.uint64)))
            out.append(mix((sums[hi] - sums[lo]) * down[lo] + count.astype(np.uint64)))
        return pick[begin], count, out[0], out[1]


def text_digests(w: Words, n: int) -> list[bytes]:
    """16 bytes for the word sequence of each of ``n`` texts."""
    count = np.diff(w.first)
    out = np.zeros((n, 2), np.uint64)
    have = np.flatnonzero(count)
    if len(have):
        place = np.arange(len(w.hash)) - w.first[w.text]
        p = powers(int(count.max()) + 1)
        starts = w.first[have]
        out[have, 0] = mix(np.add.reduceat(w.hash * p[place], starts) + count[have].astype(np.uint64))
        out[have, 1] = mix(np.add.reduceat(mix(w.hash ^ _C2) * p[place], starts) ^ _C1)
    return [x.tobytes() for x in out.astype(">u8")]


def _encoded(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "replace") for t in column.to_pylist()]


def _pack(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Start word and number of windows of a stretch; a span has fewer than 2^24."""
    return start.astype(np.int64) << 24 | count.astype(np.int64)


ROW_NAMES = ["d1", "d2", "anchor", "doc_id", "tie", "at"]
ROW_SCHEMA = ", ".join(f"{n} long" for n in ROW_NAMES)


def _leasts(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Rows (d1, d2, anchor, doc, tie, start, windows): one of the least document for each digest, and the others as known repeats.

    at >= 0 asks whether a smaller document has the digest; at < 0 is the
    complement of a stretch of windows already known to repeat one.
    """
    d1, d2, anchor, doc, tie, start, count = (np.concatenate([h[i] for h in held]) for i in range(7))
    order = np.lexsort((start, tie, doc, d2, d1))
    d1, d2, anchor, doc, tie, start, count = (x[order] for x in (d1, d2, anchor, doc, tie, start, count))
    first = np.concatenate(([True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])))
    least = doc[first][np.cumsum(first) - 1]
    ask, known = doc == least, doc > least
    out = [x[ask] for x in (d1, d2, anchor, doc, tie)] + [_pack(start[ask], count[ask])]
    if known.any():
        doc, tie, start, count = doc[known], tie[known], start[known], count[known]
        spread = mix(doc.view(np.uint64) ^ mix(start.view(np.uint64))).view(np.int64)
        out = [np.concatenate(x) for x in zip(out, (spread, tie, spread, doc, tie, ~_pack(start, count)), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=ROW_NAMES)


#: Rows of texts: not compared; a smaller document of the task has the text; compared by digest. Rows of spans.
PLAIN, COPY, ASK, SPAN = range(4)
#: In place of a stretch: the whole text.
WHOLE = -(1 << 63)

SKETCH_SCHEMA = f"{ROW_SCHEMA}, n_words long, all_sha256 string, state int"


def _sketch_rows(window: int, gram: int):
    """(doc_id, text) -> a row for each text; rows of the spans of the texts that ask, as ``_leasts`` gives them."""
    names = [*ROW_NAMES, "n_words", "all_sha256", "state"]

    def spans(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        rows = _leasts(held)
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array(np.full(n, SPAN, np.int32))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        total = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, texts = part.column(0).to_pylist(), _encoded(part.column(1))
                docs = np.array([i or 0 for i in ids], np.int64)
                n_words, sha, digest, state = [], [], [], []
                for lo, hi in slices(texts):
                    x = Windows(texts[lo:hi], window, gram)
                    digest += text_digests(x.words, hi - lo)
                    for i in range(lo, hi):
                        w, doc = texts[i].split(), ids[i]
                        n_words.append(len(w))
                        sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
                        if doc is None or len(w) < window:
                            state.append(PLAIN)
                        elif seen.get(digest[i], doc) < doc:
                            state.append(COPY)
                        else:
                            state.append(ASK)
                            seen[digest[i]] = doc
                    if len(seen) > TASK_TEXTS:
                        seen.clear()
                    pick = np.flatnonzero((np.array(state[lo:hi]) == ASK)[x.text])
                    if len(pick):
                        first, count, d1, d2 = x.spans(pick, window)
                        t = x.text[first]
                        tie = _ties(digest[lo:hi])[t]
                        held.append((d1.view(np.int64), d2.view(np.int64), x.anchor[first].view(np.int64), docs[lo:hi][t], tie, x.start[first], count))
                        total += len(first)
                    if total >= TASK_ROWS:
                        yield spans(held)
                        held, total = [], 0
                d = np.frombuffer(b"".join(digest), ">i8").astype(np.int64).reshape(-1, 2)
                none, whole = pa.nulls(len(ids), pa.int64()), pa.array(np.full(len(ids), WHOLE, np.int64))
                tie = pa.array(d[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [tie, pa.array(d[:, 1]), none, pa.array(ids, pa.int64()), tie, whole, pa.array(n_words, pa.int64()), pa.array(sha, pa.string()), pa.array(state, pa.int32())], names=names
                )
        if held:
            yield spans(held)
        give_back()

    return run


def _ties(digests: list[bytes]) -> np.ndarray:
    """The first half of each digest, which tells texts of one id apart."""
    return np.array([int.from_bytes(d[:8], "big", signed=True) for d in digests], np.int64)


def _window_rows(window: int, gram: int, anchors, spans):
    """(doc_id, text) -> rows of the single windows of the spans under the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_mask = bit_table(anchors)
        own, own_mask = bit_table(spans)
        held: list[tuple[np.ndarray, ...]] = []
        total = 0
        for batch in batches:
            for lo_row in range(0, batch.num_rows, 2000):
                part = batch.slice(lo_row, 2000)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = _encoded(part.column(1))
                for lo, hi in slices(texts):
                    x = Windows(texts[lo:hi], window, gram)
                    pick = np.flatnonzero(among(hot, hot_mask, x.anchor)) if len(x.anchor) else []
                    if not len(pick):
                        continue
                    at, count, d1, d2 = x.spans(pick, window)
                    good = among(own, own_mask, d1.view(np.int64) ^ ids[lo:hi][x.text[at]])
                    at, count = at[good], count[good]
                    at = np.repeat(at, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    if not len(at):
                        continue
                    d1, d2 = x.digests(at, window)
                    count = np.ones(len(at), np.int64)
                    t = x.text[at]
                    tie = _ties(text_digests(x.words, hi - lo))
                    held.append((d1.view(np.int64), d2.view(np.int64), x.anchor[at].view(np.int64), ids[lo:hi][t], tie[t], x.start[at], count))
                    total += len(at)
                    if total >= TASK_ROWS:
                        yield _leasts(held)
                        held, total = [], 0
        if held:
            yield _leasts(held)
        give_back()

    return run


def _in_bits(bits):
    """Rows whose long first column is in the bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask = bit_table(bits)
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch.filter(pa.array(among(table, mask, key)))

    return run


RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _strip_rows(window: int):
    """(doc_id, text, ties, ats) -> (doc_id, n_words, n_removed, kept_sha256, kept): the text without the stretches that are its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                n_words, removed, sha, kept = [], [], [], []
                ties, ats = part.column(2), part.column(3)
                for i, text in enumerate(_encoded(part.column(1))):
                    w = text.split()
                    tie = _ties(text_digests(Words([text]), 1))[0]
                    at = ats[i].values.to_numpy(zero_copy_only=False)[ties[i].values.to_numpy(zero_copy_only=False) == tie]
                    if (at == WHOLE).any():
                        gone = np.ones(len(w), bool)
                    else:
                        at = np.where(at < 0, ~at, at)
                        start, length = at >> 24, at & ((1 << 24) - 1)
                        edge = np.zeros(len(w) + 1, np.int64)
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + length + window - 1, -1)
                        gone = np.cumsum(edge)[: len(w)] > 0
                    rest = b" ".join([x for x, g in zip(w, gone, strict=True) if not g])
                    n_words.append(len(w))
                    removed.append(int(gone.sum()))
                    sha.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest.decode("utf-8") if len(at) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return run


class FingerprintIndex:
    """Runs in a folder that all executors share. Batches must come in ascending order of ids."""

    KINDS = {"texts": ["d1", "d2"], "spans": ["anchor", "d1", "d2"]}

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT):
        if not 0 < gram <= window:
            raise ValueError("a gram has 1 word to a window's")
        self.spark, self.path, self.window, self.gram, self.fanout = spark, path.rstrip("/"), window, gram, fanout

    # -- runs -----------------------------------------------------------------
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def run_paths(self, kind: str) -> list[str]:
        p, fs = self._fs(f"{self.path}/{kind}")
        if not fs.exists(p):
            return []
        found = [s.getPath().toString() for s in fs.listStatus(p)]
        done = [f for f in found if fs.exists(self._fs(f"{f}/_SUCCESS")[0])]
        return sorted(done)

    def runs(self, kind: str) -> DataFrame | None:
        paths = self.run_paths(kind)
        return self.spark.read.parquet(*paths) if paths else None

    def _write(self, kind: str, df: DataFrame) -> str:
        """A run of rows that are dealt by key and have each key once."""
        n = len(self.run_paths(kind))
        path = f"{self.path}/{kind}/run-{n:06d}-{uuid.uuid4().hex[:8]}"
        df.sortWithinPartitions(*self.KINDS[kind]).write.parquet(path)
        return path

    def compact(self, kind: str) -> None:
        """All runs of a kind into one, each key once."""
        paths = self.run_paths(kind)
        if len(paths) < 2:
            return
        self._write(kind, self._merged(kind, self.spark.read.parquet(*paths)))
        for old in paths:
            p, fs = self._fs(old)
            fs.delete(p, True)

    def _merged(self, kind: str, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.KINDS[kind]).agg(F.min("least").alias("least"))

    def drop(self) -> None:
        p, fs = self._fs(self.path)
        fs.delete(p, True)

    # -- batches --------------------------------------------------------------
    def add(self, batch: DataFrame, history: DataFrame | None = None, last: bool = False) -> DataFrame:
        """Indexes (doc_id, text) rows; a row for each: doc_id, n_words, n_removed, kept_sha256, kept (text, null if all is kept).

        ``history`` has the rows indexed before: the texts that share an anchor, but
        not the span, are looked up in it. ``last`` adds no runs. The result needs
        neither runs nor texts.
        """
        window, gram = self.window, self.gram
        batch = batch.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

        sketch = cut(batch.mapInArrow(_sketch_rows(window, gram), SKETCH_SCHEMA))

        # Texts and spans: the least document of each digest leads it, the others repeat it.
        rows = sketch.where((F.col("state") == ASK) | (F.col("state") == SPAN) & (F.col("at") >= 0)).select(*ROW_NAMES).withColumn("fresh", F.lit(True))

        def indexed(found: DataFrame, at: int) -> DataFrame:
            return found.withColumns({"tie": F.lit(0).cast("long"), "at": F.lit(at).cast("long"), "fresh": F.lit(False)})

        old, seen = self.runs("texts"), self.runs("spans")
        if old is not None:
            old = old.select("d1", "d2", F.lit(None).cast("long").alias("anchor"), F.col("least").alias("doc_id"))
            rows = rows.unionByName(indexed(old, WHOLE))
        if seen is not None:
            (bits,) = bit_sets(sketch.where("anchor is not null").select("anchor"))
            near = seen.select("anchor", "d1", "d2", "least").mapInArrow(_in_bits(bits), "anchor long, d1 long, d2 long, doc_id long")
            rows = rows.unionByName(indexed(near, 0))
        same = Window.partitionBy("d1", "d2")
        rows = rows.withColumn("lead", F.row_number().over(same.orderBy("doc_id", "fresh")) == 1)
        rows = cut(rows.withColumns({"least": F.min("doc_id").over(same), "new": F.min("fresh").over(same)}))
        leads = rows.where("lead and at >= 0")
        if not last:
            self._write("texts", rows.where("lead and new and at < 0").select("d1", "d2", "least"))
            self._write("spans", leads.where("new").select("anchor", "d1", "d2", "least"))

        # Single windows of the spans that lead, where leads of several documents share an anchor.
        split = leads.groupBy("anchor").agg((F.min("doc_id") < F.max("doc_id")).alias("shared")).where("shared").select("anchor")
        own = leads.join(split, "anchor").select("anchor", F.col("d1").bitwiseXOR(F.col("doc_id")).alias("own"), "doc_id")
        anchors, own, some = bit_sets(own)

        def windows(docs: DataFrame) -> DataFrame:
            docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
            return docs.mapInArrow(_in_bits(some), "doc_id long, text string").mapInArrow(_window_rows(window, gram, anchors, own), ROW_SCHEMA)

        singles = windows(batch).withColumn("fresh", F.lit(True))
        if history is not None and seen is not None:
            singles = singles.unionAll(windows(history).where("at >= 0").withColumn("fresh", F.lit(False)))
        singles = singles.withColumn("least", F.min("doc_id").over(same))
        covered = sketch.where((F.col("state") == COPY) | (F.col("state") == SPAN) & (F.col("at") < 0)).select("doc_id", "tie", "at")
        covered = covered.unionAll(rows.where("fresh and doc_id > least").select("doc_id", "tie", "at"))
        covered = covered.unionAll(singles.where("fresh and (at < 0 or doc_id > least)").select("doc_id", "tie", "at"))
        covered = covered.groupBy(F.col("doc_id").alias("c_id")).agg(F.collect_list(F.struct("tie", "at")).alias("c"))
        gone = F.transform(F.filter("c", lambda x: x["at"] == WHOLE), lambda x: x["tie"])
        covered = covered.select("c_id", F.array_distinct(gone).alias("gone"), F.col("c.tie").alias("ties"), F.col("c.at").alias("ats"))
        covered = cut(covered.withColumn("part", F.exists("ties", lambda x: ~F.array_contains("gone", x))))

        # Only documents that lose a part are read again.
        part = covered.where("part").select("c_id", "ties", "ats")
        (bits,) = bit_sets(part.select("c_id"))
        again = batch.where("doc_id is not null").mapInArrow(_in_bits(bits), "doc_id long, text string")
        again = again.join(part, F.col("doc_id") == F.col("c_id")).select("doc_id", "text", "ties", "ats")
        stripped = cut(again.mapInArrow(_strip_rows(window), RESULT_SCHEMA))
        rest = sketch.where(F.col("state") < SPAN).join(covered.select("c_id", "gone", "part"), F.col("doc_id") == F.col("c_id"), "left").where("part is null or not part")
        copy = F.coalesce(F.array_contains("gone", F.col("tie")), F.lit(False))
        rest = rest.select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
            F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("all_sha256")).alias("kept_sha256"),
            F.when(copy, F.lit("")).alias("kept"),
        )
        result = rest.unionAll(stripped)
        if not last:
            for kind in self.KINDS:
                if len(self.run_paths(kind)) >= self.fanout:
                    self.compact(kind)
        return result


def dedup_substrings(docs: DataFrame, *, batches: int = BATCHES, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT) -> DataFrame:
    """All of ``docs`` (doc_id, text) through an index of their own, in ``batches`` ranges of ids."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, f"{ensure_checkpoint_dir(spark)}/fingerprints-{uuid.uuid4().hex}", window, gram, fanout)
    docs = docs.select("doc_id", "text")
    marks = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10000)).first()[0] if batches > 1 else []
    edges = sorted(set(marks or []))
    out = None
    try:
        for i in range(len(edges) + 1):
            above = F.col("doc_id") > edges[i - 1] if i else F.lit(True)
            own = docs.where((above & (F.col("doc_id") <= edges[i])) if i < len(edges) else above)
            own = own if i else docs.where((F.col("doc_id") <= edges[0]) | F.col("doc_id").isNull()) if edges else docs
            done = index.add(own, docs.where(F.col("doc_id") <= edges[i - 1]) if i else None, last=i == len(edges))
            out = done if out is None else out.unionAll(done)
    finally:
        index.drop()
    return out


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
