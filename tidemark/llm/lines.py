"""Line deduplication by an exact set-similarity join.

A line is a set of words (A-Z in lower case). A line goes if an earlier line of
the corpus, by document id and line number, has a Jaccard similarity of
``percent`` or more; similarity is judged on the input, blank lines stay.

Words are ordered by rarity, estimated from a table of ``COUNTERS`` counters
over all words of the corpus; any total order gives right results, a good one
short lists. Two similar lines share a word among the first of each (prefix
filter), so lines meet by these words in one shuffle. There lines are skipped
whose lengths differ too much (length filter), whose shared word stands too
late for the overlap they need (positional filter), or whose parity sketches
differ in more bits than their words may (a bound on the symmetric difference).
The pairs that are left are verified on the words of both lines.

Lines of equal sets meet in the same place; within a task all but the first are
dropped before the shuffle, so a line that a third of all rows share costs a
row for each task. Tasks deal their rows to parts by word and send each part as
one block of columns, which spares the JVM tens of rows for each line; the
number of parts grows with the input. A line needs one earlier match only, so it
is verified against one candidate, the surest and earliest: one pair for each
line, however many near copies it has. Lines whose candidate fails and that have
others meet those again in blocks that carry the words of both, where all
candidates are verified on the spot, and no pair leaves the task. That round
reads the first round's shuffle again for the candidates of open lines, and
builds only these and the open lines from the texts.

Defined cases: a null text has no lines and stays null; an empty text has one
blank line; rows with a null id lose no lines and match none; of rows with one
id and equal texts no line is earlier than its copy, and of those with one id
and other texts the one of the lesser 64-bit hash comes first; an empty table
gives no rows; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bits import bit_set, bit_table, has
from tidemark.llm.common import bound, cut, give_back, keep_memory, read_table, sealed
from tidemark.llm.hashing import Words, mix, slices

PERCENT = 80
COUNTER_BITS = 20
COUNTERS = 1 << COUNTER_BITS
#: Counters that are summed in one row: many small rows, so many tasks share the sums.
CHUNK = 1 << 10
#: In the first round a line looks at this many candidates for a shared word, or at one with an all but equal sketch.
FIRST = 4
#: Lines that a task holds before it drops repeats and sends the rest on.
TASK_LINES = 60_000
LINE_BITS = 20
#: Words of the corpus for each part that they are dealt to.
PART_WORDS = 2_000_000
#: Lines of the second round for each part.
PART_LINES = 5_000
_HASH_BITS = 64 - 8 - LINE_BITS
#: Bits for each word and class of sizes that the second round looks for: prefix rows are many, so few may hit by chance.
WORD_BITS = 64
#: Greater sizes and places of prefix rows stop there, which weakens filters and loses nothing.
MAX_SIZE, MAX_PLACE = 65535, 255


def _texts(column: pa.Array) -> list[bytes]:
    """The texts in lower case, straight from Arrow's buffers; null: empty."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return []
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = b"" if data is None else data[int(ends[0]) : int(ends[-1])].to_pybytes().lower()
    ends = (ends - ends[0]).tolist()
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (chunk, counts) of the words' counters."""
    keep_memory()
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            texts = _texts(batch.column(0).slice(at, 2000))
            h = [(Words(texts[lo:hi]).hash >> np.uint64(64 - COUNTER_BITS)).view(np.int64) for lo, hi in slices(texts)]
            counts += np.bincount(np.concatenate([*h, np.empty(0, np.int64)]), minlength=COUNTERS)
    give_back(1)
    parts = counts.reshape(-1, CHUNK)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int64()), pa.array([p.astype(np.uint32).tobytes() for p in parts], pa.binary())], names=["chunk", "counts"])


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(raw, np.uint32).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"])


def rarity_levels(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """A level 0 (rare) to 255 for each counter, COUNTERS numbers whatever the corpus; and the number of words."""
    made = docs.select(text_col).mapInArrow(_count_rows, "chunk long, counts binary")
    table = made.repartition("chunk").mapInArrow(_sum_rows, "chunk long, counts binary").toArrow()
    counts = np.zeros((COUNTERS // CHUNK, CHUNK), np.int64)
    for chunk, raw in zip(table.column("chunk").to_pylist(), table.column("counts").to_pylist(), strict=True):
        counts[chunk] += np.frombuffer(raw, np.int64)
    return np.minimum(255, 6 * np.log2(1 + counts.reshape(-1))).astype(np.uint8), int(counts.sum())


def need(n, percent: int):
    """The least number of words that a set of ``n`` shares with a similar one."""
    return (percent * n + 99) // 100


def word_keys(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Word hashes with their rarity in front: their order is the order of words."""
    level = levels[(h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
    return level.astype(np.uint64) << np.uint64(_HASH_BITS) | mix(h) >> np.uint64(64 - _HASH_BITS)


def size_edges(percent: int) -> np.ndarray:
    """The least size of each class of sizes; similar sets are in one class or in the classes beside."""
    edges = [1]
    while edges[-1] < MAX_SIZE:
        edges.append(max(edges[-1] + 1, 100 * edges[-1] // percent))
    return np.array(edges)


def size_classes(size: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, np.minimum(size, MAX_SIZE), side="right")


def class_keys(word: np.ndarray, klass: np.ndarray) -> np.ndarray:
    """One key of words and classes of sizes."""
    return word | (klass + 1).astype(np.uint64) << np.uint64(64 - LINE_BITS)


def _placed_lines(texts: list[bytes], ids: np.ndarray, ties: np.ndarray, places) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(text, line, the line itself) of all lines whose place is in the bit sets ``places`` of documents and lines."""
    at, numbers, lines = [], [], []
    for i in np.flatnonzero(has(*places[0], ids.view(np.uint64))).tolist():
        own = texts[i].split(b"\n")
        no = np.flatnonzero(has(*places[1], place_key(ids[i], np.arange(len(own), dtype=np.int64), ties[i]))).tolist()
        at += [i] * len(no)
        numbers += no
        lines += [own[k] for k in no]
    return np.array(at, np.int64), np.array(numbers, np.int64), lines


class LineSets:
    """The lines with a word of some texts (at most 2^LINE_BITS), their words in order of rarity."""

    def __init__(self, texts: list[bytes], levels: np.ndarray, hashes: bool = False):
        w = Words(texts)
        raw = np.frombuffer(w.raw, np.uint8)
        breaks = np.flatnonzero(raw == 10)
        line = np.repeat(np.arange(len(breaks) + 1), np.diff(np.concatenate(([0], np.searchsorted(w.begin, breaks), [len(w.begin)]))))  # all texts together
        text_begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1])).astype(np.int64)
        before = np.searchsorted(breaks, text_begin)
        key = (line + w.text).astype(np.int64)  # texts share no line
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)
        no = np.cumsum(new) - 1
        n_lines = int(no[-1]) + 1 if len(no) else 0
        if n_lines > 1 << LINE_BITS:
            raise ValueError("too many lines at once")
        at = np.flatnonzero(new)
        self.text, self.line = w.text[at], line[at] - before[w.text[at]]
        both = (no.astype(np.uint64) << np.uint64(64 - LINE_BITS)) | word_keys(w.hash, levels)
        if hashes:
            order = np.argsort(both, kind="stable")
            both, self.hash = both[order], w.hash[order]
        else:
            both.sort()
        if len(both):
            new = np.concatenate(([True], both[1:] != both[:-1]))
            both = both[new]
            if hashes:
                self.hash = self.hash[new]
        owner = (both >> np.uint64(64 - LINE_BITS)).astype(np.int64)
        self.word = both & np.uint64((1 << (64 - LINE_BITS)) - 1)
        self.first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))[:n_lines]
        self.size = np.diff(np.append(self.first, len(both)))
        self.place = np.arange(len(both)) - np.repeat(self.first, self.size)
        self.owner = owner
        if n_lines:
            self.set_id = mix(np.add.reduceat(mix(self.word), self.first) + self.size.astype(np.uint64))
        else:
            self.set_id = np.empty(0, np.uint64)


def _line_slices(texts: list[bytes]) -> Iterator[tuple[int, int, list[bytes], int]]:
    """(first text, end, texts, lines before) within the limits of LineSets; a text of very many lines comes in parts."""
    limit = (1 << LINE_BITS) - 1
    for lo, hi in slices(texts):
        own = texts[lo:hi]
        counts = [t.count(b"\n") + 1 for t in own]
        if sum(counts) <= limit:
            yield lo, hi, own, 0
            continue
        for i, t in enumerate(own):
            if counts[i] <= limit:
                yield lo + i, lo + i + 1, [t], 0
                continue
            lines = t.split(b"\n")
            for at in range(0, len(lines), limit):
                yield lo + i, lo + i + 1, [b"\n".join(lines[at : at + limit])], at


def _pieces(texts: list[bytes], ids: np.ndarray, ties: np.ndarray, places) -> Iterator[tuple]:
    """What LineSets are made of: (first text, texts, -, lines before); with ``places`` (texts, lines, their numbers, -) of the lines there."""
    if places is None:
        for lo, _, own, skipped in _line_slices(texts):
            yield lo, own, None, skipped
        return
    text, line, own = _placed_lines(texts, ids, ties, places)
    for lo, hi in slices(own):
        for at in range(lo, hi, 1 << LINE_BITS):
            end = min(hi, at + (1 << LINE_BITS))
            yield text[at:end], own[at:end], line[at:end], 0


#: A row of a block: a word of a line's prefix. size 0: a line known to repeat an earlier one.
COLUMNS = {"word": "<u8", "set_id": "<u4", "parity": "<u8", "doc": "<i8", "line": "<u4", "tie": "<i8", "size": "<u2", "place": "u1"}
#: Longer lines have wider parity sketches: (least size, words of 64 bits). A wider one folds into a narrower one.
WIDTHS = ((1, 1), (90, 2), (200, 8))
BLOCK_SCHEMA = "part int, block binary, words binary"


def place_key(doc, line, tie):
    """One number for a place, also as ``_place_key`` of columns; others may share it."""
    return (doc ^ (line << 32) ^ tie).view(np.uint64)


def _place_key() -> Column:
    return F.col("doc_id").bitwiseXOR(F.shiftleft(F.col("line"), 32)).bitwiseXOR(F.col("tie"))


def ranges(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], ... at[0] + n[0] - 1, at[1], ..."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def width_class(size: np.ndarray) -> np.ndarray:
    return np.searchsorted([n for n, _ in WIDTHS], size, side="right") - 1


def _planes(values: np.ndarray) -> list[np.ndarray]:
    """The bytes of all numbers, first bytes first."""
    return [(values >> values.dtype.type(8 * i)).astype(np.uint8) for i in range(values.dtype.itemsize)]


def to_planes(columns: dict[str, np.ndarray], parity: np.ndarray) -> np.ndarray:
    """Rows of one width class as byte planes, which compress well; those of some rows make their block."""
    own = [columns[c].astype(t).view(f"u{np.dtype(t).itemsize}") for c, t in COLUMNS.items() if c != "parity"]
    return np.stack([p for v in [*own, *parity.T] for p in _planes(v)])


def to_block(planes: np.ndarray, width: int) -> bytes:
    """Number of rows, words of a sketch, then the planes."""
    return planes.shape[1].to_bytes(4, "little") + width.to_bytes(4, "little") + np.ascontiguousarray(planes).tobytes()


def from_block(raw: bytes, choose=None) -> dict[str, np.ndarray]:
    """The block's columns; with ``choose``, of those rows alone whose words and sizes it says yes to."""
    n, width, at, planes = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little"), 8, {}
    for c, t in COLUMNS.items():
        k = np.dtype(t).itemsize if c != "parity" else 0
        planes[c] = np.frombuffer(raw, np.uint8, n * k, at).reshape(k, n)
        at += n * k
    planes["parity"] = np.frombuffer(raw, np.uint8, n * 8 * width, at).reshape(8 * width, n)

    def column(c: str) -> np.ndarray:
        return np.ascontiguousarray(planes[c].T).view(COLUMNS[c]).reshape(planes[c].shape[1], -1)

    if choose is not None:
        pick = np.flatnonzero(choose(column("word")[:, 0], column("size")[:, 0]))
        n, planes = len(pick), {c: p[:, pick] for c, p in planes.items()}
    out = {c: column(c)[:, 0] for c in COLUMNS if c != "parity"} if n else {c: np.empty(0, t) for c, t in COLUMNS.items() if c != "parity"}
    wide = column("parity") if n else np.empty((0, width), np.uint64)
    # Narrow sketches are all in the fold; wide ones come beside, in rows as wide as the widest.
    out["parity"] = np.bitwise_xor.reduce(wide, axis=1) if n else np.empty(0, np.uint64)
    out["width"] = np.full(n, width, np.uint8)
    full = np.zeros((n if width > 1 else 0, WIDTHS[-1][1]), np.uint64)
    full[:, :width] = wide if width > 1 else 0
    return out | {"wide": full}


def wide_parity(word: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Lines x ``width``: bit i is the parity of the words that hash to i."""
    bit = mix(word ^ np.uint64(0xABCDEF)) & np.uint64(64 * width - 1)
    out = np.empty((len(first), width), np.uint64)
    for i in range(width):
        own = np.where(bit >> np.uint64(6) == i, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
        out[:, i] = np.bitwise_xor.reduceat(own, first)
    return out


def _prefix_rows(percent: int, levels, parts: int, words=None, places=None):
    """(doc_id, text, tie) -> blocks of prefix rows, one for each part and width.

    With ``words``, a bit set of ``class_keys``, and ``places``, bit sets of
    documents and of places, only of words, sizes and lines in them, and with the
    words of the lines beside the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        table = levels.value
        wanted = None if words is None else bit_table(words)
        there = None if places is None else [bit_table(p) for p in places]
        edges = size_edges(percent)
        #: For each width class: prefix rows (word, line number in heads, place) and parities of its lines.
        held: list[tuple[np.ndarray, ...]] = []
        heads: list[tuple[np.ndarray, ...]] = []
        hashes: list[np.ndarray] = []
        sketches: list[list[np.ndarray]] = [[] for _ in WIDTHS]
        count = 0

        def flush() -> list[tuple[int, bytes, bytes | None]]:
            set_id, doc, line, tie, size, lead_word = (np.concatenate([h[i] for h in heads]) for i in range(6))
            klass = width_class(size)
            order = np.lexsort((tie, line, doc, set_id))
            s, z, f = set_id[order], size[order], lead_word[order]
            start = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (z[1:] != z[:-1]) | (f[1:] != f[:-1]))))
            lead = order[np.repeat(start, np.diff(np.append(start, len(s))))]
            # The same place twice is the same row twice.
            gone = order[(doc[order] != doc[lead]) | (line[order] != line[lead]) | (tie[order] != tie[lead])]
            keep = np.zeros(len(set_id), bool)
            keep[order[start]] = True
            word, own, place = (np.concatenate([h[i] for h in held]) for i in range(3))
            pick = keep[own]
            word, own, place = word[pick], own[pick], place[pick]
            rows = {"word": word, "set_id": set_id[own] & np.uint64(0xFFFFFFFF), "doc": doc[own], "line": line[own], "tie": tie[own], "size": np.minimum(size[own], MAX_SIZE), "place": np.minimum(place, MAX_PLACE)}
            if wanted is None and len(gone):
                spread = mix(set_id[gone] ^ doc[gone].view(np.uint64))
                zero = np.zeros(len(gone), np.int64)
                more = {"word": spread, "set_id": set_id[gone] & np.uint64(0xFFFFFFFF), "doc": doc[gone], "line": line[gone], "tie": tie[gone], "size": zero, "place": zero}
                rows = {c: np.concatenate([v, more[c].astype(v.dtype)]) for c, v in rows.items()}
            row_class = np.concatenate([klass[own], np.zeros(len(rows["word"]) - len(own), np.int64)])
            at_class = np.zeros(len(size), np.int64)
            first, flat = np.cumsum(size) - size, np.concatenate(hashes) if hashes else None
            deal = row_class * parts + (mix(rows["word"]) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(deal.astype(np.uint16) if len(WIDTHS) * parts < 1 << 16 else deal, kind="stable")
            rows, source = {c: v[order] for c, v in rows.items()}, np.append(own, np.full(len(deal) - len(own), -1))[order]
            ends = np.searchsorted(deal[order], np.arange(len(WIDTHS) * parts + 1))
            out = []
            for k, (_, width) in enumerate(WIDTHS):
                lines = np.flatnonzero(klass == k)
                at_class[lines] = np.arange(len(lines))
                lo, hi = ends[k * parts], ends[(k + 1) * parts]
                if lo == hi:
                    continue
                p = np.zeros((hi - lo, width), np.uint64)
                real = np.flatnonzero(source[lo:hi] >= 0)
                if len(real):
                    p[real] = np.concatenate(sketches[k])[at_class[source[lo:hi][real]]]
                planes = to_planes({c: v[lo:hi] for c, v in rows.items()}, p)
                mine = ends[k * parts : (k + 1) * parts + 1]
                for i in np.flatnonzero(np.diff(mine)):
                    a, b = mine[i], mine[i + 1]
                    beside = None if flat is None else size[source[a:b]].astype("<u4").tobytes() + flat[ranges(first[source[a:b]], size[source[a:b]])].astype("<u8").tobytes()
                    out.append((int(i), to_block(planes[:, a - lo : b - lo], width), beside))
            return out

        def batch_of(blocks: list[tuple[int, bytes, bytes | None]]) -> pa.RecordBatch:
            columns = [pa.array([b[i] for b in blocks], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["part", "block", "words"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, ties = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
                texts = _texts(part.column(1))
                for lo, own, line, skipped in _pieces(texts, ids, ties, there):
                    x = LineSets(own, table, hashes=wanted is not None)
                    if not len(x.line):
                        continue
                    prefix = x.size - need(x.size, percent) + 1
                    pick = np.flatnonzero(x.place < prefix[x.owner])
                    if wanted is not None:
                        pick = pick[has(*wanted, class_keys(x.word[pick], size_classes(x.size, edges)[x.owner[pick]]))]
                        hashes.append(x.hash)
                    held.append((x.word[pick], x.owner[pick] + count, x.place[pick]))
                    row = lo + x.text if line is None else lo[x.text]
                    heads.append((x.set_id, ids[row], x.line + skipped if line is None else line[x.text], ties[row], x.size, x.word[x.first]))
                    klass = width_class(x.size)
                    for k, (_, width) in enumerate(WIDTHS):
                        lines = np.flatnonzero(klass == k)
                        if len(lines):
                            mine = klass[x.owner] == k
                            first = np.concatenate(([0], np.cumsum(x.size[lines])[:-1]))
                            sketches[k].append(wide_parity(x.word[mine], first, x.size[lines], width))
                    count += len(x.line)
                    if count >= TASK_LINES:
                        yield batch_of(flush())
                        held, heads, hashes, sketches, count = [], [], [], [[] for _ in WIDTHS], 0
        if count:
            yield batch_of(flush())
        held, heads, hashes, sketches = [], [], [], []
        give_back(1)

    return run


class Rows:
    """Prefix rows of distinct sets in runs of equal words, sorted by (word, place)."""

    def __init__(self, row: dict[str, np.ndarray], wide: np.ndarray, percent: int):
        self.row, self.wide, self.percent, self.parity = row, wide, percent, row["parity"]
        self.size, self.place = row["size"].astype(np.int64), row["place"].astype(np.int64)
        # More differing bits than this no partner of any size can make up for.
        widest = self.size * 100 // percent + self.size
        # Sizes of partners: by the length filter, and those that what stands after the shared word is enough for.
        self.low = need(self.size, percent)
        self.high = np.minimum(self.size * 100, (self.size - self.place) * (100 + percent) - percent * self.size) // percent
        self.spare = widest - 2 * (percent * widest // (100 + percent))
        self.most = np.minimum(64, self.spare).astype(np.uint8)
        # Of wider sketches, half of a fold to 128 bits; the other half is what is left of the fold to 64.
        self.half = np.zeros(len(self.size), np.uint64)
        self.deep = row["width"] > 1
        deep = np.flatnonzero(self.deep)
        self.half[deep] = np.bitwise_xor.reduce(wide[row["wide_at"][deep]][:, ::2], axis=1)

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of pairs that pass the quick test of 64 bits, those of like lengths that pass it on 128 bits where both have them."""
        sx = self.size[x]
        keep = np.flatnonzero((self.low[y] <= sx) & (sx <= self.high[y]))
        keep = keep[self.size[y[keep]] <= self.high[x[keep]]]
        x, y = x[keep], y[keep]
        half = self.half[x] ^ self.half[y]
        apart = np.bitwise_count(half) + np.bitwise_count(self.parity[x] ^ self.parity[y] ^ half)
        return keep[(apart <= self.spare[y]) | ~(self.deep[x] & self.deep[y])]

    def fits(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs pass the length, positional and parity filters, and whether by a wide margin."""
        p, r = self.percent, self.row
        keep = self.near(x, y)
        x, y = x[keep], y[keep]
        sx, sy = self.size[x], self.size[y]
        least = (p * (sx + sy) + 99 + p) // (100 + p)
        spare = sx + sy - 2 * least
        apart = np.bitwise_count(self.parity[x] ^ self.parity[y]).astype(np.int64)
        ok = (np.minimum(sx - self.place[x], sy - self.place[y]) >= least) & (apart <= spare)
        for w in sorted({n for _, n in WIDTHS if n > 1}):
            deep = np.flatnonzero(ok & (np.minimum(r["width"][x], r["width"][y]) >= w))
            if len(deep):
                diff = self.wide[r["wide_at"][x[deep]]] ^ self.wide[r["wide_at"][y[deep]]]
                # Bits that are equal modulo 64 w fold into one.
                fold = np.bitwise_xor.reduce(diff.reshape(len(deep), -1, w), axis=1)
                apart[deep] = np.bitwise_count(fold).sum(axis=1)
                ok[deep] &= apart[deep] <= spare[deep]
        return keep[ok], (2 * apart <= spare)[ok]


#: Rows of a run that are compared step by step; longer runs go on in squares of so many rows.
STEPS, SQUARE = 2048, 512
#: Words that are compared at once.
CHECK_WORDS = 1_000_000


def shared_words(flat: np.ndarray, at: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words the sets of rows ``x`` and ``y`` share, pair by pair; a set's words stand at flat[at : at + n]."""
    out = np.zeros(len(x), np.int64)
    total = np.cumsum(n[x] + n[y])
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHECK_WORDS)))
        own = np.concatenate([x[lo:hi], y[lo:hi]])
        word = flat[ranges(at[own], n[own])]
        pair = np.repeat(np.tile(np.arange(hi - lo), 2), n[own])
        order = np.lexsort((word, pair))
        word, pair = word[order], pair[order]
        out[lo:hi] = np.bincount(pair[1:][(word[1:] == word[:-1]) & (pair[1:] == pair[:-1])], minlength=hi - lo)
        lo = hi
    return out


class Found:
    """What ``match_runs`` tells of each row: candidates met, the first or surest of them, whether that one is sure, and whether the search ended early."""

    def __init__(self, n: int):
        self.made, self.best = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        self.sure, self.cut = np.zeros(n, bool), np.zeros(n, bool)


def match_runs(rows: Rows, limit: int, want: np.ndarray | None = None, similar=None) -> Found:
    """Looks for each row's candidates among the earlier rows of its run, earliest first.

    A row is done with one sure candidate or with ``limit`` candidates. With
    ``similar``, an exact test of pairs, a row is sure of what passes it and of
    nothing else, and there's no limit.
    """
    word = rows.row["word"]
    n = len(word)
    start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    first = np.repeat(start, np.diff(np.append(start, n)))
    live = np.flatnonzero(np.arange(n) > first)
    if want is not None:
        live = live[want[live]]
    found = Found(n)

    def settle(y: np.ndarray) -> np.ndarray:
        """Which of ``y`` want no more candidates, though there are more rows."""
        done = found.sure[y] if similar else found.sure[y] | (found.made[y] >= limit)
        found.cut[y[done]] = True
        return done

    def meet(x: np.ndarray, y: np.ndarray) -> None:
        """Pairs that passed the quick test, in order of y, then x."""
        fits, alike = rows.fits(x, y)
        x, y = x[fits], y[fits]
        if not len(y):
            return
        if similar:
            alike = similar(x, y)
        np.add.at(found.made, y, 1)
        who, at = np.unique(y, return_index=True)
        new = found.best[who] < 0
        found.best[who[new]] = x[at[new]]
        who, at = np.unique(y[alike], return_index=True)
        new = ~found.sure[who]
        found.best[who[new]] = x[alike][at[new]]
        found.sure[who] = True

    # Rows late in their runs first, so that those with a k-th row before them stand in front.
    back = first[live] - live
    order = np.argsort(back, kind="stable")
    y, back, open_ = live[order], back[order], np.ones(len(live), bool)
    start, parity, most = first[y], rows.parity[y], rows.most[y]
    for k in range(STEPS):
        n = int(np.searchsorted(back, -k))
        if not n:
            break
        x = start[:n] + k
        near = np.flatnonzero(np.bitwise_count(rows.parity[x] ^ parity[:n]) <= most[:n])
        near = near[open_[near]]
        if len(near):
            meet(x[near], y[near])
            near = near[back[near] < -k - 1]
            open_[near[settle(y[near])]] = False
            if k % 4 == 3 and 8 * np.count_nonzero(open_[:n]) < 7 * n:
                left = np.flatnonzero(open_[:n])
                y, back, start, parity, most, open_ = (v[left] for v in (y, back, start, parity, most, open_))
    live = np.sort(y[open_ & (back < -STEPS)])
    for own in np.split(live, np.flatnonzero(np.diff(first[live])) + 1) if len(live) else []:
        begin, end = first[own[0]] + STEPS, own[-1]
        sizes = rows.size[begin:end]
        for size in np.unique(rows.size[own]):
            # Only lengths that a set of this size can be similar to.
            x_all = begin + np.flatnonzero((sizes >= need(size, rows.percent)) & (rows.percent * sizes <= 100 * size))
            mine = own[rows.size[own] == size]
            for lo in range(0, len(mine), SQUARE):
                y = mine[lo : lo + SQUARE]
                at = 0
                while len(y) and at < len(x_all) and x_all[at] < y[-1]:
                    x = x_all[at : at + SQUARE]
                    near = (np.bitwise_count(rows.parity[y][:, None] ^ rows.parity[x]) <= rows.most[y][:, None]) & (x < y[:, None])
                    i, j = np.nonzero(near)
                    if len(i):
                        meet(x[j], y[i])
                    at += len(x)
                    y = y[~settle(y)]
    return found


FOUND_NAMES = ["doc_id", "line", "tie", "x_doc", "x_line", "x_tie", "kind", "words"]
FOUND_SCHEMA = "doc_id long, line long, tie long, x_doc long, x_line long, x_tie long, kind int, words array<long>"
#: Lines that go; lines with one candidate; with more, of which the one given is sure or not.
GONE, ONLY, SURE, MAYBE = 0, 1, 2, 3


def _match_rows(percent: int, limit: int, open_lines=None, words=None):
    """All blocks of some parts -> lines that go, and lines with their best candidate and the words by which they have any (``class_keys``).

    With ``open_lines``, a bit set of places, only those lines are looked at, and
    all their candidates are verified on the words beside the blocks; with
    ``words`` too, a bit set of ``class_keys``, blocks are of the first round and
    all these candidates are given instead, each once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        table = None if open_lines is None else bit_table(open_lines)
        wanted = None if words is None else bit_table(words)
        edges = size_edges(percent)

        def choose(word: np.ndarray, size: np.ndarray) -> np.ndarray:
            return (size > 0) & has(*wanted, class_keys(word, size_classes(size, edges)))

        def handle(blocks: list[tuple[dict[str, np.ndarray], bytes | None]]) -> pa.RecordBatch:
            got = [g for g, _ in blocks]
            wide = np.concatenate([g.pop("wide") for g in got])
            row = {n: np.concatenate([g[n] for g in got]) for n in got[0]}
            row["wide_at"] = np.cumsum(row["width"] > 1) - 1
            row["line"] = row["line"].astype(np.int64)
            if table is not None and wanted is None:
                row["n"] = np.concatenate([np.frombuffer(w, "<u4", len(g["word"])) for (_, w), g in zip(blocks, got, strict=True)]).astype(np.int64)
                row["at"] = np.cumsum(row["n"]) - row["n"]
                flat = np.concatenate([np.frombuffer(w, "<u8", offset=4 * len(g["word"])) for (_, w), g in zip(blocks, got, strict=True)])
            del got
            known = row["size"] == 0

            # Lines and words by number, so that each order is one sort of one number. Lines count up in their order.
            n = len(known)
            least, most = int(row["doc"].min()), int(row["doc"].max())
            if row["tie"].any() or most - least >= 1 << 31:
                order = np.lexsort((row["tie"], row["line"], row["doc"]))
            else:
                order = np.argsort((row["doc"] - least) << 32 | row["line"])
            new = np.zeros(n, bool)
            for c in ("doc", "line", "tie"):
                new[1:] |= row[c][order[1:]] != row[c][order[:-1]]
            line_no = np.empty(n, np.int64)
            line_no[order] = np.cumsum(new)
            at_line = order[np.concatenate(([0], np.flatnonzero(new)))]  # a row of each line
            place = [row[c][at_line] for c in ("doc", "line", "tie")]
            gone = [line_no[known]]
            order = np.argsort(row["word"])
            w = row["word"][order]
            run_no = np.empty(n, np.int64)
            run_no[order] = np.cumsum(np.concatenate(([0], w[1:] != w[:-1]))[: len(w)])
            rows_in = np.bincount(run_no[~known], minlength=n + 1)
            order = np.flatnonzero(~known & (rows_in[run_no] > 1))  # words of one line only are done
            # Of equal sets the first goes on.
            key = run_no[order] << 32 | row["set_id"][order]
            by_key = np.argsort(key)
            order, key = order[by_key], key[by_key]
            many = np.zeros(len(key) + 1, bool)
            many[1:-1] = key[1:] == key[:-1]
            many = np.flatnonzero(many[1:] | many[:-1])
            order[many] = order[many][np.lexsort((line_no[order[many]], row["size"][order[many]], row["parity"][order[many]], key[many]))]
            a, b = order[1:], order[:-1]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (row["parity"][a] != row["parity"][b]) | (row["size"][a] != row["size"][b])))[: len(order)]
            lead = order[np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(order))))]
            gone.append(line_no[order[(line_no[order] != line_no[lead]) & (row["place"][order] == 0)]])
            order = order[new]
            # Sets so small that no other set is similar are done.
            size = row["size"][order].astype(np.int64)
            order = order[100 * size >= percent * (size + 1)]
            order = order[np.bincount(run_no[order], minlength=n + 1)[run_no[order]] > 1]
            order = order[np.argsort(run_no[order] << 32 | line_no[order])]
            own, other, kind = (np.empty(0, np.int64) for _ in range(3))
            keys, ends = np.empty(0, np.uint64), np.zeros(1, np.int64)
            if len(order):
                row, line_no = {c: v[order] for c, v in row.items()}, line_no[order]
                if table is not None:
                    want = has(*table, place_key(row["doc"], row["line"], row["tie"]))

                    met = np.zeros(len(want), bool)

                    def similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                        if wanted is not None:
                            met[x] = True
                            return np.zeros(len(x), bool)
                        both = shared_words(flat, row["at"], row["n"], x, y)
                        return 100 * both >= percent * (row["n"][x] + row["n"][y] - both)

                    got = match_runs(Rows(row, wide, percent), limit, want, similar)
                    gone.append(line_no[got.sure])
                    if wanted is not None:
                        own = other = np.unique(line_no[met])
                        kind, ends = np.full(len(own), MAYBE), np.zeros(len(own) + 1, np.int64)
                else:
                    got = match_runs(Rows(row, wide, percent), limit)
                    met = np.flatnonzero(got.made)
                    met = met[np.lexsort((got.best[met], ~got.sure[met], line_no[met]))]
                    own, begin = np.unique(line_no[met], return_index=True)
                    best = line_no[got.best[met]]
                    other = best[begin]
                    alone = (got.made[met] == 1) & ~got.cut[met] & (best == np.repeat(other, np.diff(np.append(begin, len(met)))))
                    kind = np.where(np.logical_and.reduceat(alone, begin), ONLY, np.where(got.sure[met[begin]], SURE, MAYBE)) if len(met) else kind
                    # The word with each class of sizes that a similar set may have.
                    size = row["size"][met].astype(np.int64)
                    lo, hi = (np.searchsorted(edges, s, side="right") for s in (need(size, percent), np.minimum(100 * size // percent, MAX_SIZE)))
                    keys = class_keys(np.repeat(row["word"][met], hi - lo + 1), ranges(lo, hi - lo + 1))
                    ends = np.concatenate(([0], np.cumsum(hi - lo + 1)))[np.append(begin, len(met))]
            lost = np.unique(np.concatenate(gone)) if wanted is None else np.empty(0, np.int64)
            line = np.concatenate([lost, own]).astype(np.int64)
            partner = np.concatenate([lost, other]).astype(np.int64)
            kinds = np.concatenate([np.full(len(lost), GONE), kind])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(len(lost), np.int32), ends.astype(np.int32)])), pa.array(keys.view(np.int64)))
            return pa.RecordBatch.from_arrays([*[pa.array(c[line]) for c in place], *[pa.array(c[partner]) for c in place], pa.array(kinds, pa.int32()), lists], names=FOUND_NAMES)

        held: dict[int, list] = {}  # a partition has few parts
        for batch in batches:
            for part, block, beside in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                held.setdefault(part, []).append((block.as_py(), beside.as_py()))
        for part in sorted(held):
            blocks = [(from_block(block, None if wanted is None else choose), beside) for block, beside in held.pop(part)]
            blocks = [(b, beside) for b, beside in blocks if len(b["word"])]
            if blocks:
                yield handle(blocks)
                del blocks
        give_back(1)

    return run


def _needed_lines(doc_bits, line_bits):
    """(doc_id, text, tie) -> (doc_id, line, tie, words: 64-bit hashes) of the lines in the bit sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        doc_table, line_table = bit_table(doc_bits), bit_table(line_bits)
        for batch in batches:
            ids, ties = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
            at, numbers, lines = _placed_lines(_texts(batch.column(1)), ids, ties, (doc_table, line_table))
            w = Words(lines)
            order = np.lexsort((w.hash, w.text))
            h, own = w.hash[order], w.text[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])))[: len(h)]
            first = np.searchsorted(own[new], np.arange(len(lines) + 1)).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(first), pa.array(h[new].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(numbers, pa.int64()), pa.array(ties[at]), words], names=["doc_id", "line", "tie", "words"])
        give_back(1)

    return run


PLACE, X_PLACE = ["doc_id", "line", "tie"], ["x_doc", "x_line", "x_tie"]


def _place_bits(places: DataFrame) -> tuple:
    """Bit sets of the documents and of the places."""
    return bit_set(places.select("doc_id").distinct(), "doc_id"), bit_set(places.select(_place_key().alias("own")), "own")


def _kept_shuffle(df: DataFrame) -> DataFrame:
    """``df`` on a fixed RDD: who reads it again reads the files of its last shuffle, not what is before it."""
    session = df.sparkSession
    return DataFrame(session._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), session)


def _verified(rows: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The places of the later lines of pairs that are similar."""
    places = cut(pairs.select(*PLACE).unionAll(pairs.select(*X_PLACE)).distinct())
    lines = cut(rows.mapInArrow(_needed_lines(*_place_bits(places)), "doc_id long, line long, tie long, words array<long>"))
    x = lines.select(*[F.col(c).alias(x) for c, x in zip(PLACE, X_PLACE, strict=True)], F.col("words").alias("x_words"))
    both = pairs.join(lines.withColumnRenamed("words", "y_words"), PLACE).join(x, X_PLACE)
    shared = F.size(F.array_intersect("x_words", "y_words"))
    return both.where(100 * shared >= percent * (F.size("x_words") + F.size("y_words") - shared)).select(*PLACE).distinct()


def repeated_lines(rows: DataFrame, *, percent: int = PERCENT, first: int = FIRST) -> DataFrame:
    """(gone_id, gone_tie, gone: line numbers from 0) of the (doc_id, text, tie) rows that lose lines."""
    rarity, n_words = rarity_levels(rows, "text")
    levels = rows.sparkSession.sparkContext.broadcast(rarity)
    parts = max(8, -(-n_words // PART_WORDS))

    def met(parts: int, *only) -> DataFrame:
        return rows.mapInArrow(_prefix_rows(percent, levels, parts, *only), BLOCK_SCHEMA).repartition(parts, "part")

    blocks = _kept_shuffle(met(parts))
    found = cut(blocks.mapInArrow(_match_rows(percent, first), FOUND_SCHEMA)).coalesce(-(-parts // 4))
    known = found.where(F.col("kind") == GONE).select(*PLACE)
    # One candidate for each line: the surest, then the earliest.
    x = F.struct(*X_PLACE)
    best = found.where(F.col("kind") != GONE).groupBy(*PLACE).agg(
        F.min(F.struct((F.col("kind") == MAYBE).alias("unsure"), x.alias("x"))).alias("best"),
        (F.bool_or(F.col("kind") != ONLY) | (F.min(x) != F.max(x))).alias("more"),
    )
    best = cut(best.join(known, PLACE, "left_anti").select(*PLACE, "best.x.*", "more"))
    gone = cut(known.unionAll(_verified(rows, best.drop("more"), percent)).distinct())
    more = cut(best.where("more").select(*PLACE).join(gone, PLACE, "left_anti"))
    if more.limit(1).count():
        keys = found.join(more, PLACE, "left_semi").select(F.explode("words").alias("word")).distinct()
        words = bit_set(cut(keys), "word", WORD_BITS)
        open_lines = bit_set(more.select(_place_key().alias("own")).distinct(), "own")
        others = blocks.mapInArrow(_match_rows(percent, first, open_lines, words), FOUND_SCHEMA).select(*PLACE)
        places = cut(others.unionAll(more).distinct())
        few = min(parts, max(8, -(-places.count() // PART_LINES)))
        rest = met(few, words, _place_bits(places)).mapInArrow(_match_rows(percent, first, open_lines), FOUND_SCHEMA)
        gone = cut(gone.unionAll(rest.select(*PLACE)).distinct())
    return gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie")).agg(F.sort_array(F.collect_list(F.col("line").cast("int"))).alias("gone"))


def _tie(docs: DataFrame, key: Column, text: Column) -> Column:
    """Tells rows with one id apart: a hash of their text, where ids occur twice; else 0, which costs nothing."""
    ids = docs.select(key.alias("id")).where("id is not null").groupBy("id").count()
    return F.xxhash64(text) if ids.where("count > 1").limit(1).count() else F.lit(0).cast("long")


def _hit(bits):
    @F.pandas_udf("boolean")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series(has(*bit_table(bits), ids.fillna(0).astype("int64").to_numpy().view(np.uint64)))

    return run


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gone_col: str | None = None, drop_emptied: bool = False, **options) -> DataFrame:
    """``docs`` without lines that repeat an earlier one; ``gone_col`` counts them, ``drop_emptied`` drops documents that lose all.

    Only documents in a bit set of those that lose lines go through the join.
    """
    inner, name, restore = sealed(docs)
    key, text = F.col(name(id_col)).cast("long"), F.col(name(text_col))
    tie = _tie(inner, key, text)
    rows = inner.select(key.alias("doc_id"), text.alias("text"), tie.alias("tie")).where("doc_id is not null and text is not null")
    found = cut(repeated_lines(rows, **options))
    flagged = inner.withColumn("loses", _hit(bit_set(found.select("gone_id").distinct(), "gone_id"))(key))
    clean = flagged.where("NOT loses").select(*inner.columns, F.lit(0).cast("long").alias("n_gone"))
    joined = flagged.where("loses").join(found, (key == F.col("gone_id")) & (tie == F.col("gone_tie")), "left")
    kept = bound(
        F.split(text, "\n", -1),
        lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)), "\n"),
    )
    out = joined.select(
        *[F.when(F.col("gone").isNull(), text).otherwise(kept).alias(c) if c == name(text_col) else c for c in inner.columns],
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_gone"),
    )
    if drop_emptied:
        out = out.where((F.col("n_gone") == 0) | text.rlike(r"[^\x20\x09-\x0D]"))
    out = clean.unionByName(out)
    return restore(out.withColumnRenamed("n_gone", gone_col)) if gone_col else restore(out.drop("n_gone"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    found = drop_repeated_lines(docs.withColumn("n_lines", n_lines), gone_col="n_removed")
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
