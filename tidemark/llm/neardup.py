"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets are one class from the start.
Each class has ``COORDINATES`` minwise tokens. A tree branches the classes by
the tokens at its chosen coordinates: the first two levels are the key of one
shuffle, larger nodes branch further within their task by more coordinates,
several at a time, so a similar pair is likely to stay together on some path.
Small nodes are compared exhaustively on the tokens; there are as many
independent trees as make a pair at the threshold share a key with the target
probability ``recall``. Of what a task finds it sends on no more than one edge
for each member, to the least member that it is connected with.

The trees give candidate groups: a group holds all documents connected by an
estimated similarity of ``CANDIDATE`` or more, some four standard errors below
the threshold. Within each group the full sets are then compared exactly. Only
documents not yet reached are compared, so a group of copies costs as many
comparisons as it has members, and no pair list is ever made.

Hot nodes and candidate groups too large for a task are dealt in blocks, and
each pair of blocks is compared in a task of its own, so no link is lost. Members
of a hot node that are like its first one are linked to it and not compared with
each other; the rest costs rows by the square of its blocks.

Defined cases: a text without words is linked with nothing; one with fewer
words than a shingle is one shingle; a null id is linked with nothing; rows
with the same id belong together; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, give_back, read_table, sealed
from tidemark.llm.components import connected_components
from tidemark.llm.hashing import mix, powers, shingle_sets, slices

COORDINATES = 64
#: Coordinates of a tree's key, and the probability that a pair at the threshold shares a key of some tree.
LEVELS, RECALL = 2, 0.99999
#: A pair of similarity 0.8 has fewer than this share of equal tokens once in 10^5.
CANDIDATE = 0.58
#: Nodes up to this size are compared exhaustively; larger ones branch by so many coordinates, so many levels deep.
SMALL_NODE = 256
BRANCHES = 3
MAX_LEVELS = 3
#: Members of a node that one task holds; shingles of a candidate group that one task holds.
NODE_ROWS = 4096
GROUP_SHINGLES = 6_000_000
#: More hot nodes than this are joined by a shuffle, not a broadcast.
BROADCAST_ROWS = 65536

_FACTORS = np.random.default_rng(77).integers(1, 1 << 62, COORDINATES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def trees(percent: int, recall: float = RECALL) -> int:
    """How many trees give a pair of ``percent`` similarity a shared key with probability ``recall``."""
    together = (percent / 100) ** LEVELS
    return 1 if together >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def tree_coordinates(n: int) -> list[np.ndarray]:
    """The coordinates of the keys of ``n`` trees."""
    rng = np.random.default_rng(78)
    return [rng.choice(COORDINATES, LEVELS, replace=False) for _ in range(n)]


def set_digest(s: np.ndarray) -> bytes:
    """16 bytes that stand for a set of shingles."""
    a = np.sum(mix(s ^ np.uint64(0x1234567)), dtype=np.uint64)
    b = np.sum(mix(s * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens: sets x COORDINATES. All sets must have a member."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    flat = np.concatenate(sets)
    out = np.empty((len(sets), COORDINATES), np.uint64)
    for i, f in enumerate(_FACTORS):
        x = flat * f
        out[:, i] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
    return out


def _sketch_rows(shingle: int, n_trees: int):
    pairs = tree_coordinates(n_trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = part.column(0)
                texts = [b"" if t is None else t.encode("utf-8", "replace").lower() for t in part.column(1).to_pylist()]
                sizes = np.zeros(len(texts), np.int64)
                digest: list = [None] * len(texts)
                keys: list = [None] * len(texts)
                tokens: list = [None] * len(texts)
                for lo, hi in slices(texts):
                    sets = shingle_sets(texts[lo:hi], shingle)
                    have = [i for i, s in enumerate(sets) if len(s)]
                    if not have:
                        continue
                    sig = sketches([sets[i] for i in have])
                    path = np.stack([mix(sig[:, a] * powers(3)[1] + sig[:, b] * powers(3)[2] + np.uint64(t + 1)) for t, (a, b) in enumerate(pairs)], axis=1).view(np.int64)
                    small = mix(sig).astype(np.uint8)
                    for k, i in enumerate(have):
                        sizes[lo + i] = len(sets[i])
                        digest[lo + i] = set_digest(sets[i])
                        keys[lo + i] = path[k]
                        tokens[lo + i] = small[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(tokens, pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "keys", "tokens"],
                )
        give_back()

    return run


def _spread(n: int, near) -> list[tuple[int, int]]:
    """Spanning edges of the graph on 0..n-1 in which ``near(i, rest)`` tells which of ``rest`` are neighbours of i."""
    edges = []
    rest = np.arange(n)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            if hit.any():
                found = rest[hit]
                edges += [(i, j) for j in found]
                queue += list(found)
                rest = rest[~hit]
    return edges


def node_edges(tokens: np.ndarray, seed: int = 0, level: int = 0) -> list[tuple[int, int]]:
    """Spanning edges among the members of a node by estimated similarity (tokens: members x COORDINATES)."""
    n = len(tokens)
    need = int(np.ceil(CANDIDATE * COORDINATES))
    if n <= SMALL_NODE or level >= MAX_LEVELS:
        return _spread(n, lambda i, rest: (tokens[rest] == tokens[i]).sum(axis=1) >= need)
    edges = []
    for c in np.random.default_rng([seed, level, n]).choice(COORDINATES, BRANCHES, replace=False):
        order = np.argsort(tokens[:, c], kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(tokens[order, c])) + 1):
            if len(own) > 1:
                edges += [(own[i], own[j]) for i, j in node_edges(tokens[own], seed + int(c) + 1, level + 1)]
    return edges


def exact_edges(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning edges among sets by 100 x intersection >= percent x union, exactly."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (sizes.sum() - both) else []
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    flag = np.zeros(len(values), bool)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(rest), bool)
        fits = np.flatnonzero((100 * sizes[rest] >= percent * sizes[i]) & (percent * sizes[rest] <= 100 * sizes[i]))
        if not len(fits):
            return hit
        mine = ids[starts[i] : starts[i + 1]]
        flag[mine] = True
        for lo in range(0, len(fits), 256):
            own = rest[fits[lo : lo + 256]]
            pick = np.concatenate([ids[starts[j] : starts[j + 1]] for j in own])
            both = np.add.reduceat(flag[pick].astype(np.int64), np.concatenate(([0], np.cumsum(sizes[own])[:-1])))
            hit[fits[lo : lo + 256]] = 100 * both >= percent * (sizes[own] + sizes[i] - both)
        flag[mine] = False
        return hit

    return _spread(len(sets), near)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal first columns of sorted batches, whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(int(lo), int(hi - lo))
            if held and held[0].column(0)[0].as_py() != int(key[lo]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over ids; the root of a tree is its least id."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = parent.get(x, x)
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top and up != x:
            parent[x] = top
            x = up
        return top

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def __len__(self) -> int:
        return len(self.parent)

    def edges(self) -> pa.RecordBatch:
        """(least id, id) of each id that is joined to a lesser one."""
        ids = list(self.parent)
        return pa.RecordBatch.from_arrays([pa.array([self.root(i) for i in ids], pa.int64()), pa.array(ids, pa.int64())], names=["a", "b"])


#: Joined ids that a task holds before it sends them on.
FOREST_IDS = 1_000_000


def _node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, member, tokens), sorted by node -> candidate edges."""
    found = Forest()

    def handle(key: int, members: np.ndarray, tokens: np.ndarray) -> None:
        for i, j in node_edges(tokens, key & 0x7FFFFFFF):
            found.join(int(members[i]), int(members[j]))

    held: list[tuple[np.ndarray, np.ndarray]] = []
    held_key = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, member = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, COORDINATES)
        cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [n]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held_key is not None and held_key != key[lo]:
                if sum(len(m) for m, _ in held) > 1:
                    handle(int(held_key), np.concatenate([m for m, _ in held]), np.concatenate([t for _, t in held]))
                held = []
            held_key = key[lo]
            if hi - lo > 1 and lo > 0 and hi < n:
                handle(int(held_key), member[lo:hi], tokens[lo:hi])
                held = []
            elif hi - lo > 1 or lo == 0 or hi == n:
                held.append((member[lo:hi], tokens[lo:hi]))
        if len(found) > FOREST_IDS:
            yield found.edges()
            found = Forest()
    if held and sum(len(m) for m, _ in held) > 1:
        handle(int(held_key), np.concatenate([m for m, _ in held]), np.concatenate([t for _, t in held]))
    yield found.edges()
    give_back()


def _exact_rows(shingle: int, percent: int):
    """(group, member, digest, text), sorted by group -> exact edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def small() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    yield batch.slice(at, 200)

        def with_sets() -> Iterator[tuple[int, int, bytes, np.ndarray]]:
            for batch in small():
                texts = [t.encode("utf-8", "replace").lower() for t in batch.column(3).to_pylist()]
                sets = [s for lo, hi in slices(texts) for s in shingle_sets(texts[lo:hi], shingle)]
                for g, m, d, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), sets, strict=True):
                    if set_digest(s) == d:
                        yield g, m, d, s

        found = Forest()

        def handle(group: dict) -> None:
            members = list(group)
            if len(members) > 1:
                for i, j in exact_edges([group[m] for m in members], percent):
                    found.join(members[i][0], members[j][0])

        at, group = None, {}
        for g, m, d, s in with_sets():
            if g != at:
                handle(group)
                at, group = g, {}
            group[(m, d)] = s
            if len(found) > FOREST_IDS:
                yield found.edges()
                found = Forest()
        handle(group)
        yield found.edges()
        give_back()

    return run


def _beside_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, member, tokens, head, head_tokens) -> (node, member, tokens, head, alike)."""
    need = int(np.ceil(CANDIDATE * COORDINATES))
    for batch in batches:
        own, head = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, COORDINATES) for i in (2, 4))
        alike = (own == head).sum(axis=1) >= need
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(alike)], names=["node", "member", "tokens", "head", "alike"])
    give_back()


def _deal_hot(nodes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(nodes, edges): nodes of over ``limit`` rows in blocks, each pair of blocks a node of its own.

    Members like the node's first one are linked to it by ``edges``, so pairs of their blocks are left out.
    """
    hot = cut(nodes.groupBy("node").agg(F.count("*").alias("rows"), F.min(F.struct("member", "tokens")).alias("first")).where(F.col("rows") > limit))
    n_hot = hot.count()
    if not n_hot:
        return nodes, None

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if n_hot <= BROADCAST_ROWS else df

    heads = hot.select("node", F.col("first.member").alias("head"), F.col("first.tokens").alias("head_tokens"))
    rows = nodes.join(side(heads), "node").select("node", "member", "tokens", "head", "head_tokens")
    rows = cut(rows.mapInArrow(_beside_head, "node long, member long, tokens binary, head long, alike boolean"))
    blocks = rows.groupBy("node").agg(*[F.ceil(2 * F.count_if(F.col("alike") == f) / limit).cast("int").alias(n) for n, f in (("n_alike", True), ("n_other", False))])
    placed = rows.join(side(blocks.where("n_other > 0")), "node")
    own = F.pmod(F.xxhash64("member", "node"), F.when(F.col("alike"), F.col("n_alike")).otherwise(F.col("n_other"))).cast("int")

    def keys(n: str, kind: str, first, second) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda j: F.xxhash64("node", F.lit(kind), first(j), second(j)))

    with_others = F.when(F.col("alike"), keys("n_other", "mixed", lambda j: own, lambda j: j)).otherwise(F.concat(keys("n_other", "others", lambda j: F.least(own, j), lambda j: F.greatest(own, j)), keys("n_alike", "mixed", lambda j: j, lambda j: own)))
    dealt = placed.withColumn("node", F.explode(with_others)).select("node", "member", "tokens")
    edges = rows.where("alike and member <> head").select(F.least("member", "head").alias("a"), F.greatest("member", "head").alias("b"))
    return nodes.join(side(hot.select("node")), "node", "left_anti").unionByName(dealt), edges


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, recall: float = RECALL, node_rows: int = NODE_ROWS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id): a row for each row of ``docs``."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(slim.mapInArrow(_sketch_rows(shingle, trees(percent, recall)), "doc_id long, n_shingles long, digest binary, keys array<long>, tokens binary"))
    classes = cut(
        rows.where("doc_id is not null and n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("member"), F.first("keys").alias("keys"), F.first("tokens").alias("tokens"), F.first("n_shingles").alias("n"))
    )
    nodes = classes.select(F.explode("keys").alias("node"), "member", "tokens")
    dealt, edges = _deal_hot(nodes, node_rows)
    candidates = dealt.repartition("node").sortWithinPartitions("node").mapInArrow(_node_rows, "a long, b long")
    candidates = (candidates if edges is None else candidates.unionByName(edges)).distinct()
    groups = connected_components(candidates)
    members = classes.join(groups, F.col("member") == F.col("node")).select("member", "digest", "n", F.col("component").alias("grp"))
    members = cut(members)
    # Groups that a task can hold stay whole; of others each pair of blocks is a group of its own.
    sizes = members.groupBy("grp").agg(F.sum("n").alias("total")).where(F.col("total") > group_shingles).select(F.col("grp").alias("big"), F.ceil(2 * F.col("total") / group_shingles).cast("int").alias("blocks"))
    sizes = cut(sizes)
    n_big = sizes.count()
    if n_big:
        placed = members.join(F.broadcast(sizes) if n_big <= BROADCAST_ROWS else sizes, F.col("grp") == F.col("big"), "left")
        own = F.pmod(F.xxhash64("member", "digest"), F.col("blocks")).cast("int")
        others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64(F.col("grp"), F.least(own, j), F.greatest(own, j)))
        members = placed.withColumn("grp", F.explode(F.when(F.col("big").isNull(), F.array(F.col("grp"))).otherwise(others))).select("member", "digest", "n", "grp")
    texts = slim.join(members, F.col("doc_id") == F.col("member")).select("grp", "member", "digest", "text")
    links = cut(texts.repartition("grp").sortWithinPartitions("grp").mapInArrow(_exact_rows(shingle, percent), "a long, b long"))
    found = connected_components(links)
    reps = classes.select(F.col("digest").alias("d2"), "member").join(found, F.col("member") == F.col("node"), "left").select("d2", F.coalesce("component", "member").alias("component"))
    by_set = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    return by_set.join(reps, F.col("digest") == F.col("d2"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group; of rows with one id, one stays. Rows without an id all stay."""
    inner, name, restore = sealed(docs)
    found = near_components(docs, id_col=id_col, text_col=text_col, **options)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    key = F.col(name(id_col))
    kept = inner.where(key.isNotNull()).join(gone, key == F.col("gone_id"), "left_anti").dropDuplicates([name(id_col)])
    return restore(kept.unionByName(inner.where(key.isNull())))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(read_table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
