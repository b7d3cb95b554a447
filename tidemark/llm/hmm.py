"""Scoring of documents by a hidden Markov language model.

A document is its words (A-Z in lower case) and one end token. Hidden states
emit symbols: the end, or one of ``SYMBOLS`` hash classes of words; within its
class a word has its smoothed share of the class's training tokens. So

    P(text) = P(symbols by the hidden Markov chain) x product of P(word | class)

is an exact likelihood with a model of bounded size over an unbounded
vocabulary. Baum-Welch counts are gathered in each task, summed by symbol in a
shuffle and turned into the next model on the driver (states x symbols numbers,
whatever the corpus). The scaled forward recursion gives the likelihood.

Words are known by a 64-bit hash. Word counts are exact over all training
documents and never leave the cluster: documents are packed in blocks of about
``BLOCK_WORDS`` words with a vocabulary of their own, which is joined with the
corpus counts and comes back to the block. Seeds of the states come from
``SEED_DOCS`` documents by a mixture of multinomials; every Baum-Welch pass
covers all training documents.

Defined cases: a null or empty text is one end token; without training
documents all tokens are unknown and the model is uniform; a null id is a
training document; repeated rows count and return as often as they occur; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, give_back, read_table
from tidemark.llm.hashing import Words, mix, slices
from tidemark.llm.language import held_out

STATES = 8
SYMBOL_BITS = 14
SYMBOLS = 1 << SYMBOL_BITS
END = SYMBOLS
PASSES = 3
BLOCK_WORDS = 2_500_000
SEED_DOCS = 256
SEED_WORDS = (50, 4000)
#: Weight of the corpus distribution in each state's emissions, and of uniform moves.
PRIOR_TOKENS = 200.0
PRIOR_MOVES = 1.0
STAY = 0.98

BLOCK_SCHEMA = "doc_ids array<long>, held array<boolean>, lens array<int>, vocab array<long>, counts array<long>, stream binary"


@dataclass
class Chain:
    start: np.ndarray
    move: np.ndarray
    #: (SYMBOLS + 1) x states.
    emit: np.ndarray


# -- blocks -------------------------------------------------------------------
def _block(ids: list, held: list, lens: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
    n = np.concatenate(lens) if lens else np.empty(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    vocab, local = np.unique(h, return_inverse=True)
    train = np.repeat(~np.array(held, bool), n)
    counts = np.bincount(local[train], minlength=len(vocab)).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([held], pa.list_(pa.bool_())),
            pa.array([n.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([vocab.view(np.int64)], pa.list_(pa.int64())),
            pa.array([counts], pa.list_(pa.int64())),
            pa.array([local.astype(np.int32).tobytes()], pa.binary()),
        ],
        names=["doc_ids", "held", "lens", "vocab", "counts", "stream"],
    )


def _pack(block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, lens, hashes, total = [], [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                own, out = part.column(0).to_pylist(), part.column(2).to_pylist()
                texts = [b"" if t is None else t.encode("utf-8", "replace").lower() for t in part.column(1).to_pylist()]
                for lo, hi in slices(texts):
                    w = Words(texts[lo:hi])
                    ids += own[lo:hi]
                    held += out[lo:hi]
                    lens.append(np.diff(w.first))
                    hashes.append(w.hash)
                    total += len(w.hash)
                    if total >= block_words:
                        yield _block(ids, held, lens, hashes)
                        ids, held, lens, hashes, total = [], [], [], [], 0
        if ids:
            yield _block(ids, held, lens, hashes)
        ids, held, lens, hashes = [], [], [], []
        give_back()

    return run


def symbols_of(vocab: np.ndarray) -> np.ndarray:
    return (mix(vocab.view(np.uint64)) & np.uint64(SYMBOLS - 1)).astype(np.int32)


class Sequences:
    """Symbol sequences of some documents (end token included), longest first."""

    def __init__(self, lens: np.ndarray, symbols: np.ndarray, pick: np.ndarray):
        first = np.concatenate(([0], np.cumsum(lens)))
        self.order = pick[np.argsort(-lens[pick], kind="stable")]
        self.n = lens[self.order] + 1
        self.offset = np.cumsum(self.n) - self.n
        self.symbols = np.full(int(self.n.sum()), END, np.int32)
        place = np.arange(len(self.symbols)) - np.repeat(self.offset, self.n)
        source = np.repeat(first[self.order], self.n) + place
        inside = place < np.repeat(self.n - 1, self.n)
        self.symbols[inside] = symbols[source[inside]]
        #: How many of the documents are still running at each step.
        self.active = np.searchsorted(-self.n, -np.arange(int(self.n[0]) if len(self.n) else 0), side="left")


def forward(c: Chain, s: Sequences, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Log-likelihood of each document (in ``s.order``); with ``keep`` the scaled alphas and the scales of each token."""
    ll = np.zeros(len(s.n))
    emit, move = c.emit.astype(np.float32), c.move.astype(np.float32)
    alphas = np.empty((len(s.symbols), emit.shape[1]), np.float32) if keep else None
    scales = np.empty(len(s.symbols), np.float32) if keep else None
    a = None
    for t, n in enumerate(s.active):
        at = s.offset[:n] + t
        e = emit[s.symbols[at]]
        a = c.start.astype(np.float32) * e if t == 0 else (a[:n] @ move) * e
        z = a.sum(axis=1)
        a /= z[:, None]
        ll[:n] += np.log(z)
        if keep:
            alphas[at] = a
            scales[at] = z
    return ll, alphas, scales


def expected_counts(c: Chain, s: Sequences) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts: of starts, moves, emissions ((SYMBOLS + 1) x states), and the log-likelihood."""
    k = len(c.start)
    if not len(s.n):
        return np.zeros(k), np.zeros((k, k)), np.zeros((SYMBOLS + 1, k)), 0.0
    ll, alphas, scales = forward(c, s, keep=True)
    emit, move = c.emit.astype(np.float32), c.move.astype(np.float32)
    moves = np.zeros((k, k))
    b = np.ones((len(s.n), k), np.float32)
    later = 0
    for t in range(len(s.active) - 1, -1, -1):
        n = s.active[t]
        at = s.offset[:n] + t
        if later:
            nxt = s.offset[:later] + t + 1
            eb = emit[s.symbols[nxt]] * b[:later] / scales[nxt][:, None]
            moves += alphas[at[:later]].T @ eb
            b[:later] = eb @ move.T
        alphas[at] *= b[:n]
        later = n
    moves *= c.move
    start = alphas[s.offset].astype(np.float64).sum(axis=0)
    emissions = np.stack([np.bincount(s.symbols, weights=alphas[:, j], minlength=SYMBOLS + 1) for j in range(k)], axis=1)
    return start, moves, emissions, float(ll.sum())


def _block_arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """lens, held, local word ids, vocabulary of a block."""
    return row["lens"], row["held"], np.frombuffer(row["stream"], np.int32), row["vocab"]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Blocks of a batch, lists as numpy arrays."""
    for i in range(batch.num_rows):
        row = {}
        for name, col in zip(batch.schema.names, batch.columns, strict=True):
            x = col[i]
            row[name] = None if not x.is_valid else x.values.to_numpy(zero_copy_only=False) if isinstance(x, pa.ListScalar) else x.as_py()
        yield row


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, symbols) of a block's training documents with the least keys."""
    for batch in batches:
        for row in _rows(batch):
            lens, held, local, vocab = _block_arrays(row)
            if not len(lens):
                continue
            first = np.concatenate(([0], np.cumsum(lens)))
            fit = np.flatnonzero(~held.astype(bool) & (lens >= SEED_WORDS[0]) & (lens <= SEED_WORDS[1]))
            key = mix(vocab.view(np.uint64)[local[first[fit]]] + lens[fit].astype(np.uint64)) >> np.uint64(1)
            sym = symbols_of(vocab)
            best = np.argsort(key, kind="stable")[:SEED_DOCS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[best].astype(np.int64)), pa.array([sym[local[first[d] : first[d + 1]]] for d in fit[best]], pa.list_(pa.int32()))], names=["key", "symbols"]
            )


def seed_chain(docs: list[np.ndarray], background: np.ndarray, states: int) -> Chain:
    """A chain whose states are the parts of a mixture of multinomials over seed documents."""
    start = np.full(states, 1 / states)
    emit = np.repeat(background[:, None], states, axis=1)
    if docs:
        x = np.stack([np.bincount(d, minlength=SYMBOLS + 1) for d in docs]).astype(np.float64)
        p = x / x.sum(axis=1, keepdims=True)
        root = np.sqrt(p)
        chosen = [0]
        near = root @ root[0]
        while len(chosen) < min(states, len(docs)):
            chosen.append(int(np.argmin(near)))
            near = np.maximum(near, root @ root[chosen[-1]])
        emit[:, : len(chosen)] = 0.5 * p[chosen].T + 0.5 * background[:, None]
        for _ in range(15):
            like = x @ np.log(emit) + np.log(start)
            r = np.exp(like - like.max(axis=1, keepdims=True))
            r /= r.sum(axis=1, keepdims=True)
            start = (r.sum(axis=0) + 1) / (len(docs) + states)
            c = (r.T @ x).T
            emit = (c + PRIOR_TOKENS * background[:, None]) / (c.sum(axis=0) + PRIOR_TOKENS)
    move = np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return Chain(start, move, emit)


def train_chain(blocks: DataFrame, background: np.ndarray, states: int = STATES, passes: int = PASSES) -> Chain:
    """Baum-Welch over the training documents of all blocks."""
    sc = blocks.sparkSession.sparkContext
    found = blocks.select("held", "lens", "vocab", "stream").mapInArrow(_seed_rows, "key long, symbols array<int>").orderBy("key", F.size("symbols")).limit(SEED_DOCS).toArrow()
    chain = seed_chain([np.array(d) for d in found.column("symbols").to_pylist()], background, states)
    for _ in range(passes):
        shared = sc.broadcast(chain)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c: Chain = shared.value
            k = len(c.start)
            start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((SYMBOLS + 1, k))
            for batch in batches:
                for row in _rows(batch):
                    lens, held, local, vocab = _block_arrays(row)
                    s = Sequences(lens.astype(np.int64), symbols_of(vocab)[local], np.flatnonzero(~held.astype(bool)))
                    a, b, e, _ = expected_counts(c, s)
                    start, move, emit = start + a, move + b, emit + e
            give_back()
            seen = np.flatnonzero(emit.any(axis=1))
            table = np.concatenate([emit[seen], move, start[None]])
            key = np.concatenate([seen, -1 - np.arange(k), [-1 - k]])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64())] + [pa.array(table[:, j]) for j in range(k)], names=["key"] + [f"s{j}" for j in range(k)])

        schema = "key long, " + ", ".join(f"s{j} double" for j in range(states))
        got = blocks.select("held", "lens", "vocab", "stream").mapInArrow(count, schema).groupBy("key").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(states)]).toArrow()
        key = got.column("key").to_numpy()
        table = np.stack([got.column(f"s{j}").to_numpy() for j in range(states)], axis=1)
        counts = np.zeros((SYMBOLS + 1, states))
        counts[key[key >= 0]] = table[key >= 0]
        move, start = np.zeros((states, states)), np.zeros(states)
        for i, row in zip(key, table, strict=True):
            if i == -1 - states:
                start = row
            elif i < 0:
                move[-1 - i] = row
        chain = Chain(
            (start + PRIOR_MOVES / states) / (start.sum() + PRIOR_MOVES),
            (move + PRIOR_MOVES / states) / (move.sum(axis=1, keepdims=True) + PRIOR_MOVES),
            (counts + PRIOR_TOKENS * background[:, None]) / (counts.sum(axis=0) + PRIOR_TOKENS),
        )
        shared.unpersist()
    return chain


def score(docs: DataFrame, out: Column, *, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, passes: int = PASSES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Scores each row of ``docs``; rows where ``out`` holds are not learned from."""
    spark = docs.sparkSession
    packed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(out, F.lit(False)).alias("held")).mapInArrow(_pack(block_words), BLOCK_SCHEMA)
    blocks = cut(packed.withColumn("block_id", F.monotonically_increasing_id()))

    # Corpus counts: one row for each word seen in training.
    vocab = cut(blocks.select(F.explode(F.arrays_zip("vocab", "counts")).alias("x")).select(F.col("x.vocab").alias("word"), F.col("x.counts").alias("n")).where("n > 0").groupBy("word").agg(F.sum("n").alias("n")))
    train_docs = blocks.select(F.sum(F.size(F.filter("held", lambda h: ~h)).cast("long"))).first()[0] or 0

    def by_symbol(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, tokens = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
        for batch in batches:
            s = symbols_of(batch.column(0).to_numpy(zero_copy_only=False))
            types += np.bincount(s, minlength=SYMBOLS)
            np.add.at(tokens, s, batch.column(1).to_numpy(zero_copy_only=False))
        at = np.flatnonzero(types)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(types[at]), pa.array(tokens[at])], names=["symbol", "types", "tokens"])

    per = vocab.mapInArrow(by_symbol, "symbol long, types long, tokens long").groupBy("symbol").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).toArrow()
    types, tokens = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
    types[per.column("symbol").to_numpy()] = per.column("types").to_numpy()
    tokens[per.column("symbol").to_numpy()] = per.column("tokens").to_numpy()
    total = int(tokens.sum()) + train_docs
    distinct = int(types.sum()) + (train_docs > 0)
    background = np.append(tokens, train_docs) + 0.5
    background /= background.sum()

    chain = train_chain(blocks, background, states, passes)

    # Each block's vocabulary with its corpus counts.
    asked = blocks.select("block_id", F.posexplode("vocab").alias("pos", "w")).select("w", F.struct(F.col("block_id"), F.col("pos")).alias("at"))
    found = asked.join(vocab, F.col("w") == F.col("word")).groupBy(F.col("at.block_id").alias("b2")).agg(F.collect_list(F.col("at.pos")).alias("pos"), F.collect_list("n").alias("n"))
    ready = blocks.drop("counts").join(found, F.col("block_id") == F.col("b2"), "left").drop("block_id", "b2")
    shared = spark.sparkContext.broadcast((chain, types, tokens, total, distinct, train_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, types, tokens, total, distinct, train_docs = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = next(_rows(batch.slice(i, 1)))
                lens, _, local, words = _block_arrays(row)
                lens = lens.astype(np.int64)
                n = np.zeros(len(words))
                if row["pos"] is not None:
                    n[row["pos"]] = row["n"]
                sym = symbols_of(words)
                base = np.log10((n + 0.5) / (total + 0.5 * (distinct + 1)))
                within = np.log10((n + 0.5) / (tokens[sym] + 0.5 * (types[sym] + 1)))
                first = np.concatenate(([0], np.cumsum(lens)))

                def per_doc(x: np.ndarray, first: np.ndarray = first, local: np.ndarray = local) -> np.ndarray:
                    run_sum = np.concatenate(([0.0], np.cumsum(x[local])))
                    return run_sum[first[1:]] - run_sum[first[:-1]]

                s = Sequences(lens, sym[local], np.arange(len(lens)))
                ll, _, _ = forward(c, s)
                chain_score = np.empty(len(lens))
                chain_score[s.order] = ll / np.log(10)
                end = np.log10((train_docs + 0.5) / (total + 0.5 * (distinct + 1)))
                known = per_doc((n > 0).astype(np.float64)).round().astype(np.int64) + int(train_docs > 0)
                held = batch.slice(i, 1).column(batch.schema.get_field_index("held"))[0].values
                ids = batch.slice(i, 1).column(batch.schema.get_field_index("doc_ids"))[0].values
                yield pa.RecordBatch.from_arrays(
                    [ids, held, pa.array(lens + 1), pa.array(known), pa.array(np.full(len(lens), total, np.int64)), pa.array(per_doc(base) + end), pa.array(chain_score + per_doc(within))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return ready.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 1))
