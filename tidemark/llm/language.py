"""Language identification by multilingual mixture inference.

Training counts hashed byte n-grams of every labelled text for each language
(partial sums per task, then one shuffle of at most languages x buckets rows
from each). Prediction treats a document as a mixture: expectation-maximisation
estimates the proportions of the languages from the n-gram likelihoods, and the
language set is the one of best likelihood less a penalty for each language.
Sets grow by forward selection among all languages, to any size: the language of
the steepest gradient joins, until the penalty wins or a bound from the gradient
tells that it would; most documents stop at one language without a run of EM.

The model has ``NUMBERS`` numbers at most for up to ``NUMBERS`` / 64 languages,
which bounds what is broadcast: from 128 languages on, buckets are folded.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every text if nothing could be learned. Null languages are not learned
from. Equal proportions go to the language that sorts first. Repeated rows
and extra columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import give_back, read_table, sealed

#: Bytes of an n-gram, hash buckets, numbers in a model.
GRAM = 4
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
NUMBERS, LEAST_BITS = 1 << 22, 6
#: Languages that a task counts before it sends their counts on, and numbers of EM that it holds at once.
TASK_LANGUAGES, EM_NUMBERS = 64, 1 << 22
#: Passes of EM.
PASSES = 12
#: A document whose main language has a smaller share is rejected by ``keep_known``.
MIN_SHARE = 0.5
UNKNOWN = "und"

#: ASCII letters in lower case; all other ASCII becomes a space.
_FOLD = bytes(b if b >= 128 else (b | 32 if chr(b).isalpha() else 32) for b in range(256))


def gram_buckets(text: str) -> np.ndarray:
    """The bucket of each n-gram of the folded text (uint16), or an empty array."""
    raw = b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split())
    if not raw:
        return np.empty(0, np.uint16)
    b = np.frombuffer(b" " + raw + b"  ", np.uint8).astype(np.uint32)
    code = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
    return (code * np.uint32(2654435761) >> np.uint32(32 - BUCKET_BITS)).astype(np.uint16)


def gram_counts(text: str, folded: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets, without their last ``folded`` bits, in order and how often each occurs."""
    s = np.sort(gram_buckets(text) >> np.uint16(folded), kind="stable")
    if not len(s):
        return s, np.empty(0, np.float32)
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[first], np.diff(np.append(first, len(s))).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    #: languages x buckets: probability of each bucket.
    p: np.ndarray
    #: Bits by which buckets are folded.
    folded: int = 0


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all labelled rows of ``docs``."""

    def rows_of(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "bucket", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    if len(sums) >= TASK_LANGUAGES:
                        yield from rows_of(sums)
                        sums = {}
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang] += np.bincount(gram_buckets(text), minlength=BUCKETS)
        give_back()
        yield from rows_of(sums)

    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    langs = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    folded = 0
    while len(langs) << BUCKET_BITS - folded > NUMBERS and BUCKET_BITS - folded > LEAST_BITS:
        folded += 1
    buckets = BUCKETS >> folded
    found = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", F.shiftright("bucket", folded).alias("bucket")).agg(F.sum("n").alias("n"))
    table = found.toArrow()  # NUMBERS rows at most
    counts = np.zeros((len(langs), buckets))
    if langs:
        row = {x: i for i, x in enumerate(langs)}
        who = np.array([row[x] for x in table.column("lang").to_pylist()])
        counts[who, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    p = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * buckets)
    return Model(langs, p.astype(np.float32), folded)


def _em(p: np.ndarray, c: np.ndarray, starts: np.ndarray, lens: np.ndarray, pi: np.ndarray, passes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over many documents at once. p: languages x n-grams, pi: languages x documents. Proportions, log-likelihoods, gradients less the evidence."""
    total = np.add.reduceat(c, starts)
    for step in range(passes + 1):
        mix = np.zeros_like(c)
        for k in range(len(p)):
            mix += p[k] * np.repeat(pi[k], lens)
        r = c / mix
        grow = np.stack([np.add.reduceat(p[k] * r, starts) for k in range(len(p))])
        if step == passes:
            ll = np.add.reduceat(c * np.log(mix), starts)
            return pi, ll, grow - total
        pi = pi * grow / total
        pi /= pi.sum(axis=0)
    raise AssertionError


def infer(model: Model, grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Proportions (languages x documents) of documents with one n-gram or more."""
    n_lang, n_doc = len(model.languages), len(grams)
    lens = np.array([len(u) for u, _ in grams])
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    u = np.concatenate([g for g, _ in grams])
    # Each letter is in GRAM n-grams: evidence counts once.
    c = np.concatenate([k for _, k in grams]) / np.float32(GRAM)
    p = model.p[:, u]
    scale = p.max(axis=0)
    p /= scale
    single = np.stack([np.add.reduceat(c * np.log(p[k]), starts) for k in range(n_lang)])
    best = np.zeros((n_lang, n_doc), np.float32)
    first = single.argmax(axis=0)
    best[first, np.arange(n_doc)] = 1
    if n_lang == 1:
        return best
    penalty = np.log(np.maximum(np.add.reduceat(c, starts), 2)) + 1
    score = single.max(axis=0).astype(np.float64)
    open_docs = np.arange(n_doc)
    for size in range(2, n_lang + 1):
        pick = np.concatenate([np.arange(starts[d], starts[d] + lens[d]) for d in open_docs]) if size > 2 else slice(None)
        some_p, some_c, some_lens = p[:, pick], c[pick], lens[open_docs]
        some_starts = np.concatenate(([0], np.cumsum(some_lens)[:-1]))
        # The likelihood is concave: no mixture gains more than the steepest gradient.
        gain = _em(some_p, some_c, some_starts, some_lens, best[:, open_docs], 0)[2]
        gain[best[:, open_docs] > 0] = -np.inf
        more = np.flatnonzero(gain.max(axis=0) > penalty[open_docs])
        if not len(more):
            break
        new, open_docs = gain.argmax(axis=0)[more], open_docs[more]
        pick = np.concatenate([np.arange(starts[d], starts[d] + lens[d]) for d in open_docs])
        some_p, some_c, some_lens = p[:, pick], c[pick], lens[open_docs]
        some_starts = np.concatenate(([0], np.cumsum(some_lens)[:-1]))
        first = best[:, open_docs] * np.float32((size - 1) / size)
        first[new, np.arange(len(open_docs))] = 1 / size
        got, ll, _ = _em(some_p, some_c, some_starts, some_lens, first, PASSES)
        value = ll - (size - 1) * penalty[open_docs]
        win = np.flatnonzero(value > score[open_docs])
        if not len(win):
            break
        open_docs = open_docs[win]
        score[open_docs] = value[win]
        best[:, open_docs] = got[:, win]
    return best


def inferred(model: Model, texts: list[str | None]) -> dict[int, np.ndarray]:
    """Proportions of each text with an n-gram, by its number; a bounded number of texts at a time."""
    out: dict[int, np.ndarray] = {}
    held: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []
    size = 0

    def flush() -> None:
        if held:
            pi = infer(model, [g for _, g in held])
            out.update({i: pi[:, k] for k, (i, _) in enumerate(held)})

    for i, t in enumerate(texts):
        if t is None or not model.languages or not len((g := gram_counts(t, model.folded))[0]):
            continue
        held.append((i, g))
        size += len(g[0]) * len(model.languages)
        if size >= EM_NUMBERS:
            flush()
            held, size = [], 0
    flush()
    return out


SHARES = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_shares", SHARES)])


def prediction(model: Model, text: Column, spark: SparkSession) -> Column:
    """struct(lang_pred, score, lang_shares) of a text. Only texts go to Python, and no text comes back."""
    shared = spark.sparkContext.broadcast(model)
    shares_type = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    @F.arrow_udf(PREDICTION)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for batch in batches:
            pred: list = []
            score: list = []
            shares: list = []
            for at in range(0, len(batch), 256):
                texts = batch.slice(at, 256).to_pylist()
                found: dict[int, list] = {}
                for i, pi in inferred(m, texts).items():
                    order = [j for j in np.argsort(-pi, kind="stable") if pi[j] > 0]
                    found[i] = [{"lang": m.languages[j], "share": float(min(1.0, pi[j]))} for j in order]
                for i in range(len(texts)):
                    own = found.get(i, [])
                    pred.append(own[0]["lang"] if own else UNKNOWN)
                    score.append(own[0]["share"] if own else 0.0)
                    shares.append(own)
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, shares_type)], names=["lang_pred", "score", "lang_shares"])
        give_back()

    return run(F.when(text.rlike(r"\p{L}"), text))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (share of that language) and lang_shares (array of language and share, largest first)."""
    inner, name, restore = sealed(docs)
    found = inner.withColumn("p", prediction(model, F.col(name(text_col)), docs.sparkSession))
    return restore(found.select(*inner.columns, "p.lang_pred", "p.score", "p.lang_shares"))


def held_out(doc_id: Column, parts: int, which: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == which, F.lit(False))


def keep_known(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_share: float = MIN_SHARE) -> DataFrame:
    """Rows of ``docs`` with a known main language; their columns as they were."""
    model = train(docs, text_col, lang_col)
    found = prediction(model, F.col(text_col), docs.sparkSession)
    return docs.where((found["lang_pred"] != UNKNOWN) & (found["score"] >= min_share))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = train(docs.where(~out))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score", F.size("lang_shares").alias("n_langs"))
