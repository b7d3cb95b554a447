"""Quality rules by distribution divergence.

A document is compared with the reference of its language: the histogram of
character classes and that of the language's most common words (all others in
one class), both summed over the whole corpus. The Jensen-Shannon distance
(base 2, 0..1) to each must not exceed its threshold. A histogram of too few
characters or words says nothing, so each test has a minimum length below which
it passes. Base rules on length and repetition come first.

All work is done by SQL functions: one job counts words, one measures every
document; the measures are checkpointed, and references are their sums. Tables
with a row for each language are broadcast up to ``BROADCAST_LANGUAGES`` rows.

Defined cases: a null text has no words, and fails the base rules; documents
without a language are a language of their own; words of equal count go in
code point order; repeated rows count and return as they are; an empty table
gives no rows; columns other than the text pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, WORD, bound, cut, read_table, sealed

#: Character classes of the histogram, with white space; all others (lower-case and caseless letters) are one more class.
CLASSES = {
    "upper": r"\p{Lu}",
    "digit": r"\p{N}",
    "stop": r"[.,;:!?'\"()-]",
    "symbol": r"[#*$%&|<>=+@^~/_\\\[\]{}`]",
}
COMMON_WORDS = 16
BROADCAST_LANGUAGES = 4096
#: Distances above these fail; tests on fewer characters or words pass.
MAX_CHAR_DISTANCE = 0.27
MAX_WORD_DISTANCE = 0.42
MIN_CHARS = 200
MIN_WORDS = 60
#: Base rules.
MIN_BASE_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more in ``w``.

    A window's hash and place share a long, so equal windows stand together in one
    sort of numbers; the place takes as many bits as it needs. Neighbours of equal
    hash are compared on their words. Only if two of them differ, windows are sorted
    by their words instead, so the count is exact however short the hash is.
    """

    def equal(p: Column, q: Column) -> Column:
        return (F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def by_words() -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.struct(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("k"), i.alias("at")))

        def same(s: Column, i: Column, x: Column) -> Column:
            return F.coalesce(F.get(s, i)["k"] == x["k"], F.lit(False))

        return bound(F.sort_array(windows), lambda s: bound(F.sort_array(F.transform(F.filter(s, lambda x, i: same(s, i - 1, x) | same(s, i + 1, x)), lambda x: x["at"])), covered))

    def count(packed: Column, bits: Column) -> Column:
        def hash_of(x: Column) -> Column:
            return F.call_function("shiftright", x, bits)

        def place(x: Column) -> Column:
            return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

        def same(s: Column, i: Column, x: Column) -> Column:
            return F.coalesce(hash_of(F.get(s, i)) == hash_of(x), F.lit(False))

        def told(near: Column) -> Column:
            def differs(x: Column, i: Column) -> Column:
                y = F.get(near, i - 1)
                return F.coalesce((hash_of(y) == hash_of(x)) & ~equal(place(y), place(x)), F.lit(False))

            return F.when(F.size(F.filter(near, differs)) > 0, by_words()).otherwise(bound(F.sort_array(F.transform(near, place)), covered))

        return bound(F.sort_array(packed), lambda s: bound(F.filter(s, lambda x, i: same(s, i - 1, x) | same(s, i + 1, x)), told))

    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(
        bound(
            F.length(F.bin(F.size(w))),
            lambda bits: bound(
                F.transform(
                    F.sequence(F.lit(0), F.size(w) - 3),
                    lambda i: F.call_function("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")),
                ),
                lambda packed: count(packed, bits),
            ),
        )
    )


def dup_lines(text: Column) -> Column:
    return bound(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two histograms (arrays of counts); null if one is empty."""

    def share(h: Column) -> Column:
        return bound(F.aggregate(h, F.lit(0.0), lambda s, x: s + x), lambda total: F.when(total > 0, F.transform(h, lambda x: x / total)))

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, 0.5 * p * F.log2(p / m)).otherwise(0.0)

    terms = F.zip_with(share(a), share(b), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return bound(total, lambda t: F.when(t.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))))


def _small(table: DataFrame) -> DataFrame:
    """A table with a row for each language, broadcast if it has few."""
    table = cut(table)
    return F.broadcast(table) if table.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES else table


def common_words(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(ref_lang, common): the most frequent words of each language."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("ref_lang"), F.explode(words(F.lower(text_col))).alias("word"))
    counted = rows.groupBy("ref_lang", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("ref_lang").orderBy(F.desc("n"), "word")
    top = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= COMMON_WORDS)
    listed = F.sort_array(F.collect_list(F.struct("r", "word")))
    return _small(top.groupBy("ref_lang").agg(F.transform(listed, lambda x: x["word"]).alias("common")))


def common_counts(w: Column, common: Column) -> Column:
    """How often each of ``common`` is in ``w`` (case ignored), then all others."""
    return bound(
        F.filter(F.transform(w, lambda x: F.array_position(common, F.lower(x))), lambda c: c > 0),
        lambda hits: F.concat(
            F.transform(common, lambda _, k: (F.size(hits) - F.size(F.array_remove(hits, (k + 1).cast("long")))).cast("long")),
            F.array((F.size(w) - F.size(hits)).cast("long")),
        ),
    )


def measure(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """The columns of ``docs`` but its text, ref_lang, and ``m``: counts and the two histograms."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    common = common_words(docs, text_col, lang_col)
    rows = docs.join(common, F.coalesce(F.col(lang_col), F.lit("")) == F.col("ref_lang"), "left")
    measures = bound(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            dup_lines(text).alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
            F.length(text).cast("long").alias("n_chars"),
            F.array(*[F.regexp_count(text, F.lit(p)).cast("long") for p in CLASSES.values()]).alias("classes"),
            common_counts(w, F.coalesce("common", F.array().cast("array<string>"))).alias("commons"),
        ),
    )
    return rows.select(*[docs[c] for c in docs.columns if c != text_col], F.coalesce(F.col(lang_col), F.lit("")).alias("ref_lang"), measures.alias("m"))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the text, with the base counts, base_failed, kept, char_distance and word_distance."""
    docs, name, restore = sealed(docs)
    text_col, lang_col = name(text_col), name(lang_col)
    m = F.col("m")
    chars = F.concat(
        m["classes"],
        F.array(m["n_chars"] - m["word_chars"], m["word_chars"] - F.aggregate(m["classes"], F.lit(0).cast("long"), lambda a, x: a + x)),
    )
    measured = cut(measure(docs, text_col, lang_col).withColumn("chars", chars))
    width, depth = len(CLASSES) + 2, COMMON_WORDS + 1

    def sums(col: Column, n: int) -> Column:
        return F.array(*[F.coalesce(F.sum(F.get(col, F.lit(i))), F.lit(0)) for i in range(n)])

    refs = measured.groupBy(F.col("ref_lang").alias("r_lang")).agg(sums(F.col("chars"), width).alias("ref_chars"), sums(m["commons"], depth).alias("ref_commons"))
    rows = measured.join(_small(refs), F.col("ref_lang") == F.col("r_lang"), "left")
    # A language with fewer common words than asked for has a shorter histogram.
    rows = rows.withColumns(
        {
            "char_distance": js_distance(F.col("chars"), F.col("ref_chars")),
            "word_distance": js_distance(m["commons"], F.slice("ref_commons", F.lit(1), F.size(m["commons"]))),
        }
    )
    failed = (m["n_words"] < MIN_BASE_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    chars_ok = (m["n_chars"] < MIN_CHARS) | (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE)
    words_ok = (m["n_words"] < MIN_WORDS) | (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    judged = rows.select(
        *[measured[c] for c in docs.columns if c != text_col],
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        (~failed & chars_ok & words_ok).alias("kept"),
        "char_distance",
        "word_distance",
    )
    return restore(judged)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs).drop("lang")
