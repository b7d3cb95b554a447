"""Merkle tree fingerprints of documents.

A text is split without loss into paragraphs (lines) and these into clauses.
The leaves are digests of clauses; a paragraph's digest covers its leaves, a
section's its paragraphs, the root the sections. A section ends after a
paragraph whose digest starts with 0-3, so an edit moves no section but its
own. Equal roots mean equal texts; branches whose digests differ locate edits.

A fingerprint is a string: ``root/section:paragraph.leaves paragraph.leaves/...``
with 64, 8, 8 and 8 hexadecimal digits for each. The likeness of two is found
from the root down: equal roots end the walk, equal sections count whole, equal
paragraphs of the other sections count whole, and only the leaves of what
differs are compared one by one.

The neighbour of each document in ascending id order comes from a window within
ranges of ids of about ``RANGE_BYTES`` of text; a copy of the first row of the
next range stands at the end of each range, so no window crosses ranges.

Defined cases: a null text is an empty text; an empty text has one paragraph
without a leaf; of rows with the same id the one whose text hashes lower comes
first; a single row is its own neighbour; an empty table gives no rows; extra
columns pass through ``fingerprints``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bound, cut, free_name, read_table, sealed

#: Text bytes of an id range, and ranges at most.
RANGE_BYTES = 2 << 20
MAX_RANGES = 65536
#: A clause ends after one of these marks and a blank.
CLAUSE = r"(?<=[.,;:!?] )"


def _paragraph(p: Column) -> Column:
    return bound(
        F.transform(F.split(p, CLAUSE, -1), lambda s: F.md5(s)),
        lambda leaves: F.struct(F.md5(F.array_join(leaves, "")).alias("digest"), F.when(p == "", F.array().cast("array<string>")).otherwise(F.transform(leaves, lambda d: F.substring(d, 1, 8))).alias("leaves")),
    )


def tree(text: Column) -> Column:
    """struct(root, sections: array of (digest, paragraphs: array of (digest, leaves)))."""

    def sections(pars: Column) -> Column:
        ends = F.filter(
            F.sequence(F.lit(0), F.size(pars) - 1),
            lambda i: (i == F.size(pars) - 1) | (F.substring(F.get(pars, i)["digest"], 1, 1) < "4"),
        )
        return bound(
            ends,
            lambda e: F.transform(
                e,
                lambda end, k: bound(
                    F.coalesce(F.get(e, k - 1) + 1, F.lit(0)),
                    lambda start: bound(
                        F.slice(pars, start + 1, end - start + 1),
                        lambda own: F.struct(F.md5(F.array_join(F.transform(own, lambda p: p["digest"]), "")).alias("digest"), own.alias("paragraphs")),
                    ),
                ),
            ),
        )

    return bound(
        F.transform(F.split(text, "\n", -1), _paragraph),
        lambda pars: bound(sections(pars), lambda secs: F.struct(F.sha2(F.array_join(F.transform(secs, lambda s: s["digest"]), ""), 256).alias("root"), secs.alias("sections"))),
    )


def to_string(node: Column) -> Column:
    def paragraph(p: Column) -> Column:
        return F.concat(F.substring(p["digest"], 1, 8), F.lit("."), F.array_join(p["leaves"], ""))

    def section(s: Column) -> Column:
        return F.concat(F.substring(s["digest"], 1, 8), F.lit(":"), F.array_join(F.transform(s["paragraphs"], paragraph), " "))

    return F.concat(node["root"], F.lit("/"), F.array_join(F.transform(node["sections"], section), "/"))


def root(fingerprint: Column) -> Column:
    return F.substring(fingerprint, 1, 64)


def sections_of(fingerprint: Column) -> Column:
    """The distinct sections of a fingerprint, as they stand in it."""
    return F.array_distinct(F.split(F.substring(fingerprint, F.lit(66), F.length(fingerprint)), "/", -1))


def paragraphs_of(sections: Column) -> Column:
    """The distinct paragraphs of some sections."""
    return F.array_distinct(F.flatten(F.transform(sections, lambda s: F.split(F.substring(s, F.lit(10), F.length(s)), " ", -1))))


def leaves_of(paragraphs: Column) -> Column:
    """The distinct leaves of some paragraphs."""
    return F.array_distinct(F.flatten(F.transform(paragraphs, lambda p: F.regexp_extract_all(F.substring(p, F.lit(10), F.length(p)), F.lit("(.{8})"), F.lit(1)))))


def _leaf_count(branches: Column, over: int) -> Column:
    """Leaves below some branches, by the digits that are not theirs: ``over`` before the first paragraph's leaves, ten before each other's."""
    return F.aggregate(branches, F.lit(0), lambda n, x: n + F.floor((F.length(x) - over - 10 * (F.length(x) - F.length(F.translate(x, " ", "")))) / 8).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the share of the leaves of both that stand under equal branches or are equal themselves (0 without any)."""

    def both(x: Column) -> Column:
        same = F.array_intersect(x["a"], x["b"])
        return bound(
            F.struct(paragraphs_of(F.array_except(x["a"], x["b"])).alias("a"), paragraphs_of(F.array_except(x["b"], x["a"])).alias("b")),
            lambda y: _leaf_count(same, 18)
            + _leaf_count(F.array_intersect(y["a"], y["b"]), 9)
            + F.size(F.array_intersect(leaves_of(F.array_except(y["a"], y["b"])), leaves_of(F.array_except(y["b"], y["a"])))),
        )

    walked = bound(
        F.struct(sections_of(a).alias("a"), sections_of(b).alias("b")),
        lambda x: F.coalesce(2.0 * both(x) / F.nullif(_leaf_count(x["a"], 18) + _leaf_count(x["b"], 18), F.lit(0)), F.lit(0.0)),
    )
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(walked)


def changed_paragraphs(old: Column, new: Column) -> Column:
    """Positions of the paragraphs of ``new`` (trees) that stand under a section of no equal in ``old`` and equal none of its paragraphs."""

    def flat(t: Column) -> Column:
        return F.flatten(F.transform(t["sections"], lambda s: F.transform(s["paragraphs"], lambda p: F.struct(s["digest"].alias("s"), p["digest"].alias("p")))))

    return bound(
        F.struct(flat(old).alias("o"), flat(new).alias("n")),
        lambda x: F.filter(
            F.transform(
                x["n"],
                lambda q, i: F.when(~F.exists(x["o"], lambda r: r["s"] == q["s"]) & ~F.exists(x["o"], lambda r: r["p"] == q["p"]), i),
            ),
            lambda i: i.isNotNull(),
        ),
    )


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    return docs.withColumn(out_col, to_string(tree(F.coalesce(F.col(text_col), F.lit("")))))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are not above ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(b).cast("long") for b in bounds]) if len(bounds) < 64 else F.from_json(F.lit("[" + ",".join(map(str, bounds)) + "]"), "array<bigint>")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) <= key), at + step).otherwise(at),
    )


def with_next(docs: DataFrame, id_col: str, text_col: str, derived: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Adds next_text, the text of the next row in ascending id order; the last row's next is the first.

    ``derived`` has functions of the text by name: each adds its value and the
    next row's as next_<name>. They are computed once a row, after the rows moved.
    """
    derived = derived or {}
    outer, (docs, name, restore) = docs, sealed(docs)
    id_col, text_col = name(id_col), name(text_col)
    taken = {text_col: "next_text"} | {n: f"next_{n}" for n in derived}
    key, tie = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), F.xxhash64(text_col)
    keyed = docs.withColumns({"range_key": key, "range_tie": tie})
    slim = cut(keyed.select("range_key", "range_tie", F.octet_length(text_col).alias("bytes")))
    total = slim.agg(F.sum("bytes")).first()[0] or 0
    n = max(1, min(MAX_RANGES, -(-total // RANGE_BYTES)))
    found = slim.agg(F.percentile_approx("range_key", [i / n for i in range(1, n)], 20 * n + 1000)).first()[0] if n > 1 else []
    bounds = sorted(set(found or []))
    ranged = keyed.withColumn("range_no", _range_of(F.col("range_key"), bounds))
    # The first row of each range, for the range before it: MAX_RANGES rows of three numbers at most.
    first = slim.withColumn("range_no", _range_of(F.col("range_key"), bounds)).groupBy("range_no").agg(F.min(F.struct("range_key", "range_tie")).alias("f")).orderBy("range_no").collect()
    if not first:
        return outer.withColumns({free_name(outer, n): F.lit(None).cast("string") for n in [*derived, *taken.values()]})
    heads = [(first[i - 1]["range_no"], f["f"]["range_key"], f["f"]["range_tie"]) for i, f in enumerate(first)]
    table = docs.sparkSession.createDataFrame(heads, "for_range int, head_key long, head_tie long")
    ends = (
        keyed.join(F.broadcast(table), (F.col("range_key") == F.col("head_key")) & (F.col("range_tie") == F.col("head_tie")))
        .groupBy("for_range")
        .agg(F.first(text_col).alias("end_text"))
        .select(
            *[F.col("end_text").alias(c) if c == text_col else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns],
            F.lit(0).cast("long").alias("range_key"), F.lit(0).cast("long").alias("range_tie"), F.col("for_range").alias("range_no"), F.lit(True).alias("range_end"),
        )
    )
    both = ranged.withColumn("range_end", F.lit(False)).unionByName(ends).repartition("range_no")
    both = both.withColumns({n: f(F.col(text_col)) for n, f in derived.items()}) if derived else both
    order = Window.partitionBy("range_no").orderBy("range_end", "range_key", "range_tie")
    led = both.withColumns({n: F.lead(c).over(order) for c, n in taken.items()}).where(~F.col("range_end"))
    return restore(led.drop("range_key", "range_tie", "range_no", "range_end"))


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # A document's tree is made once and goes along to the row before.
    pairs = with_next(docs, "doc_id", "text", {"fingerprint": lambda text: to_string(tree(text))})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    made = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    made = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", to_string(tree(F.col("edited"))).alias("edited_fingerprint"), "next_fingerprint")
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
