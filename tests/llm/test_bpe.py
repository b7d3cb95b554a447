import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import bpe

SPEC = bpe.tokenizer_spec(bpe.default_tokenizer_path())
WIDE, NARROW = bpe.TreeBPE(SPEC, leaf=300), bpe.TreeBPE(SPEC, leaf=40, window=16, short_piece=64)
PARTS = ["a", "b", "e", "th", "the ", "ing", " ", "  ", "\n", "\n\n", "\t", "'re", "'s", "'", "'ll", "1", "234", "é", "ñ", "中", "😀", "!", "...", "<|endoftext|>", "<|endof", "text|>", "Ab", "\x85", "\x00", "\x1c", "-", "--", "$$", "　", " "]


def plain(text):
    return WIDE.tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=150).map("".join))
def test_trees_agree_with_the_tokenizer(text):
    want = plain(text)
    for coder in (WIDE, NARROW):
        if text:
            assert coder.encode_long(text) == want
        assert coder.encode_batch([text]) == [want]
        assert coder.decode(want) == text == coder.tok.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    assert WIDE.encode_batch([text]) == [plain(text)]
    if text:
        assert NARROW.encode_long(text) == plain(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "abcde" * 4000, " " * 9000, "!?" * 5000, "\n" * 999 + "x", "é" * 5000])
def test_long_unsplit_texts(text):
    assert NARROW.encode_long(text) == plain(text)
    rnd = random.Random(1)
    mixed = "".join(rnd.choice("abcdefghi") for _ in range(len(text)))
    assert NARROW.encode_long(mixed) == plain(mixed)


def test_settled_characters_are_split_alike():
    assert WIDE.by_pattern
    for c in [*map(chr, range(0x250)), *map(chr, range(0x2000, 0x2065))]:
        for text in (c, c * 2, f"a{c}b", f"1{c}2", f" {c} ", f"!{c}{c}?{c}\n{c}"):
            assert not bpe.UNSETTLED.search(text) and WIDE._split(text).ids == plain(text)


def test_ordinary_documents_are_trees(monkeypatch):
    """A text of some thousand characters is joined from leaves; none is encoded whole."""
    coder, joins = bpe.TreeBPE(SPEC), []
    join = coder.join
    monkeypatch.setattr(coder, "join", lambda a, b: joins.append(1) or join(a, b))
    text = "Some words, it's a text of 12 parts.\n" * 300
    assert coder.encode_batch([text]) == [plain(text)] and len(joins) == -(-len(text) // bpe.LEAF) - 1 > 2


def test_query(spark, table, docs):
    rows = [(1, None), (2, ""), (3, "Hello  world, it's <|endoftext|> here\n"), (3, "Hello  world, it's <|endoftext|> here\n"), (None, "中文 текст"), (9, "long text. " * 20_000)]
    got = bpe.op9_bpe(spark, table(docs(rows))).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, len(ids := plain(t or "")), sha(",".join(map(str, ids))), sha(t or "")) for i, t in rows]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])) for r in got)
    assert bpe.op9_bpe(spark, table(docs([]))).count() == 0


def test_ids_and_text(docs):
    df = docs([(1, "some text"), (2, None)]).withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r for r in bpe.encode_column(df, SPEC, "text", decoded_col="back").collect()}
    assert got[1]["_ids"] == plain("some text") and got[1]["ids"] == "clash" and got[1]["back"] == got[1]["text"] and got[2]["_ids"] == [] and got[2]["back"] == ""
