import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark import errors
from tidemark.functions import generate
from tidemark.sources.blocks import Block, encode_block


@given(st.dictionaries(st.binary(max_size=8), st.binary(max_size=20), max_size=60), st.sampled_from([1, 2, 16, 1024]), st.binary(max_size=8))
def test_round_trip_and_seek(entries, interval, target):
    rows = sorted(entries.items())
    block = Block(encode_block(rows, interval))
    assert list(block) == rows
    assert list(block.seek(target)) == [r for r in rows if r[0] >= target]


def test_damage():
    with pytest.raises(errors.CorruptionError):
        Block(b"x")
    with pytest.raises(errors.InvalidArgumentError):
        encode_block([(b"b", b""), (b"a", b"")])
    raw = encode_block([(b"k", b"v" * 9)])
    with pytest.raises(errors.CorruptionError):
        list(Block(b"\x05" + raw[1:]))


def test_generators():
    a, b = generate.Random(301), generate.Random(301)
    assert [a.next() for _ in range(5)] == [b.next() for _ in range(5)]
    assert generate.Random(0).next() == generate.Random(2**31 - 1).next() == 16807
    assert all(0 <= a.uniform(7) < 7 and a.skewed(5) < 32 for _ in range(200))
    text = generate.compressible(a, 0.25, 10_000)
    assert len(text) == 10_000 and len(zlib.compress(text)) < 4_000
    ops = list(generate.operations(a, 500))
    assert 150 < sum(op for op, *_ in ops) < 350 and all((v is None) == (op == 0) for op, _, v in ops)
