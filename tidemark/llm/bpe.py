"""Byte-level BPE encoding and decoding by tree concatenation.

A text is cut into leaves; halves are encoded on their own (a leaf batch runs
on the tokenizer's threads), then joined pairwise up to the whole text. A join
re-encodes a window around the cut that grows until its tokens agree with the
tokens of both sides exactly. Two facts make the agreement exact:

* The pre-tokenizer scans from left to right and never looks back, so a scan
  that starts on a true boundary finds true boundaries, but for those within a
  few characters of a cut. Two scans that share a boundary agree from there on.
* Inside one long pre-token, a sequence of tokens is the encoding of its bytes
  if each pair of neighbours is. A window whose first and last token equal the
  sides' tokens joins three valid sequences without a new pair.

All texts take this way; one not longer than a leaf is a tree of one leaf. Where
the file's pre-tokenizer is the plain byte-level one, and a text has only
characters whose classes are the same in every edition of Unicode, pre-tokens
are found by its pattern and each distinct one is merged once by the file's
model; other leaves and windows go through the tokenizer. Special strings in a
text become their special token, as in the tokenizer.

Defined cases: a null or empty text has no tokens and decodes to an empty
text; repeated rows give repeated rows; an empty table gives no rows; columns
of the input pass through, and output names get underscores in front where they
clash.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.llm.common import free_name, give_back, read_table

#: Characters of a leaf.
LEAF = 2048
#: Boundaries nearer to a cut than this (bytes) may depend on what follows it:
#: a scan looks 3 characters ahead, a special string is at most 13 characters.
MARGIN = 64
WINDOW = 128
#: A crossing pre-token up to this length is encoded again as a whole.
SHORT_PIECE = 4096
BATCH_CHARS = 400_000
#: A character outside these ranges may be classed differently by another edition of Unicode.
UNSETTLED = regex.compile("[^\\x00-\u024f\u2000-\u2064]")
#: The split pattern of byte-level pre-tokenizers (fixed value), with white space as Unicode has it.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
#: Pre-tokens that are remembered, and the longest of them in characters.
REMEMBERED, REMEMBERED_CHARS = 500_000, 64


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoded:
    """Token ids, with flags for those that start a pre-token; ``plain`` if the pattern may split the text they stand for."""

    __slots__ = ("ids", "plain", "starts")

    def __init__(self, ids: list[int], starts: list[bool], plain: bool = False):
        self.ids, self.starts, self.plain = ids, starts, plain


class TreeBPE:
    def __init__(self, spec: str, leaf: int = LEAF, margin: int = MARGIN, window: int = WINDOW, short_piece: int = SHORT_PIECE):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf, self.margin, self.window, self.short_piece = leaf, margin, window, short_piece
        alphabet = byte_alphabet()
        self.letter = {b: c for c, b in alphabet.items()}
        added = self.tok.get_added_tokens_decoder()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if i in added else bytes(alphabet[c] for c in token)
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.added = set(added)
        spec_ = json.loads(spec)
        before = spec_.get("pre_tokenizer") or {}
        self.by_pattern = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec_.get("normalizer")
        self.special = regex.compile("|".join(regex.escape(t.content) for t in added.values()) or r"(?!)")
        self.known: dict[str, tuple[list[int], list[bool]]] = {}
        #: Bytes of each token, as numbers.
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)

    # -- leaves ---------------------------------------------------------------
    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text: all leaves of some texts are encoded together, then each text's are joined."""
        out: list = [None] * len(texts)
        run: list[int] = []
        chars = 0
        for i, t in enumerate(texts):
            run.append(i)
            chars += len(t)
            if chars >= BATCH_CHARS:
                self._flush(texts, run, out)
                run, chars = [], 0
        self._flush(texts, run, out)
        return out

    def _flush(self, texts: list[str], run: list[int], out: list) -> None:
        leaves = [[texts[i][k : k + self.leaf] for k in range(0, len(texts[i]), self.leaf)] for i in run]
        plain = [self.by_pattern and not UNSETTLED.search(texts[i]) and not self.special.search(texts[i]) for i in run]
        coded = iter(self.tok.encode_batch([x for own, p in zip(leaves, plain, strict=True) if not p for x in own], add_special_tokens=False))
        for i, own, p in zip(run, leaves, plain, strict=True):
            out[i] = self.concatenate([self._split(x) if p else self._of(next(coded)) for x in own]).ids if own else []

    def _split(self, text: str) -> Encoded:
        """A plain text: pre-tokens by the pattern, tokens of each from memory or from the model."""
        ids, starts, known = [], [], self.known
        for w in PATTERN.findall(text):
            got = known.get(w) or self._merge(w)
            ids += got[0]
            starts += got[1]
        return Encoded(ids, starts, True)

    def _merge(self, word: str) -> tuple[list[int], list[bool]]:
        ids = self._bpe(word.encode())
        got = ids, [True] + [False] * (len(ids) - 1)
        if len(word) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = got
        return got

    def encode_long(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def concatenate(self, level: list[Encoded]) -> Encoded:
        """Neighbours are joined pairwise until one is left."""
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def _of(self, e) -> Encoded:
        words, ids = e.word_ids, e.ids
        # An added token has a word of its own; word numbers start anew after it.
        starts = [True, *[w is None or w != before for before, w in zip(words, words[1:], strict=False)]][: len(ids)]
        if not self.added.isdisjoint(ids):
            for i, x in enumerate(ids):
                if x in self.added:
                    starts[i] = True
                    if i + 1 < len(ids):
                        starts[i + 1] = True
        return Encoded(ids, starts)

    def _encode(self, raw: bytes) -> Encoded:
        return self._of(self.tok.encode(raw.decode("utf-8"), add_special_tokens=False))

    def _bytes(self, ids: list[int]) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])

    # -- joining --------------------------------------------------------------
    def join(self, a: Encoded, b: Encoded) -> Encoded:
        """The encoding of the text of ``a`` followed by that of ``b``."""
        if not a.ids or not b.ids:
            return a if a.ids else b
        left = self._left_anchor(a)
        head = self._bytes(a.ids[left:])
        size = self.window
        long_piece = False
        while True:
            # As many tokens of b as the window needs.
            count = min(len(b.ids), size + 4)
            ends_b = np.cumsum(self.sizes[b.ids[:count]])
            begins = {0: 0} | {int(ends_b[k - 1]): k for k in range(1, count) if b.starts[k]}
            whole = self._bytes(b.ids[:count])
            cut = self._char_cut(whole, size)
            got = self._pieces(head + whole[:cut], long_piece, a.plain)
            if cut >= len(whole) and count == len(b.ids):
                return self._assemble(a, left, got, b, len(b.ids))
            safe, pos = len(head) + cut - self.margin, 0
            found = None
            for k, (piece_len, _) in enumerate(got):
                prev, pos = pos, pos + piece_len
                if prev > safe or pos > safe:
                    break
                if pos >= len(head) and (pos - len(head)) in begins:
                    found = (k + 1, begins[pos - len(head)])
                    break
            if found:
                return self._assemble(a, left, got[: found[0]], b, found[1])
            size *= 2
            long_piece = size > self.short_piece

    def _left_anchor(self, a: Encoded) -> int:
        """The last pre-token of ``a`` that no text after ``a`` can move; 0 if there's none."""
        at, i = 0, len(a.ids)
        while i > 0:
            i -= 1
            at += len(self.bytes_of[a.ids[i]])
            if at >= self.margin and a.starts[i]:
                return i
        return 0

    def _char_cut(self, raw: bytes, size: int) -> int:
        """``size`` or the next place after it where a character starts."""
        while size < len(raw) and raw[size] & 0xC0 == 0x80:
            size += 1
        return min(size, len(raw))

    def _pieces(self, raw: bytes, long_piece: bool, plain: bool) -> list[tuple[int, list[int] | None]]:
        """(bytes, ids) of each pre-token of ``raw``; ids are left open (None) where only the place is asked for."""
        if plain:
            words = PATTERN.findall(raw.decode("utf-8"))
            return [(len(w.encode()), None if long_piece else (self.known.get(w) or self._merge(w))[0]) for w in words]
        if not long_piece:
            e = self._encode(raw)
            out: list[tuple[int, list[int]]] = []
            for i, s in zip(e.ids, e.starts, strict=True):
                if s:
                    out.append([0, []])
                out[-1][0] += len(self.bytes_of[i])
                out[-1][1].append(i)
            return [(n, ids) for n, ids in out]
        text, out, at = raw.decode("utf-8"), [], 0
        special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        while at < len(text):
            stop, which = min(((p, s) for s in special if (p := text.find(s, at)) >= 0), default=(len(text), None))
            for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(text[at:stop]) if stop > at else []:
                out.append((len(word), None))
            if which:
                out.append((len(which.encode()), [self.tok.token_to_id(which)]))
            at = stop + len(which or "")
        return out

    def _assemble(self, a: Encoded, left: int, pieces: list, b: Encoded, upto: int) -> Encoded:
        """a[:left], the pre-tokens of the window, b[upto:]; open pre-tokens get their ids here."""
        ids, starts = a.ids[:left], a.starts[:left]
        if any(x[1] is None for x in pieces):
            mid = a.ids[left:] + b.ids[:upto]
            seam = len(a.ids) - left
            pieces = self._fill(mid, seam, pieces)
        for _, got in pieces:
            ids.extend(got)
            starts.extend([True] + [False] * (len(got) - 1))
        return Encoded(ids + b.ids[upto:], starts + b.starts[upto:], a.plain)

    def _fill(self, mid: list[int], seam: int, pieces: list) -> list:
        """Ids for the pre-tokens of a window that spans ``mid``, whose sides meet before token ``seam``."""
        offsets, at = [0], 0
        for i in mid:
            at += len(self.bytes_of[i])
            offsets.append(at)
        at_token = {o: k for k, o in enumerate(offsets)}
        raw, cross, pos, out = self._bytes(mid), offsets[seam], 0, []
        for n, ids in pieces:
            if ids is None:
                lo, hi = at_token.get(pos), at_token.get(pos + n)
                if pos < cross < pos + n and lo is not None and hi is not None and n > self.short_piece:
                    ids = self._agree(mid[lo:hi], seam - lo)
                else:
                    ids = self._bpe(raw[pos : pos + n])
            out.append((n, ids))
            pos += n
        return out

    def _bpe(self, raw: bytes) -> list[int]:
        return [t.id for t in self.tok.model.tokenize("".join([self.letter[b] for b in raw]))]

    def _agree(self, ids: list[int], seam: int) -> list[int]:
        """One long pre-token from its halves: re-encode a growing window of tokens until both of its ends agree."""
        k = 8
        while True:
            lo, hi = max(0, seam - k), min(len(ids), seam + k)
            got = self._bpe(self._bytes(ids[lo:hi]))
            left_ok = lo == 0 or (got and got[0] == ids[lo])
            right_ok = hi == len(ids) or (got and got[-1] == ids[hi - 1])
            # A single token may not stand for both ends at once.
            if left_ok and right_ok and (len(got) > 1 or (lo == 0 and hi == len(ids))):
                return ids[:lo] + got + ids[hi:]
            k *= 2

    # -- decoding -------------------------------------------------------------
    def decode(self, ids: list[int]) -> str:
        return self._bytes(ids).decode("utf-8", "replace")


def encode_column(docs: DataFrame, spec: str, text_col: str, *, ids_col: str | None = "ids", decoded_col: str | None = None, digests: bool = False, leaf: int = LEAF) -> DataFrame:
    """``docs`` with token ids (array of int), the decoded text, or n_tokens and digests of both."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # one vocabulary file
    made_here = {"ids": ids_col, "decoded": decoded_col} | ({n: n for n in ("n_tokens", "ids_sha256", "decoded_sha256")} if digests else {})
    kinds = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    fields = [(n, free_name(docs, c), kinds[n]) for n, c in made_here.items() if c]
    names = {n for n, _, _ in fields}
    carried = [c for c in docs.columns if c != text_col or not digests]
    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField(c, t) for _, c, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Made for the task and dropped with it: workers live on, and a vocabulary is large.
        bpe = TreeBPE(shared.value, leaf)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = ["" if t is None else t for t in column.slice(at, 512).to_pylist()]
                unique = list(dict.fromkeys(texts))
                where = {t: i for i, t in enumerate(unique)}
                coded = bpe.encode_batch(unique)
                made: dict[str, list] = {n: [] for n in names}
                for t, ids in zip(unique, coded, strict=True):
                    text = bpe.decode(ids) if decoded_col or digests else None
                    one = {"ids": ids, "decoded": text}
                    if digests:
                        one |= {
                            "n_tokens": len(ids),
                            "ids_sha256": hashlib.sha256(",".join([bpe.decimal[i] for i in ids]).encode()).hexdigest(),
                            "decoded_sha256": hashlib.sha256(text.encode()).hexdigest(),
                        }
                    for n in names:
                        made[n].append(one[n])
                pick = pa.array([where[t] for t in texts], pa.int32())
                types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in carried] + [pa.array(made[n], types.get(n, pa.string())).take(pick) for n, _, _ in fields],
                    names=carried + [c for _, c, _ in fields],
                )
        del bpe
        give_back()

    return docs.mapInArrow(run, schema)


def tokenizer_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    spec = tokenizer_spec(tokenizer_path or default_tokenizer_path())
    return encode_column(docs, spec, "text", ids_col=None, digests=True)
