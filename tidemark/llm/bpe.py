"""BPE encoding and decoding that equals the tokenizers library's, with tree concatenation for long unsplit text.

A text is cut at special strings, normalised and split into pre-tokens as the tokenizer file says;
BPE never looks across a pre-token, so each distinct one is encoded once and kept in a bounded
table. A pre-token of over ``LEAF`` symbols is not handed over whole, since merging it takes time
that grows faster than its length: its leaves are encoded in parallel (``encode_batch``), then
neighbours are joined up the tree. At each join a window of k tokens on both sides is encoded anew,
k growing until the window's first and last token are those that stood there. Then every adjacent
pair of tokens occurs in a true encoding, which makes the whole sequence the true encoding.

Texts of characters below U+0250 (but for a few) take a plain path whose normalisation and split
are written with ``re``; all others go through the library's own normaliser and splitter.

Defined results: a null text is empty and gives no tokens and an empty decoded text; special
strings in a text are special tokens, as in the library; texts and words of any length are encoded whole; rows
repeat as they are, those of a null id too; an empty table gives no rows; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import map_batches

#: Symbols of a pre-token that are encoded at once; pre-tokens kept in a worker's table.
LEAF, KEPT = 256, 150_000


def _byte_symbols() -> list[str]:
    """The printable character that byte-level BPE has for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in set(plain) else next(spare)) for b in range(256)]


class TreeBpe:
    """Encoder of single pre-tokens, given as byte symbols, for one BPE model."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str | None, leaf: int = LEAF):
        from tokenizers import Tokenizer, models

        self.suffix, self.leaf = suffix or "", leaf
        self.inner = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        self.last = Tokenizer(models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=suffix)) if suffix else self.inner
        self.name = {i: t for t, i in vocab.items()}

    def _width(self, token: int) -> int:
        name = self.name[token]
        return len(name) - (len(self.suffix) if self.suffix and name.endswith(self.suffix) else 0)

    def _encode(self, text: str, ends: bool) -> list[int]:
        return (self.last if ends else self.inner).encode(text, add_special_tokens=False).ids

    def _join(self, text: str, at: int, a: list[int], b: list[int], ends: bool) -> list[int]:
        """Tokens of ``text`` whose parts before and from ``at`` have the tokens a and b; b ends the word if ``ends``."""
        k = 1
        while True:
            i, j = min(k, len(a)), min(k, len(b))
            lo = at - sum(map(self._width, a[len(a) - i :]))
            hi = at + sum(map(self._width, b[:j]))
            window = self._encode(text[lo:hi], ends and j == len(b))
            if (i == len(a) or window[0] == a[-i]) and (j == len(b) or window[-1] == b[j - 1]):
                return a[: len(a) - i] + window + b[j:]
            k *= 2

    def encode(self, symbols: str) -> list[int]:
        if len(symbols) <= self.leaf:
            return self._encode(symbols, True)
        cuts = [*range(0, len(symbols), self.leaf), len(symbols)]
        leaves = [symbols[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        made = [x.ids for x in self.inner.encode_batch(leaves[:-1], add_special_tokens=False)] + [self._encode(leaves[-1], True)]
        spans = [(a, b, ids) for a, b, ids in zip(cuts, cuts[1:], made, strict=False)]
        while len(spans) > 1:
            up = []
            for k in range(0, len(spans) - 1, 2):
                (a, at, left), (_, b, right) = spans[k], spans[k + 1]
                up.append((a, b, self._join(symbols[a:b], at - a, left, right, b == len(symbols))))
            spans = up + spans[len(spans) // 2 * 2 :]
        return spans[0][2]


class Encoder:
    """What a tokenizer file says, by pre-tokens."""

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, split = said["model"], said["pre_tokenizer"]["pretokenizers"][0]
        self.tokenizer = Tokenizer.from_file(path)
        self.tree = TreeBpe(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"], leaf)
        self.name = {**self.tree.name, **{x["id"]: x["content"] for x in said["added_tokens"]}}
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.symbols = _byte_symbols()
        self.leaf = leaf
        low = [chr(c) for c in range(0x250) if c not in range(0x1C, 0x20) and chr(c) != "İ"]
        letters = "".join(c for c in low if unicodedata.category(c)[0] == "L")
        digits = "".join(c for c in low if unicodedata.category(c)[0] == "N")
        self.odd = re.compile("[^" + re.escape("".join(low)) + "]")
        # Fixed value: the split pattern that the plain path stands for.
        self.plain = split["pattern"]["Regex"] == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\\s{letters}{digits}]+").findall
        self.known: dict[str, tuple[bytes, str]] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if self.plain and not self.odd.search(text):
            return self.words(text.lower())
        return [w for w, _ in self.split.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def _word(self, word: str) -> tuple[bytes, str]:
        if len(self.known) >= KEPT:
            self.known.clear()
        ids = self.tree.encode("".join(map(self.symbols.__getitem__, word.encode())))
        made = np.array(ids, "<u4").tobytes(), " ".join(map(self.name.__getitem__, ids))
        if len(word) <= self.leaf:
            self.known[word] = made
        return made

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """The ids as little-endian unsigned 32-bit integers, and the decoded text."""
        got: list[tuple[bytes, str]] = []
        for piece in self.cut.split(text or "") if self.cut else [text or ""]:
            if piece in self.special:
                got.append((np.array([self.special[piece]], "<u4").tobytes(), piece))
            elif piece:
                known = self.known.get
                got += [known(w) or self._word(w) for w in self.pre_tokens(piece)]
        return b"".join([i for i, _ in got]), " ".join([n for _, n in got])


@lru_cache(2)
def encoder(path: str, leaf: int = LEAF) -> Encoder:
    return Encoder(path, leaf)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """<id_col>, n_tokens, ids (little-endian unsigned 32-bit integers), decoded of every row.

    ``path`` names the tokenizer's file on every machine.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(cols):
        made = [encoder(path, leaf).encode(t) for t in cols[1]]
        return [cols[0], [len(i) // 4 for i, _ in made], [i for i, _ in made], [d for _, d in made]]

    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens bigint, ids binary, decoded string", rows=256)
