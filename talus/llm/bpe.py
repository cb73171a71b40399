"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that can end its encoding: a token that ends there, and that is
compatible with the last token of the prefix before it. Two neighbouring tokens are compatible when merging would never
join symbols across their border. The tokens that end at a place come from an automaton over the vocabulary, the words'
ids from the back-pointers. The vocabulary and merges are read from the tokenizer's file, whose path is a parameter; the
file's text is broadcast, every worker builds its tables once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from tokenizers import Tokenizer

from talus.llm.common import row_column, small_batches

END = "\ue000"          # stands for the end-of-word suffix; no byte symbol uses it
REMEMBERED = 120_000    # words a worker remembers, half of them those of the last turn
_NEVER = 1 << 40
# Below U+0300, but for control characters, normalization is lower-casing and the character classes are settled.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u02ff]*")
_LOWERED = sorted(set("".join(filter(_PLAIN.fullmatch, map(chr, range(0x300)))).lower()))


def _listed(kind: str) -> str:
    """The characters of a kind that a lower-cased plain text can hold, written out: the standard library then finds the same
    pieces as `regex` would, in half the time."""
    return "".join(re.escape(c) for c in _LOWERED if regex.fullmatch(kind, c))


_LETTER, _NUMBER, _SPACE = _listed(r"\p{L}"), _listed(r"\p{N}"), _listed(r"\s")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


def byte_symbols() -> list[str]:
    """The printable symbol of every byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    printable = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class _Words(dict):
    """Ids of the words met, worked out when first asked for. When half of `REMEMBERED` words are held they become the last
    turn's, and those of the turn before are forgotten; a word met again moves on, so frequent words stay."""

    def __init__(self, make):
        super().__init__()
        self.make, self.last = make, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.last.get(piece)
        if ids is None:
            ids = tuple(self.make(piece))
        if len(piece) < 64:
            if len(self) >= REMEMBERED // 2:
                self.last = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes and decodes whole texts with a vocabulary whose last symbol of a word carries a suffix."""

    def __init__(self, description: str):
        parsed = json.loads(description)
        model = parsed["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocabulary: dict[str, int] = {self._inner(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.numbers = {i: str(i) for i in self.names}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for n, (a, b) in enumerate(model["merges"]):
            left, right = self.vocabulary[self._inner(a)], self.vocabulary[self._inner(b)]
            whole = self.vocabulary[self._inner(a + b)]
            self.rank[left, right], self.parts[whole], self.made_at[whole] = n, (left, right), n
        self.compatible: dict[int, bool] = {}   # by left id * 2^20 + right id
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.edges: tuple[dict, dict] = ({}, {})
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocabulary.items():
            if self._stands(i):  # no encoding holds the others
                self.automaton.add_word(token, (i, len(token) - token.endswith(END), token.endswith(END)))
        self.automaton.make_automaton()
        self.symbols = byte_symbols()
        self.seen = _Words(self.word)
        # The same file's own normalizer and word splitter, for texts with characters beyond the plain ones.
        self.library = Tokenizer.from_str(description)

    def _inner(self, token: str) -> str:
        return token[:-len(self.suffix)] + END if token.endswith(self.suffix) else token

    def _stands(self, token: int) -> bool:
        """Whether merging a token's own symbols gives that token again."""
        return token not in self.parts or self._joins(*self.parts[token], self.made_at[token])

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge (0 first, 1 last) of a token, from the single symbol up to the token itself, each with
        the rank at which it grows into the next."""
        chain = self.edges[side].get(token)
        if chain is None:
            chain, grown = [], _NEVER
            at = token
            while True:
                chain.append((at, grown))
                if at not in self.parts:
                    break
                grown, at = self.made_at[at], self.parts[at][side]
            chain = self.edges[side][token] = chain[::-1]
        return chain

    def _joins(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge before `limit` joins symbols across the border of two tokens while both are being built.

        Symbols grow in order of rank. At any time the border lies between the current last symbol of the left token
        and the current first one of the right token; they would merge if their own rank came before both tokens' next
        steps (at equal ranks the leftmost goes first).
        """
        rank, lefts, rights = self.rank, iter(self._edge(left, 1)), iter(self._edge(right, 0))
        last, grow_left = next(lefts)
        first, grow_right = next(rights)
        while True:
            across = rank.get((last, first), _NEVER)
            if across < limit and across < grow_left and across <= grow_right:
                return False
            if grow_left <= grow_right:
                if grow_left == _NEVER:
                    return True
                last, grow_left = next(lefts)
            else:
                first, grow_right = next(rights)

    def encode_symbols(self, word: str) -> list[int]:
        """Ids of one word given as byte symbols. The automaton yields the tokens that end at a place, longest first;
        the end mark belongs to the last symbol, so nothing may end between the two."""
        n = len(word)
        tokens, lengths = [-1] * (n + 1), [0] * (n + 1)   # per prefix: its last token and that token's length
        compatible = self.compatible
        for place, (token, length, ends) in self.automaton.iter(word + END):
            stop = place if ends else place + 1
            if tokens[stop] >= 0 or (stop == n) != ends:
                continue
            if length < stop:
                before = tokens[stop - length]
                if before < 0:
                    continue
                pair = before << 20 | token
                fits = compatible.get(pair)
                if fits is None:
                    fits = compatible[pair] = self._joins(before, token, _NEVER)
                if not fits:
                    continue
            tokens[stop], lengths[stop] = token, length
        out = []
        while n:
            out.append(tokens[n])
            n -= lengths[n]
        if len(compatible) > 2 * REMEMBERED:
            compatible.clear()
        return out[::-1]

    def word(self, piece: str) -> list[int]:
        return self.encode_symbols("".join([self.symbols[b] for b in piece.encode()]))

    def _pieces(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _PIECE.findall(text.lower())
        backward = {s: b for b, s in enumerate(self.symbols)}
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(backward[c] for c in symbols).decode() for symbols, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, text: str) -> list[int]:
        """Special tokens written in a text are cut out first; then every piece between them is encoded."""
        out: list[int] = []
        ids_of = self.seen.__getitem__
        for part in self.special_cut.split(text):
            if part in self.special:
                out.append(self.special[part])
                continue
            out.extend(chain.from_iterable(map(ids_of, self._pieces(part))))
        return out

    def decode(self, ids: list[int]) -> str:
        return _joined(self.names, ids)

    def ids_text(self, ids: list[int]) -> str:
        return _joined(self.numbers, ids)


def _joined(words: dict[int, str], ids: list[int]) -> str:
    return " ".join(itemgetter(*ids)(words)) if len(ids) > 1 else "".join([words[i] for i in ids])


_BUILT: dict[int, Encoder] = {}   # per worker: the encoder of the last description


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs -> (row, n_tokens, ids_sha256, decoded_sha256) for every row; a NULL text counts as empty (no tokens, the
    digest of the empty string)."""
    with open(path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    @pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if hash(shared.value) not in _BUILT:
            _BUILT.clear()
            _BUILT[hash(shared.value)] = Encoder(shared.value)
        encoder = _BUILT[hash(shared.value)]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = []
            for text in batch:
                ids = encoder.encode(text)
                rows.append((len(ids), sha(encoder.ids_text(ids)), sha(encoder.decode(ids))))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    rows = small_batches(docs).select(row_column(docs)).withColumn("made", digests(F.coalesce(F.col("row.text"), F.lit(""))))
    return rows.select("row", "made.*")


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """docs -> (row, ids): the token ids themselves."""
    with open(path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    @pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(shared.value)
        for batch in batches:
            yield pd.Series([encoder.encode(t) for t in batch])

    return small_batches(docs).select(row_column(docs)).withColumn("ids", ids(F.coalesce(F.col("row.text"), F.lit(""))))


def digest(docs: DataFrame, path: str) -> DataFrame:
    return encoded(docs.select("doc_id", "text"), path).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
