"""Byte-level BPE as a lazily built finite-state transducer.

The encoding of a word's prefix ends in exactly one token, and a sequence of
tokens is an encoding exactly if each two neighbours are one of their joined
bytes.  So a left-to-right scan need only know, for each place from which a
token may still begin, the tokens that lead there.  That knowledge is the
state; the tokens all those ways share are certain and are emitted.  States and
transitions are made the first time an input needs them, and the lookahead is
bounded by the longest token.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the split of a text into words before merging, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Transitions and words a worker keeps before it begins anew.
MOST_TRANSITIONS, MOST_WORDS = 400_000, 200_000


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """token bytes → rank, from lines of base64 and number."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, blob.splitlines()) if token}


class Transducer:
    """Encodes words, the pieces of ``PATTERN``, byte by byte.

    ``ranks`` come from a byte-pair vocabulary: every byte has a token, and
    every other token is the join of two of lower rank, made in that order.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.prefixes = {token[:i] for token in ranks for i in range(1, len(token))}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self._begin()

    def _begin(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._state((None, ((b"", ()),)))

    def _state(self, key: tuple) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
        return self.ids[key]

    def merge(self, word: bytes, below: int = 1 << 60) -> list[int]:
        """The plain definition: join the neighbours of the lowest rank until none of a rank under ``below`` can be joined."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose joining makes this one; None for a byte."""
        if token not in self.halves:
            word = self.token[token]
            parts = self.merge(word, token) if len(word) > 1 else []
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def joins(self, a: int, b: int) -> bool:
        """Whether token ``b`` may stand after token ``a``.

        Undoes the joins inside both, the latest first, and looks whether the
        pieces on either side of the border would have been joined before.
        """
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        left, right, ranks, token = a, b, self.ranks, self.token
        bound, known = 1 << 60, None
        while known is None:
            joined = ranks.get(token[left] + token[right])
            if joined is not None and joined < bound:
                known = False
                break
            # of joins at one rank the left one comes first, so a join at the border beats an equal one on its right
            if left > right and (half := self._halves(left)):
                bound, left = left, half[1]
            elif half := self._halves(right):
                bound, right = right + 1, half[0]
            elif half := self._halves(left):
                bound, left = left, half[1]
            else:
                known = True
        if len(self.pairs) > MOST_TRANSITIONS:
            self.pairs.clear()
        self.pairs[a, b] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, ways = self.states[state]
        here, live, add = None, [], bytes((byte,))
        for begun, way in ways:
            begun += add
            if here is None:
                token = self.ranks.get(begun)
                if token is not None and (len(begun) == 1 or self._halves(token)):  # a token that merging never reaches is none
                    last = way[-1] if way else before
                    if last is None or self.joins(last, token):
                        here = (*way, token)
            if begun in self.prefixes:
                live.append((begun, way))
        if here is None:
            raise ValueError("the vocabulary lacks a byte")
        paths = [w for _, w in live]
        paths.append(here)
        low, high, sure = min(paths), max(paths), 0  # what these two share at the front, all share
        for x, y in zip(low, high):  # noqa: B905
            if x != y:
                break
            sure += 1
        live.append((b"", here))
        if sure:
            before, live = here[sure - 1], [(begun, w[sure:]) for begun, w in live]
        made = (self._state((before if len(low) == sure else None, tuple(live))), here[:sure])
        self.next[state << 8 | byte] = made
        return made

    def encode_word(self, word: str) -> tuple[int, ...]:
        if len(self.next) > MOST_TRANSITIONS:
            self._begin()
        state, out, known = 0, [], self.next
        for byte in word.encode("utf-8", "replace"):
            made = known.get(state << 8 | byte)
            state, emitted = made if made is not None else self._step(state, byte)
            if emitted:
                out += emitted
        return (*out, *self.states[state][1][-1][1])

    def encode(self, text: str) -> list[int]:
        out, words = [], self.words
        for word in _SPLIT(text):
            ids = words.get(word)
            if ids is None:
                ids = self.encode_word(word)
                if len(word) <= 64:
                    if len(words) >= MOST_WORDS:
                        words.clear()
                    words[word] = ids
            out += ids
        return out


_SPLIT = regex.compile(PATTERN).findall


class Utf8Decoder:
    """UTF-8 in pieces: a state machine that gives out whole characters and keeps what is unfinished.

    Bytes that can't be part of a character give U+FFFD.
    """

    def __init__(self):
        self.need, self.held, self.low, self.high = 0, bytearray(), 0x80, 0xBF

    def feed(self, piece: bytes) -> str:
        out = []
        for b in piece:
            if self.need:
                if self.low <= b <= self.high:
                    self.held.append(b)
                    self.need -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.need:
                        out.append(self.held.decode())
                        self.held.clear()
                    continue
                out.append("�")
                self._reset()
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                self.held.append(b)
                # the second byte's range rules out overlong forms, surrogates and what lies beyond U+10FFFF
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        left = "�" if self.need else ""
        self._reset()
        return left

    def _reset(self) -> None:
        self.need, self.low, self.high = 0, 0x80, 0xBF
        self.held.clear()


def decode(ids, token: dict[int, bytes]) -> Iterator[str]:
    """The text of token ids, piece by piece; a character of several tokens comes whole."""
    machine = Utf8Decoder()
    for i in ids:
        if piece := machine.feed(token[i]):
            yield piece
    if rest := machine.end():
        yield rest


_made: dict[str, Transducer] = {}


def transducer(blob: bytes, name: str) -> Transducer:
    """One transducer per worker and vocabulary."""
    if name not in _made:
        _made.clear()
        _made[name] = Transducer(read_ranks(blob))
    return _made[name]


def encode_corpus(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens.

    An empty text and a null text both have the empty list.  A null key stays.
    Texts of any length are encoded whole.  ``vocabulary`` is the path of a
    file of base64 tokens and ranks, read by the driver; its size is that of
    the vocabulary, whatever the corpus.
    """
    blob = Path(vocabulary).read_bytes()
    shared = documents.sparkSession.sparkContext.broadcast(blob)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, collecting = transducer(shared.value, vocabulary), gc.isenabled()
        gc.disable()  # the machine's many tuples hold no cycles
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):  # bounds what is held, whatever the batch
                    part = batch.slice(at, 512)
                    coded = [machine.encode(t) if t else [] for t in part.column(1).to_pylist()]
                    offsets = np.zeros(len(coded) + 1, dtype=np.int32)
                    np.cumsum([len(c) for c in coded], out=offsets[1:])
                    values = np.fromiter((i for c in coded for i in c), dtype=np.int32, count=offsets[-1])
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[key, "ids"])
        finally:
            if collecting:
                gc.enable()

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
