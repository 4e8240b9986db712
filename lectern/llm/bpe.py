"""Byte-level BPE by backtracking over longest matches.

``Vocabulary`` holds a public byte-level BPE vocabulary whose ids are merge ranks. ``Encoder`` finds
the longest token that starts at each byte with an Aho-Corasick automaton, walks the text with these
matches, and tests each two neighbouring tokens for compatibility: a pair is compatible if the
merges, done in rank order, would never join across the border. Incompatible candidates fall back to
the next shorter prefix token, and dead ends are marked and left, so that each byte is settled once
and the result is exactly that of the merges, in linear time.

Cases: null and empty texts have the empty array; special tokens are ordinary text; a text of any
length is processed whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: The split before merging, a fixed value of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces that a worker remembers at most; a full memory is emptied, results stay the same.
REMEMBERED = 400_000
NO_LIMIT = 1 << 62


class Vocabulary:
    """Tokens by id, the split of each token into the two it is merged from, and offsets for decoding."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.buffer = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.offsets = np.zeros(len(tokens) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in tokens], out=self.offsets[1:])

    @classmethod
    def from_rank_file(cls, lines: Iterable[bytes]) -> Vocabulary:
        """From lines of a base64 token and its rank."""
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (x.split() for x in lines if x.strip()))
        if [rank for rank, _ in pairs] != list(range(len(pairs))):
            raise ValueError("ranks must be 0, 1, 2 ...")
        return cls([token for _, token in pairs])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, read from the offset table."""
        ids = np.asarray(list(ids), dtype=np.int64)
        if not len(ids):
            return ""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(start, size)
        return self.buffer[at].tobytes().decode("utf-8", errors="replace")


class Encoder:
    """Exact BPE ids of texts; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN) -> None:
        words = [t.decode("latin-1") for t in vocabulary.tokens]
        self.id_of = {w: i for i, w in enumerate(words)}
        self.length = [len(w) for w in words]
        self.automaton = ahocorasick.Automaton()
        for i, w in enumerate(words):
            self.automaton.add_word(w, i)
        self.automaton.make_automaton()
        self.shorter = [self._prefix(w) for w in words]
        self.left, self.right = list(range(len(words))), list(range(len(words)))
        self.merged: dict[tuple[int, int], int] = {}
        self._splits(words)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}
        self.byte = [self.id_of[chr(b)] for b in range(256)]

    def _prefix(self, word: str) -> int:
        """The longest token that is a proper prefix, or -1."""
        for n in range(len(word) - 1, 0, -1):
            if (found := self.id_of.get(word[:n])) is not None:
                return found
        return -1

    def _splits(self, words: list[str]) -> None:
        """Merges of each token: the only compatible pair of earlier tokens that spells it."""
        for i, w in enumerate(words):
            first = self.shorter[i]
            while first >= 0:
                second = self.id_of.get(w[self.length[first] :])
                if second is not None and first < i and second < i and self.compatible(first, second):
                    self.left[i], self.right[i] = first, second
                    self.merged[first, second] = i
                    break
                first = self.shorter[first]

    def compatible(self, one: int, two: int) -> bool:
        """Whether ``one`` and ``two`` stay apart when the bytes of both are merged in rank order.

        The two are undone step by step from the latest merge; if tokens that met at the border could
        have been merged before the step that hid them, the pair isn't what the merges give."""
        limit = NO_LIMIT
        while True:
            joint = self.merged.get((one, two))
            if joint is not None and joint < limit:
                return False
            undo_first = one > two
            for turn in (undo_first, not undo_first):
                if turn and self.right[one] != one:
                    limit, one = one, self.right[one]
                    break
                if not turn and self.left[two] != two:
                    limit, two = two + 1, self.left[two]
                    break
            else:
                return True

    def piece(self, word: str) -> list[int]:
        """Ids of one piece, given as a string of bytes."""
        whole = self.id_of.get(word)
        if whole is not None:
            return [whole]
        longest = [-1] * len(word)
        length = self.length
        for end, token in self.automaton.iter(word):
            longest[end + 1 - length[token]] = token
        alive = bytearray(b"\1") * (len(word) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(word):
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if alive[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < len(word) else -1
            else:
                alive[at] = 0
                out.pop()
                at -= length[last]
                token = last
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        out: list[int] = []
        known = self.known
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.piece(piece.encode("utf-8").decode("latin-1"))
                if len(piece) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


_ENCODERS: dict[tuple[int, int], Encoder] = {}


def encoder_of(tokens: list[bytes], pattern: str = PATTERN) -> Encoder:
    """The worker's encoder for a broadcast vocabulary, built at its first use."""
    key = (len(tokens), hash((tokens[-1], tokens[len(tokens) // 2], pattern)))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Vocabulary(tokens), pattern)
    return _ENCODERS[key]


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file; read by the driver, which broadcasts it (at most some 50,000 tokens)."""
    with open(path, "rb") as lines:
        return Vocabulary.from_rank_file(lines)


def encode_corpus(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(key, ids) of each row; other columns are ignored, repeated rows stay repeated.

    A narrow map over the scan: no shuffle, two columns read."""
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary.tokens)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value, pattern)
        for batch in batches:
            flat, ends = [], [0]
            for t in batch.column(1).to_pylist():
                if t:
                    flat += encoder.encode(t)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(key, n_tokens) of each row by the same encoder; null and empty texts have 0."""
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary.tokens)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value, pattern)
        for batch in batches:
            sizes = [len(encoder.encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, n_tokens bigint")
