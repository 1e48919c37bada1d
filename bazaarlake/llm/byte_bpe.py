"""Byte-level BPE in linear time.

Text is cut by the vocabulary's pattern; each distinct piece is encoded once by backtracking from longest
matches: bytes are read as Latin-1 characters, an Aho-Corasick automaton finds every vocabulary entry in the
piece, and a token is accepted after another only if greedy merging would keep the boundary between the two
(memoised per pair). Positions found to be dead ends are marked, so no position is tried twice.
"""

from __future__ import annotations

import base64
from array import array
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Where the vocabulary lies; every function that needs it takes the path as a parameter.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern by which this vocabulary's text is cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct pieces remembered by a worker; a full memory is emptied, which changes no result.
MEMORY = 400_000

#: Ids in an Arrow batch after which it is sent on.
FLUSH = 4_000_000


def parse_ranks(data: bytes) -> list[bytes]:
    """Token bytes by rank from a rank file (a base64 token and its rank on each line)."""
    pairs = [line.split() for line in data.splitlines() if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class ByteBPE(dict):
    """A mapping from a piece of text to the tuple of its ids, filled on demand."""

    def __init__(self, tokens: list[bytes]):
        super().__init__()
        self.tokens = [t.decode("latin-1") for t in tokens]
        self.length = [len(t) for t in self.tokens]
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        self.split = regex.compile(PATTERN).findall
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter = [self._shorter(t) for t in self.tokens]
        self.joined: dict[tuple[int, int], int] = {}
        self.halves = [(i, i) for i in range(len(self.tokens))]
        self.fits: dict[tuple[int, int], bool] = {}
        self._learn_merges()

    def _shorter(self, token: str) -> int:
        """The longest entry that is a proper prefix of ``token``; -1 without one."""
        for n in range(len(token) - 1, 0, -1):
            if (i := self.rank.get(token[:n])) is not None:
                return i
        return -1

    def _learn_merges(self) -> None:
        """Finds of each entry the two earlier ones it is merged from."""
        for i, token in enumerate(self.tokens):
            left = self.shorter[i]
            while left >= 0:
                right = self.rank.get(token[self.length[left] :])
                if left < i and right is not None and right < i and self._compatible(left, right):
                    self.joined[left, right] = i
                    self.halves[i] = (left, right)
                    break
                left = self.shorter[left]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves the boundary between ``a`` and ``b``.

        The later of the two merges is undone step by step; if the tokens then at the boundary merge before
        the one undone last, they would have been merged across it.
        """
        limit = len(self.tokens) + 1
        joined, halves = self.joined, self.halves
        while True:
            merged = joined.get((a, b))
            if merged is not None and merged < limit:
                return False
            inner_a, inner_b = halves[a][1], halves[b][0]
            if inner_a == a and inner_b == b:
                return True
            if inner_b == b or (a > b and inner_a != a):
                limit, a = a, inner_a
            else:
                limit, b = b + 1, inner_b

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8").decode("latin-1")
        whole = self.rank.get(data)
        if whole is not None:
            return (whole,)
        n = len(data)
        length, fits, shorter = self.length, self.fits, self.shorter
        longest = [-1] * n
        for end, i in self.automaton.iter(data):
            at = end + 1 - length[i]
            if longest[at] < 0 or length[i] > length[longest[at]]:
                longest[at] = i
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if alive[end]:
                    if last < 0:
                        break
                    ok = fits.get((last, token))
                    if ok is None:
                        if len(fits) > 4 * MEMORY:
                            fits.clear()
                        ok = fits[last, token] = self._compatible(last, token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return tuple(out)
                token = longest[at]
            else:
                alive[at] = 0
                token = out.pop()
                at -= length[token]

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode_piece(piece)
        if len(piece) < 200:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))

    def count(self, text: str) -> int:
        return sum(map(len, map(self.__getitem__, self.split(text))))


_READY: dict[int, ByteBPE] = {}


def coder(data: bytes) -> ByteBPE:
    """The coder of a rank file's bytes; built once in each worker process."""
    key = hash(data)
    if key not in _READY:
        _READY[key] = ByteBPE(parse_ranks(data))
    return _READY[key]


def vocabulary(spark: SparkSession, path: str):
    """The rank file as a broadcast of its bytes: 0.8 MB whatever the corpus."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 32_000_000:
        raise ValueError(f"{path} is no vocabulary: {len(data)} bytes")
    return spark.sparkContext.broadcast(data)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): the ids of every row's whole text, without special tokens.

    A null or an empty text gives an empty list, a null key stays null, repeated rows each give a row, and any
    other column of ``df`` is left out. No row moves between partitions.
    """
    shared = vocabulary(df.sparkSession, path)

    def run(batches):
        enc = coder(shared.value)
        get, split = enc.__getitem__, enc.split
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            ids, ends, begun = array("i"), [0], 0
            for k, t in enumerate(texts, 1):
                if t:
                    ids.extend(chain.from_iterable(map(get, split(t))))
                ends.append(len(ids))
                if len(ids) > FLUSH or k == len(texts):  # long texts go out in several batches
                    values = pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32))
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([keys.slice(begun, k - begun), lists], names=[key, "ids"])
                    ids, ends, begun = array("i"), [0], k

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str = DEFAULT_VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the number of ids of each row's whole text; 0 for a null or an empty one."""
    shared = vocabulary(df.sparkSession, path)

    def run(batches):
        enc = coder(shared.value)
        get, split = enc.__getitem__, enc.split
        for batch in batches:
            counts = [sum(map(len, map(get, split(t)))) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(counts, pa.int64())], names=[*keep, name])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{schema}, {name} bigint")
