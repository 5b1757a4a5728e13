"""Byte-level BPE encoding of a corpus with a public rank file.

The merge loop is a rank queue: one bucket of linked-list positions per merge
rank, and over the ranks a two-level bitmap whose lowest set bit names the next
rank.  A merge only touches its neighbours, entries that no longer describe the
pair at their position are skipped when they come up, so a pre-token of n bytes
costs about n queue operations however long it is.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriptor.session import prepare


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Path of a public tokenizer's file (``folder`` overrides the default place)."""
    return os.path.join(folder or os.environ.get("SKRIPTOR_TOKENIZERS", "/opt/tokenizers"), name)


#: Fixed value: the published pre-token pattern of the 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WORD_BITS = 256  # ranks per word of the lower bitmap
CHUNK_CHARS = 2_000_000  # characters encoded before ids are handed on
CACHED_CHARS = 48  # longer pre-tokens are rarely met twice
CACHE_ENTRIES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank (= id) of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class RankQueue:
    """Positions by merge rank; ``pop`` gives the lowest rank's leftmost position."""

    __slots__ = ("low", "high", "buckets")

    def __init__(self, n_ranks: int):
        self.low = [0] * (n_ranks // WORD_BITS + 1)
        self.high = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, pos: int) -> None:
        held = self.buckets.get(rank)
        if held is None:
            self.buckets[rank] = [pos]
            w, b = divmod(rank, WORD_BITS)
            if not self.low[w]:
                self.high |= 1 << w
            self.low[w] |= 1 << b
        else:
            heapq.heappush(held, pos)

    def pop(self) -> tuple[int, int] | None:
        if not self.high:
            return None
        w = (self.high & -self.high).bit_length() - 1
        word = self.low[w]
        b = (word & -word).bit_length() - 1
        rank = w * WORD_BITS + b
        held = self.buckets[rank]
        pos = heapq.heappop(held)
        if not held:
            del self.buckets[rank]
            self.low[w] = word = word & ~(1 << b)
            if not word:
                self.high &= ~(1 << w)
        return rank, pos


class ByteBpe:
    """Encoder over a rank table; keeps the ids of pre-tokens it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.n_ranks = max(ranks.values(), default=0) + 1
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.byte_id = [ranks.get(bytes([b]), -1) for b in range(256)]
        if -1 in self.byte_id:
            raise ValueError("the rank table lacks single bytes")
        self.find = regex.compile(pattern).findall
        self.pair: dict[tuple[int, int], int] = {}
        self._reset()

    def _reset(self) -> None:
        self.code: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)
        self.used = self.n = 0

    def rank_of(self, a: int, b: int) -> int:
        key = (a, b)
        r = self.pair.get(key)
        if r is None:
            r = self.pair[key] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return r

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token's bytes."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        ids = [self.byte_id[b] for b in data]
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = RankQueue(self.n_ranks)
        for i in range(n - 1):
            if (r := self.rank_of(ids[i], ids[i + 1])) >= 0:
                queue.push(r, i)
        while (top := queue.pop()) is not None:
            rank, i = top
            j = nxt[i]
            if ids[i] < 0 or j >= n or self.rank_of(ids[i], ids[j]) != rank:
                continue  # stale: one side was merged away or into something else
            ids[i], ids[j] = rank, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if (r := self.rank_of(rank, ids[k])) >= 0:
                    queue.push(r, i)
            if (h := prv[i]) >= 0 and (r := self.rank_of(ids[h], rank)) >= 0:
                queue.push(r, h)
        return [t for t in ids if t >= 0]

    def _add(self, ids: list[int]) -> int:
        n = len(ids)
        if self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), n), np.int32)])
        if self.n == len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + n] = ids
        self.start[self.n], self.size[self.n] = self.used, n
        self.used += n
        self.n += 1
        return self.n - 1

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all pre-tokens in order, and the number of them for each text."""
        if self.n > CACHE_ENTRIES or self.used > 20 * CACHE_ENTRIES:
            self._reset()
        code, out, counts = self.code, [], []
        for text in texts:
            found = self.find(text) if text else []
            try:
                out += [code[t] for t in found]
            except KeyError:
                for t in found:
                    c = code.get(t)
                    if c is None:
                        c = self._add(self.merge(t.encode("utf-8", "surrogatepass")))
                        if len(t) <= CACHED_CHARS:
                            code[t] = c
                    out.append(c)
            counts.append(len(found))
        return np.array(out, np.int64), np.array(counts, np.int64)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their offsets, one slice for each text."""
        codes, counts = self.codes(texts)
        sizes = self.size[codes].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total, dtype=np.int64) + np.repeat(self.start[codes] - (ends - sizes), sizes)
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[at], edges.astype(np.int32)

    def count_batch(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        codes, counts = self.codes(texts)
        ends = np.concatenate([[0], np.cumsum(self.size[codes], dtype=np.int64)])
        edges = np.concatenate([[0], np.cumsum(counts)])
        return ends[edges[1:]] - ends[edges[:-1]]


_MADE: dict[tuple, ByteBpe] = {}


def encoder(shared) -> ByteBpe:
    """The worker's encoder for a broadcast ``(key, ranks, pattern)``; made once."""
    key, ranks, pattern = shared
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = ByteBpe(ranks, pattern)
    return _MADE[key]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= CHUNK_CHARS:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def share_ranks(df: DataFrame, vocabulary: str, folder: str | None, pattern: str = PATTERN):
    """Broadcast of the rank table; its size is that of the vocabulary, not of the data."""
    path = tokenizer_path(vocabulary, folder)
    return df.sparkSession.sparkContext.broadcast(((path, pattern), read_ranks(path), pattern))


def encode_corpus(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None
) -> DataFrame:
    """(id, ids array<int>) of every row, without special tokens.

    Null and empty texts have an empty list; ids that are null stay null; rows
    that repeat are encoded as often as they come; an empty table gives an empty
    result.  Other columns are not read.
    """
    prepare(df.sparkSession)
    shared = share_ranks(df, vocabulary, folder)
    id_type = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                flat, edges = own.encode_batch(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["key", "ids"])

    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"key {id_type.simpleString()}, ids array<int>")
    return out.select(F.col("key").alias(id_col), "ids")


def count_tokens(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None
) -> DataFrame:
    """(id, tokens bigint) of every row; null and empty texts count 0."""
    prepare(df.sparkSession)
    shared = share_ranks(df, vocabulary, folder)
    id_type = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                n = own.count_batch(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64())], ["key", "tokens"])

    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"key {id_type.simpleString()}, tokens bigint")
    return out.select(F.col("key").alias(id_col), "tokens")
