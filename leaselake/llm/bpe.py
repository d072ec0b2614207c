"""Byte-level BPE with two tiers: a minimal perfect hash over the vocabulary, then a heap over linked bytes."""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from leaselake.llm.common import map_chunks, with_fields

MEMO_PIECES, MEMO_LENGTH = 400_000, 64
_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, token i at place i. Ranks must be 0..n-1."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks are not 0 to {len(ranks) - 1}")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Minimal perfect hash of n byte strings: hash, displace, one slot each.

    Strings are dealt to n/3 buckets. Buckets are placed from the largest to the smallest with the first
    displacement that sends all their strings to free slots; a bucket of one string names its slot.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        self.shift = [0] * self.buckets
        self.slots = [-1] * n
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        taken = np.zeros(n, dtype=bool)
        tries = np.arange(4096, dtype=np.uint64)
        for bucket in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[bucket]
            if not own:
                break
            if len(own) == 1:
                continue
            base = 0
            while True:
                with np.errstate(over="ignore"):
                    mixed = np.array([hashes[i] for i in own], dtype=np.uint64)[:, None] ^ ((tries + np.uint64(base)) * np.uint64(_GOLDEN))
                    mixed = mixed * np.uint64(_GOLDEN)
                at = ((mixed >> np.uint64(29)) % np.uint64(n)).astype(np.int64)
                good = ~taken[at].any(axis=0)
                for j in np.flatnonzero(good):
                    if len(set(at[:, j].tolist())) == len(own):
                        break
                else:
                    base += len(tries)
                    continue
                self.shift[bucket] = base + int(j)
                for i, slot in zip(own, at[:, j].tolist()):
                    self.slots[slot] = i
                    taken[slot] = True
                break
        free = iter(np.flatnonzero(~taken).tolist())
        for bucket, own in enumerate(members):
            if len(own) == 1:
                slot = next(free)
                self.shift[bucket] = -slot - 1
                self.slots[slot] = own[0]

    def place(self, key: bytes) -> int:
        """Index of the only string that ``key`` can be; the caller compares."""
        h = xxhash.xxh64_intdigest(key)
        shift = self.shift[h % self.buckets]
        if shift < 0:
            return self.slots[-shift - 1]
        mixed = ((h ^ (shift * _GOLDEN & _MASK)) * _GOLDEN & _MASK) >> 29
        return self.slots[mixed % self.n]


class Codec(dict):
    """Encoder and decoder; as a mapping it gives the packed ids of a pre-token.

    The mapping keeps the last answers, at most ``MEMO_PIECES`` of at most ``MEMO_LENGTH`` characters each, since
    text repeats its words.
    """

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.whole = PerfectHash(tokens)
        self.split = regex.compile(pattern).findall
        self.packed = [i.to_bytes(4, "little") for i in range(len(tokens))]

    def __missing__(self, piece: str) -> bytes:
        ids = self.resolve(piece.encode())
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def resolve(self, raw: bytes) -> bytes:
        """Packed ids of one pre-token: the vocabulary entry itself, else merges."""
        at = self.whole.place(raw)
        if self.tokens[at] == raw:
            return self.packed[at]
        return b"".join([self.packed[i] for i in self.merge(raw)])

    def merge(self, raw: bytes) -> list[int]:
        """Merge the neighbours of lowest rank, leftmost first, until no neighbours are a token.

        Parts are linked by their end places. A heap entry (rank, start, end) holds only while the part at
        ``start`` and the next one still end there.
        """
        n, rank = len(raw), self.rank
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(raw[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = end[i]
            if j < 0 or j >= n or j >= e or end[j] != e:
                continue
            end[i], end[j] = e, -1
            if e < n:
                before[e] = i
                r = rank.get(raw[i : end[e]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            p = before[i]
            if p >= 0:
                r = rank.get(raw[p:e])
                if r is not None:
                    heapq.heappush(heap, (r, p, e))
        ids, i = [], 0
        while i < n:
            ids.append(rank[raw[i : end[i]]])
            i = end[i]
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """One codec per worker process."""
    key = (shared.value[0], pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value[1], pattern)
    return _CODECS[key]


@lru_cache(maxsize=4)
def _shared_vocabulary(application: str, path: str):
    tokens = read_ranks(path)
    digest = xxhash.xxh64_hexdigest(b"\0".join(tokens))
    return SparkSession.active().sparkContext.broadcast((digest, tokens))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit) to every row; null text counts as empty.

    The rank file (bounded by the vocabulary) is read by the driver and broadcast. No shuffle. Columns
    already named ids are replaced.
    """
    shared = _shared_vocabulary(docs.sparkSession.sparkContext.applicationId, path)
    kept = docs.drop("ids")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shared, pattern)
        ids = [codec.encode(t or "") for t in part.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], [*part.schema.names, "ids"])

    return map_chunks(kept, run, with_fields(kept, "ids binary"), text)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``ids`` and ``decoded`` (the bytes of the ids), in one pass."""
    shared = _shared_vocabulary(docs.sparkSession.sparkContext.applicationId, path)
    kept = docs.select(key, text)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shared, pattern)
        ids = [codec.encode(t or "") for t in part.column(1).to_pylist()]
        decoded = [codec.decode(i) for i in ids]
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], [key, "ids", "decoded"]
        )

    schema = with_fields(kept.select(key), "ids binary, decoded binary")
    return map_chunks(kept, run, schema, text)


def decode(encoded: DataFrame, path: str, pattern: str = "", ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary) to every row with packed ids; null ids give null."""
    shared = _shared_vocabulary(encoded.sparkSession.sparkContext.applicationId, path)
    kept = encoded.drop("decoded")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shared, pattern)
        out = [None if i is None else codec.decode(i) for i in part.column(ids).to_pylist()]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    return map_chunks(kept, run, with_fields(kept, "decoded binary"), ids)
