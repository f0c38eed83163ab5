"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split into pre-tokens. Tier one asks a minimal perfect hash over the
vocabulary, which resolves a pre-token that is a token itself with one probe and
one comparison. Tier two merges the bytes of all others: the bytes form a doubly
linked list, a heap holds the ranks of neighbouring pairs, and the lowest rank,
leftmost among equals, is merged until no pair is in the vocabulary; a pre-token
of n bytes takes n log n steps. Resolved short pre-tokens are remembered in each
Python worker up to a fixed number.

The rank file is read by the driver, checked against MAX_VOCABULARY, and
broadcast; the tables are built once per Python worker. Rows don't move.

Defined results: null texts are empty and have no ids; ids that aren't in the
vocabulary make decode() raise; repeated rows stay repeated; very long texts are
split piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Tokens of a vocabulary at most, as it is broadcast.
MAX_VOCABULARY = 1_000_000
#: Pre-tokens that a worker remembers at most, and the longest that it does.
MEMO, MEMO_CHARS = 600_000, 40
#: Characters from which on a text is split in portions.
LONG_TEXT = 1 << 20

_UNICODE = regex.compile(public_tokenizers.PATTERN)
# The same pattern for texts within Latin-1, whose letters, numbers and blanks are these (fixed values).
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile(public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{_S}{_L}{_N}]").replace(r"\p{L}", f"[{_L}]").replace(r"\p{N}", f"[{_N}]").replace(r"(?!\S)", f"(?![^{_S}])").replace(r"\s", f"[{_S}]"))
_BEYOND = re.compile("[^\x00-\xff]")


def pieces(text: str) -> Iterator[list[str]]:
    """The pre-tokens of a text, in lists."""
    pattern = _LATIN if text.isascii() or not _BEYOND.search(text) else _UNICODE
    if len(text) < LONG_TEXT:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while part := list(islice(found, 1 << 16)):
        yield part


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys in n slots, one displacement per bucket of about two keys.

    Buckets are placed from the largest; those of one key take what slots are
    left, whose number is stored directly as a negative displacement.
    """

    def __init__(self, keys: Iterable[bytes], values: Iterable[int]):
        keys, values = list(keys), list(values)
        self.n = n = len(keys)
        self.buckets = max(1, n // 2)
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        members: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, k in enumerate(keys):
            h = xxhash.xxh64_intdigest(k)
            members[h % self.buckets].append((h, i))
        free = np.ones(n, dtype=bool)

        def put(slot: int, i: int) -> None:
            free[slot] = False
            self.keys[slot], self.values[slot] = keys[i], values[i]

        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        single = next((at for at, b in enumerate(order) if len(members[b]) < 2), len(order))
        for b in order[:single]:
            d = 0
            while True:
                slots = [self._slot(h, d) for h, _ in members[b]]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, i) in zip(slots, members[b]):
                put(s, i)
        rest = iter(np.flatnonzero(free).tolist())
        for b in order[single:]:
            for _, i in members[b]:
                slot = next(rest)
                self.shift[b] = -slot - 1
                put(slot, i)

    def _slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x >> 24) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[slot] if self.keys[slot] == key else None


class Codec(dict):
    """Maps a pre-token to its ids as little-endian unsigned 32-bit integers; the mapping itself is the bounded memory."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.whole = PerfectHash(ranks.keys(), ranks.values())
        self.tokens = {r: t for t, r in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        # The token that two neighbouring tokens make, by both ids.
        self.pairs = {a << 20 | b: r for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None}
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a piece by merging neighbours from the lowest rank up."""
        n, pair = len(piece), self.pairs.get
        ids = [self.single[b] for b in piece]
        low = [pair(a << 20 | b, -1) for a, b in zip(ids, ids[1:])]  # what the part that begins here makes with the next
        low.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [r << 40 | i for i, r in enumerate(low) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i = x & 0xFFFFFFFFFF
            if low[i] != x >> 40:
                continue  # one of the two has been merged since
            j = after[i]
            end = after[i] = after[j]
            ids[i], ids[j], low[j] = low[i], -1, -1
            if end < n:
                before[end] = i
                r = low[i] = pair(ids[i] << 20 | ids[end], -1)
                if r >= 0:
                    push(heap, r << 40 | i)
            else:
                low[i] = -1
            if (p := before[i]) >= 0:
                r = low[p] = pair(ids[p] << 20 | ids[i], -1)
                if r >= 0:
                    push(heap, r << 40 | p)
        return [x for x in ids if x >= 0]

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            raw = piece.encode()
            whole = self.whole.get(raw)
            ids = [whole] if whole is not None else self.merge(raw)
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO // 2:  # two generations: what is used again stays
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(b"".join(map(self.__getitem__, part)) for part in pieces(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """This worker's codec of a broadcast (digest, ranks)."""
    digest, ranks = shared.value
    if digest not in _CODECS:
        _CODECS.clear()
        _CODECS[digest] = Codec(ranks)
    return _CODECS[digest]


def _share(spark: SparkSession, path: str):
    ranks = read_ranks(path)
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{path} has {len(ranks)} tokens; {MAX_VOCABULARY} at most are broadcast")
    return spark.sparkContext.broadcast((hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), ranks))


def _others(df: DataFrame, *added: str) -> list[str]:
    """The columns that stay; those named like an added one, in any case, are replaced."""
    gone = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in gone]


def encode(docs: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with the ids of their texts as an array of int in column ``to``."""
    shared, kept = _share(docs.sparkSession, path), _others(docs, to)
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            ids = [np.frombuffer(codec.encode(t or ""), dtype="<u4").astype(np.int32) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, type=pa.list_(pa.int32()))], names=[*kept, to])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema)
    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, f"{schema}, `{to}` array<int>")


def decode(rows: DataFrame, path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """rows with the text of their ids in column ``to``; bytes that aren't UTF-8 become U+FFFD."""
    shared, kept = _share(rows.sparkSession, path), _others(rows, to)
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            texts = [codec.decode(np.array(x or [], dtype="<u4").tobytes()).decode("utf-8", "replace") for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, type=pa.string())], names=[*kept, to])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[f"`{c}`" for c in kept]).schema)
    return rows.select(*[f"`{c}`" for c in kept]).mapInArrow(run, f"{schema}, `{to}` string")


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes decoded from them, of every row of docs(doc_id, text, ...); and the ids, if asked for."""
    shared = _share(docs.sparkSession, path)
    hexdigest = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            n, ids, back, whole = [], [], [], []
            for t in b.column(1).to_pylist():
                found = codec.encode(t or "")
                n.append(len(found) // 4)
                ids.append(hexdigest(found))
                back.append(hexdigest(codec.decode(found)))
                if with_ids:
                    whole.append(np.frombuffer(found, dtype="<u4").astype(np.int32))
            more = [pa.array(whole, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string()), *more], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
