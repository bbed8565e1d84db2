"""Byte-level BPE encoding and decoding by ranks, with a segment tree for the merges.

A pre-token (a match of the pattern) that is a token itself is that token. Any other is merged byte by byte: a segment
tree over the byte positions holds at each leaf the rank of the pair that begins there, and at each inner node the
least rank below it with its leftmost position. The root names the next merge; the merge changes the leaves of the pair,
of its right half and of the live neighbour before it, and each change updates one path to the root. A pre-token of n
bytes takes O(n log n), so a document without any blank is no special case.

Pre-tokens of up to 64 bytes are merged by the thousand, one tree a row, in NumPy; longer ones in a tree of their own.
Encoded pre-tokens stay in a bounded cache for each Python worker; what falls out of it is encoded anew.

Defined results: a null or empty text has no ids and decodes to no bytes. Rows are independent of each other, so repeated
rows, ids and other columns don't matter.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from pointweave.llm import latin
from pointweave.llm.common import TwoGenerations, batched, released

NONE = np.int64(2**62)
SIZES, ROWS = (8, 16, 32, 64), 8192
#: Characters that ``roundtrip`` encodes at a time.
AT_ONCE = 1 << 18
#: The size of a pre-token's row, by its bytes.
SIZE_OF = [next(s for s in SIZES if n <= s) for n in range(SIZES[-1] + 1)]


class Ranks:
    """A vocabulary of ranks, a line each: base64 of the bytes, a blank, the rank."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.bytes_of = {r: t for t, r in self.rank.items()}
        self.byte_rank = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.longest = max(map(len, self.rank))
        self.shift = np.int64(max(self.bytes_of) + 1).item().bit_length()
        pairs = {}
        for token, rank in self.rank.items():
            for k in range(1, len(token)):
                a, b = self.rank.get(token[:k]), self.rank.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << self.shift | b] = rank
        self.place_pairs(pairs)

    def place_pairs(self, pairs: dict[int, int]) -> None:
        """A hash table at most a quarter full, so that most pairs, and most that are none, take one look."""
        self.bits = max(4, (4 * len(pairs)).bit_length())
        mask = (1 << self.bits) - 1
        self.pair_keys, self.pair_ranks = np.full(mask + 1, -1, np.int64), np.full(mask + 1, NONE, np.int64)
        keys = np.array(list(pairs), np.int64)
        for key, rank, at in zip(keys.tolist(), pairs.values(), self.slot(keys).tolist(), strict=True):
            while self.pair_keys[at] != -1:
                at = at + 1 & mask
            self.pair_keys[at], self.pair_ranks[at] = key, rank

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens; NONE where they make no token."""
        keys = a << self.shift | b
        at = self.slot(keys)
        held = self.pair_keys[at]
        out = np.where(held == keys, self.pair_ranks[at], NONE)
        left = np.flatnonzero((held != keys) & (held != -1))
        while len(left):  # another pair is in the slot: look at the next one
            at[left] = at[left] + 1 & len(self.pair_keys) - 1
            held = self.pair_keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.pair_ranks[at[left[hit]]]
            left = left[~hit & (held != -1)]
        return out

    # one pre-token

    def merge(self, piece: bytes) -> array:
        """The tree, the live neighbours and the ids are flat arrays: a node is rank * size + position, the least of which is the
        least rank's leftmost position."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        none, rank_of, longest = 1 << 62, self.rank.get, self.longest
        leaves = np.full(size, none, np.int64)
        if n > 1:
            ids = self.byte_rank[np.frombuffer(piece, np.uint8)]
            ranks = self.of_pairs(ids[:-1], ids[1:])
            leaves[: n - 1] = np.where(ranks < NONE, ranks * size + np.arange(n - 1), NONE)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = array("q", np.concatenate([np.zeros(1, np.int64), *levels[::-1]]).tobytes())
        del leaves, levels
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = i + size
            tree[k] = value
            while k > 1:
                value = tree[k ^ 1] if tree[k ^ 1] < value else value
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value

        def pair(i: int, end: int) -> int:
            rank = rank_of(piece[i:end]) if end - i <= longest else None
            return none if rank is None else rank * size + i

        while (root := tree[1]) < none:
            p = root % size
            q = after[p]
            end = after[p] = after[q]
            put(q, none)
            if end < n:
                before[end] = p
                put(p, pair(p, after[end]))
            else:
                put(p, none)
            o = before[p]
            if o >= 0:
                put(o, pair(o, end))
        out, p = array("i"), 0
        while p < n:
            out.append(self.rank[piece[p : after[p]]])
            p = after[p]
        return out

    # many pre-tokens of up to ``size`` bytes

    def merge_rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        n, none = len(pieces), NONE
        lens = np.array([len(p) for p in pieces], np.int64)
        ids = self.byte_rank[np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8)].reshape(n, size)
        places = np.arange(size)
        tree = np.full((n, 2 * size), none, np.int64)
        first = self.of_pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, size - 1)
        first = np.where((places[1:] < lens[:, None]) & (first < none), first * size + places[:-1], none)
        tree[:, size : 2 * size - 1] = first
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        after, before = np.tile(places + 1, (n, 1)), np.tile(places - 1, (n, 1))
        live = places < lens[:, None]
        flat, rows = tree.ravel(), np.arange(n)
        ids1, after1, before1, live1 = (x.reshape(-1) for x in (ids, after, before, live))
        while True:
            root = flat[rows * (2 * size) + 1]
            rows = rows[root < none]
            if not len(rows):
                break
            root = root[root < none]
            p, rank, base, up = root % size, root // size, rows * size, rows * (2 * size)
            q = after1[base + p]
            end = after1[base + q]
            inside = end < lens[rows]
            ids1[base + p], after1[base + p], live1[base + q] = rank, end, False
            before1[(base + end)[inside]] = p[inside]
            new = np.full(len(rows), none, np.int64)
            new[inside] = self.of_pairs(rank[inside], ids1[(base + end)[inside]])
            flat[up + size + q] = none
            flat[up + size + p] = np.where(new < none, new * size + p, none)
            o = before1[base + p]
            has = o >= 0
            o, up_o = o[has], up[has]
            new = self.of_pairs(ids1[base[has] + o], rank[has])
            flat[up_o + size + o] = np.where(new < none, new * size + o, none)
            for start, leaf in ((up, size + q), (up, size + p), (up_o, size + o)):
                k = leaf >> 1
                for _ in range(size.bit_length() - 1):
                    two = start + 2 * k
                    flat[start + k] = np.minimum(flat[two], flat[two + 1])
                    k >>= 1
        packed = ids[live].astype("<i4").tobytes()
        ends = np.concatenate([[0], np.cumsum(live.sum(axis=1) * 4)]).tolist()
        return [packed[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each pre-token, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {s: [] for s in SIZES}
        raw = [p.encode() for p in pieces]
        for k, piece in enumerate(raw):
            whole = self.rank.get(piece)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(piece) > SIZES[-1]:
                out[k] = np.array(self.merge(piece), "<i4").tobytes()
            else:
                by_size[SIZE_OF[len(piece)]].append(k)
        for size, ks in by_size.items():
            for at in range(0, len(ks), ROWS):
                some = ks[at : at + ROWS]
                for k, ids in zip(some, self.merge_rows([raw[k] for k in some], size), strict=True):
                    out[k] = ids
        return out


class Encoder(TwoGenerations):
    """Pre-token to packed ids."""

    def __init__(self, path: str, pattern: str, limit: int = 250_000):
        super().__init__(limit)
        self.ranks, self.find_any = Ranks(path), regex.compile(pattern).findall
        plain = latin.plain_pattern(pattern)
        self.find_plain = re.compile(plain).findall if plain else None

    def find(self, text: str) -> list[str]:
        return self.find_any(text) if self.find_plain is None or latin.BEYOND(text) else self.find_plain(text)

    def learn(self, pieces: set[str]) -> None:
        new = self.unknown(pieces)
        self.update(zip(new, self.ranks.encode_pieces(new), strict=True))

    def encode(self, texts: list) -> list[np.ndarray]:
        self.rotate()
        found = [self.find(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(found)))
        get = self.__getitem__
        return [np.frombuffer(b"".join(map(get, pieces)), "<i4") for pieces in found]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def id_lists(packed: bytearray, ends: list[int]) -> pa.Array:
    values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(packed)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def byte_strings(raw: bytearray, ends: list[int]) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.array(ends, pa.int32()).buffers()[1], pa.py_buffer(raw)])


def encode(text: Column, path: str, pattern: str) -> Column:
    """The ids of a text, as an array of int."""

    @F.arrow_udf("array<int>")
    def bpe_encode(texts: pa.Array) -> pa.Array:
        own, packed, ends = encoder(path, pattern), bytearray(), [0]
        for some in batched(texts):
            for ids in own.encode(some):
                packed += ids.data
                ends.append(len(packed) // 4)
        return id_lists(packed, ends)

    return bpe_encode(text.cast("string"))


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes of an array of ids; an id that the vocabulary lacks raises KeyError, null gives no bytes."""

    @F.arrow_udf("binary")
    def bpe_decode(ids: pa.Array) -> pa.Array:
        own, raw, at = encoder(path, pattern), bytearray(), [0]
        values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        for a, b, none in zip(ends, ends[1:], null, strict=False):
            if not none:
                raw += own.decode(values[a:b].tolist())
            at.append(len(raw))
        return byte_strings(raw, at)

    return bpe_decode(ids)


def roundtrip(text: Column, path: str, pattern: str) -> Column:
    """A struct of a text's ids and the bytes that they decode to, as ``decode`` of ``encode`` gives them. As two functions Spark
    would encode each text twice, once for either column. Not moved or repeated by the optimizer."""

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def bpe_roundtrip(texts: pa.Array) -> pa.Array:
        released()
        own, packed, ends, raw, at = encoder(path, pattern), bytearray(), [0], bytearray(), [0]
        for some in batched(texts, AT_ONCE):
            for ids in own.encode(some):
                packed += ids.data
                ends.append(len(packed) // 4)
                raw += own.decode(ids.tolist())
                at.append(len(raw))
        return pa.StructArray.from_arrays([id_lists(packed, ends), byte_strings(raw, at)], ["ids", "decoded"])

    return bpe_roundtrip.asNondeterministic()(text.cast("string"))
