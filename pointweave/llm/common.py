"""Shared pieces: connected components, bounded caches, batches of text."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.storage import drop_written, written

#: Rows of text that are Python objects at a time; links of 16 bytes whose minima are broadcast.
SLICE_ROWS, BROADCAST_LINKS = 512, 500_000


def few(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df marked for broadcast if it is counted to have so many rows at most. For narrow rows; give a written table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first variant of it that no column of ``df`` has (in any case)."""
    taken, n = {c.lower() for c in df.columns}, 0
    out = name
    while out.lower() in taken:
        n += 1
        out = f"{name}_{n}"
    return out


def unclaimed(df: DataFrame, *names: str) -> None:
    """An error if a column has one of these names (in any case)."""
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"columns {sorted(taken)} would be overwritten; give other names")


def slices(array: pa.Array) -> Iterator[list]:
    """The values of a text column as Python strings, a few hundred at a time; null stays None."""
    for at in range(0, len(array), SLICE_ROWS):
        yield array.slice(at, SLICE_ROWS).to_pylist()


def batched(texts: pa.Array, chars: int = 1 << 20):
    """Some hundred texts at a time, fewer if they are long."""
    for part in slices(texts):
        some, held = [], 0
        for t in part:
            some.append(t)
            held += len(t or "")
            if held > chars:
                yield some
                some, held = [], 0
        if some:
            yield some


#: glibc's, where there is one.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def released() -> None:
    """Give this process's free memory back to the system. A Python worker goes from stage to stage, and what earlier ones have
    freed would else count beside what the next one holds."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


class TwoGenerations(dict):
    """A cache that is bounded in entries and, as long keys stay only until ``rotate``, in bytes: at ``limit`` entries the young
    become the old, and the old ones go. What goes is computed anew, so results never depend on the limits."""

    LONGEST = 64

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old, self.passing = limit, {}, []

    def unknown(self, keys) -> list:
        """Those of the distinct keys that aren't in the cache; old ones become young."""
        new = []
        for k in keys:
            if k not in self:
                known = self.old.get(k)
                if known is None:
                    new.append(k)
                else:
                    self[k] = known
        self.passing += [k for k in new if len(k) > self.LONGEST]
        return new

    def rotate(self) -> None:
        for k in self.passing:
            self.pop(k, None)
        self.passing = []
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (public domain constants of MurmurHash3)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected links (a long, b long): node, root (the least node of its component).

    Alternates large-star and small-star steps (Kiveris et al., 2014); each round is written to the shared folder.
    Needs O(log^2 n) rounds; only nodes with a link come out. Hot nodes are pre-aggregated by ``min``. Minima of up to
    ``BROADCAST_LINKS`` counted links are broadcast; of more, each is written before it is joined, as AQE splits a hot side of a
    join only if the other one isn't an aggregate over the same shuffle. Null or self links are ignored; an empty input gives no
    rows.
    """
    edges = written(
        links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    sign, n = None, edges.count()
    for _ in range(max_rounds):
        own: list[DataFrame] = []

        def ready(df: DataFrame, own=own, n=n) -> DataFrame:
            if n <= BROADCAST_LINKS:
                return F.broadcast(df)
            own.append(written(df, "linkleast"))
            return own[-1]

        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(ready(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(ready(low), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        new = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(edges, *own)
        edges, n = after, new[0]
        if tuple(new) == sign:
            break
        sign = tuple(new)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
