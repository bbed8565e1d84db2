"""SimHash near-dedup with deletion-variant signatures.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of a text's word shingles. Fingerprints
link at ``max_bits`` d or fewer differing bits; the links' connected components are the groups.

Search: a fingerprint is cut into m = d // 2 + 1 segments, fewer than the d + 1 that equality alone would need, so that
in any linked pair one segment differs by at most one bit.

* It differs by none: the segment itself is the key. The rest differs by at most d bits.
* No segment is equal and one differs by one bit: the key is the segment with that bit left out, one variant for each
  bit. Every other segment differs by a bit or more, so the rest differs by at most d - 1 bits, and at least 2m - d
  segments differ by exactly one bit: the last 2m - d - 1 of the segments need no variants.

Segments alone would be short keys that unrelated fingerprints share at scale, so each is joined by a piece of the rest,
cut into one more piece than it can differ by bits: one piece is equal. For d = 4 that gives 183 keys of 30 bits each.

Distinct fingerprints only are indexed (copies share one), sorted by key with spill, and verified while they stream by.
Within a key, a search from fingerprint to fingerprint that meets each one once emits links that span the group; not all
pairs. A long run is cut further by the bits that vary in it: of d + j pieces of them, j are equal in any linked pair, so
each choice of j pieces is a key of its own, and unrelated fingerprints seldom meet. A key's fingerprints take 8 bytes each, and
only distinct ones count, however many documents share them; no more than 680,000 are within four bits of any one. A key with
more than a million is dealt out in pairs of blocks all the same.

Defined results: a text without words, null or empty has fingerprint zero and links like any other. Repeated rows and
rows with equal ids get a row each. A null id is never the smallest; a group of null ids only has a null component. Only
the id and text columns are read, so other columns and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import components, few, fresh, mix64, slices
from pointweave.storage import scratch, written

#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15
#: Fingerprints of a run that is cut further, those of a part that are all compared with each other, comparisons at a time.
LONG_RUN, SHORT_RUN, AT_ONCE = 2048, 128, 1 << 18


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    tokens = (text or "").encode().lower().split()  # bytes: A-Z and ASCII blanks only
    if not tokens:
        return 0
    n, ones = max(1, len(tokens) - words + 1), np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, BLOCK):
        some = [digest(join(tokens[i : i + words]), seed) for i in range(at, min(n, at + BLOCK))]
        bits = np.unpackbits(np.array(some, np.uint64).view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(words: int = 4):
    """A column function: text to fingerprint (the unsigned integer's bits in a long)."""

    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t, words) for part in slices(texts) for t in part]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return simhash


def cut(places: list[int], n: int) -> list[list[int]]:
    """Bit places in n even parts."""
    ends = [len(places) * k // n for k in range(n + 1)]
    return [places[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def masks(max_bits: int) -> np.ndarray:
    """The bits that each key of a fingerprint keeps."""
    d, of = max_bits, lambda places: sum(1 << p for p in places)
    m, found = d // 2 + 1, []
    segments = cut(list(range(64)), m)
    for k, segment in enumerate(segments):
        rest = [p for other in segments if other is not segment for p in other]
        if d == 0:
            found.append(2**64 - 1)
            break
        found += [of(segment) | of(piece) for piece in (cut(rest, d + 1) if rest else [[]])]
        if k < d - m + 1:
            found += [of(segment) & ~(1 << bit) | of(piece) for bit in segment for piece in (cut(rest, d) if rest else [[]])]
    return np.array(found, np.uint64)


def keys_of(fps: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """All keys of each fingerprint: the kept bits and the variant's number, mixed into 64 bits."""
    salt = mix64(np.arange(1, len(kept) + 1, dtype=np.uint64))
    return mix64((fps[:, None] & kept[None, :]) ^ salt[None, :])


def span(fps: np.ndarray, max_bits: int) -> tuple[list, list]:
    """Links that span each group of these distinct fingerprints, found by a search that meets each one once. Many open ones
    are compared with the rest at a time."""
    a, b, rest = [], [], fps
    while rest.size > 1:
        open_, rest = rest[:1], rest[1:]
        while open_.size and rest.size:
            n = max(1, AT_ONCE // rest.size)
            some, open_ = open_[:n], open_[n:]
            near = np.bitwise_count(rest[None, :] ^ some[:, None]) <= max_bits
            hit = near.any(axis=0)
            if hit.any():
                hits = rest[hit]
                a.append(some[near[:, hit].argmax(axis=0)])
                b.append(hits)
                rest = rest[~hit]
                open_ = np.concatenate([open_, hits])
    return a, b


def span_long(fps: np.ndarray, max_bits: int) -> tuple[list, list]:
    """As span. The bits that vary are cut in max_bits + j pieces, of which linked fingerprints have j in common; j is so that
    few unrelated ones meet."""
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    places = [p for p in range(64) if varying >> p & 1]
    if len(fps) <= LONG_RUN or len(places) < 2 * (max_bits + 2):
        return span(fps, max_bits)
    j = next((j for j in (2, 3) if len(fps) >> len(places) * j // (max_bits + j) <= SHORT_RUN // 2), 4)
    pieces = [sum(1 << p for p in part) for part in cut(places, max_bits + j)]
    a, b = [], []
    for some in combinations(pieces, j):
        code = fps & np.uint64(sum(some))
        order = np.argsort(code)
        code, own = code[order], fps[order]
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        sizes = np.diff(np.append(starts, len(code)))
        small = np.repeat(sizes <= SHORT_RUN, sizes)
        near, code = own[small], code[small]
        for d in range(1, int(sizes[sizes <= SHORT_RUN].max(initial=1))):
            hit = (code[d:] == code[:-d]) & (np.bitwise_count(near[d:] ^ near[:-d]) <= max_bits)
            a.append(near[:-d][hit])
            b.append(near[d:][hit])
        for r in np.flatnonzero(sizes > SHORT_RUN):
            x, y = span(own[starts[r] : starts[r] + sizes[r]], max_bits)
            a += x
            b += y
    return a, b


def link_runs(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links in rows that are sorted by (key, fingerprint): neighbours first, then a search in broken runs."""
    same = key[1:] == key[:-1]
    near = same & (np.bitwise_count(fp[1:] ^ fp[:-1]) <= max_bits)
    a, b = [fp[:-1][near]], [fp[1:][near]]
    broken = np.flatnonzero(same & ~near)
    if broken.size:
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        runs = np.unique(np.searchsorted(starts, broken, side="right") - 1)
        ends = np.append(starts, len(key))
        for r in runs:
            x, y = span_long(fp[ends[r] : ends[r + 1]], max_bits)
            a += x
            b += y
    both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def expand(max_bits: int):
    kept = masks(max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                fps = batch.column(0).slice(at, 1024).to_numpy(zero_copy_only=False).view(np.uint64)
                keys = keys_of(fps, kept).ravel().view(np.int64)
                yield pa.record_batch([pa.array(keys), pa.array(np.repeat(fps, len(kept)).view(np.int64))], ["key", "fp"])

    return run


def verify(max_bits: int, run_rows: int):
    """Rows sorted by (key, fp) to links (a, b, 0). The last run of a batch waits for the next batch. A run of more than
    run_rows fingerprints isn't held: it gives one row (key, 0, how many)."""

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = link_runs(key, fp, max_bits)
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.zeros(len(a), np.int64))], ["a", "b", "n"])

    def joined(held: list) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the last run so far
        rows, at = 0, None  # its length and key; held is empty once it is too long

        def closed() -> Iterator[pa.RecordBatch]:
            if rows > run_rows:
                yield pa.record_batch([pa.array([at], pa.int64()), pa.array([0], pa.int64()), pa.array([rows], pa.int64())], ["a", "b", "n"])
            elif rows > 1:
                yield links(*joined(held))

        for batch in batches:
            key, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            first = np.searchsorted(key, key[0], side="right") if at == key[0] else 0  # these go on with the last run
            if first:
                rows += int(first)
                held = [] if rows > run_rows else [*held, (key[:first], fp[:first])]
                key, fp = key[first:], fp[first:]
                if not len(key):
                    continue
            yield from closed()
            last = np.searchsorted(key, key[-1])  # where the new last run begins
            if last > 1:
                starts = np.flatnonzero(np.concatenate([[True], key[1:last] != key[: last - 1]]))
                sizes = np.diff(np.append(starts, last))
                for k in starts[sizes > run_rows]:
                    yield pa.record_batch([pa.array([key[k]], pa.int64()), pa.array([0], pa.int64()), pa.array(sizes[starts == k])], ["a", "b", "n"])
                small = np.repeat(sizes <= run_rows, sizes)
                if small.sum() > 1:
                    yield links(key[:last][small], fp[:last][small])
            at, rows = key[-1], len(key) - int(last)
            held = [] if rows > run_rows else [(key[last:].copy(), fp[last:].copy())]
        yield from closed()

    return run


LINKS = "a bigint, b bigint, n bigint"


def near_links(distinct: DataFrame, max_bits: int, run_rows: int) -> DataFrame:
    """Links that span the groups. A key with more than run_rows fingerprints is dealt out in blocks, each pair of blocks to
    a run of its own, so that no task holds more than run_rows or so of them."""
    keyed = distinct.select("fp").mapInArrow(expand(max_bits), "key bigint, fp bigint")
    dealt = keyed.repartition("key").sortWithinPartitions("key", "fp")
    found = written(dealt.mapInArrow(verify(max_bits, run_rows), LINKS), "nearlinks")
    links = found.where("n = 0").select("a", "b")
    large = found.where("n > 0").select(F.col("a").alias("key"), F.ceil(F.col("n") * 2 / run_rows).cast("int").alias("blocks"))
    n_large = large.limit(100_001).count()
    if not n_large:
        return links
    rows = keyed.join(F.broadcast(large) if n_large <= 100_000 else large, "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key")
    pairs = rows.select(pair, "fp").repartition("key").sortWithinPartitions("key", "fp")
    more = pairs.mapInArrow(verify(max_bits, 1 << 62), LINKS)
    return links.unionByName(more.select("a", "b"))


def near_groups(distinct: DataFrame, max_bits: int = 4, run_rows: int = 1 << 20) -> DataFrame:
    """distinct: one long column fp without repeats. Gives (node, root) of all that have a link."""
    return components(near_links(distinct, max_bits, run_rows))


def marked(docs: DataFrame, id_col: str, text_col: str, words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """The documents' (id, hash of the text, fingerprint), and each distinct fingerprint's root and smallest id."""
    text = F.col(text_col).cast("string")
    marks = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), fingerprints(words)(text).alias("fp"))
    marks = written(marks, "simhash")
    classes = written(marks.groupBy("fp").agg(F.min("id").alias("least")), "simhashes")
    groups = near_groups(classes, max_bits)  # its links are written
    rooted = classes.join(groups, classes.fp == groups.node, "left")
    return marks, rooted.select("fp", F.coalesce("root", "fp").alias("root"), "least")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 4, max_bits: int = 4) -> DataFrame:
    """A row per document: id, fingerprint (16 lowercase hex digits), component_id (the smallest id of its component)."""
    with scratch(docs.sparkSession) as keep:
        marks, rooted = marked(docs, id_col, text_col, words, max_bits)
        # plain sides of the joins, so that AQE can split a hot root or fingerprint
        rooted = written(rooted, "simhashroots")
        low = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhashleast")
        found = keep(written(rooted.join(low, "root").select("fp", "component_id"), "simhashfound"))
        keep(marks)
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marks.join(found, "fp").select(F.col("id").alias(id_col), shown, "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 4, max_bits: int = 4) -> DataFrame:
    """One document of each group with all its columns: the smallest id; of equal or null ids, one by the text's hash."""
    with scratch(docs.sparkSession) as keep:
        marks, rooted = marked(docs, id_col, text_col, words, max_bits)
        return keep_first(docs, marks, rooted.select("fp", "root"), "fp", id_col, text_col, keep)


def keep_first(docs: DataFrame, marks: DataFrame, rooted: DataFrame, mark: str, id_col: str, text_col: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The documents that stay, by their marks (id, th, mark) and each mark's root. keep: of the scratch that this is in."""
    # plain sides of the joins, so that AQE can split a hot mark or group
    rooted = written(rooted, "simhashroots")
    grouped = written(marks.join(rooted, mark).select("id", "th", "root"), "simhashed")
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first"))
    first = written(first, "simhashfirst")
    kept = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    gone = keep(written(grouped.join(first, "root").where(~kept).select("id", "th").distinct(), "simhashgone"))
    own, owner = fresh(docs, "text_hash"), fresh(docs, "text_owner")
    hashed = docs.withColumn(own, F.xxhash64(F.col(text_col).cast("string")))
    gone = few(gone).select(F.col("id").alias(owner), F.col("th").alias(f"{owner}_hash"))
    left = hashed.join(gone, F.col(id_col).eqNullSafe(F.col(owner)) & (F.col(own) == F.col(f"{owner}_hash")), "left_anti")
    if grouped.groupBy("id", "th").count().where("count > 1").head(1):  # repeated rows
        left = left.dropDuplicates([id_col, own])
    return left.drop(own)
