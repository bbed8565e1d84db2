"""SimHash near-dedup at a similarity of 0.8: wide fingerprints of shingle sets, deletion variants, and an exact check.

Two texts link if their sets of distinct shingles have a Jaccard similarity of 4/5 or more; the links' connected components are
the groups. A bit of a fingerprint is 1 if it is set in over half of the set's hashes. Two sets of equal size and similarity 4/5
have a cosine of 8/9, so each bit differs with a probability of acos(8/9) / pi = 0.15: of 64 bits some 10 differ, at which no
segment of useful length is sure to be equal or one bit apart. So a fingerprint has as many bits as it takes: it is cut into
segments whose length L follows the logarithm of the number of texts, so that a variant has some eight unrelated ones, and so
many segments that a pair at the threshold has one that differs by at most a bit with a probability of ``RECALL`` (17 segments
of 16 bits for up to 260,000 texts; pairs of greater similarity are met all the more, and groups are held together by many
links). It has ``LANES`` words of 64 bits at least.

Index: a segment that is equal is a key itself; one that differs by a bit is met as one of its one-wildcard variants. To shuffle
a row for each variant would take L + 1 rows a segment. Instead a segment goes by each of its halves: the one that doesn't hold
the differing bit is equal, and a task that has all segments with that half makes the variants of the other half itself. Two
rows a segment stand for all its variants.

Verify: the whole fingerprints' differing bits (three standard deviations above a pair's at the threshold, at most) and the
sets' sizes rule out most of those that meet; the others are compared by their whole sets. First only neighbours in equal
segments are, which holds groups of very many copies together by a few links each; then all that meet and are in different
components by then, each pair once, in the first segment where it meets. No group gives all its pairs. Sets are compared in
blocks, each pair of blocks by a task of its own, and each set goes only where a pair needs it.

Texts with equal sets are one class, and only classes are indexed, however many texts they hold. A half with more than
``run_rows`` classes isn't held by one task: it is dealt out in pairs of blocks.

Defined results: words are as in ``simhash``; a text with fewer words than a shingle is one shingle, and texts without words
are equal. Repeated rows and null ids are as in ``simhash.keep_one``. Other columns and their names don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import components, few, mix64, released, slices
from pointweave.llm.simhash import keep_first
from pointweave.storage import drop_written, scratch, written

#: The chance that a pair at the threshold meets, and that one of its bits differs.
RECALL, DIFFERS = 0.995, math.acos(8 / 9) / math.pi
#: The least length of a segment, the least words of a fingerprint, and standard deviations above a threshold pair's bits.
SEGMENT_BITS, LANES, DEVIATIONS = 16, 8, 3.09
#: How near neighbours are that are compared first; members of a run up to which each is compared with each at once.
NEAR, SHORT_RUN = 4, 64
#: Shingles hashed at a time, rows expanded at a time; the most that a byte counts.
BLOCK, ROWS, BYTE = 1 << 15, 1 << 16, 255
#: Bytes of sets in a block, the least number of blocks, and shingles that are compared at a time.
BLOCK_BYTES, BLOCKS, AT_ONCE = 8 << 20, 32, 1 << 20
#: The eight bits of each byte as eight bytes of a 64-bit integer.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


@dataclass(frozen=True)
class Layout:
    """Segments of so many bits, in fingerprints of ``lanes`` 64-bit words."""

    bits: int
    segments: int

    @classmethod
    def of(cls, n_texts: int) -> Layout:
        bits = max(SEGMENT_BITS, n_texts.bit_length() - 2)
        meets = (1 - DIFFERS) ** bits + bits * DIFFERS * (1 - DIFFERS) ** (bits - 1)
        return cls(bits, math.ceil(math.log(1 - RECALL) / math.log(1 - meets)))

    @property
    def lanes(self) -> int:
        return max(LANES, -(-self.bits * self.segments // 64))

    @property
    def most(self) -> int:
        """Bits in which a pair may differ."""
        n = 64 * self.lanes
        return math.floor(n * DIFFERS + DEVIATIONS * math.sqrt(n * DIFFERS * (1 - DIFFERS)))

    @property
    def low(self) -> int:
        """Bits of the lower half."""
        return self.bits // 2

    def cut(self, fps: np.ndarray) -> np.ndarray:
        """Each fingerprint's (row's) segments as integers."""
        bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")[:, : self.bits * self.segments]
        padded = np.zeros((len(fps), self.segments, 64), np.uint8)
        padded[:, :, : self.bits] = bits.reshape(len(fps), self.segments, self.bits)
        return np.packbits(padded, axis=2, bitorder="little").view(np.int64)[:, :, 0]


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z and ASCII blanks only
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    n = max(1, len(tokens) - words + 1)
    found = np.zeros(n, np.uint64)
    for j in range(min(words, len(tokens))):
        found = mix64(found ^ hashed[j : j + n])
    return np.unique(found)


def fingerprints(sets: list[np.ndarray], lanes: int) -> np.ndarray:
    """A row of 64-bit words for each set. Bits are counted eight to a 64-bit integer, 255 hashes at a time."""
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    salts = mix64(np.arange(1, lanes + 1, dtype=np.uint64))
    ones = np.zeros((lanes, len(sets), 64), np.int64)
    for at in range(0, len(flat), BLOCK):
        part = flat[at : at + BLOCK]
        cuts = np.unique(np.concatenate([np.arange(0, len(part), BYTE), ends[(ends > at) & (ends < at + len(part))] - at]))
        owner = np.searchsorted(ends, at + cuts, side="right")
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        for lane in range(lanes):
            spread = SPREAD[mix64(part ^ salts[lane]).view(np.uint8).reshape(-1, 8)]
            counts = np.add.reduceat(spread, cuts, axis=0).view(np.uint8).reshape(len(cuts), 64)
            ones[lane][owner[first]] += np.add.reduceat(counts, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=2, bitorder="little").view(np.uint64)[:, :, 0].T


MARK = "struct<sh:bigint,n:int,fp:binary>"


def marks_of(lanes: int, words: int):
    """A column function: text to its set's hash and size, and its fingerprint."""

    @F.arrow_udf(MARK)
    def mark(texts: pa.Array) -> pa.Array:
        released()
        hashes, sizes, fps = [], [], []
        for part in slices(texts):
            sets = [shingles(t, words) for t in part]
            hashes += [xxhash.xxh64_intdigest(s.tobytes()) for s in sets]
            sizes += [len(s) for s in sets]
            fps += [row.tobytes() for row in fingerprints(sets, lanes)]
        return pa.StructArray.from_arrays([pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(fps, pa.binary())], ["sh", "n", "fp"])

    return mark


def words_of(column: pa.Array, lanes: int) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, lanes)


def columns_of(batch: pa.RecordBatch, lanes: int) -> list[np.ndarray]:
    """A batch's columns, of which the last one has fingerprints."""
    return [*(c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]), words_of(batch.columns[-1], lanes)]


def equal_keys(layout: Layout):
    """(sh, fp) to a row for each segment: key, sh, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                keys = layout.cut(words_of(some.column(1), layout.lanes)) + (np.arange(layout.segments, dtype=np.int64) << layout.bits)
                owner = pa.array(np.repeat(np.arange(some.num_rows), layout.segments))
                yield pa.record_batch([pa.array(keys.ravel()), some.column(0).take(owner), some.column(1).take(owner)], ["key", "sh", "fp"])

    return run


def half_keys(layout: Layout):
    """(sh, fp, n, root) to two rows for each segment: key (the segment's number, which half, and its value), other (the other
    half), sh, n, root, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = layout.low
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                cut = layout.cut(words_of(some.column(1), layout.lanes))
                halves = np.stack([cut >> low, cut & (1 << low) - 1], axis=2)  # the upper one goes with the lower one as other
                number = np.arange(2 * layout.segments, dtype=np.int64).reshape(-1, 2) << layout.bits
                owner = pa.array(np.repeat(np.arange(some.num_rows), 2 * layout.segments))
                columns = [pa.array((halves + number).ravel()), pa.array(halves[:, :, ::-1].ravel().astype(np.int32)), *(some.column(k).take(owner) for k in (0, 2, 3, 1))]
                yield pa.record_batch(columns, ["key", "other", "sh", "n", "root", "fp"])

    return run


def ordered(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.zeros(len(a), np.int64))], ["a", "b", "many"])


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of two matrices' rows."""
    out = np.zeros(len(x), np.int64)
    for lane in range(x.shape[1]):
        out += np.bitwise_count(x[:, lane] ^ y[:, lane])
    return out


def neighbours(layout: Layout):
    """Rows (key, sh, fp), sorted by key and fp, to pairs of near rows with equal keys that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last rows
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = columns_of(batch, layout.lanes)
            before = 0 if held is None else len(held[0])
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            key, sh, fp = cols
            for d in range(1, NEAR + 1):
                new = max(0, before - d)  # where the first pair with a new row begins
                at = new + np.flatnonzero(key[new : max(new, len(key) - d)] == key[new + d :])
                at = at[differing(fp[at], fp[at + d]) <= layout.most]
                yield ordered(sh[at], sh[at + d])
            held = [c[-NEAR:].copy() for c in cols]

    return run


def whole_runs(batches: Iterator[pa.RecordBatch], lanes: int, run_rows: int) -> Iterator[tuple[list[np.ndarray], int, int]]:
    """The columns of rows sorted by key (the first), cut between keys only, some ten thousand rows at a time; and (none, key,
    rows) for each key with more than run_rows, which isn't held."""
    held: list[list[np.ndarray]] = []
    rows, last, n_last = 0, None, 0  # held rows, the last key and its rows

    def given() -> Iterator[tuple[list[np.ndarray], int, int]]:
        if held:
            yield [np.concatenate(c) for c in zip(*held, strict=True)], 0, 0

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = columns_of(batch, lanes)
        key = cols[0]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        for a, b in zip(starts, ends, strict=True):
            if key[a] != last:
                if n_last > run_rows:
                    yield [], int(last), n_last
                if rows >= ROWS:
                    yield from given()
                    held, rows = [], 0
                last, n_last, begun = key[a], 0, len(held)
            n_last += int(b - a)
            if n_last > run_rows:
                if len(held) > begun:
                    rows -= sum(len(c[0]) for c in held[begun:])
                    del held[begun:]
                continue
            held.append([c[a:b].copy() for c in cols])
            rows += int(b - a)
    if n_last > run_rows:
        yield [], int(last), n_last
    yield from given()


def met(cols: list[np.ndarray], layout: Layout) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole keys' rows (key, other, sh, n, root, fp) to pairs of classes that may link: variants of the other half are made here,
    and those with the same variant are compared unless they have one root."""
    key, other, _, _, root, _ = cols
    upper = (key >> layout.bits) % 2 == 0  # equal segments are met by their upper half alone
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])).astype(np.int64)
    for bit in range(-1, max(layout.low, layout.bits - layout.low)):
        take = np.flatnonzero(upper) if bit < 0 else np.arange(len(key))
        if not len(take):
            continue
        code = other[take].astype(np.int64) & ~(1 << bit if bit >= 0 else 0)
        code |= group[take] << 32
        order = np.lexsort((root[take], code))
        code, at = code[order], take[order]
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        ends = np.append(starts[1:], len(code))
        mixed, sizes = root[at[starts]] != root[at[ends - 1]], ends - starts
        short = np.repeat(mixed & (sizes <= SHORT_RUN), sizes)
        near, own = code[short], at[short]
        for d in range(1, int(sizes[mixed & (sizes <= SHORT_RUN)].max(initial=1))):
            hit = np.flatnonzero(near[d:] == near[:-d])
            yield possible(own[hit], own[hit + d], bit, cols, layout)
        for r in np.flatnonzero(mixed & (sizes > SHORT_RUN)):
            own = at[starts[r] : ends[r]]
            cuts = np.flatnonzero(np.concatenate([[True], root[own[1:]] != root[own[:-1]]]))
            for a, b in zip(cuts, np.append(cuts[1:], len(own)), strict=True):  # a root's members with those behind them
                for i in own[a:b] if b < len(own) else ():
                    yield possible(np.full(len(own) - b, i), own[b:], bit, cols, layout)


def possible(x: np.ndarray, y: np.ndarray, bit: int, cols: list[np.ndarray], layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows' pairs those that may link and haven't met before: other roots, sizes and fingerprints near; with a wildcard,
    those that differ there."""
    key, other, sh, n, root, fp = cols
    ok = (root[x] != root[y]) & (4 * np.maximum(n[x], n[y]).astype(np.int64) <= 5 * np.minimum(n[x], n[y]).astype(np.int64))
    if bit >= 0:
        ok &= (other[x] ^ other[y]) >> bit & 1 == 1
    x, y = x[ok], y[ok]
    ok = differing(fp[x], fp[y]) <= layout.most
    x, y = x[ok], y[ok]
    if len(x):
        first = (np.bitwise_count(layout.cut(fp[x] ^ fp[y]).view(np.uint64)) <= 1).argmax(axis=1)
        ok = first == key[x] >> layout.bits + 1
        x, y = x[ok], y[ok]
    return sh[x], sh[y]


def meeting(layout: Layout, run_rows: int):
    """Rows of half_keys, sorted by key, to pairs (a, b, 0); a key with more than run_rows gives (key, 0, how many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, key, many in whole_runs(batches, layout.lanes, run_rows):
            if many:
                yield pa.record_batch([pa.array([key]), pa.array([0], pa.int64()), pa.array([many], pa.int64())], ["a", "b", "many"])
                continue
            held, rows = [], 0
            for pair in met(cols, layout):
                if len(pair[0]):
                    held.append(pair)
                    rows += len(pair[0])
                if rows > ROWS:
                    yield ordered(*map(np.concatenate, zip(*held, strict=True)))
                    held, rows = [], 0
            if held:
                yield ordered(*map(np.concatenate, zip(*held, strict=True)))
        released()

    return run


PAIRS = "a bigint, b bigint, many bigint"


def first_pairs(classes: DataFrame, layout: Layout) -> DataFrame:
    keyed = classes.select("sh", "fp").mapInArrow(equal_keys(layout), "key bigint, sh bigint, fp binary")
    dealt = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(neighbours(layout), PAIRS).select("a", "b").distinct()


def other_pairs(rooted: DataFrame, layout: Layout, run_rows: int) -> DataFrame:
    """rooted: sh, fp, n, root. All pairs that meet and have different roots, from a written table."""
    kinds = "key bigint, other int, sh bigint, n int, root bigint, fp binary"
    keyed = rooted.select("sh", "fp", "n", "root").mapInArrow(half_keys(layout), kinds)
    found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meeting(layout, run_rows), PAIRS)
    found = written(found.distinct(), "widepairs")
    pairs = found.where("many = 0").select("a", "b")
    large = found.where("many > 0").select(F.col("a").alias("key"), F.ceil(F.col("many") * 2 / run_rows).cast("int").alias("blocks"))
    if not large.head(1):
        return pairs
    rows = keyed.join(few(large), "key").withColumn("block", F.pmod(F.xxhash64("sh"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("beside", F.explode(F.expr("sequence(0, blocks - 1)")))
    # the key stays the order within a pair of blocks, as the half that it stands for counts
    rows = rows.withColumn("pair", F.xxhash64("key", F.least("block", "beside"), F.greatest("block", "beside")))
    dealt = rows.repartition("pair").sortWithinPartitions("pair", "key")
    kept = dealt.select("pair", "key", "other", "sh", "n", "root", "fp")
    more = kept.mapInArrow(meeting_blocks(layout), PAIRS)
    return written(pairs.unionByName(more.select("a", "b")).distinct(), "wideothers")


def meeting_blocks(layout: Layout):
    """As meeting, with the pair of blocks before the key: a change of either ends a run."""
    plain = meeting(layout, 1 << 62)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        held: list[pa.RecordBatch] = []
        for batch in batches:
            pair = batch.column(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else []
            for a, b in zip(starts, [*starts[1:], len(pair)], strict=True):
                if held and pair[a] != last:
                    yield from plain(iter(held))
                    held = []
                last = pair[a]
                held.append(batch.slice(a, b - a).select(["key", "other", "sh", "n", "root", "fp"]))
        if held:
            yield from plain(iter(held))

    return run


def sets_of(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                found = [shingles(t, words).tobytes() for t in part]
                yield pa.record_batch([batch.column(0).slice(at, len(part)), pa.array(found, pa.binary())], ["sh", "found"])
                at += len(part)

    return run


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block pair, a, b, set of a), sorted, a block pair's sets (null b) before its pairs, to the pairs that link."""
    at, sets = None, {}
    for batch in batches:
        blocks, a, b = (c.to_pylist() for c in batch.columns[:3])
        found, ends, k = batch.column(3), len(a), 0
        links: list[tuple[int, int]] = []
        while k < ends:
            if blocks[k] != at:
                at, sets = blocks[k], {}
            if b[k] is None:
                sets[a[k]] = np.frombuffer(found[k].as_py(), np.uint64)
                k += 1
                continue
            own, others, n = sets[a[k]], [], 0
            first = k
            while k < ends and blocks[k] == at and b[k] is not None and a[k] == a[first] and n < AT_ONCE:
                others.append(sets[b[k]])
                n += len(others[-1])
                k += 1
            flat = np.concatenate(others)
            equal = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            sizes = np.array([len(x) for x in others])
            both = np.add.reduceat(equal, np.cumsum(sizes) - sizes, dtype=np.int64)
            links += [(a[first], b[first + j]) for j in np.flatnonzero(9 * both >= 4 * (len(own) + sizes))]
        yield pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])
    sets = {}
    released()


def confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a written table) whose sets have the similarity."""
    wanted = pairs.select(F.col("a").alias("sh")).unionByName(pairs.select(F.col("b").alias("sh"))).distinct()
    wanted = written(classes.select("sh", "th").join(wanted, "sh"), "widewanted")
    own = texts.join(few(wanted), "th").groupBy("sh").agg(F.first("text").alias("text"))
    sets = written(own.mapInArrow(sets_of(words), "sh bigint, found binary"), "widesets")
    total = sets.agg(F.sum(F.octet_length("found"))).first()[0] or 0
    n = max(BLOCKS, math.ceil(total / BLOCK_BYTES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n))
    dealt = pairs.withColumn("blocks", F.least(block("a"), block("b")) * n + F.greatest(block("a"), block("b")))
    needed = dealt.select("blocks", F.col("a").alias("sh")).unionByName(dealt.select("blocks", F.col("b").alias("sh"))).distinct()
    held = needed.join(sets, "sh").select("blocks", F.col("sh").alias("a"), F.lit(None).cast("bigint").alias("b"), "found")
    rows = held.unionByName(dealt.withColumn("found", F.lit(None).cast("binary")).select("blocks", "a", "b", "found"))
    # sets first: their b is null, pairs by a
    in_order = rows.repartition("blocks").sortWithinPartitions("blocks", F.col("b").isNotNull(), "a")
    links = written(in_order.mapInArrow(compared, "a bigint, b bigint"), "widelinks")
    drop_written(wanted, sets)
    return links


def near_groups(classes: DataFrame, texts: DataFrame, words: int, layout: Layout, run_rows: int = 1 << 20) -> DataFrame:
    """classes: sh, th, n, fp. Gives (node, root) of all classes that have a link."""
    pairs = written(first_pairs(classes, layout), "widefirst")
    first = confirmed(pairs, classes, texts, words)
    drop_written(pairs)
    groups = written(components(first), "widegroups")
    rooted = classes.join(few(groups), F.col("sh") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sh"))
    second = confirmed(other_pairs(rooted, layout, run_rows), classes, texts, words)
    found = components(first.unionByName(second))
    drop_written(groups)
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, run_rows: int = 1 << 20) -> DataFrame:
    """One document of each group with all its columns: the smallest id; of equal or null ids, one by the text's hash."""
    text = F.col(text_col).cast("string")
    layout = Layout.of(docs.count())
    texts = docs.select(F.xxhash64(text).alias("th"), text.alias("text"))
    mark = marks_of(layout.lanes, words)(text).alias("mark")
    with scratch(docs.sparkSession) as keep:
        marks = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), mark).select("id", "th", "mark.*")
        marks = written(marks, "widemarks")
        classes = written(marks.groupBy("sh").agg(F.first(F.struct("th", "n", "fp")).alias("one")).select("sh", "one.*"), "wideclasses")
        groups = near_groups(classes, texts, words, layout, run_rows)
        rooted = classes.select("sh").join(groups, F.col("sh") == F.col("node"), "left").select("sh", F.coalesce("root", "sh").alias("root"))
        return keep_first(docs, marks.select("id", "th", "sh"), rooted, "sh", id_col, text_col, keep)
