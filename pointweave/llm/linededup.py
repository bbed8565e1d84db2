"""Line dedup over a sharded minimal perfect hash.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of at least ``min_chars``
code points that at least ``min_docs`` documents hold lose all their lines, except in the document with the largest id.

1. Every document emits the 128-bit hashes of its distinct long keys; an aggregation counts documents and keeps the
   largest id (map-side combined, so a line that a third of all documents share costs one row per task).
2. The hashes with enough documents, cut into shards of ``shard_keys``, are each laid out by a minimal perfect hash
   (levels of bit arrays; the rank of the set bit is the slot) that indexes arrays of 64-bit fingerprints, counts and
   largest ids. Hashes below the threshold can never drop a line: probing rejects them by their fingerprint.
3. Documents probe the arrays. Up to ``broadcast_bytes`` (measured, not guessed) the shards are broadcast; beyond that
   the documents' hashes go to the shards, salted by the counted lines and by how many documents share a line of the
   shard, and stream past the shard's arrays, which come first; only the hits come back to their documents.

Ids are cast to bigint; ids of a type that has no such cast are Spark's error.

Defined results: each input row is one document, so repeated rows count as often as they occur, and all rows that have
the largest id keep their lines. A null id is smaller than every other. A null or empty text is one empty line. The
operator adds one struct column and keeps all others; a column that already has that name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import few, fresh, mix64, slices
from pointweave.storage import drop_written, written

BLANK = b" \t\n\x0b\x0c\r"
NO_ID = -(2**63)
RESULT = "struct<kept:string,n_lines:bigint,n_dropped:bigint>"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def is_long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)


def hashes(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes, as rows of two unsigned integers."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), ">u8").astype(np.uint64).reshape(-1, 2)


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit hashes with arrays for their fingerprints, counts and last ids."""

    GAMMA, LEVELS = 2.0, 40

    def __init__(self, words: np.ndarray, ends: np.ndarray, fingerprint: np.ndarray, count: np.ndarray, last: np.ndarray):
        self.words, self.ends = words, ends
        self.fingerprint, self.count, self.last = fingerprint, count, last
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray, count: np.ndarray, last: np.ndarray) -> PerfectHash:
        left, levels, ends = np.arange(len(hi)), [], []
        for level in range(cls.LEVELS):
            if not len(left):
                break
            n_words = max(1, int(np.ceil(cls.GAMMA * len(left) / 64)))
            at = cls.place(hi[left], lo[left], level, n_words)
            alone = np.bincount(at, minlength=64 * n_words) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            ends.append(n_words)
            left = left[~alone[at]]
        if len(left):
            raise ValueError("hashes must be distinct")
        words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        out = cls(words, np.cumsum(ends, dtype=np.int64), np.zeros(len(hi), np.uint64), np.zeros(len(hi), np.uint32), np.zeros(len(hi), np.int64))
        slot = out.slots(hi, lo)
        out.fingerprint[slot], out.last[slot] = lo, last
        out.count[slot] = np.minimum(count, 2**32 - 1)
        return out

    @staticmethod
    def place(hi: np.ndarray, lo: np.ndarray, level: int, n_words: int) -> np.ndarray:
        salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
        return (mix64(hi ^ mix64(lo + salt)) % np.uint64(64 * n_words)).astype(np.int64)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 for some that were not built in, any slot for others: compare the fingerprint."""
        out, left, start = np.full(len(hi), -1, np.int64), np.arange(len(hi)), 0
        for level, end in enumerate(self.ends):
            if not len(left):
                break
            at = self.place(hi[left], lo[left], level, int(end - start))
            word, bit = start + (at >> 6), (at & 63).astype(np.uint64)
            held = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[held]] = (self.before[word] + np.bitwise_count(below))[held]
            left, start = left[~held], end
        return out

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where its fingerprint is another one's."""
        at = self.slots(hi, lo)
        if len(self.fingerprint):
            at[self.fingerprint[at] != lo] = -1
        return at

    def row(self) -> dict:
        return {k: getattr(self, k).tobytes() for k in ("words", "ends", "fingerprint", "count", "last")}

    @classmethod
    def of(cls, row: dict) -> PerfectHash:
        kinds = {"words": np.uint64, "ends": np.int64, "fingerprint": np.uint64, "count": np.uint32, "last": np.int64}
        return cls(*(np.frombuffer(row[k], kind) for k, kind in kinds.items()))


SHARD = "shard int, most bigint, words binary, ends binary, fingerprint binary, `count` binary, last binary"


def shard_of(hi: np.ndarray, n_shards: int) -> np.ndarray:
    return ((hi & np.uint64(2**63 - 1)) % np.uint64(n_shards)).astype(np.int64)


def shard_column(n_shards: int) -> Column:
    """As shard_of."""
    return (F.col("hi").bitwiseAND(F.lit(2**63 - 1)) % F.lit(n_shards)).cast("int")


def emit(min_chars: int):
    """Batches of (id, text) to (hi, lo, id) of each document's distinct long keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False), 0
            for texts in slices(batch.column(1)):
                keys, owners = [], []
                for k, text in enumerate(texts):
                    found = {x for x in map(line_key, (text or "").encode().split(b"\n")) if is_long(x, min_chars)}
                    keys += found
                    owners += [at + k] * len(found)
                at += len(texts)
                both = hashes(keys).view(np.int64)
                yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids[owners].astype(np.int64) if owners else np.zeros(0, np.int64))], ["hi", "lo", "id"])

    return run


def build_shard(key: tuple, table: pa.Table) -> pa.Table:
    hi, lo = (table.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
    row = PerfectHash.build(hi, lo, table.column("n").to_numpy(), table.column("last").to_numpy()).row()
    most = max(table.column("n").to_pylist())
    arrays = {"shard": pa.array([key[0].as_py()], pa.int32()), "most": pa.array([most], pa.int64())} | {k: pa.array([v], pa.binary()) for k, v in row.items()}
    return pa.table(arrays)


class LineIndex:
    """The shards, as a table in the shared folder."""

    def __init__(self, table: DataFrame, n_shards: int, n_keys: int, n_bytes: int):
        self.table, self.n_shards, self.n_keys, self.n_bytes = table, n_shards, n_keys, n_bytes


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 40, min_docs: int = 5, shard_keys: int = 65536) -> LineIndex:
    lines = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    lines = lines.mapInArrow(emit(min_chars), "hi bigint, lo bigint, id bigint")
    keys = lines.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs)
    keys = written(keys, "linekeys")
    n_keys = keys.count()
    n_shards = max(1, -(-n_keys // shard_keys))
    keys_by_shard = keys.withColumn("shard", shard_column(n_shards))
    table = written(keys_by_shard.groupBy("shard").applyInArrow(build_shard, SHARD), "lineindex")
    size = sum((F.length(c) for c in ("words", "ends", "fingerprint", "count", "last")), F.lit(0))
    n_bytes = table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    drop_written(keys)
    return LineIndex(table, n_shards, n_keys, n_bytes)


def drop_from(text: str | None, gone) -> tuple[str, int, int]:
    """gone: for each line, whether it goes."""
    lines = (text or "").split("\n")
    kept = [x for x, g in zip(lines, gone, strict=True) if not g]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def long_lines(texts: list) -> tuple[list[int], list[int], list[bytes], list[int]]:
    """Row and line number of all keys of texts, the keys, and the number of lines of each text."""
    rows, numbers, keys, n_lines = [], [], [], []
    for k, text in enumerate(texts):
        lines = (text or "").encode().split(b"\n")
        n_lines.append(len(lines))
        for j, line in enumerate(lines):
            rows.append(k)
            numbers.append(j)
            keys.append(line_key(line))
    return rows, numbers, keys, n_lines


def judge(texts: list, verdict, min_chars: int) -> list[dict]:
    """verdict(rows, hi, lo): whether each long key's lines go from that row."""
    rows, numbers, keys, n_lines = long_lines(texts)
    picked = [k for k, key in enumerate(keys) if is_long(key, min_chars)]
    gone = [[False] * n for n in n_lines]
    if picked:
        both = hashes([keys[k] for k in picked])
        for k, g in zip(picked, verdict(np.array([rows[k] for k in picked]), both[:, 0], both[:, 1]), strict=True):
            gone[rows[k]][numbers[k]] = bool(g)
    return [dict(zip(("kept", "n_lines", "n_dropped"), drop_from(t, g), strict=True)) for t, g in zip(texts, gone, strict=True)]


ARRAYS = ("words", "ends", "fingerprint", "count", "last")


def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, hi, lo, id, arrays), a shard's arrays before the hashes that probe it, to hits (id, lo). A shard and a batch
    are held at a time."""
    at, shard = None, None
    for batch in batches:
        to = batch.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else []
        for a, b in zip(starts, [*starts[1:], len(to)], strict=True):
            if to[a] != at:
                at, shard = to[a], None
            some = batch.slice(a, b - a)
            arrays = some.filter(some.column(4).is_valid())
            if arrays.num_rows:  # of several salts the same
                shard = PerfectHash.of(arrays.slice(0, 1).to_pylist()[0])
            probes = some.filter(some.column(4).is_null())
            if shard is None or not probes.num_rows:
                continue
            hi, lo, ids = (probes.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3))
            slot = shard.find(hi.view(np.uint64), lo.view(np.uint64))
            hit = (slot >= 0) & (shard.last[slot] != ids)
            yield pa.record_batch([pa.array(ids[hit]), pa.array(lo[hit])], ["id", "lo"])


RESULT_ARROW = pa.struct([("kept", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "lines", *, min_chars: int = 40, min_docs: int = 5, shard_keys: int = 65536, broadcast_bytes: int = 48 << 20, salts: int = 16, salt_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with a struct column ``out``: kept (the text without its dropped lines), n_lines, n_dropped."""
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col, min_chars=min_chars, min_docs=min_docs, shard_keys=shard_keys)
    if index.n_bytes <= broadcast_bytes:
        n_shards = index.n_shards
        shards = spark.sparkContext.broadcast({r["shard"]: r.asDict() for r in index.table.collect()})  # at most broadcast_bytes
        drop_written(index.table)
        opened: dict[int, PerfectHash] = {}

        @F.arrow_udf(RESULT)
        def probe(ids: pa.Array, texts: pa.Array) -> pa.Array:
            if not opened and shards.value:
                opened.update({k: PerfectHash.of(r) for k, r in shards.value.items()})
            ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
            done: list[dict] = []
            for part in slices(texts):
                own = ids[len(done) : len(done) + len(part)]

                def verdict(rows, hi, lo, own=own):
                    gone, to = np.zeros(len(hi), bool), shard_of(hi, n_shards)
                    for s in np.unique(to):
                        if int(s) in opened:
                            here, shard = np.flatnonzero(to == s), opened[int(s)]
                            at = shard.find(hi[here], lo[here])
                            gone[here] = (at >= 0) & (shard.last[at] != own[rows[here]])
                    return gone

                done += judge(part, verdict, min_chars)
            return pa.array(done, RESULT_ARROW)

        return docs.withColumn(out, probe(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).alias(out))

    n_shards = index.n_shards
    n_lines = docs.agg(F.sum(F.size(F.split(F.col(text_col).cast("string"), "\n")))).first()[0] or 0  # at least as many as probe
    salts = max(salts, -(-n_lines // (n_shards * salt_rows)))
    probes = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    probes = probes.mapInArrow(emit(min_chars), "hi bigint, lo bigint, id bigint")
    # a shard with a line that very many documents share is dealt out further, by that line's count
    index_rows = index.table.withColumn("salts", F.greatest(F.lit(salts), F.ceil(F.col("most") / salt_rows)).cast("int"))
    hot = written(index_rows.where(F.col("salts") > salts).select("shard", "salts"), "lineshot")
    probes = probes.withColumn("shard", shard_column(n_shards)).join(few(hot), "shard", "left")
    probes = probes.withColumn("salt", F.pmod(F.xxhash64("id", "hi"), F.coalesce("salts", F.lit(salts))).cast("int")).drop("salts")
    index_rows = index_rows.withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).drop("salts", "most")
    # both kinds of rows in one stream, a shard's arrays before its probes
    both = probes.unionByName(index_rows, allowMissingColumns=True)
    dealt = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("words").isNull())
    hits = dealt.select("shard", "hi", "lo", "id", *ARRAYS).mapInArrow(route, "id bigint, lo bigint")
    key, gone = fresh(docs, "line_owner"), fresh(docs, "line_hits")
    hits = hits.groupBy("id").agg(F.collect_set("lo").alias(gone)).withColumnRenamed("id", key)

    @F.arrow_udf(RESULT)
    def drop(texts: pa.Array, hits: pa.Array) -> pa.Array:
        done: list[dict] = []
        for part in slices(texts):
            own = hits.slice(len(done), len(part)).to_pylist()
            sets = [set(x or ()) for x in own]
            done += judge(part, lambda rows, hi, lo, sets=sets: [int(x) in sets[r] for r, x in zip(rows, lo.view(np.int64), strict=True)], min_chars)
        return pa.array(done, RESULT_ARROW)

    joined = docs.join(hits, F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)) == F.col(key), "left")
    return joined.withColumn(out, drop(F.col(text_col).cast("string"), F.col(gone))).drop(key, gone)
