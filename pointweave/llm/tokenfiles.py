"""Token ids in binary files of shuffled planes.

A file holds the ids of some documents, one after the other, cut into blocks of a fixed number of ids. Each block is
transposed: plane k has bit k (or byte k) of all its ids, so that high planes, which hardly change, compress to next to
nothing. Each plane is a zstandard frame. The layout, integers little-endian:

    magic (8 bytes) | planes of block 0, planes of block 1, ... | index (a zstandard frame) | u64 place of the index | magic

    index: u32 ids a block | u8 bits of a plane (1 or 8) | u64 blocks | u64 documents
           | for each block: u64 place, u32 ids, u8 planes, u32 bytes of each of its planes
           | for each document: i64 id, u8 whether it has one, u64 ids

The index lets a reader open any block, and so any document, alone.

Documents are range-partitioned by id and the text's hash (so rows of one id are dealt out too) and sorted, and each partition
gives one file or more: a file is closed at ``roll_ids`` ids or ``roll_docs`` documents, so neither it nor the index in memory
grows with the partition. Files in the order of their partitions hold the documents in ascending order. Only a row per file
reaches the driver, for the running number of ids.

Encoding cuts texts into pieces (the tokenizer drops white space and never joins over it), has the library encode each
piece that its worker's bounded cache lacks, many joined by blanks at a time, and puts the ids together again.

Defined results: a null or empty text has the end id only. A null id comes first. Rows with equal ids are ordered by their
texts' hashes, then by their texts, and keep a row each. Only the id and text columns are read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm import latin
from pointweave.llm.common import TwoGenerations, slices
from pointweave.llm.files import Folder, own_name
from pointweave.storage import drop_written, new_path, written

MAGIC = b"PWIDPLN1"


# planes


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """ids (uint32) to planes, the lowest first; planes above the highest id's are left out."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    if bits == 8:
        return [ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, k].tobytes() for k in range(-(-top // 8))]
    return [np.packbits((ids >> np.uint32(k) & np.uint32(1)).astype(bool), bitorder="little").tobytes() for k in range(top)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        held = np.frombuffer(plane, np.uint8)
        if bits == 1:
            held = np.unpackbits(held, count=n, bitorder="little")
        out |= held.astype(np.uint32) << np.uint32(k * bits)
    return out


class Writer:
    """Writes one file; add() documents in order, then close()."""

    def __init__(self, out, block_ids: int = 1 << 16, bits: int = 1, level: int = 3):
        self.out, self.block_ids, self.bits, self.at = out, block_ids, bits, len(MAGIC)
        self.press = zstandard.ZstdCompressor(level=level).compress
        self.blocks: list[bytes] = []
        self.docs: list[tuple[int | None, int]] = []
        self.wait: list[np.ndarray] = []
        self.waiting = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            self.flush(self.waiting // self.block_ids * self.block_ids)

    def flush(self, n: int) -> None:
        ids = np.concatenate(self.wait) if self.wait else np.zeros(0, np.uint32)
        for k in range(0, n, self.block_ids):
            block = ids[k : min(n, k + self.block_ids)].astype(np.uint32)
            planes = [self.press(p) for p in to_planes(block, self.bits)]
            self.blocks.append(struct.pack(f"<QIB{len(planes)}I", self.at, len(block), len(planes), *map(len, planes)))
            for p in planes:
                self.out.write(p)
                self.at += len(p)
        self.wait, self.waiting = [ids[n:].copy()], self.waiting - n

    def close(self) -> None:
        if self.waiting:
            self.flush(self.waiting)
        head = struct.pack("<IBQQ", self.block_ids, self.bits, len(self.blocks), len(self.docs))
        docs = b"".join(struct.pack("<qBQ", d or 0, d is not None, n) for d, n in self.docs)
        self.out.write(self.press(head + b"".join(self.blocks) + docs))
        self.out.write(struct.pack("<Q", self.at) + MAGIC)


class Reader:
    """Opens the index of one file; block(k) reads one block, documents() all in order."""

    def __init__(self, file):
        self.file, size = file, file.size()
        at, magic = struct.unpack("<Q8s", file.read_at(16, size - 16))
        if magic != MAGIC or file.read_at(8, 0) != MAGIC:
            raise ValueError("not a file of id planes")
        index = zstandard.ZstdDecompressor().decompressobj().decompress(file.read_at(size - 16 - at, at))
        self.block_ids, self.bits, n_blocks, n_docs = struct.unpack_from("<IBQQ", index)
        k, self.blocks = struct.calcsize("<IBQQ"), []
        for _ in range(n_blocks):
            place, n, planes = struct.unpack_from("<QIB", index, k)
            sizes = struct.unpack_from(f"<{planes}I", index, k + 13)
            self.blocks.append((place, n, sizes))
            k += 13 + 4 * planes
        self.docs = [(d if has else None, n) for d, has, n in struct.iter_unpack("<qBQ", index[k : k + 17 * n_docs])]

    def block(self, k: int) -> np.ndarray:
        place, n, sizes = self.blocks[k]
        raw, planes, at = self.file.read_at(sum(sizes), place), [], 0
        for s in sizes:
            planes.append(zstandard.ZstdDecompressor().decompressobj().decompress(raw[at : at + s]))
            at += s
        return from_planes(planes, n, self.bits)

    def document(self, k: int) -> np.ndarray:
        """The ids of document k alone, from the blocks that hold it."""
        start = sum(n for _, n in self.docs[:k])
        end = start + self.docs[k][1]
        held = [self.block(b) for b in range(start // self.block_ids, -(-end // self.block_ids))]
        first = start // self.block_ids * self.block_ids
        return np.concatenate([*held, np.zeros(0, np.uint32)])[start - first : end - first]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        k, held = 0, np.zeros(0, np.uint32)
        for doc_id, n in self.docs:
            parts, need = [], n
            while need:
                if not len(held):
                    held, k = self.block(k), k + 1
                parts.append(held[:need])
                held, need = held[need:], need - len(parts[-1])
            yield doc_id, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


# encoding


class WordEncoder(TwoGenerations):
    """Piece of text without ASCII blanks to packed ids, encoded by the tokenizers library.

    Pieces are a text's runs between ASCII blanks. If the tokenizer composes, lower-cases and then splits by a pattern, a
    text of Latin characters only (all composed already) is lower-cased and split likewise here, so that its pieces are
    single pre-tokens, of which there are far fewer distinct ones.
    """

    def __init__(self, path: str, limit: int = 400_000):
        super().__init__(limit)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        end = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if end and t.endswith(end)]] = True
        self.find = self.pattern() if end else None
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        # texts with these are left to the library: characters beyond, those whose lower case is, special tokens
        leave = "".join(c for c in map(chr, range(latin.END)) if len(c.lower()) > 1 or ord(c.lower()) >= latin.END)
        self.odd = re.compile("|".join([f"[^\\x00-{chr(latin.END - 1)}]", f"[{leave}]", *map(re.escape, added)])).search

    def pattern(self):
        """findall of the tokenizer's pattern over lower-cased Latin text, or None if it works otherwise."""
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        blanks = [s for s in steps if s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " "]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        known = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and blanks and [s["type"] for s in splits] == ["Split", "ByteLevel"]
        if not known or not splits[0]["invert"] or splits[0]["behavior"] != "Removed" or splits[1]["use_regex"] or splits[1]["add_prefix_space"]:
            return None
        plain = latin.plain_pattern(splits[0]["pattern"].get("Regex", "\\"))
        return re.compile(plain).findall if plain else None

    def encode_single(self, pieces: list[str]) -> list[bytes]:
        """Each is one pre-token, whose last id alone ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(pieces):
            return self.encode_pieces(pieces)
        packed, ends = ids.astype("<u4").tobytes(), [0, *(ends * 4).tolist()]
        return [packed[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in pieces])])
        owner = np.searchsorted(starts, np.array([a for a, _ in found.offsets], np.int64), side="right") - 1
        ends = (np.searchsorted(owner, np.arange(len(pieces) + 1)) * 4).tolist()
        packed = np.array(found.ids, "<u4").tobytes()
        return [packed[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, texts: list) -> list[np.ndarray]:
        self.rotate()
        cut, single, other = [], set(), set()
        for t in texts:
            if not t:
                cut.append([])
            elif self.find is not None and not self.odd(t):
                cut.append(self.find(t.lower()))
                single.update(cut[-1])
            else:
                cut.append([p.decode() for p in t.encode().split()])
                other.update(cut[-1])
        for pieces, encode in ((self.unknown(single), self.encode_single), (self.unknown(other - single), self.encode_pieces)):
            for at in range(0, len(pieces), 2000):
                some = pieces[at : at + 2000]
                self.update(zip(some, encode(some), strict=True))
        get = self.__getitem__
        return [np.frombuffer(b"".join(map(get, pieces)), "<u4") for pieces in cut]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# Spark


def write_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 1, folder: str | None = None, block_ids: int = 1 << 16, bits: int = 1, level: int = 3, roll_ids: int = 1 << 26, roll_docs: int = 1 << 17) -> DataFrame:
    """Write all documents' ids to files in ``folder`` (a new one in the shared folder) and return the manifest:
    folder, name, n_docs, start (ids in all files before), n_ids; a row per file in ascending order."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "ids")

    kinds = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, out, n_ids, done = None, None, 0, 0
        coder, end = word_encoder(tokenizer), np.array([end_id], np.uint32)

        def closed() -> pa.RecordBatch:
            writer.close()
            out.close()
            row = {"part": TaskContext.get().partitionId(), "file": done, "name": name, "n_docs": len(writer.docs), "n_ids": n_ids}
            return pa.RecordBatch.from_pylist([row], kinds)

        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for part in slices(batch.column(1)):
                for found in coder.encode(part):
                    if writer is None:
                        name = own_name("ids")
                        out = Folder(folder).write(name)
                        writer, n_ids = Writer(out, block_ids, bits, level), 0
                    writer.add(ids[at], np.concatenate([found, end]))
                    n_ids += len(found) + 1
                    at += 1
                    if n_ids >= roll_ids or len(writer.docs) >= roll_docs:
                        yield closed()
                        writer, done = None, done + 1
        if writer is not None:
            yield closed()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    dealt = rows.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash", "text").select("id", "text")
    manifest = written(dealt.mapInArrow(run, "part int, file int, name string, n_docs bigint, n_ids bigint"), "idfiles")
    found, start, out = sorted(manifest.collect()), 0, []  # a row per file
    drop_written(manifest)
    for r in found:
        out.append((folder, r["name"], r["n_docs"], start, r["n_ids"]))
        start += r["n_ids"]
    return spark.createDataFrame(out, "folder string, name string, n_docs bigint, start bigint, n_ids bigint").repartition(max(1, len(out)))


def read_ids(manifest: DataFrame) -> DataFrame:
    """The documents in the files: doc_id, start, n_tokens, ids_crc32, a file at a time, a document's ids at a time."""
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, rows = row["start"], []
                with Folder(row["folder"]).read(row["name"]) as file:
                    for doc_id, ids in Reader(file).documents():
                        rows.append({"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())})
                        start += len(ids)
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return manifest.select("folder", "name", "start").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
