import base64
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointweave.llm import bpe, queries, tokencounts, tokenfiles

WORD, BYTE, PIECE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
ODD = ["a", "B", "é", "É", "é", "İ", "ß", "Σ", "ς", "ǅ", "ŉ", "ª", "'s", "'LL", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x85", "\xa0", " ", "\x1c", "1", "22", "!", ".", ",", "#\x1c#", "中文", "<|endoftext|>", "‍", "😀", "ﬁ", "﻿", "\x00", "Å", "word", "Word.", "word,", "çà?"]


def odd_texts(n=1500):
    r = random.Random(4)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(tik):
    own, r = bpe.encoder(BYTE, P.PATTERN), random.Random(1)
    long = ["".join(r.choice("abcdeé́中") for _ in range(n)) for n in (60, 64, 65, 130, 5000, 60_000)]
    texts = odd_texts() + long + ["", None, "x" * 40_000, " " * 30_000]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == tik.encode_ordinary(text or "")
        assert own.decode(ids.tolist()) == (text or "").encode()


def test_bpe_rows_equal_one_tree():
    ranks, r = bpe.Ranks(BYTE), random.Random(2)
    for size in bpe.SIZES:
        pieces = [bytes(r.choice(b"theandingerst \xc3\xa9") for _ in range(r.randint(1, size))) for _ in range(300)]
        assert [np.frombuffer(x, "<i4").tolist() for x in ranks.merge_rows(pieces, size)] == [ranks.merge(p).tolist() for p in pieces]


def test_bpe_cache_may_be_tiny(tik):
    own = bpe.Encoder(BYTE, P.PATTERN, limit=3)
    for text in odd_texts(200):
        assert own.encode([text])[0].tolist() == tik.encode_ordinary(text)


def test_bpe_query(spark, sf_dir, tik, docs_of):
    for frame in (spark.read.parquet(f"{sf_dir}/documents.parquet"), docs_of([(1, None), (1, ""), (None, "a b"), (2, "c " * 50_000)]), docs_of([])):
        texts = [(r["doc_id"], r["text"] or "") for r in frame.collect()]
        ids = [(i, t, tik.encode_ordinary(t)) for i, t in texts]
        want = [(i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t, x in ids]
        assert sorted((tuple(r) for r in queries.bpe_digests(frame).collect()), key=str) == sorted(want, key=str)


def test_words_equal_the_library():
    own = tokenfiles.WordEncoder(WORD, limit=300)
    texts = odd_texts() + ["".join(chr(c) + "." for c in range(0x20, 0x530))]
    texts += [f"a{chr(c)}b {chr(c)} 'S{chr(c)}'re1" for c in range(0x260)] + ["they're we'LL x's'm 'd''ve"]
    library = Tokenizer.from_file(WORD)
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], own.encode(texts[at : at + 100]), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_planes_round_trip(bits, block):
    rng, file = np.random.default_rng(9), File()
    docs = [(k if k % 5 else None, rng.integers(0, 2 ** int(rng.integers(1, 33)), int(rng.integers(0, 90))).astype(np.uint32)) for k in range(40)]
    writer = tokenfiles.Writer(file, block, bits)
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    reader = tokenfiles.Reader(file)
    for (d, ids), (got_d, got) in zip(docs, reader.documents(), strict=True):
        assert d == got_d and np.array_equal(ids, got)
    assert all(np.array_equal(reader.document(k), docs[k][1]) for k in range(40))


def test_no_documents():
    file = File()
    tokenfiles.Writer(file).close()
    assert list(tokenfiles.Reader(file).documents()) == []


def hash_of(text):
    """Spark's xxhash64 of a text, signed."""
    return np.array([xxhash.xxh64_intdigest((text or "").encode(), 42)], np.uint64).view(np.int64)[0]


def test_token_files(spark, sf_dir, docs_of):
    library = Tokenizer.from_file(WORD)
    odd = docs_of([(3, "b a"), (3, "a"), (1, None), (2, ""), (None, "x"), (5, "word " * 60_000)])
    for frame in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd, docs_of([])):
        for bits in (1, 8):
            rows = sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0], hash_of(r[1]), r[1] or ""))
            start, want = 0, []
            for i, t in rows:
                ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
                want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
            got = tokenfiles.read_ids(tokenfiles.write_ids(frame, WORD, bits=bits, block_ids=1000))
            assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == want


def brute_count(text, costs):
    """The least cost and, of equal ones, the fewest pieces of one word, by a plain table."""
    word = tokencounts.MARK + text
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + n * tokencounts.BYTE_COST, best[end - 1][1] + n)]
        options += [(best[s][0] + costs[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in costs]
        best.append(min(options))
    return best[-1]


def test_token_counts(spark, sf_dir, docs_of):
    costs = tokencounts.load_costs(PIECE)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    texts += odd_texts(300) + [None, "", "中" * 50, "thethethe" * 40]
    own = tokencounts.Terminals(costs, limit=500)
    got = [r for at in range(0, len(texts), 64) for r in own.count(texts[at : at + 64])]
    for text, row in zip(texts, got, strict=True):
        each = [brute_count(w.decode(), costs) for w in (text or "").encode().split()]
        assert row == (len(each), sum(p for _, p in each), sum(c for c, _ in each))
    frame = docs_of([(k, t) for k, t in enumerate(texts)])
    found = frame.select("doc_id", tokencounts.token_counts(F.col("text"), PIECE).alias("c")).select("doc_id", "c.*").collect()
    assert sorted(tuple(r) for r in found) == [(k, *row) for k, row in enumerate(got)]
    tiny = tokencounts.Terminals(costs, limit=3, nodes=10)
    assert [r for t in texts for r in tiny.count([t])] == got


def test_token_counts_query(spark, sf_dir):
    costs, known = tokencounts.load_costs(PIECE), {}
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        words = (r["text"] or "").encode().split()
        for w in set(words) - set(known):
            known[w] = brute_count(w.decode(), costs)
        want.append((r["doc_id"], len(words), sum(known[w][1] for w in words), sum(known[w][0] for w in words)))
    assert sorted(tuple(r) for r in queries.op8_token_counts(spark, sf_dir).collect()) == sorted(want)


def test_token_counts_edges(docs_of):
    count = lambda df: sorted((tuple(r) for r in df.select("doc_id", tokencounts.token_counts(F.col("text"), PIECE).alias("c")).select("doc_id", "c.*").collect()), key=str)
    assert count(docs_of([])) == []
    long = "word " * 100_000 + "x" * 700
    rows = count(docs_of([(None, "a b"), (3, "a b"), (3, "a b"), (4, None), (5, ""), (6, " \n\t"), (7, long)]))
    costs = tokencounts.load_costs(PIECE)
    ab, last = [brute_count(w, costs) for w in ("a", "b")], [brute_count("word", costs)] * 100_000 + [brute_count("x" * 700, costs)]
    total = lambda found: (len(found), sum(p for _, p in found), sum(c for c, _ in found))
    assert rows == sorted([(None, *total(ab)), (3, *total(ab)), (3, *total(ab)), (4, 0, 0, 0), (5, 0, 0, 0), (6, 0, 0, 0), (7, *total(last))], key=str)


def test_files_roll_and_ids_repeat(spark, docs_of):
    """Small files, rows of one id in several tasks, and what the files hold one after the other."""
    rows = [(7, f"word {k} of many") for k in range(300)] + [(None, "x")] * 20 + [(k, "a b") for k in range(30)]
    library = Tokenizer.from_file(WORD)
    for limits in ({"roll_docs": 7}, {"roll_ids": 50}):
        manifest = tokenfiles.write_ids(docs_of(rows).repartition(4), WORD, bits=8, **limits)
        files = manifest.orderBy("start").collect()
        assert sum(f["n_docs"] for f in files) == 350 and len(files) > 40
        assert all(f["n_docs"] <= 7 if "roll_docs" in limits else f["n_ids"] < 60 for f in files)
        got = tokenfiles.read_ids(manifest).orderBy("start").collect()
        assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
        ids = [r["doc_id"] for r in got]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
        crcs = sorted(zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for _, t in rows)
        assert sorted(r["ids_crc32"] for r in got) == crcs


def test_long_pre_tokens_leave_the_caches(tik):
    own, words = bpe.Encoder(BYTE, P.PATTERN), tokenfiles.WordEncoder(WORD)
    for k in range(20):
        text = "x" * (5000 + k) + " short"
        assert own.encode([text])[0].tolist() == tik.encode_ordinary(text)
        words.encode([text])
    for cache in (own, words):
        cache.rotate()
        assert max(map(len, cache)) <= cache.LONGEST
