import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pointweave.llm import linededup
from pointweave.llm.linededup import PerfectHash

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars, min_docs):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    held, last = defaultdict(int), {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k] += 1
            last[k] = max(last.get(k, -(2**63)), -(2**63) if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or held[key(x)] < min_docs or last[key(x)] == (-(2**63) if i is None else i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def rows_of(n=60):
    rng = np.random.default_rng(3)
    lines = [f"line number {k} of the shared ones é" for k in range(25)]
    rows = []
    for i in range(n):
        some = [lines[k] for k in rng.integers(0, 25, rng.integers(0, 9))]
        some = [x.upper().replace("É", "é") if rng.random() < 0.3 else f"\t{x} \x0b" if rng.random() < 0.3 else x for x in some]
        rows.append((i, "\n".join([*some, "short", f"own line of document {i}, long enough"])))
    return [*rows, (None, None), (100, ""), (101, None), (7, rows[7][1]), (7, rows[7][1]), (None, "\n".join(lines)), (102, "x " * 200_000 + "\n" + lines[0])]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
@pytest.mark.parametrize("shard_keys", [65536, 4])
def test_against_brute_force(docs_of, broadcast_bytes, shard_keys):
    rows = rows_of()
    found = linededup.dedup_lines(docs_of(rows), min_chars=20, min_docs=5, broadcast_bytes=broadcast_bytes, shard_keys=shard_keys, salts=3, salt_rows=2)
    got = [(r["doc_id"], r["lines"]["kept"], r["lines"]["n_lines"], r["lines"]["n_dropped"]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 20, 5), key=str)
    assert any(r[3] for r in got) and {"words", "mark"} <= set(found.columns)


def test_a_shard_streams():
    """Arrays first, then any number of hashes, a batch at a time; salts repeat the arrays."""
    rng = np.random.default_rng(2)
    hi, lo = rng.integers(0, 2**63, 500), rng.integers(0, 2**63, 500)
    shards = [PerfectHash.build(hi[k::2].view(np.uint64), lo[k::2].view(np.uint64), np.full(250, 9), np.full(250, 5 + k)).row() for k in range(2)]
    kinds = {"shard": pa.int32(), "hi": pa.int64(), "lo": pa.int64(), "id": pa.int64(), **dict.fromkeys(linededup.ARRAYS, pa.binary())}
    rows = []
    for k in range(2):
        rows += [{"shard": k, **shards[k]}] * 2
        for i in range(3000):
            at = int(rng.integers(0, 500))  # also of the other shard: no hit
            rows.append({"shard": k, "hi": int(hi[at]), "lo": int(lo[at]), "id": i % 10})
    want = sorted((r["id"], r["lo"]) for r in rows if "id" in r and r["lo"] in lo[r["shard"] :: 2] and r["id"] != 5 + r["shard"])
    whole = pa.Table.from_pylist(rows, pa.schema(list(kinds.items())))
    for size in (1, 100, 10**6):
        got = [tuple(r.values()) for b in linededup.route(iter(whole.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert sorted(got) == want and want


def test_hot_lines_are_salted_by_their_number(docs_of, spark):
    """One shared line in all documents, few keys: the groups that a task holds don't grow with the documents."""
    rows = [(k, "the one line that all documents share here\nand a line of its own for " + str(k) * 12) for k in range(400)]
    docs = docs_of(rows)
    found = linededup.dedup_lines(docs, min_docs=5, broadcast_bytes=0, salts=2, salt_rows=20)
    got = {r["doc_id"]: r["lines"]["n_dropped"] for r in found.collect()}
    assert got == {k: int(k != 399) for k in range(400)}


def test_empty_table(docs_of):
    assert linededup.dedup_lines(docs_of([])).collect() == []
    assert linededup.dedup_lines(docs_of([]), broadcast_bytes=-1).collect() == []


def test_clashing_result_name(docs_of):
    row = linededup.dedup_lines(docs_of([(1, "a\nb")]), out="words").first()
    assert row["words"]["n_lines"] == 2


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    hi, lo = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**63, n).astype(np.uint64)
    built = PerfectHash.of(PerfectHash.build(hi, lo, np.arange(n), np.arange(n) * 3).row())
    at = built.find(hi, lo)
    assert sorted(at.tolist()) == list(range(n))
    assert np.array_equal(built.count[at], np.arange(n)) and np.array_equal(built.last[at], np.arange(n) * 3)
    assert (built.find(hi ^ np.uint64(5), lo ^ np.uint64(9)) == -1).all()


def test_query(spark, sf_dir):
    from pointweave.llm import queries

    got = {r["doc_id"]: r for r in queries.op1_line_dedup(spark, sf_dir).collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for i, kept, n, dropped in brute(rows, 40, 5):
        assert (got[i]["kept_sha256"], got[i]["n_lines"], got[i]["n_dropped"]) == (hashlib.sha256(kept.encode()).hexdigest(), n, dropped)
