import re

import numpy as np
import pytest
import xxhash

from pointweave.llm import simhash
from pointweave.llm.common import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, fps, max_bits=4):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(rows))]


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3, 4, 5, 6])
def test_keys_meet_within_the_bits(max_bits):
    rng, kept = np.random.default_rng(max_bits), simhash.masks(max_bits)
    for _ in range(1500):
        a = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        places = rng.choice(64, rng.integers(0, max_bits + 1), replace=False)
        b = a ^ sum(1 << int(p) for p in places)
        x, y = simhash.keys_of(np.array([a, b], np.uint64), kept)
        assert (x == y).any()


def test_all_four_bit_patterns_over_segments():
    """Every way to spread four bits over the segments' ends and middles is met."""
    kept = simhash.masks(4)
    places = np.array([0, 1, 10, 20, 21, 22, 31, 41, 42, 43, 52, 62, 63])
    rng = np.random.default_rng(1)
    for _ in range(4000):
        b = sum(1 << int(p) for p in rng.choice(places, 4, replace=False))
        assert ((np.uint64(b) & kept) == 0).any()


def test_span_finds_the_same_groups():
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 2**16, 3000).astype(np.uint64) << np.uint64(20))
    fps = np.concatenate([fps[:300], fps[300:310] ^ np.uint64(2**63)])
    fps = np.unique(fps)
    a, b = simhash.link_runs(np.zeros(len(fps), np.int64), fps, 4)
    rows = [(k, "") for k in range(len(fps))]
    want = brute_components(rows, [int(x) for x in fps])
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert (x ^ y).bit_count() <= 4
        root[find(x)] = find(y)
    got = [find(int(x)) for x in fps]
    assert len({(g, w) for g, w in zip(got, want, strict=True)}) == len(set(got)) == len(set(want))


def near_rows():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for group in range(8):
        words = list(rng.choice(vocabulary, 300))
        for k in range(6):
            copy = list(words)
            for at in rng.integers(0, 300, k):
                copy[at] = "changed"
            rows.append((group * 10 + k, " ".join(copy)))
    rows += [(500, None), (501, ""), (502, " \t\n"), (None, ""), (503, "one two"), (504, "ONE two"), (505, "é É"), (506, "Und " * 30_000), (507, "und " * 20_000), (None, "alone here"), (503, "one two"), (503, "other words under this id")]
    return rows


def test_against_brute_force(docs_of):
    rows = near_rows()
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute_components(rows, fps), strict=True)), key=str)
    got = simhash.simhash_groups(docs_of(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_keep_one(docs_of):
    rows = near_rows()
    fps = [brute_fingerprint(t) for _, t in rows]
    groups = brute_components([(k, "") for k in range(len(rows))], fps)
    kept = simhash.keep_one(docs_of(rows))
    assert kept.columns == ["doc_id", "text", "words", "mark"]
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == len(set(groups))
    for group in set(groups):
        ids = [rows[k][0] for k in range(len(rows)) if groups[k] == group]
        known = [i for i in ids if i is not None]
        own = [i for i, t in got if any(groups[k] == group and rows[k] == (i, t) for k in range(len(rows)))]
        assert own == [min(known) if known else None]


def test_empty(docs_of):
    assert simhash.simhash_groups(docs_of([])).collect() == []
    assert simhash.keep_one(docs_of([])).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(0, 200)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(201)) and all(got[k] == 1000 for k in range(1000, 1400)) and len(got) == 601


def test_query(spark, sf_dir):
    from pointweave.llm import queries

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute_components(rows, fps), strict=True))
    assert sorted(tuple(r) for r in queries.op2_simhash(spark, sf_dir).collect()) == want


@pytest.mark.parametrize("run_rows", [2, 7, 40, 1 << 20])
def test_large_keys_in_blocks(spark, run_rows):
    """A dense ball of fingerprints, some chains, and far ones that share a key."""
    rng = np.random.default_rng(8)
    centre = int(rng.integers(0, 2**62))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(14, rng.integers(0, 10), replace=False)) for _ in range(250)}
    fps |= {centre ^ (0x3FF << 40) ^ (k << 30) for k in range(40)} | {int(x) for x in rng.integers(0, 2**62, 100)}
    fps = sorted(fps)
    want = brute_components(list(enumerate(fps)), fps)
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    got = {r["node"]: r["root"] for r in simhash.near_groups(distinct, 4, run_rows).collect()}
    pairs = {(got.get(f, f), w) for f, w in zip(fps, want, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(set(want))


def test_runs_over_batches():
    """Runs that end in any batch, one longer than what is held."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    key = np.sort(rng.integers(0, 30, 600))
    key[100:300] = key[100]
    fp = np.arange(600).astype(np.uint64)
    whole = simhash.link_runs(key, fp, 4)
    for size in (1, 7, 64, 600):
        batches = [pa.record_batch([pa.array(key[a : a + size]), pa.array(fp[a : a + size].view(np.int64))], ["key", "fp"]) for a in range(0, 600, size)]
        rows = [tuple(r.values()) for b in simhash.verify(4, 1000)(iter(batches)) for r in b.to_pylist()]
        assert {r[:2] for r in rows} == set(zip(whole[0].tolist(), whole[1].tolist(), strict=True))
        rows = [tuple(r.values()) for b in simhash.verify(4, 50)(iter(batches)) for r in b.to_pylist()]
        counts = dict(zip(*map(np.ndarray.tolist, np.unique(key, return_counts=True)), strict=True))
        assert {r[0]: r[2] for r in rows if r[2]} == {k: n for k, n in counts.items() if n > 50}
