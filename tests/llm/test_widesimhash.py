import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pointweave.llm import simhash, widesimhash


def brute_sets(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_groups(texts):
    """For each text, the first of its group."""
    sets, root = [brute_sets(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def edited_rows():
    """Families of edits at similarities around 0.8, a passage that many hold, odd texts; ids ascend."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = " ".join(rng.choice(vocabulary, 20))
    texts = []
    for family in range(12):
        base = list(rng.choice(vocabulary, int(rng.integers(50, 300))))
        for k in range(50 if family == 0 else 6):
            copy = list(base)
            for at in rng.choice(len(base), int(rng.integers(0, max(2, len(base) // 30))), replace=False):
                copy[at] = "edit" + str(rng.integers(10**6))
            if k % 3 == 1:
                copy = copy[: int(len(copy) * rng.uniform(0.75, 1.0))]
            texts.append(" ".join(copy))
    texts += [passage + " " + " ".join(rng.choice(vocabulary, 30)) for _ in range(60)]
    texts += [None, "", " \n", "one two", "ONE  two", "one two three", "und " * 3000, "Und " * 2000, "é É a b c d"]
    return list(enumerate(texts))


@pytest.mark.parametrize("limits", [{}, {"SHORT_RUN": 3, "NEAR": 1, "ROWS": 50, "BLOCK_BYTES": 4000}, {"run_rows": 12, "AT_ONCE": 50}])
def test_against_brute_force(docs_of, monkeypatch, limits):
    """With a recall that leaves nothing to chance here; ``test_layout`` and ``test_few_are_lost`` hold the usual one."""
    run_rows = limits.get("run_rows", 1 << 20)
    for name, value in {"RECALL": 1 - 1e-7, "DEVIATIONS": 5, **limits}.items():
        monkeypatch.setattr(widesimhash, name, value, raising=name != "run_rows")
    rows = edited_rows()
    groups = brute_groups([t for _, t in rows])
    assert 20 < len(set(groups)) < len(rows) - 40
    got = widesimhash.keep_one(docs_of(rows).repartition(5), run_rows=run_rows)
    assert got.columns == ["doc_id", "text", "words", "mark"]
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(groups))


def test_fingerprints_count_bits():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 255, 256, 700, 40_000, 3)]
    got = widesimhash.fingerprints(sets, 3)
    for row, found in zip(got, sets, strict=True):
        for lane in range(3):
            salt = widesimhash.mix64(np.array([lane + 1], np.uint64))
            bits = np.unpackbits(widesimhash.mix64(found ^ salt).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
            assert int(row[lane]) == sum(1 << k for k in range(64) if 2 * int(bits[k]) > len(found))


@pytest.mark.parametrize("n_texts", [10, 200_000, 15_000_000, 10**10])
def test_layout(n_texts):
    """Segments are cut where they should be, and pairs at the threshold meet about as often as asked for."""
    layout, rng = widesimhash.Layout.of(n_texts), np.random.default_rng(1)
    assert layout.bits >= 16 and 2 ** (layout.bits + 3) > n_texts
    fps = rng.integers(0, 2**63, (50, layout.lanes)).astype(np.uint64)
    bits = "".join(f"{int(w):064b}"[::-1] for w in fps[7])
    assert layout.cut(fps)[7].tolist() == [int(bits[k * layout.bits : (k + 1) * layout.bits][::-1], 2) for k in range(layout.segments)]
    flips = rng.random((5000, layout.segments, layout.bits)) < widesimhash.DIFFERS
    assert (flips.sum(axis=2) <= 1).any(axis=1).mean() > widesimhash.RECALL - 0.01


def test_few_are_lost():
    """Of sets at the threshold and a little above, those whose fingerprints meet."""
    layout, rng, found = widesimhash.Layout.of(200_000), np.random.default_rng(9), {}
    for similar, pairs in ((0.8, 400), (0.83, 400)):
        sets = []
        for n in rng.integers(40, 400, pairs):
            own = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            both = int(np.ceil(similar * 2 * n / (1 + similar)))
            sets += [np.unique(own[:n]), np.unique(np.concatenate([own[:both], own[n : 2 * n - both]]))]
        fps = widesimhash.fingerprints(sets, layout.lanes)
        found[similar] = np.mean([meets(fps[k], fps[k + 1], layout) for k in range(0, len(sets), 2)])
    assert found[0.8] >= 0.98 and found[0.83] >= 0.995, found


def meets(a, b, layout):
    """Whether a segment of two fingerprints differs by at most a bit, and the whole by few enough."""
    x, y = layout.cut(np.stack([a, b]))
    return bool((np.bitwise_count((x ^ y).view(np.uint64)) <= 1).any()) and int(np.bitwise_count(a ^ b).sum()) <= layout.most


@pytest.mark.parametrize("rows", [1, 13, 100_000])
@pytest.mark.parametrize("short", [2, 64])
def test_all_that_meet_are_given_once(monkeypatch, rows, short):
    monkeypatch.setattr(widesimhash, "ROWS", rows)
    monkeypatch.setattr(widesimhash, "SHORT_RUN", short)
    layout, rng = widesimhash.Layout(17, 4), np.random.default_rng(4)
    base = rng.integers(0, 2**63, (6, layout.lanes)).astype(np.uint64)
    fps = []
    for f in base:
        for _ in range(15):
            copy = f.copy()
            for at in rng.choice(64 * layout.lanes, int(rng.integers(0, 70)), replace=False):
                copy[at // 64] ^= np.uint64(1 << int(at % 64))
            fps.append(copy)
    fps = np.stack(fps)
    n, root = rng.integers(90, 130, len(fps)), rng.integers(0, 40, len(fps))
    batch = pa.record_batch([pa.array(np.arange(len(fps))), pa.array([f.tobytes() for f in fps], pa.binary()), pa.array(n.astype(np.int32)), pa.array(root)], ["sh", "fp", "n", "root"])
    keyed = pa.Table.from_batches(widesimhash.half_keys(layout)(iter([batch]))).sort_by("key")
    found = [(r["a"], r["b"]) for b in widesimhash.meeting(layout, 1 << 20)(iter(keyed.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    want = {(i, j) for j in range(len(fps)) for i in range(j) if root[i] != root[j] and 4 * max(n[i], n[j]) <= 5 * min(n[i], n[j]) and meets(fps[i], fps[j], layout)}
    assert sorted(found) == sorted(want) and 50 < len(want)


def test_stage_drops_what_differs_by_more_bits(docs_of, spark, sf_dir):
    words = [f"word{k}" for k in range(100)]
    other = [*words[:30], "changed", *words[31:]]
    texts = " ".join(words), " ".join(other)
    both, sets = brute_sets(texts[0]) & brute_sets(texts[1]), brute_sets(texts[0]) | brute_sets(texts[1])
    assert len(both) / len(sets) >= 0.8
    assert (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).bit_count() > 4
    docs = docs_of([(1, texts[0]), (2, texts[1]), (3, "quite another text of its own")])
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, sf_dir).collect()) == [1, 3]


def test_repeated_rows_and_null_ids(docs_of):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "x y z"), (4, "x y z"), (4, "other words"), (None, "x y z")]
    got = sorted(((r["doc_id"], r["text"]) for r in widesimhash.keep_one(docs_of(rows)).collect()), key=str)
    assert got == sorted([(None, "a b c d e f"), (4, "x y z"), (4, "other words")], key=str)
    assert widesimhash.keep_one(docs_of([])).collect() == []
