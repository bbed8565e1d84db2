import random
import re

import pytest
from pyspark.sql import functions as F

from pointweave.llm import decontam, queries
from pointweave.storage import written

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window=10):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for k in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[k : k + n]), set()).add(item)
    sizes = {len(g) for g in grams}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = grams.get(tuple(w[k : k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        named = sorted({str(x) for x in found if x is not None})
        out.append((i, len(w), len(hit), len(named), named, bool(hit)))
    return sorted(out, key=str)


def bench(spark, items):
    return spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, words string")


def cases(seed, vocabulary):
    r = random.Random(seed)
    some = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, some(r.randint(1, 40))) for k in range(12)] + [(20, None), (21, ""), (22, "Mit License"), (23, "mit-license"), (3, some(12)), (None, some(11)), (24, some(9)), (25, some(10))]
    docs = []
    for k in range(60):
        parts = [some(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            w = words(r.choice(items)[1])
            a = r.randint(0, max(0, len(w) - 1))
            parts += [" -- ".join(x.upper() for x in w[a : a + r.randint(5, 14)]), some(r.randint(0, 5))]
        docs.append((k, " ".join(parts)))
    docs += [(100, None), (101, ""), (None, docs[3][1]), (5, docs[5][1]), (5, docs[6][1]), (102, items[0][1]), (103, " ".join(t or "" for _, t in items) + " far" * 30_000)]
    return docs, items


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
@pytest.mark.parametrize("vocabulary", [["a", "b"], ["a", "é", "c3", "中", "dd"], [f"w{k}" for k in range(200)]])
def test_against_brute_force(spark, docs_of, broadcast_rows, vocabulary):
    docs, items = cases(len(vocabulary), vocabulary)
    found = decontam.decontaminate(docs_of(docs), bench(spark, items), broadcast_rows=broadcast_rows)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, items)
    kept = decontam.keep_clean(docs_of(docs), bench(spark, items), broadcast_rows=broadcast_rows)
    assert kept.columns == ["doc_id", "text", "words", "mark"]
    clean = [r for r, (*_, bad) in zip(sorted(docs, key=str), [brute([d], items)[0] for d in sorted(docs, key=str)], strict=True) if not bad]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == clean


@pytest.mark.parametrize(("window", "k"), [(10, 6), (10, 10), (5, 1), (1, 1), (13, 8)])
def test_other_windows(spark, docs_of, window, k):
    docs, items = cases(7, [f"w{n}" for n in range(30)])
    found = decontam.decontaminate(docs_of(docs[:40]), bench(spark, items), window=window, k=k)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs[:40], items, window)


def test_empty(spark, docs_of):
    docs, items = cases(1, ["a", "b", "c"])
    assert decontam.decontaminate(docs_of([]), bench(spark, items)).collect() == []
    assert not any(r["contaminated"] for r in decontam.decontaminate(docs_of(docs), bench(spark, [])).collect())
    assert decontam.keep_clean(docs_of(docs), bench(spark, [])).count() == len(docs)


def test_no_python_in_the_plan(spark, sf_dir, monkeypatch):
    """Nor in the plans of what is written on the way."""
    plans = []

    def noting(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(decontam, "written", noting)
    for broadcast_rows in (100_000, 0):
        docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
        found = decontam.decontaminate(docs, items, broadcast_rows=broadcast_rows)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        plans.append(decontam.keep_clean(docs, items, broadcast_rows=broadcast_rows)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) >= 10
    assert not [p for p in plans for name in ("Python", "Arrow", "Pandas") if name in p]


def test_winnowing(spark):
    """Fewer than half of the k-grams are chosen, one in each window at least, and none of equal words twice in a window."""
    r = random.Random(3)
    text = " ".join(f"w{r.randrange(50)}" for _ in range(4000))
    df = spark.createDataFrame([(text,)], "text string").select(decontam.words_of(F.col("text")).alias("words"))
    marks = decontam.split_mark(decontam.with_marks(df, 10, 4, []).select(F.explode("marks").alias("mark")))
    rows = marks.collect()
    places = sorted(r["place"] for r in rows)
    assert len(places) == len(set(places)) < 0.35 * 4000
    assert places[0] <= 6 and places[-1] >= 4000 - 10 and max(b - a for a, b in zip(places, places[1:], strict=False)) <= 7
    w = text.split()
    named = {}
    for r in rows:
        assert named.setdefault(r["mark"], w[r["place"] : r["place"] + 4]) == w[r["place"] : r["place"] + 4]


def test_chained(spark):
    df = spark.createDataFrame([(list("abcdefghij"),)], "w array<string>")
    got = df.select(decontam.chained(F.col("w"), 4, lambda x, y: F.concat(x, y))).first()[0]
    assert got[:7] == ["abcd", "bcde", "cdef", "defg", "efgh", "fghi", "ghij"]
