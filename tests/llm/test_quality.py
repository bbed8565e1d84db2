import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.llm import labelled, queries, ruleensemble, rulelists, stats


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
TEXTS = [None, "", " \n\t", "a", "a b c", "a b c a b c", "a a a a", "x # $%&|<> *\nline\nline\n line", "é 中\xa0x　y\x1cz", "a\rb\x0bc\x0cd", "w " * 100_000, "\n\n\nx\n\nx\n", "A b A b "]


def test_counts(spark, sf_dir):
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for text in texts:
        row = dict(zip(stats.COUNTS, stats.counts(text), strict=True))
        assert tuple(row[n] for n in NAMES) == brute(text)
    assert stats.repeated_words(np.array([5, 6, 7, 5, 6, 7, 9]), 1 << 22) == 6


def test_columns_equal_rows(docs_of):
    rows = docs_of(list(enumerate(TEXTS))).select("doc_id", stats.count_column(F.col("text")).alias("c"))
    found = rows.select("doc_id", *[v.alias(k) for k, v in stats.ratio_columns("c").items()]).orderBy("doc_id").collect()
    want = stats.ratio_rows(np.array([stats.counts(t) for t in TEXTS]))
    assert np.array_equal(np.array([list(r)[1:] for r in found]), want)


def sample(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(stats.RATIOS)))
    bad = (x[:, 1] > 0.9) | (x[:, 4] > 0.8) & (x[:, 5] <= 0.3)
    return x, bad


def test_list_learns_the_rules():
    x, bad = sample()
    rules = rulelists.learn(x, bad)
    y, wrong = sample(seed=9)
    found = np.zeros(len(y), bool)
    for rule in rules:
        found |= np.logical_and.reduce([c.holds(y) for c in rule])
    assert rules and (found & ~wrong).mean() < 0.01 and (found & wrong).sum() > 0.85 * wrong.sum()


@pytest.mark.parametrize("bad", [[], [True] * 5, [False] * 5])
def test_one_class(bad):
    x = np.zeros((len(bad), len(stats.RATIOS)))
    assert rulelists.learn(x, np.array(bad, bool)) == []
    model = ruleensemble.learn(x, 1.0 - np.array(bad, float))
    assert model.terms == [] and 0 <= model.scores(x[:1] if len(x) else np.zeros((1, len(stats.RATIOS))))[0] <= 1


def test_ensemble_column_equals_scores(docs_of):
    x, bad = sample()
    model = ruleensemble.learn(x, (~bad).astype(float))
    y, wrong = sample(seed=3)
    assert 0 < len(model.terms) <= 160
    assert ((model.scores(y) >= 0.5) == ~wrong).mean() > 0.95
    found = ruleensemble.scored(docs_of(list(enumerate(TEXTS))), model).orderBy("doc_id").collect()
    want = model.scores(stats.ratio_rows(np.array([stats.counts(t) for t in TEXTS])))
    assert np.allclose([r["score"] for r in found], want)


def labels_of(spark, sf_dir):
    return {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}


def test_op5_query_holds_out_and_learns(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = labels_of(spark, sf_dir)
    rows = queries.op5_quality_classifier(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.9


def test_training_rows_leave_out_what_is_held_out(spark, docs_of):
    docs = docs_of([(k, f"text {k} " * (k + 1)) for k in range(50)] + [(3, "text again"), (None, "x")])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(50)] + [(1, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    x, y = labelled.training_rows(docs, labels, "doc_id", "text", "quality", 1000)
    assert len(x) == len(y) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(50))
    assert len(labelled.training_rows(docs, labels, "doc_id", "text", "quality", 7)[0]) == 7
    assert len(labelled.training_rows(docs, labels.limit(0), "doc_id", "text", "quality", 7)[0]) == 0


def test_op9_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels, right = labels_of(spark, sf_dir), []
    rows = queries.op9_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counted = brute(texts[r["doc_id"]])
        assert tuple(r[n] for n in NAMES) == counted
        assert r["base_failed"] == (counted[0] < 50 or 100 * counted[4] > 50 * counted[0])
        assert not (r["base_failed"] and r["kept"])
        if not r["base_failed"] and labels.get(r["doc_id"]) is not None:
            right.append(r["kept"] == bool(labels[r["doc_id"]]))
    assert np.mean(right) > 0.93


def test_judged_edges(docs_of):
    rows = [(1, None), (1, ""), (None, "word " * 60), (2, "a b c " * 60), (3, " ".join(f"w{k}" for k in range(60)))]
    with pytest.raises(ValueError, match="words"):
        rulelists.judged(docs_of(rows), [], counted="words")
    for name in ("counts", "kept", "Base_Failed"):
        with pytest.raises(ValueError, match=name.lower()):
            rulelists.judged(docs_of(rows).withColumn(name, F.lit("own")), [])
    assert rulelists.judged(docs_of([]), []).collect() == []
    found = rulelists.judged(docs_of(rows), []).collect()
    assert sorted((str(r["doc_id"]), r["base_failed"], r["kept"]) for r in found) == [("1", True, False), ("1", True, False), ("2", True, False), ("3", False, True), ("None", True, False)]


def test_scored_edges(spark, docs_of):
    """Empty tables, null ids and texts, repeated rows, clashing names, very long texts."""
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(60)], "doc_id long, quality int, toxic int")
    docs = docs_of([(k, ("clean words here " + " ".join(f"w{j}" for j in range(30))) if k % 3 else "# $ % & " * 20) for k in range(60)])
    model = ruleensemble.fit(docs, labels)
    rows = [(None, None), (1, ""), (1, ""), (2, "# $ % & " * 20), (2, "# $ % & " * 20), (3, "clean words here " + " ".join(f"w{j}" for j in range(30))), (None, "word " * 300_000)]
    found = ruleensemble.scored(docs_of(rows), model).collect()
    assert len(found) == 7 and all(0 <= r["score"] <= 1 for r in found)
    by = {(r["doc_id"], r["text"]): r["score"] for r in found}
    assert by[2, rows[3][1]] < 0.3 <= by[3, rows[5][1]]
    assert ruleensemble.scored(docs_of([]), model).collect() == []
    empty = ruleensemble.fit(docs_of([]), labels)
    assert empty.terms == [] and ruleensemble.scored(docs_of(rows[:1]), empty).first()["score"] == pytest.approx(0.5)
    for name in ("counts", "SCORE"):
        with pytest.raises(ValueError, match=name.lower()):
            ruleensemble.scored(docs_of(rows).withColumn(name, F.lit("own")), model)


def test_rules_are_simplified():
    above = lambda t, k=0: rulelists.Condition(k, True, t)
    below = lambda t, k=0: rulelists.Condition(k, False, t)
    assert rulelists.simplified([above(0.5), above(0.9), below(0.95), below(0.99), above(0.1, 1)]) == [above(0.9), below(0.95), above(0.1, 1)]
    x, bad = sample()
    for rule in rulelists.learn(x, bad):
        assert len({(c.feature, c.above) for c in rule}) == len(rule)


def test_fit_leaves_out_what_the_base_fails(spark, docs_of):
    docs = docs_of([(k, "few words" if k % 2 else " ".join(f"w{k}{j}" for j in range(60))) for k in range(80)])
    labels = spark.createDataFrame([(k, int(k % 2 == 0), 0) for k in range(80)], "doc_id long, quality int, toxic int")
    assert rulelists.fit(docs, labels) == []  # what is left is of one class
    assert rulelists.fit(docs, labels, min_words=1) != []
