import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.llm import licenses, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def brute_method(text, index):
    """Every place of every template, without an index."""
    words = licenses.words_of(text)
    labels, score = set(), 0.0
    for t in index.templates:
        for start in range(-len(t.words), len(words)):
            own = words[max(0, start) : max(0, start + len(t.words))]
            equal = sum(0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(t.words))
            if equal >= index.share * len(t.words) and t.key in b" " + b" ".join(own) + b" ":
                labels.add(t.label)
                score = max(score, equal / len(t.words))
    return labels, score


def brute_alignment(text, index):
    """Every alignment of every template with the whole text, cell by cell."""
    words = licenses.words_of(text)
    line, found = b" " + b" ".join(words) + b" ", {}
    for k, t in enumerate(index.templates):
        if t.key not in line:
            continue
        n, e = len(t.words), index.edits[k]
        row = [(j, 0) for j in range(n + 1)]
        for i, w in enumerate(words):
            new = [(0, i + 1)]
            for j in range(n):
                new.append(min((row[j][0] + (w != t.words[j]), row[j][1]), (row[j + 1][0] + 1, row[j + 1][1]), (new[j][0] + 1, new[j][1])))
            row = new
            if row[n][0] <= e and t.key in b" " + b" ".join(words[row[n][1] : i + 1]) + b" ":
                found[t.label] = max(found.get(t.label, 0), (n - row[n][0]) / n)
    return found


def brute_all(text, index):
    labels, score = brute_method(text, index)
    aligned = brute_alignment(text, index)
    return labels | set(aligned), max([score, *aligned.values()])


NOTICES = [text for _, _, text in licenses.NOTICES]
TEXTS = [None, "", "MIT License", "mit license mit license MIT-LICENSE", "the gnu general public license, cc by", "émit license mit licenseé", "cc_by", "cc by cc by by", *NOTICES, *(n.replace("License", "Licence") for n in NOTICES), *("pre " * 7 + n.upper() + " post" for n in NOTICES), "x " + NOTICES[0][40:], NOTICES[0].replace("free", "for free"), " ".join(NOTICES), "license " * 50_000 + NOTICES[2], "mit license " * 30_000, "a " * 100_000]


def test_against_brute_force(docs_of):
    docs = docs_of(list(enumerate(TEXTS)) + [(None, "mit license"), (2, "MIT License")])
    index = licenses.build_index(docs)
    for text in TEXTS[:-3]:
        n, base, first, last, names, all_names, score = index.scan(text)
        assert (n, base, first, last, names) == brute_base(text)
        labels, want = brute_all(text, index)
        assert set(filter(None, all_names.split(","))) == labels | set(filter(None, names.split(",")))
        assert score == want
    assert index.scan(TEXTS[-2])[1:6] == (30_000, 0, 59_998, "mit", "mit")
    rows = docs.select("doc_id", licenses.scan_column(F.col("text"), index).alias("f")).select("doc_id", "f.*").collect()
    assert sorted((tuple(r) for r in rows), key=str) == sorted(((r["doc_id"], *index.scan(r["text"])) for r in docs.collect()), key=str)


def test_frequencies(docs_of):
    counted, n = licenses.document_frequencies(docs_of([(1, "MIT mit License"), (2, "license"), (3, None)]), "text")
    assert (counted, n) == ({b"mit": 1, b"license": 2}, 3)
    assert licenses.document_frequencies(docs_of([]), "text") == ({}, 0)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001"])
def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts, index = {r["doc_id"]: r["text"] for r in docs.collect()}, licenses.build_index(docs)
    rows = queries.op10_license_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts) and any(r["score"] > 0 for r in rows)
    for r in rows:
        assert tuple(r)[1:6] == brute_base(texts[r["doc_id"]])
        labels, score = brute_all(texts[r["doc_id"]], index)
        assert r["labels"] == ",".join(sorted((labels | set(r["base_labels"].split(","))) - {""})) and r["score"] == score


def test_time_is_linear():
    index = licenses.Index({}, 100)
    for text in ("mit license " * 90_000, "license " * 120_000 + "mit license", (licenses.NOTICES[0][2] + " ") * 1000):
        start = time.process_time()
        index.scan(text)
        assert time.process_time() - start < 10


def test_empty_table(docs_of):
    empty = docs_of([])
    index = licenses.build_index(empty)
    assert empty.select("doc_id", licenses.scan_column(F.col("text"), index).alias("f")).collect() == []
    assert index.scan("Released under the MIT License") == (5, 1, 3, 3, "mit", "mit", 1.0)


def test_edited_whole_licences():
    """Up to a fifth of the words changed, dropped and inserted; beyond, none."""
    rng, index = np.random.default_rng(6), licenses.Index({}, 100)
    for k, (label, key, notice) in enumerate(licenses.NOTICES):
        words, inside = licenses.words_of(notice), b" ".join(licenses.words_of(key))
        for edits in (index.edits[k] // 2, index.edits[k]):
            own = list(words)
            for _ in range(edits):
                at, how = int(rng.integers(0, len(own))), int(rng.integers(0, 3))
                own[at : at + (how != 2)] = [] if how == 0 else [b"edited"]
            text = b" ".join(own)
            if inside in text:
                labels, score = set(index.scan("before " + text.decode() + " behind")[5].split(",")), index.scan(text.decode())[6]
                assert label in labels and score >= 1 - edits / len(words) - 1e-9
                assert (labels - set(index.scan(text.decode())[4].split(",")), score) == (brute_all(text.decode(), index)[0] - set(index.scan(text.decode())[4].split(",")), brute_all(text.decode(), index)[1])


def test_inserted_and_dropped_words():
    index = licenses.Index({}, 100)
    found = lambda text: (set(index.scan(text)[5].split(",")), index.scan(text)[6])
    labels, score = found("This work is licensed under GNU General Public License, version 3")
    assert labels == {"gpl", "gpl-3"} and score == 11 / 12
    for label, key, notice in licenses.NOTICES:
        words = licenses.words_of(notice)
        inside = b" ".join(licenses.words_of(key))
        changed = [words[:at] + words[at + 1 :] for at in range(len(words))] + [words[:at] + [b"really"] + words[at:] for at in range(1, len(words))]
        for own in changed:
            text = b" ".join(own)
            if len(words) >= 5 and inside in text:
                labels, score = found("some words before " + text.decode() + " and some behind")
                assert label in labels and score >= (len(words) - 1) / len(words), text
