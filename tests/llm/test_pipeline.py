import hashlib

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from pointweave import storage
from pointweave.llm import bpe, rulelists
from tests.llm.test_decontam import brute as brute_decontam
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_quality import brute as brute_counts
from tests.llm.test_widesimhash import brute_groups


def test_stages_against_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in table.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    rules = rulelists.fit(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r["doc_id"] for r in rulelists.judged(table, rules).where("kept").collect()}
    base = {i for i, t in docs if (c := brute_counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    assert kept <= base
    docs = [(i, t) for i, t in docs if i in kept]
    docs = [(i, t) for i, t, _, _ in brute_lines(docs, 40, 5)]
    docs.sort()
    docs = [docs[k] for k in sorted(set(brute_groups([t for _, t in docs])))]  # the smallest id of each group
    bad = {r[0] for r in brute_decontam(docs, items) if r[5]}
    docs = [d for d in docs if d[0] not in bad]

    own = bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = []
    for i, t in docs:
        ids = own.encode([t])[0].tolist()
        want.append((i, len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == sorted(want) and got


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, sf_dir)
        assert done.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "decontaminate", "byte_bpe"]


def test_texts_are_encoded_once(spark, docs_of, sf_dir):
    docs = docs_of([(1, "Some words, and some more."), (2, None), (3, ""), (None, "Zwölf 12 Boxkämpfer " * 50)])
    done = corpus_pipeline.byte_bpe(spark, docs, sf_dir)
    assert done._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython", 1)[1].split("\n")[0].count("text") == 1
    own = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    ids = docs.select("doc_id", bpe.encode(F.col("text"), *own).alias("ids"))
    want = ids.select("doc_id", "ids", F.sha2(bpe.decode(F.col("ids"), *own), 256).alias("decoded_sha256"))
    assert sorted(map(str, done.select("doc_id", "ids", "decoded_sha256").collect())) == sorted(map(str, want.collect()))


def test_nulls_empties_ties_and_repeated_rows(spark, docs_of, tmp_path):
    """Over a table of its own, with columns whose names the stages use themselves; and what is left of the tables written."""
    clean = lambda k, n=80: " ".join(f"w{k}x{j}" for j in range(n))
    line = "a line that many of these documents share with each other"
    texts = [(1, None), (2, ""), (None, clean(1)), (None, clean(1)), (3, clean(2)), (3, clean(2)), (4, clean(2)), (5, clean(3)), (5, clean(4)), (6, clean(5, 200_000)), (7, "few words")]
    texts += [(k, clean(k) + "\n" + line) for k in range(10, 16)] + [(20, clean(20) + " " + " ".join(f"item{j}" for j in range(12)))]
    docs = docs_of(texts).withColumnsRenamed({"words": "kept", "mark": "lines"}).withColumn("counts", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b", " ".join(f"item{j}" for j in range(12))), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(3, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    storage.clean(spark)
    got = corpus_pipeline.run(spark, str(tmp_path))
    rows = sorted(((r["doc_id"], r["decoded_sha256"]) for r in got.collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(None, sha(clean(1))), (3, sha(clean(2))), (5, sha(clean(3))), (5, sha(clean(4))), (6, sha(clean(5, 200_000)))]
    want += [(k, sha(clean(k) + ("\n" + line if k == 15 else ""))) for k in range(10, 16)]
    assert rows == sorted(want, key=str)
    assert len(storage.WRITTEN) <= 1
    storage.clean(spark)
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
