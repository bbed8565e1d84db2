"""A corpus from raw documents to token ids, in five stages of the operators in ``pointweave.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; rejected documents, copies and contaminated documents go.

Defined results: a null or empty text fails the base rules and goes. Of repeated rows one stays, as of any copies. A null id is
no label's and smaller than any other where lines stay, but never the smallest of a group of copies. Empty tables give no rows;
further columns are carried along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm import bpe, decontam, linededup, rulelists, widesimhash
from pointweave.llm.common import fresh
from pointweave.storage import drop_written, scratch, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the learned decision list rejects go."""
    rules = rulelists.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = [fresh(docs, x) for x in ("counts", "kept", "base_failed")]
    return rulelists.judged(docs, rules, counted=names[0], out=names[1], base=names[2]).where(F.col(names[1])).drop(*names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows the text."""
    name = fresh(docs, "lines")
    done = linededup.dedup_lines(docs, out=name).withColumn("text", F.col(f"{name}.kept"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast("bigint"))
    return done.select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id: by SimHash fingerprints wide enough for a
    similarity of five-word shingles of 0.8 or more, verified on the shingles."""
    return widesimhash.keep_one(docs).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 of the ids' decimals and of the decoded bytes."""
    own = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = docs.select("doc_id", bpe.roundtrip(F.col("text"), *own).alias("both")).select("doc_id", "both.*")
    shown = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", shown.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: Learned rules, XXH64 fingerprints and BPE can't be expressed in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's own tables and its input go when its output is written; the last one's input stays
    as long as the result is to be read (``pointweave.storage.clean`` deletes it)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as keep:
            docs = keep(written(stage(spark, before, sf_dir), name))
        if name != STAGES[0][0]:
            drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
