"""The operators' queries over whole tables, with production parameters, and DuckDB SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm import bpe, decontam, licenses, linededup, ruleensemble, rulelists, simhash, tokencounts, tokenfiles, warc
from pointweave.llm.labelled import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept", 256).alias("kept_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfiles.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), bits=8)
    return tokenfiles.read_ids(manifest)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_archives(warc.normalise(whole, delete_source=True), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    own = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = docs.select("doc_id", bpe.encode(F.col("text"), *own).alias("ids"))
    both = ids.select("doc_id", "ids", bpe.decode(F.col("ids"), *own).alias("decoded"))
    shown = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), shown.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", names, "contaminated")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ruleensemble.scored(docs, ruleensemble.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = rulelists.judged(docs, rulelists.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", *[f"counts.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencounts.token_counts(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    return table(spark, sf_dir, "documents").select("doc_id", counts.alias("counts")).select("doc_id", "counts.*")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licenses.scan_column(F.col("text"), licenses.build_index(docs))
    return docs.select("doc_id", found.alias("found")).select("doc_id", "found.*")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_simhash, op3_token_files, op4_warc, op5_quality_classifier, op6_byte_bpe, op7_decontaminate, op8_token_counts, op9_quality_rules, op10_license_scan)}

LINE_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
k AS (
  SELECT doc_id, i, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key),
j AS (SELECT k.*, coalesce(c.n >= 5 AND c.last <> k.doc_id, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

#: SHA-1 as 40 hex digits, five of which are four characters of base32.
WARC_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload)::BIGINT AS n, sha1(payload) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first FROM h WHERE n >= 0 GROUP BY hex)
SELECT h.page_id, h.n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
  CASE WHEN f.first = h.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first <> h.page_id THEN f.first END AS refers_to
FROM h JOIN f USING (hex)
"""

DECONTAMINATE_SQL = r"""
WITH t AS (
  SELECT doc_id AS id, false AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT item_id, true, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
s AS (SELECT DISTINCT least(len(w), 10) AS n FROM t WHERE item AND len(w) > 0),
i AS (
  SELECT DISTINCT id AS item_id, n, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p
        FROM t WHERE item AND len(w) > 0)),
d AS (
  SELECT id, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM t, s WHERE NOT item AND len(w) >= n)),
h AS (SELECT d.id, d.p, d.n, i.item_id FROM d JOIN i ON d.win = i.win AND d.n = i.n),
c AS (SELECT id, count(DISTINCT word) AS n_hit FROM (SELECT id, unnest(range(p, p + n)) AS word FROM h) GROUP BY id),
m AS (SELECT id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
      FROM (SELECT DISTINCT id, item_id::VARCHAR AS name FROM h) GROUP BY id)
SELECT t.id AS doc_id, len(t.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM t LEFT JOIN c ON t.id = c.id LEFT JOIN m ON t.id = m.id WHERE NOT t.item
"""

ORACLE_SQL = {"op7_decontaminate": DECONTAMINATE_SQL, "op4_warc": WARC_SQL, "op1_line_dedup": LINE_DEDUP_SQL}
