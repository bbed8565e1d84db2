"""A bounded sample of labelled documents with their statistics, for models that are fitted on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.stats import COUNTS, count_column, ratio_rows


def held_out(doc_id):
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int, leave_out=None) -> tuple[np.ndarray, np.ndarray]:
    """(ratios, label) of at most ``max_rows`` labelled documents, those of the least hash of their ids, none held out.

    Null ids and labels are left out; of repeated labels the greatest counts, of repeated documents one. Ordered by id, so
    that a fit depends on the rows alone. leave_out: a condition on the struct of counts, given its name; such rows go.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id")
    rows = rows.select("id", "label", count_column(F.col("text")).alias("counts")).groupBy("id", "label").agg(F.min("counts").alias("counts"))
    rows = rows if leave_out is None else rows.where(~leave_out("counts"))
    found = sorted(tuple(r) for r in rows.select("id", "label", *[f"counts.{c}" for c in COUNTS]).collect())  # at most max_rows
    table = np.array([r[1:] for r in found], np.int64).reshape(-1, 1 + len(COUNTS))
    return ratio_rows(table[:, 1:]), table[:, 0]
