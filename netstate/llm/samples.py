"""Folds and bounded samples of labelled rows, on which classifiers are fitted."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text modulo 4 is 2; false where the id is null. Such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def stratified(rows: DataFrame, label: str, most: int) -> DataFrame:
    """About ``most`` rows of every label at most, by a hash of doc_id; labels with fewer rows stay whole.

    The share of each label comes from counts over all rows, so no task gathers more than its part of the sample.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}     # one row a label
    keep = F.lit(False)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    for value, n in counts.items():
        keep = keep | ((F.col(label) == F.lit(value)) & (draw < most / n))
    return rows.where(keep)
