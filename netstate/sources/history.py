"""Stored analyses: append, list, load, delete. Files are only ever added."""
from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.operators.chunks import beside

META = ("id string, owner string, filename string, created timestamp_ntz, kind string, records long, windows long, "
        "forecast_windows long, alerts long, peak_risk double, labelled boolean, threshold double")
TOMBSTONE = "id string, deleted timestamp_ntz"


def analysis_id(name: str, when: datetime) -> str:
    """Time plus a short form of the file name."""
    stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    slug = re.sub("[^A-Za-z0-9]+", "-", stem).strip("-").lower()[:30]
    return f"{when:%Y%m%d-%H%M%S}-{slug or 'traffic'}"


def save_analysis(root: str, name: str, when: datetime, owner: str | None, states: DataFrame, scored: DataFrame,
                  found: DataFrame, threshold: float, kind: str, labelled: bool) -> str:
    """Append the states and one metadata row; returns the id."""
    spark, key = states.sparkSession, analysis_id(name, when)
    states.write.mode("error").parquet(f"{root}/states/analysis_id={key}")
    total = states.agg(F.sum("flow_count").cast("long").alias("records"), F.count("*").alias("windows"))
    risk = scored.agg(F.count("*").alias("forecast_windows"), F.max("risk").alias("peak_risk"))
    alerts = found.agg(F.count("*").alias("alerts"))
    row = beside(total, risk, alerts)
    fixed = {"id": key, "owner": owner, "filename": name, "created": when, "kind": kind, "labelled": labelled,
             "threshold": float(threshold)}
    known = [f.split()[0] for f in META.split(", ")]
    types = dict(f.split() for f in META.split(", "))
    row.select(*[(F.lit(fixed[c]) if c in fixed else F.col(c)).cast(types[c]).alias(c) for c in known]
               ).write.mode("append").parquet(f"{root}/analyses")
    return key


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def list_history(spark: SparkSession, root: str, owner: str | None = None) -> DataFrame:
    """Stored analyses, newest first; ``owner`` (any case) restricts the list. Deleted ones are gone."""
    rows = _table(spark, f"{root}/analyses", META)
    if owner is not None:
        rows = rows.where(F.lower(F.coalesce("owner", F.lit(""))) == owner.lower())
    rows = rows.join(_table(spark, f"{root}/deleted", TOMBSTONE), "id", "left_anti")
    return rows.orderBy(F.col("created").desc(), F.col("id").desc())


def load_analysis(spark: SparkSession, root: str, key: str) -> DataFrame:
    """States of one analysis: only its partition folder is read."""
    gone = _table(spark, f"{root}/deleted", TOMBSTONE).where(F.col("id") == key)
    if not gone.isEmpty():
        raise KeyError(f"analysis {key} was deleted")
    return spark.read.parquet(f"{root}/states/analysis_id={key}")


def delete_analysis(spark: SparkSession, root: str, key: str, when: datetime) -> None:
    """Deleting adds a tombstone; readers leave the id out."""
    spark.createDataFrame([(key, when)], TOMBSTONE).write.mode("append").parquet(f"{root}/deleted")
