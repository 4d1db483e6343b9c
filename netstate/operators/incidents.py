"""Incidents: alerts with a stable id, ground-truth confirmation, triage."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.config import Options
from netstate.functions.levels import incident_level
from netstate.operators.chunks import beside, next_match
from netstate.operators.sequences import KEYS
from netstate.schema import INCIDENT_FIELDS, INCIDENT_STATUSES

TRIAGE_SCHEMA = "id string, status string, note string, ts timestamp_ntz, seq long"
AUDIT_SCHEMA = "ts timestamp_ntz, action string, detail string"


def incident_id(source: Column, opened: Column, stage: Column) -> Column:
    """``INC-`` plus six hex digits of a hash of what identifies the incident."""
    text = F.concat_ws("|", source, F.date_format(opened, "yyyy-MM-dd HH:mm:ss"), stage)
    return F.concat(F.lit("INC-"), F.upper(F.substring(F.sha1(text), 1, 6)))


def incidents(found: DataFrame, states: DataFrame, options: Options) -> DataFrame:
    """Incident rows of alerts. ``confirmed``: 1 if an attack window lies within the horizon around the alert, 0 if
    not, -1 without any label."""
    attacks = states.where("is_attack").select(*KEYS, "pos")
    hit = next_match(found, attacks, KEYS, F.col("opened_pos") - options.horizon, F.col("pos"),
                     options.chunk_windows, "_a")
    labelled = states.agg(F.coalesce(F.bool_or("is_attack"), F.lit(False))).scalar()
    near = F.coalesce(F.col("_a.at") <= F.col("last_pos") + options.horizon, F.lit(False))
    return hit.withColumn("_labelled", labelled).select(
        incident_id(F.col("source"), F.col("opened_time"), F.col("stage")).alias("id"), "source", "opened_time",
        "closed_time", "stage", F.array_join("stages", " > ").alias("progression"),
        incident_level(F.col("peak_severity")).alias("severity"), "peak_risk", "eta_seconds",
        F.col("n_windows").alias("windows"),
        F.when(~F.col("_labelled"), -1).otherwise(near.cast("int")).alias("confirmed"), "segment", "opened_pos")


def incident_summary(found: DataFrame, scored: DataFrame, states: DataFrame, threshold: float,
                     options: Options) -> DataFrame:
    """One row of totals: windows, hours, incidents by severity, top tactic, risk, confirmed share."""
    by_stage = found.groupBy("stage").agg(F.count("*").alias("n"), F.count_if(F.col("confirmed") == 1).alias("c"),
                                          *[F.count_if(F.col("severity") == s).alias(s.lower())
                                            for s in ("Critical", "High")])
    inc = by_stage.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("incidents"),
                       F.coalesce(F.sum("critical"), F.lit(0)).alias("critical"),
                       F.coalesce(F.sum("high"), F.lit(0)).alias("high"),
                       F.max(F.struct("n", "stage")).getField("stage").alias("top_tactic"),
                       (F.sum("c") / F.sum("n")).alias("confirmed_share"))
    risk = scored.agg(F.max("risk").alias("peak_risk"), F.avg("risk").alias("mean_risk"),
                      F.avg((F.col("risk") >= threshold * options.watch_ratio).cast("double")).alias("share_elevated"))
    span = states.agg(F.count("*").alias("windows"), (F.count("*") * options.window_seconds / 3600.0).alias("hours"),
                      F.coalesce(F.bool_or("is_attack"), F.lit(False)).alias("labelled"),
                      F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))
    return beside(span, risk, inc).withColumn("confirmed_share", F.when(F.col("labelled"), F.col("confirmed_share")))


# ---------------------------------------------------------------------------------------------- triage
def upsert_incidents(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored table after new results came in: results are replaced, triage fields of known incidents stay."""
    refreshed = ["closed_time", "progression", "severity", "peak_risk", "windows", "confirmed"]
    s, n = stored.alias("s"), new.select(*INCIDENT_FIELDS).alias("n")
    both = s.join(n, F.col("s.id") == F.col("n.id"), "full_outer")
    fresh = F.col("n.id").isNotNull()

    def field(c):
        if c in refreshed:
            return F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
        return F.coalesce(F.col(f"s.{c}"), F.col(f"n.{c}")).alias(c)

    return both.select(*[field(c) for c in INCIDENT_FIELDS], F.coalesce("s.status", F.lit("New")).alias("status"),
                       F.coalesce("s.note", F.lit("")).alias("note"))


def new_incident_table(new: DataFrame) -> DataFrame:
    return new.select(*INCIDENT_FIELDS, F.lit("New").alias("status"), F.lit("").alias("note"))


def triage_event(spark, incident: str, status: str, note: str, ts, seq: int) -> DataFrame:
    """A row for the append-only triage table; the status is checked."""
    if status not in INCIDENT_STATUSES:
        raise ValueError(f"status must be one of {INCIDENT_STATUSES}")
    return spark.createDataFrame([(incident, status, note, ts, seq)], TRIAGE_SCHEMA)


def with_triage(stored: DataFrame, events: DataFrame) -> DataFrame:
    """Incidents with the latest triage event applied."""
    latest = events.groupBy("id").agg(F.max_by(F.struct("status", "note"), F.struct("ts", "seq")).alias("_t"))
    joined = stored.join(latest, "id", "left")
    return joined.select(*[c for c in stored.columns if c not in ("status", "note")],
                         F.coalesce("_t.status", "status").alias("status"), F.coalesce("_t.note", "note").alias("note"))


def audit_rows(events: DataFrame) -> DataFrame:
    """Audit entries of triage events."""
    return events.select("ts", F.lit("incident_update").alias("action"),
                         F.concat("id", F.lit(" -> "), "status").alias("detail"))


def audit_tail(audit: DataFrame, newest: int = 100) -> DataFrame:
    """The newest entries; of equal times those first whose text is."""
    return audit.orderBy(F.col("ts").desc(), "action", "detail").limit(newest)


def list_incidents(stored: DataFrame, source: str | None = None, statuses: list[str] | None = None,
                   severities: list[str] | None = None, tactics: list[str] | None = None) -> DataFrame:
    """Incidents that match every given filter, newest first."""
    rows = stored
    for column, wanted in (("source", [source] if source else None), ("status", statuses),
                           ("severity", severities), ("stage", tactics)):
        if wanted:
            rows = rows.where(F.col(column).isin(wanted))
    return rows.orderBy(F.col("opened_time").desc(), "id")


def queue_counts(stored: DataFrame) -> DataFrame:
    """One row of queue figures."""
    return stored.agg(F.count("*").alias("queue"), F.count_if(F.col("severity") == "Critical").alias("critical"),
                      F.count_if(F.col("severity") == "High").alias("high"),
                      F.count_if(F.col("status") == "New").alias("new"),
                      F.count_if(F.col("status") == "False positive").alias("false_positives"))
