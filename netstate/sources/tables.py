"""State tables, uploads of any kind, exports."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.config import BENIGN, Options
from netstate.operators.grid import build_states, index_states
from netstate.schema import feature_names, state_schema
from netstate.sources.files import file_heads, file_kind, list_files
from netstate.sources.flow_csv import OPTIONAL, dialect_of, read_flows


def write_states(states: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Parquet partitioned by source (a read of one source touches its folder only), or CSV with a header."""
    if fmt == "csv":
        states.write.mode(mode).option("header", "true").csv(path)
    else:
        states.write.mode(mode).partitionBy("source").parquet(path)


def is_state_header(columns: list[str], options: Options) -> bool:
    names = feature_names(options)
    return sum(n in columns for n in names) >= int(0.8 * len(names))


def read_states(spark: SparkSession, path: str, options: Options) -> DataFrame:
    """A state table (Parquet or CSV); metadata columns a file lacks get their defaults.

    ``given`` is the place of a row: rows of a file come in its order, whatever their times.
    """
    first = path.rstrip("/").lower()
    if first.endswith((".csv", ".csv.gz")) or list_files(spark, path, "*.parquet").isEmpty():
        header = spark.read.option("header", "true").csv(path).columns
        known = {f.name: f.dataType for f in state_schema(options)}
        raw = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
        rows = raw.select(*[F.expr(f"try_cast(`{c}` as {known[c].simpleString()})").alias(c) if c in known else F.col(c)
                            for c in header])
    else:
        rows = spark.read.parquet(path)
    rows = rows.withColumn("given", F.monotonically_increasing_id())
    defaults = {"stage": F.lit(BENIGN), "is_attack": F.lit(False), "source": F.lit("states"),
                "segment": F.lit(0), "filled": F.lit(False), "attack_flows": F.lit(0.0),
                "attack_fraction": F.lit(0.0)}
    full = rows.withColumns({c: F.coalesce(F.col(c), d) if c in rows.columns else d for c, d in defaults.items()})
    return full.withColumns({"is_attack": F.col("is_attack").cast("boolean"),
                             "segment": F.col("segment").cast("int")})


def load_traffic(spark: SparkSession, path: str, options: Options) -> tuple[DataFrame, dict]:
    """State tables, or flow CSVs and packet captures in any mixture -> indexed states and what kind of data it was.

    Every file is looked at. State tables beside raw traffic or beside state tables of the other format are an error,
    since windows of both would overlap. info: kind (mixed: CSVs and captures), labelled, optional_fields; the counts are
    :func:`netstate.operators.views.traffic_stats`.
    """
    files = list_files(spark, path, "*").select("path", file_kind(F.col("path")).alias("kind"))
    kinds = {r["kind"] for r in files.select("kind").distinct().collect()}
    if not kinds:
        raise ValueError(f"no files below {path}")
    heads = file_heads(files.where("kind = 'text'"), 0).select("header").distinct().collect() if "text" in kinds else []
    dialects = [dialect_of(r["header"], options) for r in heads]              # as many as there are different headers
    flow_dialects = [d for d in dialects if not is_state_header(list(d.header), options)]
    held = {"pcap": "pcap" in kinds, "flow-csv": bool(flow_dialects), "parquet states": "parquet" in kinds,
            "CSV states": len(flow_dialects) < len(dialects)}
    found = [k for k, there in held.items() if there]
    if len(found) > 1 and (held["parquet states"] or held["CSV states"]):
        raise ValueError(f"{path} holds {' and '.join(found)}; load state tables from a folder of their own")
    if held["parquet states"] or held["CSV states"]:
        header = spark.read.parquet(path).columns if "parquet" in kinds else [c for d in dialects for c in d.header]
        return index_states(read_states(spark, path, options), options), {
            "kind": "state-table", "labelled": "is_attack" in header, "optional_fields": []}
    parts = []
    if held["pcap"]:
        from netstate.operators.packets import packet_flows
        from netstate.sources.captures import read_captures
        parts.append(packet_flows(read_captures(spark, path)))
    if held["flow-csv"]:
        parts.append(read_flows(spark, path, options, "*"))
    optional = OPTIONAL[:-1]
    return build_states(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts), options), {
        "kind": "mixed" if len(found) > 1 else found[0], "labelled": any("label" in d.fields for d in flow_dialects),
        "optional_fields": [f for f in optional if held["pcap"] or any(f in d.fields for d in flow_dialects)]}


def export(df: DataFrame, path: str, fmt: str = "csv", mode: str = "error") -> None:
    """Write alerts, incidents or outcomes for other tools; arrays are joined for CSV."""
    if fmt == "json":
        df.write.mode(mode).json(path)
        return
    flat = []
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind == "array":
            flat.append(F.array_join(f.name, " > ").alias(f.name))
        elif kind == "struct":                                     # its fields as columns of their own
            flat += [F.col(f"`{f.name}`.`{x.name}`").alias(f"{f.name}_{x.name}") for x in f.dataType]
        else:
            flat.append(F.col(f"`{f.name}`"))
    df.select(*flat).write.mode(mode).option("header", "true").csv(path)
