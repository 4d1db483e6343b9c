"""Flow CSV files of any dialect -> canonical flows.

Files are grouped by header and by the timestamp format that most of their rows have: one pass over the time column counts what
times look like. Every group is then one plain CSV scan with one static projection, so column pruning works. The format found is
only the first that a row tries: rows that change it, or spell protocols in another way, are read as well.
"""
from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.config import BENIGN, COLUMN_ALIASES, PROTOCOL_NUMBERS, Options
from netstate.functions.labels import simple_name, stage_of_label
from netstate.schema import FLOW_SCHEMA
from netstate.sources.files import file_heads, file_kind, find_flow_files, list_files

REQUIRED = ["timestamp", "dst_port", "protocol"]
OPTIONAL = ["src_ip", "dst_ip", "src_port", "ttl", "retransmissions", "label"]

# Timestamp formats in the order they are tried; day first wins over month first.
TIMESTAMP_FORMATS = [
    "d/M/yyyy H:m:s",
    "yyyy-M-d H:m:s",
    "yyyy-M-d H:m:s.SSSSSSSSS",
    "d/M/yyyy H:m",
    "d/M/yyyy h:m:s a",
    "M/d/yyyy H:m:s",
    "M/d/yyyy h:m:s a",
    "yyyy/M/d H:m:s",
]
# Column order of the headerless UNSW-NB15 files.
UNSW_COLUMNS = [
    "srcip", "sport", "dstip", "dsport", "proto", "state", "dur", "sbytes", "dbytes",
    "sttl", "dttl", "sloss", "dloss", "service", "Sload", "Dload", "Spkts", "Dpkts",
    "swin", "dwin", "stcpb", "dtcpb", "smeansz", "dmeansz", "trans_depth",
    "res_bdy_len", "Sjit", "Djit", "Stime", "Ltime", "Sintpkt", "Dintpkt",
    "tcprtt", "synack", "ackdat", "is_sm_ips_ports", "ct_state_ttl", "ct_flw_http_mthd",
    "is_ftp_login", "ct_ftp_cmd", "ct_srv_src", "ct_srv_dst", "ct_dst_ltm",
    "ct_src_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm",
    "attack_cat", "Label",
]


# ---------------------------------------------------------------------------------------------- headers
def resolve_columns(header: list[str]) -> dict[str, int]:
    """Field -> position in the header: the first alias wins, of equal names the first column."""
    at: dict[str, int] = {}
    for i, name in enumerate(header):
        at.setdefault(simple_name(name), i)
    hits = {field: [at[simple_name(a)] for a in aliases if simple_name(a) in at]
            for field, aliases in COLUMN_ALIASES.items()}
    return {field: found[0] for field, found in hits.items() if found}


@dataclass(frozen=True)
class Dialect:
    """Everything that is fixed for a group of files."""

    header: tuple[str, ...]
    has_header: bool
    columns: tuple[tuple[str, int], ...]
    duration_divisor: float
    iat_divisor: float

    @property
    def fields(self) -> dict[str, int]:
        return dict(self.columns)

    @property
    def missing(self) -> list[str]:
        return [f for f in REQUIRED if f not in self.fields]


def dialect_of(header_line: str, options: Options) -> Dialect:
    header = next(csv.reader([header_line]), [])
    headerless = len(header) == len(UNSW_COLUMNS) and "timestamp" not in resolve_columns(header)
    names = UNSW_COLUMNS if headerless else header
    fields = resolve_columns(names)
    if "attack_cat" in names:
        fields["label"] = names.index("attack_cat")
    units = (options.duration_divisor, options.iat_divisor)
    if names and (names[fields.get("timestamp", 0)] == "Stime" or names[fields.get("dst_port", 0)] == "dsport"):
        units = (1.0, 1000.0)         # this layout counts in seconds and milliseconds
    return Dialect(tuple(names), not headerless, tuple(sorted(fields.items())), *units)


def describe_files(spark: SparkSession, path: str, options: Options, pattern: str = "*.csv") -> DataFrame:
    """One row per file: number of columns, missing required fields, optional fields present. Headers are read in tasks."""
    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, line in zip(batch["path"], batch["header"]):
                fields = dialect_of(line, options).fields if line else {}
                rows.append((path, len(next(csv.reader([line]), [])), [f for f in REQUIRED if f not in fields],
                             [f for f in OPTIONAL if f in fields]))
            yield pd.DataFrame(rows, columns=["path", "columns", "missing_required", "optional_present"])

    heads = file_heads(find_flow_files(spark, path, pattern), 0).select("path", "header")
    return heads.mapInPandas(describe, "path string, columns int, missing_required array<string>, optional_present array<string>")


def file_checks(spark: SparkSession, path: str, options: Options) -> DataFrame:
    """(path, status, problem, rows, flows) of every file below ``path``: what keeps it from being read is a ``fail`` row.

    Problems: unsupported kind, missing fields (by name), no usable record. Captures and Parquet tables are passed by their kind.
    Empty files are not listed by Spark.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    every = list_files(spark, path, "*").select("path", file_kind(name).alias("kind"), F.regexp_extract(name, r"\.([a-z0-9]+)$", 1).alias("ending"))
    known = (F.col("kind") != "text") | F.col("ending").isin("csv", "txt")
    described = describe_files(spark, path, options, "*").select("path", F.col("missing_required").alias("missing"))
    counted = _rows(spark, path, options, "*.{csv,txt}", skip=True, named="file_path")
    if counted is None:
        counts = described.select("path", F.lit(0).alias("rows"), F.lit(0).alias("flows")).limit(0)
    else:
        counts = counted.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("rows"), F.count_if(F.col("problem").isNull()).alias("flows"))
    joined = every.join(described, "path", "left").join(counts, "path", "left")
    problem = (F.when(~known, "unsupported kind").when(F.col("kind") != "text", None)
               .when(F.size("missing") > 0, F.concat(F.lit("missing fields: "), F.array_join("missing", ", ")))
               .when(F.coalesce("flows", F.lit(0)) == 0, "no usable record"))
    return joined.select("path", F.when(problem.isNull(), "ok").otherwise("fail").alias("status"), problem.alias("problem"), "rows", "flows")


# --------------------------------------------------------------------------------------------- elections
def number(text: Column) -> Column:
    """Text -> finite double, null where that is impossible."""
    value = F.trim(text).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def parsed_time(text: Column, fmt: str) -> Column:
    """Timestamp of a text in the format ``fmt``, else in the first other one that fits; null if none does.

    Numbers are epoch seconds, beyond 1e11 milliseconds.
    """
    text = F.trim(text)
    value = number(text)
    epoch = F.timestamp_seconds(F.when(F.abs(value) > 1e11, value / 1000).otherwise(value)).cast("timestamp_ntz")
    stated = [] if fmt in ("s", "ms", "mixed") else [fmt]
    written = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz")
               for f in stated + [f for f in TIMESTAMP_FORMATS if f not in stated]]
    return F.coalesce(*([*written, epoch] if stated else [epoch, *written]))


def time_shapes(rows: DataFrame) -> DataFrame:
    """(path, ts, n): what the times of a file look like, from (path, ts) rows of any number.

    The date stays and every digit of the clock becomes a 1, so a file has some shapes a day; epoch numbers are 1e9 or, beyond
    1e11, 1e12. Shapes are counted map-side.
    """
    text, value = F.trim("ts"), number(F.col("ts"))
    cut = F.locate(" ", text)
    clock = F.when(cut > 0, F.concat(F.substr(text, F.lit(1), cut), F.regexp_replace(F.substr(text, cut + 1), "[0-9]", "1"))).otherwise(text)
    shape = F.when(value.isNotNull(), F.when(F.abs(value) > 1e11, "1000000000000").otherwise("1000000000")).otherwise(clock)
    return rows.select("path", shape.alias("ts")).groupBy("path", "ts").agg(F.count("*").alias("n"))


def elect(shapes: DataFrame, options: Options) -> DataFrame:
    """(path, fmt) from :func:`time_shapes` over all rows: the format of time that rows of a file try first.

    All values numeric: seconds or, if most are beyond 1e11, milliseconds. Else the format that fits most rows, the earlier one
    of equals, and an early one at once if it fits more than 98 %; below one half each row picks its own format.
    """
    n, some = F.col("n"), F.col("ts").isNotNull()
    fits = [F.sum(F.when(F.try_to_timestamp(F.trim("ts"), F.lit(f)).isNotNull(), n).otherwise(0)) / F.sum(n) for f in TIMESTAMP_FORMATS]
    per = shapes.groupBy("path").agg(
        F.array(*fits).alias("fits"), F.bool_and(number(F.col("ts")).isNotNull() | ~some).alias("numeric"),
        (2 * F.sum(F.when(number(F.col("ts")) > 1e11, n).otherwise(0)) > F.sum(F.when(some, n).otherwise(0))).alias("fine"))
    early = F.array_position(F.transform("fits", lambda x: x > 0.98), True)
    best = F.when(early > 0, early).otherwise(F.array_position("fits", F.array_max("fits"))).cast("int")
    formats = F.array(*[F.lit(f) for f in TIMESTAMP_FORMATS])
    fmt = (F.when(F.col("numeric"), F.when(F.col("fine"), "ms").otherwise("s"))
           .when(F.array_max("fits") >= 0.5, F.element_at(formats, best)).otherwise("mixed"))
    chosen = F.lit(options.timestamp_format) if options.timestamp_format else fmt
    return per.select("path", chosen.alias("fmt"))


# -------------------------------------------------------------------------------------------------- scan
def _columns(dialect: Dialect) -> str:
    return ", ".join([f"c{i} string" for i in range(len(dialect.header))] + ["extra string"])


def scan(spark: SparkSession, paths: list[str], dialect: Dialect, named: str = "file_name") -> DataFrame:
    """All text columns of files with one header; ``extra`` isn't null in lines with too many fields."""
    reader = spark.read.schema(_columns(dialect)).option("header", str(dialect.has_header).lower())
    rows = reader.option("mode", "PERMISSIVE").option("enforceSchema", "true").csv(paths)
    return rows.withColumn("source", F.col(f"_metadata.{named}"))


def canonical(rows: DataFrame, dialect: Dialect, fmt: str, options: Options) -> DataFrame:
    """One projection from raw text columns to the canonical flow schema, and ``problem``: null for flows.

    Else what keeps a row from being one: too many fields, header (a header line once more), time or port.
    """
    fields = dialect.fields

    def raw(field):
        return F.col(f"c{fields[field]}")

    def num(field, absent=0.0):
        return number(raw(field)) if field in fields else F.lit(absent).cast("double")

    def count(field, divisor=1.0):
        value = num(field)
        return F.when(value < 0, 0.0).otherwise(value) / divisor

    named = F.create_map(*[F.lit(x) for name, n in PROTOCOL_NUMBERS.items() for x in (name, float(n))])
    protocol = F.coalesce(num("protocol"), F.try_element_at(named, F.lower(F.trim(raw("protocol")))), F.lit(0.0))
    window = num("win_fwd")
    label = F.trim(raw("label")) if "label" in fields else F.lit("unlabeled")
    stage = stage_of_label(label, options) if "label" in fields else F.lit(BENIGN)

    def text(field):
        return raw(field) if field in fields else F.lit(None).cast("string")

    out = {
        "source": F.col("source"), "timestamp": parsed_time(raw("timestamp"), fmt), "dst_port": num("dst_port"),
        "protocol": protocol, "flow_duration": count("flow_duration", dialect.duration_divisor), "fwd_packets": count("fwd_packets"),
        "bwd_packets": count("bwd_packets"), "fwd_bytes": count("fwd_bytes"), "bwd_bytes": count("bwd_bytes"),
        "iat_mean": count("iat_mean", dialect.iat_divisor), "iat_std": count("iat_std", dialect.iat_divisor),
        "iat_max": count("iat_max", dialect.iat_divisor), "win_fwd": F.when(window >= 0, window),
        "ttl": num("ttl", None), "retransmissions": num("retransmissions", None), "pktlen_mean": count("pktlen_mean"),
        "pktlen_std": count("pktlen_std"), **{f: count(f) for f in ("syn", "ack", "rst", "fin", "psh", "urg")},
        "src_ip": text("src_ip"), "dst_ip": text("dst_ip"), "src_port": num("src_port", None), "raw_label": label}
    header_again = F.coalesce(F.lower("raw_label") == "label", F.lit(False))
    problem = (F.when(F.col("extra").isNotNull(), "too many fields").when(header_again, "header")
               .when(F.col("timestamp").isNull(), "time").when(F.col("dst_port").isNull(), "port"))
    flows = rows.select(*[c.alias(n) for n, c in out.items()], stage.alias("stage"), "extra")
    return flows.select(*FLOW_SCHEMA.names, problem.alias("problem"))


def _rows(spark: SparkSession, path: str, options: Options, pattern: str, skip: bool = False, named: str = "file_name") -> DataFrame | None:
    """Canonical rows with ``problem``. ``skip``: files without the required fields are passed over, None if no file has them."""
    heads = file_heads(find_flow_files(spark, path, pattern), 0)
    listed = heads.select("path", "header").collect()          # the file listing, as any reader keeps it
    if not listed and not skip:
        raise ValueError(f"no flow files below {path}")
    by_dialect: dict[Dialect, list[str]] = {}
    for r in listed:
        by_dialect.setdefault(dialect_of(r["header"], options), []).append(r["path"])
    parts = []
    for dialect, paths in sorted(by_dialect.items(), key=lambda e: e[1]):
        if dialect.missing and skip:
            continue
        if dialect.missing:
            raise ValueError(f"{paths[0]}: required fields {dialect.missing} not found; a flow file needs {REQUIRED}")
        times = scan(spark, sorted(paths), dialect, "file_path").select(
            F.col("source").alias("path"), F.col(f"c{dialect.fields['timestamp']}").alias("ts"))
        groups: dict[str, list[str]] = {}
        for r in elect(time_shapes(times), options).collect():        # one row a file, as the listing has
            groups.setdefault(r["fmt"], []).append(r["path"])
        empty = [p for p in paths if not any(p in g for g in groups.values())]
        parts += [canonical(scan(spark, sorted(files), dialect, named), dialect, fmt, options)
                  for fmt, files in sorted(({**groups, "mixed": groups.get("mixed", []) + empty} if empty else groups).items())]
    return reduce(DataFrame.unionByName, parts) if parts else None


def read_rows(spark: SparkSession, path: str, options: Options, pattern: str = "*.csv") -> DataFrame:
    """As :func:`read_flows`, with the rows that are no flows: ``problem`` says why."""
    return _rows(spark, path, options, pattern)


def read_flows(spark: SparkSession, path: str, options: Options, pattern: str = "*.csv") -> DataFrame:
    """Canonical flows of a CSV file or of all flow CSVs below a folder; ``row_report`` counts the rows that are none."""
    return _rows(spark, path, options, pattern).where("problem is null").drop("problem")


def row_report(spark: SparkSession, path: str, options: Options, pattern: str = "*.csv") -> DataFrame:
    """One row per file: rows, flows, and the rows that are none by their problem."""
    rows = _rows(spark, path, options, pattern)
    kinds = {"too many fields": "too_many_fields", "header": "header_again", "time": "no_time", "port": "no_port"}
    return rows.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(F.col("problem").isNull()).alias("flows"),
                                      *[F.count_if(F.col("problem") == k).alias(n) for k, n in kinds.items()])


def has_labels(spark: SparkSession, path: str, options: Options) -> bool:
    heads = file_heads(find_flow_files(spark, path, "*"), 0).select("header").distinct().collect()
    return any("label" in dialect_of(r["header"], options).fields for r in heads)
