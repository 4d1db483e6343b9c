"""Checks of incoming traffic, of a data set, and of stored files."""
from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netstate.config import Options
from netstate.operators.chunks import beside, chunk_of, running
from netstate.operators.scaling import Scaler, feature_report
from netstate.operators.sequences import KEYS, has_history
from netstate.operators.states import window_number
from netstate.session import materialize
from netstate.sources.files import list_files, open_file


def order_violations(states: DataFrame, options: Options, keys: list[str] | None = None) -> DataFrame:
    """Windows that do not come after the one before them in their segment, all or by ``keys``: ``bad``.

    The order is that of the file a table was read from, where it has kept it in ``given``, else that of ``pos``.
    """
    order = "given" if "given" in states.columns else "pos"
    rows = running(states.select(*KEYS, order, "timestamp"), KEYS, [order], chunk_of(order, options.chunk_windows),
                   last={"_before": F.struct(order, "timestamp")}, before=True)
    return rows.groupBy(*(keys or [])).agg(F.count_if(F.col("timestamp") <= F.col("_before.timestamp")).alias("bad"))


def stored_table_checks(states: DataFrame, options: Options) -> DataFrame:
    """Per segment of a state table as it was stored: rows, windows missing inside, repeated windows, windows out of order."""
    number = window_number(F.col("timestamp"), options)
    seen = states.groupBy(*KEYS, number.alias("_win")).agg(F.count("*").alias("n"))
    sizes = seen.groupBy(*KEYS).agg(F.sum("n").alias("rows"), (F.max("_win") - F.min("_win") + 1 - F.count("*")).alias("missing"),
                                    F.sum(F.col("n") - 1).alias("repeated"))
    return sizes.join(order_violations(states, options, KEYS), KEYS).select(*KEYS, "rows", "missing", "repeated", F.col("bad").alias("disordered"))


def _check(name: str, status, detail):
    return F.struct(F.lit(name).alias("check"), status.alias("status"), detail.alias("detail"))


def _text(template: str, *values):
    return F.format_string(template, *values)


def traffic_checks(states: DataFrame, scaler: Scaler, options: Options, kind: str = "flow-csv",
                   optional_fields: list[str] | None = None) -> DataFrame:
    """Checklist of a traffic table: (no, check, status, detail) with status ok, warn or fail."""
    titles = {"flow-csv": "Flow CSV", "pcap": "Packet capture", "state-table": "Prepared network-state table"}
    fields = {"flow-csv": "optional fields present: " + (", ".join(optional_fields or []) or "none"),
              "pcap": "derived from packet headers"}.get(kind, "pre-aggregated network-state table")
    base = states.agg(F.count("*").alias("windows"), F.min("timestamp").alias("first"),
                      F.max("timestamp").alias("last"), F.count_if(F.col("timestamp").isNull()).alias("undated"),
                      F.count_if(has_history(options)).alias("able"))
    kinds = feature_report(states, scaler, options).agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("missing", "unavailable", "novel")])
    row = beside(base, order_violations(states, options), kinds)

    def ok(condition, otherwise="fail"):
        return F.when(condition, "ok").otherwise(otherwise)

    matching = (F.when(F.col("missing") > 0, "fail")
                .when(F.col("unavailable") + F.col("novel") > 0, "warn").otherwise("ok"))
    checks = F.array(
        _check("File format recognized", ok(F.col("windows") > 0), F.lit(titles.get(kind, kind))),
        _check("Timestamp detected", ok((F.col("undated") == 0) & (F.col("windows") > 0)),
               F.concat_ws(" to ", F.date_format("first", "yyyy-MM-dd HH:mm:ss"),
                           F.date_format("last", "yyyy-MM-dd HH:mm:ss"))),
        _check("Required traffic fields detected", F.lit("ok"), F.lit(fields)),
        _check("Temporal ordering verified", ok(F.col("bad") == 0), _text("%d windows out of order", F.col("bad"))),
        _check("Compatible feature representation", matching,
               _text("%d missing, %d empty, %d ignored features", F.col("missing"), F.col("unavailable"),
                     F.col("novel"))),
        _check("Sufficient temporal history", ok(F.col("able") > 0),
               _text("%d windows have the history a forecast needs", F.col("able"))),
        _check("No training performed", F.lit("ok"), F.lit("the scaler and the model are only read")))
    return row.select(F.posexplode(checks).alias("no", "_c")).select((F.col("no") + 1).alias("no"), "_c.*")


def sanity_checks(states: DataFrame, scored: DataFrame) -> DataFrame:
    """Checks of a labelled data set and its forecast: (check, passed, value)."""
    s = states.agg(
        F.min(F.year("timestamp")).alias("y0"), F.max(F.year("timestamp")).alias("y1"),
        F.count_if(F.least("duration_mean", "flow_count", "packets_total", "bytes_total") < 0).alias("negative"),
        F.count_if("is_attack").alias("attack"))
    p = F.col("attack_prob")
    mean = F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p)
    spread = F.sqrt(F.aggregate(p, F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))) / F.size(p))
    f = scored.withColumn("_m", mean).agg(
        F.min(F.array_min("attack_prob")).alias("low"), F.max(F.array_max("attack_prob")).alias("high"),
        F.avg(spread).alias("spread"), F.avg(F.when(F.col("is_attack"), F.array_max("attack_prob"))).alias("hot"),
        F.avg(F.when(~F.col("is_attack"), F.array_max("attack_prob"))).alias("cold"))
    row = beside(s, f)
    gap = F.col("hot") - F.col("cold")

    def check(name, passed, value):
        return F.struct(F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"),
                        value.cast("double").alias("value"))

    return row.select(F.inline(F.array(
        check("timestamps sane", (F.col("y0") >= 2000) & (F.col("y1") <= 2035), F.col("y0")),
        check("no negative durations or counts", F.col("negative") == 0, F.col("negative")),
        check("attack windows present", F.col("attack") > 0, F.col("attack")),
        check("probabilities valid", (F.col("low") >= 0) & (F.col("high") <= 1), F.col("high")),
        check("forecast depends on the step", F.col("spread") > 1e-4, F.col("spread")),
        check("risk higher during attacks", gap > 0.1, gap))))


FAN = 1024


def _root(leaves: DataFrame, keys: list[str], place: str, fan: int) -> DataFrame:
    """(keys, leaves, digest): the root of a tree of SHA-256 digests over ``leaves`` (keys, ``place``, digest), one for each key.

    ``fan`` neighbours by ``place``, which counts from 0 but may have holes, are hashed together, level by level, until one is
    left; no array holds more than ``fan`` digests. The depth of a tree depends on its own leaves only.
    """
    tops = leaves.groupBy(*keys).agg(F.max(place).alias("_top"))
    highest = tops.agg(F.max("_top")).first()[0] or 0
    with_top = leaves.join(tops, keys) if keys else leaves.withColumn("_top", F.lit(highest))
    level = with_top.select(*keys, F.col(place).alias("_at"), "digest", F.lit(1).cast("long").alias("leaves"), "_top", F.lit(False).alias("_done"))
    while True:
        entries = F.sort_array(F.collect_list(F.struct("_at", "digest")))
        node = F.sha2(F.array_join(F.transform(entries, lambda e: e["digest"]), ""), 256)
        level = level.groupBy(*keys, F.floor(F.col("_at") / fan).alias("_up")).agg(
            F.when(F.bool_or("_done"), F.max("digest")).otherwise(node).alias("digest"), F.sum("leaves").alias("leaves"),
            F.floor(F.max("_top") / fan).alias("_top"), (F.bool_or("_done") | (F.max("_top") < fan)).alias("_done")).withColumnRenamed("_up", "_at")
        if highest < fan:
            return level.select(*keys, "leaves", "digest")
        highest //= fan


def file_digests(spark: SparkSession, path: str, block_bytes: int = 8 << 20, fan: int = FAN) -> DataFrame:
    """(path, length, blocks, digest) of every file below ``path``: blocks are hashed in parallel, their digests meet in a tree.

    A file of any size is read by as many tasks as it has blocks; equal bytes have equal digests for the same block size.
    """
    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                with open_file(r.path) as f:
                    f.seek(r.block * block_bytes)
                    out.append((r.path, r.length, r.block, hashlib.sha256(f.read(min(block_bytes, r.length - r.block * block_bytes))).hexdigest()))
            yield pd.DataFrame(out, columns=["path", "length", "block", "digest"])

    last = F.greatest(F.ceil(F.col("length") / block_bytes) - 1, F.lit(0))
    blocks = list_files(spark, path, "*").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = materialize(blocks.repartition(tasks, "path", "block").mapInPandas(
        digests, "path string, length long, block long, digest string"), "block-digests")
    return _root(leaves, ["path", "length"], "block", fan).select("path", "length", F.col("leaves").alias("blocks"), "digest")


def fingerprint(spark: SparkSession, path: str, block_bytes: int = 8 << 20) -> DataFrame:
    """One row: the root over the digests of all files below ``path`` in the order of their names, their number and bytes.

    Names count from the folder on, so a copied folder keeps its fingerprint.
    """
    files = file_digests(spark, path, block_bytes)
    common = files.agg(F.min("path"), F.max("path")).first()
    if common[0] is None:
        return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.sha2(F.lit(""), 256).alias("fingerprint"))
    root = os.path.commonprefix([os.path.dirname(p) + "/" for p in common])
    root = root[:root.rindex("/") + 1]
    named = files.withColumn("name", F.substr("path", F.lit(len(root) + 1)))
    # neighbours by name meet first: the order among at most some million names, each a short row
    placed = named.withColumn("_n", F.row_number().over(Window.orderBy("name")) - 1).select(
        "_n", "length", F.sha2(F.concat_ws(" ", "name", "digest"), 256).alias("digest"))
    size = files.agg(F.sum("length").alias("bytes"))
    return beside(_root(placed, [], "_n", FAN).select(F.col("leaves").alias("files"), F.col("digest").alias("fingerprint")), size)


def table_digest(table: DataFrame, key: str, columns: list[str], block: int = 4096, fan: int = FAN) -> DataFrame:
    """One row: the root over the rows of a table, in the order of the number ``key``: rows, digest.

    A leaf holds the rows of ``block`` neighbouring keys. Columns count as their texts, null as an empty one; whatever file layout
    holds the rows, equal rows have equal digests. Rows with the same key are put in the order of their digests.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = table.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.sha2(text, 256).alias("digest"))
    low = rows.agg(F.min("_key").alias("_low"))
    entries = F.sort_array(F.collect_list(F.struct("_key", "digest")))
    leaves = rows.withColumn("_block", F.floor((F.col("_key") - low.scalar()) / block)).groupBy("_block").agg(
        F.sha2(F.array_join(F.transform(entries, lambda e: e["digest"]), ""), 256).alias("digest"), F.count("*").alias("_rows"))
    leaves = materialize(leaves, "row-digests")
    return beside(_root(leaves, [], "_block", fan).select("digest"), leaves.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows")))


def unchanged(before: DataFrame, after: DataFrame) -> bool:
    return before.first()["fingerprint"] == after.first()["fingerprint"]
