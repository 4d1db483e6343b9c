"""Splits, sample spans, history and future of a window."""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netstate.config import BENIGN, STAGE_ORDER, Options
from netstate.functions.labels import stage_rank
from netstate.operators.chunks import chunk_of, neighbours, running, runs
from netstate.operators.states import window_number

KEYS = ["source", "segment"]


# ------------------------------------------------------------------------------------------------ splits
def split_at(row: Column, rows: Column, options: Options) -> Column:
    """Split label of position ``row`` among ``rows`` positions (no shuffle: both travel with the state row)."""
    span = options.history + options.horizon
    if options.split_strategy == "blocked":
        parts = options.split_parts
        block = F.greatest(F.lit(span + 12),
                           F.least(F.lit(options.block_windows), F.floor(rows / len(parts)).cast("int")))
        turn = (F.floor(row / block) % len(parts)).cast("int")
        return F.element_at(F.array(*[F.lit(p) for p in parts]), turn + 1)
    train_end = F.floor(rows * F.lit(options.train_fraction))
    val_end = F.floor(rows * F.lit(options.train_fraction + options.val_fraction))
    return (F.when(row >= val_end + span, "test").when((row >= train_end + span) & (row < val_end), "val")
            .when(row < train_end, "train").otherwise("gap"))


def with_split(states: DataFrame, options: Options) -> DataFrame:
    """Add ``split``: train / val / test / gap."""
    if options.split_strategy != "chronological":
        return states.withColumn("split", split_at(F.col("row"), F.col("source_rows"), options))
    # One time line over all sources, ranked by (window, source) in two levels: counts per window and group of sources, one
    # short row each, are added up over time; inside such a group rows are ranked by source.
    timed = states.withColumns({"_win": window_number(F.col("timestamp"), options), "_part": source_part(states, options)})
    counts = timed.groupBy("_win", "_part").agg(F.count("*").alias("_n"))
    placed = running(counts, [], ["_win", "_part"], chunk_of("_win", options.chunk_windows),
                     sums={"_upto": F.col("_n")}, totals={"_all": F.col("_n")})
    inside = F.row_number().over(Window.partitionBy("_win", "_part").orderBy("source"))
    ranked = timed.withColumn("_rank", inside).join(placed, ["_win", "_part"])
    place = F.col("_upto") - F.col("_n") + F.col("_rank") - 1
    return (ranked.withColumn("split", split_at(place, F.col("_all"), options))
            .drop("_win", "_part", "_rank", "_n", "_upto", "_all"))


def source_part(states: DataFrame, options: Options) -> Column:
    """A beginning of the source name, ordered as the names are: empty while the sources of a window fit in one task.

    Beyond that it is what all names have in common and two more characters.
    """
    few = states.agg(F.approx_count_distinct("source").alias("n"), F.min("source").alias("low"), F.max("source").alias("high")).first()
    if few["n"] <= options.chunk_windows:
        return F.lit("")
    return F.substr("source", F.lit(1), F.lit(len(os.path.commonprefix([few["low"], few["high"]])) + 2))


def full_span(options: Options) -> Column:
    """The span [pos-L+1, pos+H] lies inside the segment."""
    return (F.col("pos") >= options.history - 1) & (F.col("pos") + options.horizon < F.col("seg_len"))


def has_history(options: Options) -> Column:
    return F.col("pos") >= options.history - 1


def with_samples(states: DataFrame, options: Options) -> DataFrame:
    """Add ``split`` and ``is_sample``: the whole span lies in one segment and one split."""
    L, H = options.history, options.horizon
    if options.split_strategy != "chronological":
        # a block (or a part of the source) is longer than a span, so equal labels at both ends and at the row suffice
        def label(shift):
            return split_at(F.col("row") + shift, F.col("source_rows"), options)
        same = (label(1 - L) == F.col("split")) & (label(H) == F.col("split"))
        return with_split(states, options).withColumn("is_sample", full_span(options) & same)
    framed = neighbours(
        with_split(states, options), KEYS, "pos", options.chunk_windows, L - 1, H,
        lambda w: {"_low": F.min("split").over(w.rowsBetween(1 - L, H)),
                   "_high": F.max("split").over(w.rowsBetween(1 - L, H))})
    return (framed.withColumn("is_sample", full_span(options) & (F.col("_low") == F.col("_high")))
            .drop("_low", "_high"))


def split_summary(states: DataFrame, options: Options) -> DataFrame:
    """Windows, attack windows and windows per attack stage of every split (one row per split and stage)."""
    split = with_split(states, options)
    return split.groupBy("split", F.when(F.col("is_attack"), F.col("stage")).otherwise(BENIGN).alias("stage")).agg(
        F.count("*").alias("windows"))


def split_totals(states: DataFrame, options: Options) -> DataFrame:
    return with_split(states, options).groupBy("split").agg(
        F.count("*").alias("windows"), F.count_if("is_attack").alias("attack_windows"))


def samples_by_next_stage(states: DataFrame, options: Options) -> DataFrame:
    """Samples per split and per stage of the window right after the sample."""
    stage = F.when(F.col("is_attack"), F.col("stage")).otherwise(BENIGN)
    following = neighbours(states.select(*KEYS, "pos", "seg_len", "row", "source_rows", "timestamp",
                                         stage.alias("_stage")),
                           KEYS, "pos", options.chunk_windows, 0, 1, lambda w: {"next_stage": F.lead("_stage").over(w)})
    return (with_samples(following, options).where("is_sample").groupBy("split", "next_stage")
            .agg(F.count("*").alias("samples")))


# ------------------------------------------------------------------------------------- history and future
def with_future(states: DataFrame, options: Options, vocab: list[str] | None = None) -> DataFrame:
    """Add ``future_attack`` (0/1 per step) and, with a vocabulary, ``future_stage`` (stage id per step)."""
    steps = range(1, options.horizon + 1)
    with_id = states if vocab is None else states.withColumn("_sid", stage_id(vocab))

    def columns(w):
        out = {"future_attack": F.array(*[F.lead(F.col("is_attack").cast("double"), k).over(w) for k in steps])}
        if vocab is not None:
            out["future_stage"] = F.array(*[F.lead("_sid", k).over(w) for k in steps])
        return out

    return neighbours(with_id, KEYS, "pos", options.chunk_windows, 0, options.horizon, columns).drop("_sid")


def with_history(df: DataFrame, column: str, options: Options, into: str = "history") -> DataFrame:
    """Add the last L values of ``column`` as an array, oldest first; shorter at the start of a segment."""
    L = options.history
    return neighbours(df, KEYS, "pos", options.chunk_windows, L - 1, 0,
                      lambda w: {into: F.collect_list(column).over(w.rowsBetween(1 - L, 0))})


#: Up to so many origins are sent to all tasks, each with the windows that it looks back on.
FEW = 50_000


def history_of(states: DataFrame, origins: DataFrame, value: Column, options: Options, into: str = "history",
               few: bool = False) -> DataFrame:
    """(source, segment, pos, ``into``) for chosen origins only: their last L values of ``value``, oldest first.

    Only the windows the origins look back on are touched, and ``value`` is worked out for those. They are dealt out by stretches of
    positions, and histories are collected where the rows lie: a value is shuffled once, not once for each origin that sees it.
    ``few``: the origins are a sample; if there are at most ``FEW``, they are sent to the states instead of the other way round.
    """
    L = options.history
    few = few and origins.count() <= FEW
    marks = origins.select(*KEYS, "pos").distinct()
    seen = marks.select(*KEYS, F.explode(F.sequence(F.col("pos") - (L - 1), F.col("pos"))).alias("pos"), (F.col("pos")).alias("_origin"))
    wanted = seen.groupBy(*KEYS, "pos").agg(F.bool_or(F.col("pos") == F.col("_origin")).alias("_mark"))
    rows = states.join(F.broadcast(wanted) if few else wanted, [*KEYS, "pos"]).select(*KEYS, "pos", "_mark", value.alias("_v"))
    return neighbours(rows, KEYS, "pos", options.chunk_windows, L - 1, 0,
                      lambda w: {into: F.collect_list("_v").over(w.rowsBetween(1 - L, 0))}, where=F.col("_mark")).select(*KEYS, "pos", into)


def with_future_values(df: DataFrame, column: str, options: Options, into: str = "future") -> DataFrame:
    """Add the next H values of ``column`` as an array; shorter at the end of a segment."""
    H = options.horizon
    return neighbours(df, KEYS, "pos", options.chunk_windows, 0, H,
                      lambda w: {into: F.collect_list(column).over(w.rowsBetween(1, H))})


def flat_history(df: DataFrame, column: str, options: Options, into: str = "flat") -> DataFrame:
    """History of an array column, flattened to one vector (oldest window first)."""
    return (with_history(df, column, options, "_history").withColumn(into, F.flatten("_history")).drop("_history"))


# ----------------------------------------------------------------------------------------------- stages
def stage_vocabulary(states: DataFrame, options: Options) -> DataFrame:
    """Benign plus the attack stages seen in the train split, numbered in stage order."""
    seen = (with_split(states, options).where((F.col("split") == "train") & F.col("is_attack"))
            .select("stage").distinct().where(stage_rank(F.col("stage")) > 0))
    benign = states.sparkSession.createDataFrame([(BENIGN,)], "stage string")
    # at most one row per known stage reaches this window
    order = Window.orderBy(stage_rank(F.col("stage")))
    return (seen.where(F.col("stage") != BENIGN).unionByName(benign)
            .select("stage", (F.row_number().over(order) - 1).cast("int").alias("id")))


def vocabulary_list(states: DataFrame, options: Options) -> list[str]:
    """The vocabulary as model metadata (bounded by the number of known stages)."""
    rows = stage_vocabulary(states, options).collect()
    return [r["stage"] for r in sorted(rows, key=lambda r: r["id"])]


def stage_id(vocab: list[str]) -> Column:
    """Stage id of a row; attack stages outside the vocabulary are -1."""
    stage = F.when(F.col("is_attack"), F.col("stage")).otherwise(BENIGN)
    return (F.array_position(F.array(*[F.lit(s) for s in vocab]), stage) - 1).cast("int")


def new_stages(states: DataFrame, known: list[str], options: Options) -> DataFrame:
    """Train-split attack stages a vocabulary lacks, in the order they extend it."""
    seen = (with_split(states, options).where((F.col("split") == "train") & F.col("is_attack"))
            .select("stage").distinct())
    old = states.sparkSession.createDataFrame([(s,) for s in known], "stage string")
    rank = stage_rank(F.col("stage"))
    fresh = seen.join(old, "stage", "left_anti")
    order = Window.orderBy(F.when(rank > 0, rank).otherwise(len(STAGE_ORDER) + 1), "stage")
    return fresh.select("stage", (F.row_number().over(order) - 1 + len(known)).cast("int").alias("id"))


# ------------------------------------------------------------------------------------------------ blocks
def holdout_blocks(states: DataFrame, options: Options, label: str = "test", min_windows: int = 1) -> DataFrame:
    """Contiguous runs of one split label inside a segment."""
    rows = with_split(states, options).where(F.col("split") == label)
    marked = runs(rows.select(*KEYS, "pos", "timestamp", "is_attack", "stage"), KEYS, "pos",
                  options.chunk_windows, 0, "first_pos")
    return (marked.groupBy(*KEYS, "first_pos").agg(
        F.count("*").alias("windows"), F.max("pos").alias("last_pos"), F.min("timestamp").alias("start"),
        F.count_if("is_attack").alias("attack_windows"),
        F.array_sort(F.collect_set(F.when(F.col("is_attack"), F.col("stage")))).alias("stages"))
        .where(F.col("windows") >= min_windows))


def holdout_selection(states: DataFrame, options: Options, blocks: int, label: str = "test") -> DataFrame:
    """A replay table of at most ``blocks`` hold-out blocks, stage-rich and attack-rich ones first.

    Blocks without any attack only fill up while at least two places stay free. Selected blocks get their own segment
    number and source name, in time order.
    """
    found = holdout_blocks(states, options, label, options.history + options.horizon + 5)
    ranked = found.orderBy((F.size("stages") * 1000 + F.col("attack_windows")).desc(), "start", "source")
    with_attack = ranked.where("attack_windows > 0").limit(blocks)
    quiet = ranked.where("attack_windows = 0").limit(max(blocks - 2, 0))
    both = with_attack.withColumn("_q", F.lit(0)).unionByName(quiet.withColumn("_q", F.lit(1)))
    # at most 2 * blocks rows from here on
    order = Window.orderBy("_q", (F.size("stages") * 1000 + F.col("attack_windows")).desc(), "start", "source")
    place = both.withColumn("_place", F.row_number().over(order))
    chosen = place.where((F.col("_place") <= blocks) & ((F.col("_q") == 0) | (F.col("_place") <= max(blocks - 2, 0))))
    number = F.row_number().over(Window.orderBy("start", "source", "first_pos"))
    named = chosen.select("source", "segment", "first_pos", "last_pos", number.cast("int").alias("_no"))
    inside = (F.col("pos") >= F.col("first_pos")) & (F.col("pos") <= F.col("last_pos"))
    keep = [c for c in states.columns if c not in ("source", "segment", "pos", "seg_len", "row", "source_rows")]
    return states.join(F.broadcast(named), KEYS).where(inside).select(
        *keep, F.format_string("holdout-%02d-%s", "_no", F.substring("source", 1, 20)).alias("source"),
        (F.col("_no") - 1).alias("segment"))


def attack_bands(states: DataFrame, options: Options) -> DataFrame:
    """Start and end of every run of labelled attack windows."""
    rows = states.where("is_attack").select(*KEYS, "pos", "timestamp")
    marked = runs(rows, KEYS, "pos", options.chunk_windows, 0, "first_pos")
    return marked.groupBy(*KEYS, "first_pos").agg(F.max("pos").alias("last_pos"), F.min("timestamp").alias("start"),
                                                  F.max("timestamp").alias("end"))
