"""Regular window grid: gap filling, segments, positions."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from netstate.config import BENIGN, Options
from netstate.operators.chunks import chunk_of, neighbours, running
from netstate.operators.states import window_number
from netstate.schema import feature_names
from netstate.session import materialize


def regular_states(states: DataFrame, options: Options, min_segment: int = 1, told: dict | None = None) -> DataFrame:
    """Zero-fill short gaps, number the segments, drop segments shorter than ``min_segment`` windows.

    ``told`` gets what is observed on the way: windows, segments, and how many of either are dropped as too short.

    Adds ``segment`` (dense per source), ``pos`` (position in the segment), ``seg_len``, ``row`` (position in the
    source) and ``source_rows``. The grid is worked out on the window numbers alone: every window looks at most
    ``max_gap_windows + 1`` windows around itself, segment borders travel between chunks as one carry row per chunk.
    The wide rows are shuffled once, by (source, window), and each emits the few empty windows before it. No source
    and no segment is ever gathered in one task. ``states`` should be a table that is cheap to read again.
    """
    names = feature_names(options)
    numbered = states.drop("segment").withColumn("_win", window_number(F.col("timestamp"), options))
    placed = place_windows(numbered.select("source", "_win").distinct(), options, min_segment, told)
    steps = (one_per_window(numbered, ["source", "_win"], names).join(placed, ["source", "_win"])
             .withColumn("_k", F.explode(F.sequence(F.lit(0), (F.col("_emitted") - 1).cast("int")))))
    # repeat k = 0 is the window itself, k > 0 the empty window k steps earlier
    empty = F.col("_k") > 0
    back = F.make_dt_interval(secs=(F.col("_k") * options.window_seconds).cast("decimal(18,6)"))
    zero = names + ["attack_flows", "attack_fraction"]
    return steps.select(
        F.when(empty, F.col("timestamp") - back).otherwise(F.col("timestamp")).alias("timestamp"),
        *[F.when(empty, 0.0).otherwise(F.col(c)).alias(c) for c in zero],
        F.when(empty, BENIGN).otherwise(F.col("stage")).alias("stage"),
        (~empty & F.col("is_attack")).alias("is_attack"), "source",
        (empty | F.coalesce(F.col("filled"), F.lit(False))).alias("filled"),
        (F.col("_segments") - 1).cast("int").alias("segment"),
        (F.col("_win") - F.col("_k") - F.col("_start")).alias("pos"), "seg_len",
        (F.col("_upto") - 1 - F.col("_k")).alias("row"), "source_rows")


def place_windows(windows: DataFrame, options: Options, min_segment: int, told: dict | None = None) -> DataFrame:
    """Segment and row numbers for the distinct (source, _win) pairs that stay. The narrow ends are written once."""
    reach, size = options.max_gap_windows + 1, options.chunk_windows
    ends = neighbours(
        windows, ["source"], "_win", size, reach, reach,
        lambda w: {"_before": F.col("_win") - F.lag("_win").over(w), "_after": F.lead("_win").over(w) - F.col("_win")})
    first = F.col("_before").isNull() | (F.col("_before") > reach)
    last = F.col("_after").isNull() | (F.col("_after") > reach)
    chunk = chunk_of("_win", size)
    bounded = running(ends, ["source"], ["_win"], chunk, last={"_start": F.when(first, F.col("_win"))},
                      upcoming={"_end": F.when(last, F.col("_win"))})
    bounded = bounded.withColumn("seg_len", F.col("_end") - F.col("_start") + 1)
    fresh = F.col("_win") == F.col("_start")
    short, seen = F.col("seg_len") < min_segment, Observation()
    bounded = materialize(bounded.observe(
        seen, F.count("*").alias("windows"), F.count_if(fresh).alias("segments"), F.count_if(short).alias("windows_dropped"),
        F.count_if(fresh & short).alias("segments_dropped")), "segment-ends").where(~short)
    if told is not None:
        told.update(seen.get)
    bounded = bounded.withColumn("_emitted", F.when(fresh, 1).otherwise(F.col("_before")))
    return running(bounded, ["source"], ["_win"], chunk,
                   sums={"_segments": fresh.cast("long"), "_upto": F.col("_emitted")},
                   totals={"source_rows": F.col("_emitted")}).drop("_before", "_after", "_end")


def one_per_window(states: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Of repeated windows keep the fullest one, with a fixed choice between equals."""
    order = Window.partitionBy(*keys).orderBy(F.col("flow_count").desc(), F.hash(*[F.col(n) for n in names]))
    return states.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def build_states(flows: DataFrame, options: Options, told: dict | None = None) -> DataFrame:
    """The whole way from canonical flows to the pruned, regular state table.

    The window states are written once: the grid step reads their narrow key columns several times. ``told``: as in
    :func:`regular_states`.
    """
    from netstate.operators.states import window_states

    return regular_states(materialize(window_states(flows, options), "window-states"), options, options.min_segment, told)


def index_states(states: DataFrame, options: Options) -> DataFrame:
    """Positions for a state table that already has ``segment`` (for example one loaded from a file).

    Rows count, not the clock: a window that is missing leaves no hole in ``pos``, and repeated ones follow each other.
    """
    size = options.chunk_windows
    drop = [c for c in ("pos", "seg_len", "row", "source_rows") if c in states.columns]
    names = [c for c in states.columns if c not in drop]
    numbered = states.drop(*drop).withColumns({"_win": window_number(F.col("timestamp"), options),
                                               "_tie": F.xxhash64(*[c for c in names if c not in ("source", "segment")])})
    placed = running(numbered, ["source", "segment"], ["timestamp", "_tie"], chunk_of("_win", size),
                     sums={"_k": F.lit(1).cast("long")}, totals={"seg_len": F.lit(1).cast("long")})
    spans = numbered.groupBy("source", "segment").agg(F.min("_win").alias("_first"), F.count("*").alias("_n"))
    before = running(spans, ["source"], ["_first", "segment"], chunk_of("_first", size),
                     sums={"_offset": F.col("_n")}, totals={"source_rows": F.col("_n")})
    pos = F.col("_k") - 1
    return placed.join(before.select("source", "segment", "_offset", "_n", "source_rows"), ["source", "segment"]).select(
        *names, pos.alias("pos"), "seg_len", (F.col("_offset") - F.col("_n") + pos).alias("row"), "source_rows")


def short_and_long_segments(states: DataFrame, shortest: int = 10, longest: int = 5) -> DataFrame:
    """The shortest and the longest segments with their window counts."""
    sizes = states.groupBy("source", "segment").agg(F.count("*").alias("windows"))
    low = sizes.orderBy("windows", "source", "segment").limit(shortest).withColumn("end", F.lit("shortest"))
    high = (sizes.orderBy(F.col("windows").desc(), "source", "segment").limit(longest)
            .withColumn("end", F.lit("longest")))
    return low.unionByName(high)
