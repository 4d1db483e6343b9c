"""Alerts with persistence, hysteresis, de-duplication, escalation and per-stage cooldown.

The rules look like a state machine, but almost all of them are local, so the batch form is relational:

* a window counts as *above* (level WARNING or higher) or *clear* (risk below ``clear_ratio`` x threshold);
* an alert can only end where a run of clear windows reaches ``clear_windows``. These ends cut a segment into
  *stretches* with at most one alert each: it opens at the first allowed window with ``persistence`` above-windows in a
  row and lives to the end of the stretch;
* only the cooldown links stretches, and only if a candidate lies within ``cooldown_windows`` of the previous end.
  Stretches linked that way form a chain. Pieces of a chain become maps from cooldown state to cooldown state, which are then
  put together, so a chain of any length is spread over tasks.

What an alert contains is then an aggregation over its windows. Long segments and long alerts are spread over chunks.
:mod:`netstate.streaming.alerts` has the same rules as a per-window step for Structured Streaming.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.config import BENIGN, Options
from netstate.functions.levels import level_of, level_rank
from netstate.operators.chunks import chunk_of, neighbours, next_match, running
from netstate.operators.sequences import KEYS
from netstate.session import materialize

RESOLVED = "source string, segment int, stretch long, open_k long, last_k long"


def _above_windows(rows: DataFrame, threshold: float, options: Options) -> DataFrame:
    """Windows that are above, with their streak and the ends of clear runs before and after them."""
    n, m, cool = options.persistence, options.clear_windows, options.cooldown_windows
    reach = max(n, cool + 1, m) + 1
    flagged = rows.withColumns({"above": F.col("risk") >= threshold,
                                "clear": F.col("risk") < options.clear_ratio * threshold})

    def streak(flag, w):
        frame = w.rowsBetween(-reach, 0)
        since = F.max(F.when(~F.col(flag), F.col("k"))).over(frame)
        return F.col("k") - F.coalesce(since, F.min("k").over(frame) - 1)

    # only above-windows and the ends of clear runs matter from here on
    streaks = neighbours(flagged, KEYS, "k", options.chunk_windows, reach, 0,
                         lambda w: {"streak": streak("above", w), "calm": streak("clear", w)},
                         where=F.col("above") | (F.col("clear") & (F.col("calm") == m)))
    end = F.when(~F.col("above"), F.struct("k", "pos", "timestamp", "row"))
    placed = running(streaks, KEYS, ["k"], chunk_of("k", options.chunk_windows), last={"before": end},
                     upcoming={"end": end})
    cooling = F.coalesce(F.col("pos") <= F.col("before.pos") + cool, F.lit(False))
    return placed.where("above").select(
        *KEYS, "k", "pos", "row", "timestamp", "risk", "headline_stage", "eta_step", "streak", "before", "end",
        F.coalesce(F.col("before.k"), F.lit(-1)).alias("stretch"), level_of(F.col("risk"), threshold, options).alias(
            "level"), cooling.alias("cooling"), (F.col("streak") >= n).alias("ready"))


def _stretches(above: DataFrame) -> DataFrame:
    """One summary row per stretch that could hold an alert; its arrays hold at most one entry per stage or cooldown
    window."""
    by_stage = above.groupBy(*KEYS, "stretch", "headline_stage").agg(
        F.max("k").alias("last_k"),
        F.min(F.when(F.col("ready") & ~F.col("cooling"), F.struct("k", "headline_stage"))).alias("free"),
        F.collect_list(F.when(F.col("ready") & F.col("cooling"), F.struct("k", "pos", "headline_stage"))).alias("early"),
        F.max("before.pos").alias("before_pos"), F.max("end.pos").alias("end_pos"))
    return (by_stage.groupBy(*KEYS, "stretch").agg(
        F.min("free").alias("free"), F.sort_array(F.flatten(F.collect_list("early"))).alias("early"),
        F.collect_list(F.struct("headline_stage", "last_k")).alias("stages"), F.max("last_k").alias("last_k"),
        F.max("before_pos").alias("before_pos"), F.max("end_pos").alias("end_pos"))
        .where(F.col("free").isNotNull() | (F.size("early") > 0)))


def fold_sorted(df: DataFrame, keys: list[str], order: str, step, schema: str) -> DataFrame:
    """Fold the rows of each key in order: ``step(state, row) -> (state, output row or None)``.

    Partitions arrive sorted, batch by batch, so a key is never held in memory.
    """
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                now = tuple(getattr(row, k) for k in keys)
                if now != key:
                    key, state = now, None
                state, result = step(state, row)
                if result is not None:
                    out.append(result)
            yield pd.DataFrame(out, columns=names)

    names = [f.split()[0] for f in schema.split(", ")]
    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, order).mapInPandas(fold, schema)


def _opened(row, blocked: dict[str, int]):
    """The window at which the alert of a stretch opens: the first early candidate that isn't blocked, else the free one."""
    free = (c for c in row.early if blocked.get(c["headline_stage"], -1) < c["pos"])
    return next(free, row.free)


def _blocked_by(row, opening, options: Options) -> dict[str, int]:
    """Stages that the alert of a stretch blocks, with the last position of that."""
    if opening is None or pd.isna(row.end_pos):
        return {}
    held = {s["headline_stage"] for s in row.stages if s["last_k"] >= opening["k"] and s["headline_stage"] != BENIGN}
    return {s: int(row.end_pos) + options.cooldown_windows for s in held | {opening["headline_stage"]}}


def _settle(options: Options):
    """Fold step over the stretches of a chain: where does the alert of each stretch open?"""
    def step(blocked, row):
        blocked = blocked or {}
        opening = _opened(row, blocked)
        if opening is None:
            return blocked, None
        return {**blocked, **_blocked_by(row, opening, options)}, (row.source, row.segment, row.stretch, opening["k"], row.last_k)

    return step


def _written(blocked: dict[str, int], at: int) -> str:
    """A cooldown state as text, without what has ended before ``at``."""
    return json.dumps({s: until for s, until in sorted(blocked.items()) if until >= at})


#: Entering states of a piece of a chain; a chain that needs more goes through one fold as a whole.
MOST_STATES = 512


def _piece_maps(options: Options, most: int):
    """What a piece of a chain makes of every cooldown state in which it may be entered.

    Only stretches before the piece whose cooldown reaches into it can matter. They come with it, and whichever of their
    candidates opened, the state is among those collected here. Rows of one piece: those stretches, then its own.
    """
    def run(keys, rows):
        rows = rows.sort_values("stretch")
        own = list(rows[rows["home"] == rows["piece"]].itertuples(index=False))
        if not own:
            return pd.DataFrame([], columns=columns)
        at, states = int(own[0].at), {"{}": {}}
        for row in rows[rows["home"] < rows["piece"]].itertuples(index=False):
            openings = [*row.early, row.free]
            later = [{**state, **_blocked_by(row, o, options)} for state in states.values() for o in openings]
            states = {_written(state, at): state for state in later}
            if len(states) > most:
                return pd.DataFrame([(*keys, at, None, None, None)], columns=columns)
        out = []
        for entry, blocked in states.items():
            found = []
            for row in own:
                opening = _opened(row, blocked)
                if opening is not None:
                    found.append({"stretch": row.stretch, "open_k": opening["k"], "last_k": row.last_k})
                    blocked = {**blocked, **_blocked_by(row, opening, options)}
                blocked = {s: until for s, until in blocked.items() if until >= row.at}
            out.append((*keys, at, entry, _written(blocked, at), found))
        return pd.DataFrame(out, columns=columns)

    columns = [*KEYS, "chain", "piece", "at", "entry", "exit", "found"]
    return run


def _entered(state, row):
    """Fold step over the maps of a chain: picks the entry of each piece that the piece before it leads to."""
    piece, reached, left = state or (None, "{}", "{}")
    if row.piece != piece:
        piece, reached = row.piece, left
    if row.entry == _written(json.loads(reached), int(row.at)):
        return (piece, reached, row.exit), (row.source, row.segment, row.chain, row.piece, row.entry)
    return (piece, reached, left), None


def _settled_chains(chained: DataFrame, options: Options, most: int = MOST_STATES) -> DataFrame:
    """Where the alert of each stretch of each chain opens, if there is one.

    A chain is cut into pieces of ``chunk_windows`` positions. All pieces are worked on at once, each for every state in
    which it may be entered: a map from state to state. Going through the maps of a chain then takes a few short rows a piece.
    """
    size = options.chunk_windows
    placed = chained.withColumn("at", F.coalesce("before_pos", F.lit(-1))).withColumn("home", chunk_of("at", size))
    spread = placed.groupBy(*KEYS, "chain").agg((F.min("home") < F.max("home")).alias("long")).where("long")
    if spread.isEmpty():                                            # every chain is one piece
        return fold_sorted(chained, [*KEYS, "chain"], "stretch", _settle(options), RESOLVED)
    first, last = chunk_of("end_pos", size), chunk_of(F.col("end_pos") + options.cooldown_windows, size)
    reached = F.when(F.col("end_pos").isNotNull(), F.filter(F.sequence(first, last), lambda p: p > F.col("home")))
    pieces = placed.withColumn("piece", F.explode(F.concat(F.array("home"), F.coalesce(reached, F.array().cast("array<bigint>")))))
    maps = materialize(pieces.groupBy(*KEYS, "chain", "piece").applyInPandas(
        _piece_maps(options, most), "source string, segment int, chain long, piece long, at long, entry string, exit string, "
        "found array<struct<stretch:bigint,open_k:bigint,last_k:bigint>>"), "chain-maps")
    whole = maps.where("entry is null").select(*KEYS, "chain").distinct()
    cut = maps.join(whole, [*KEYS, "chain"], "left_anti")
    entered = fold_sorted(cut.select(*KEYS, "chain", "piece", "at", "entry", "exit"), [*KEYS, "chain"], "piece", _entered,
                          "source string, segment int, chain long, piece long, entry string")
    settled = cut.join(entered, [*KEYS, "chain", "piece", "entry"], "left_semi").select(*KEYS, F.inline("found"))
    rest = fold_sorted(chained.join(whole, [*KEYS, "chain"], "left_semi"), [*KEYS, "chain"], "stretch", _settle(options), RESOLVED)
    return settled.union(rest)


def alert_windows(rows: DataFrame, threshold: float, options: Options) -> DataFrame:
    """The above-windows that belong to an alert, with its opening ordinal ``open_k``.

    The above-windows are few and read three times, so they are written once.
    """
    above = materialize(_above_windows(rows, threshold, options), "above-windows")
    stretches = _stretches(above)
    size = options.chunk_windows
    # without an early candidate a stretch does not depend on the one before it, and starts a chain
    chained = running(stretches, KEYS, ["stretch"], chunk_of("stretch", size),
                      last={"chain": F.when(F.size("early") == 0, F.col("stretch"))})
    chained = chained.withColumn("chain", F.coalesce("chain", F.lit(-1)))
    settled = _settled_chains(materialize(chained, "stretches"), options)
    # an alert meets its windows chunk by chunk, so a long one is no hot join key
    spread = settled.withColumn("part", F.explode(F.sequence(chunk_of("open_k", size), chunk_of("last_k", size))))
    return (above.withColumn("part", chunk_of("k", size)).join(spread.drop("last_k"), [*KEYS, "stretch", "part"])
            .where(F.col("k") >= F.col("open_k")))


def first_crossing(threshold: float) -> Column:
    """First step at or above the threshold (1 if there is none)."""
    at = F.array_position(F.transform("attack_prob", lambda p: p >= threshold), True)
    return F.greatest(at, F.lit(1)).cast("int")


def alerts(timeline: DataFrame, threshold: float, options: Options, dense: bool = True,
           ordinal: Column | None = None) -> DataFrame:
    """Alerts of a scored time line (source, segment, pos, row, timestamp, risk, headline_stage, attack_prob).

    Runs the two jobs that settle the alerts; what is returned is a small written table with a light plan on top.

    ``dense``: the positions of a segment follow each other without holes. Otherwise streaks count the rows that are
    there, while the cooldown counts positions.
    """
    rows = timeline.withColumn("eta_step", first_crossing(threshold)).select(
        *KEYS, "pos", "row", "timestamp", "risk", "headline_stage", "eta_step")
    if dense:
        rows = rows.withColumn("k", F.col("pos") if ordinal is None else ordinal)
    else:
        rows = running(rows, KEYS, ["pos"], chunk_of("pos", options.chunk_windows), sums={"k": F.lit(1).cast("long")})
    inside = alert_windows(rows, threshold, options)
    opening = F.col("k") == F.col("open_k")
    by_stage = inside.groupBy(*KEYS, "stretch", "headline_stage").agg(
        F.min("k").alias("first_k"), F.min("open_k").alias("open_k"), F.count("*").alias("n"),
        F.max(F.struct("k", "pos", "timestamp", "level")).alias("last"), F.max("risk").alias("peak_risk"),
        F.max(level_rank(F.col("level"))).alias("peak_rank"), F.max("end").alias("end"),
        F.min(F.when(~opening & (F.col("level") == "CRITICAL"), F.struct("k", "pos", "timestamp"))).alias("critical"),
        F.min(F.when(opening, F.struct("k", "pos", "row", "timestamp", "headline_stage", "level", "eta_step",
                                       "streak"))).alias("open"))
    shown = (F.col("headline_stage") != BENIGN) | F.col("open").isNotNull()
    whole = by_stage.groupBy(*KEYS, "stretch").agg(
        F.min("open").alias("open"), F.sum("n").alias("n"), F.max("last").alias("last"),
        F.max("peak_risk").alias("peak_risk"), F.max("peak_rank").alias("peak_rank"), F.max("end").alias("end"),
        F.min("critical").alias("critical"),
        F.sort_array(F.collect_list(F.when(shown, F.struct("first_k", "headline_stage")))).alias("stages"))
    named = whole.select(
        *KEYS, F.col("open.headline_stage").alias("stage"), F.col("last.level").alias("severity"),
        F.when(F.col("peak_rank") > 3, "CRITICAL").otherwise("WARNING").alias("peak_severity"),
        F.col("open.level").alias("opened_level"),
        F.col("open.pos").alias("opened_pos"), F.col("open.row").alias("opened_row"),
        F.col("open.timestamp").alias("opened_time"),
        F.col("last.pos").alias("last_pos"), F.col("last.timestamp").alias("last_time"), "peak_risk",
        (F.col("open.eta_step") * float(options.window_seconds)).alias("eta_seconds"),
        (F.col("n") - 1 + F.col("open.streak")).alias("n_windows"),
        F.transform("stages", lambda s: s["headline_stage"]).alias("stages"),
        F.col("end.pos").alias("closed_pos"), F.col("end.timestamp").alias("closed_time"),
        F.when(F.col("open.level") == "WARNING", F.col("critical")).alias("escalated"))
    named = materialize(named, "alerts")
    # ordinal number per source, in time order
    numbered = running(named, ["source"], ["opened_row"], chunk_of("opened_row", options.chunk_windows),
                       sums={"id": F.lit(1).cast("long")})
    return _closed_by_segment_end(numbered, rows, options)


def _closed_by_segment_end(found: DataFrame, rows: DataFrame, options: Options) -> DataFrame:
    """An alert still open at the end of its segment is closed, without an event, when the next segment starts."""
    starts = neighbours(rows.select(*KEYS, "k", "row", "timestamp"), KEYS, "k", options.chunk_windows, 1, 0,
                        lambda w: {"_first": F.lag("k").over(w).isNull()}, where=F.col("_first"))
    ended = next_match(found, starts.select("source", "row", F.col("timestamp").alias("at_time")), ["source"],
                       F.col("opened_row") + 1, F.col("row"), options.chunk_windows, "following", ["at_time"])
    by_rule = F.col("closed_pos").isNotNull()
    return ended.select(
        *KEYS, "id", "stage", "severity", "peak_severity", "opened_level", "opened_pos", "opened_row", "opened_time",
        "last_pos", "last_time", "peak_risk", "eta_seconds",
        F.when(by_rule | F.col("following").isNotNull(), "CLOSED").otherwise("OPEN").alias("status"), "n_windows",
        "stages", "closed_pos",
        F.coalesce("closed_time", "following.at_time").alias("closed_time"),
        (F.col("last_pos") - F.col("opened_pos") + 1).alias("duration_windows"), "escalated",
        by_rule.alias("closed_by_rule"))


def alert_events(found: DataFrame) -> DataFrame:
    """opened / escalated / closed events, one row each."""
    def event(kind, pos, time, severity, stage):
        return F.struct(F.lit(kind).alias("type"), pos.alias("pos"), time.alias("time"), severity.alias("severity"),
                        stage.alias("stage"))

    none = F.lit(None).cast("string")
    events = F.array(
        event("opened", F.col("opened_pos"), F.col("opened_time"), F.col("opened_level"), F.col("stage")),
        F.when(F.col("escalated").isNotNull(), event("escalated", F.col("escalated.pos"), F.col("escalated.timestamp"),
                                                     F.lit("CRITICAL"), none)),
        F.when(F.col("closed_by_rule"), event("closed", F.col("closed_pos"), F.col("closed_time"), none, none)))
    return found.select(*KEYS, F.col("id").alias("alert_id"), F.inline(F.filter(events, lambda e: e.isNotNull())))


# ----------------------------------------------------------------------------------------------- views
def alert_table(found: DataFrame, timeline: DataFrame, threshold: float, options: Options) -> DataFrame:
    """Alerts with the forecast that opened them: crossing step, seconds ahead, risk at that step."""
    at = F.col("attack_prob")
    crossing = F.array_position(F.transform(at, lambda p: p >= threshold), True)
    step = F.when(crossing > 0, crossing).otherwise(F.array_position(at, F.array_max(at))).cast("int")
    openings = timeline.select("source", "segment", F.col("pos").alias("opened_pos"), step.alias("step"),
                               F.element_at(at, step).alias("risk_at_step"))
    from netstate.functions.levels import display_level
    joined = found.join(openings, [*KEYS, "opened_pos"])
    return joined.select(
        *KEYS, F.col("id").alias("n"), "opened_pos", "last_pos", "closed_pos", "opened_time", "closed_time", "stage",
        F.array_join("stages", " > ").alias("stages"), display_level(F.col("peak_severity")).alias("severity"),
        "peak_risk", "step", (F.col("step") * options.window_seconds).alias("seconds_ahead"), "risk_at_step",
        F.col("n_windows").alias("windows"), "duration_windows", "eta_seconds", "status")


def open_at(found: DataFrame, timeline: DataFrame, options: Options) -> DataFrame:
    """Every scored window with the alert open at it (if any).

    Alerts of a segment do not overlap, so the last one opened so far decides; no range join.
    """
    from netstate.operators.chunks import last_match
    marks = found.select(*KEYS, "opened_pos", "id", "closed_pos", F.col("stage").alias("alert_stage"))
    rows = timeline.select(*KEYS, "pos", "timestamp", "risk")
    hit = last_match(rows, marks, KEYS, F.col("pos"), F.col("opened_pos"), options.chunk_windows, "_a",
                     ["id", "closed_pos", "alert_stage"])
    alive = F.col("_a.closed_pos").isNull() | (F.col("pos") < F.col("_a.closed_pos"))
    return hit.select(*KEYS, "pos", "timestamp", "risk", F.when(alive, F.col("_a.id")).alias("alert_id"),
                      F.when(alive, F.col("_a.alert_stage")).alias("alert_stage"))


def _percent(x: Column) -> Column:
    return F.format_string("%.0f%%", x * 100)


def alert_reason(table: DataFrame, threshold: float, options: Options) -> DataFrame:
    """A sentence per alert that says which rule opened it."""
    return table.withColumn("reason", F.concat(
        F.lit(f"Opened after {options.persistence} windows in a row with a risk of {threshold:.0%} or more; "),
        _percent(F.col("risk_at_step")), F.lit(" is expected "), F.col("seconds_ahead").cast("string"), F.lit(" seconds ahead.")))


def risk_text(rows: DataFrame, threshold: float, options: Options) -> DataFrame:
    """A sentence per forecast origin that sums up its steps."""
    reach = options.horizon * options.window_seconds
    best = rows.groupBy(*KEYS, "pos").agg(
        F.max_by(F.struct("risk", "label"), F.struct("risk", -F.col("step"))).alias("peak"),
        F.min_by(F.struct("label", "stage", "risk"), F.when(F.col("above"), F.col("step"))).alias("first"))
    start = F.when(F.col("first").isNotNull(), F.concat(
        F.col("first.stage"), F.lit(" expected from "), F.col("first.label"), F.lit(" ("), _percent(F.col("first.risk")),
        F.lit(f", limit {threshold:.0%}). "))).otherwise(f"Below the limit of {threshold:.0%} in every step. ")
    peak = F.concat(F.lit(f"Peak over {reach} seconds: "), _percent(F.col("peak.risk")), F.lit(" at "), F.col("peak.label"), F.lit("."))
    return best.select(*KEYS, "pos", F.concat(start, peak).alias("text"))


def replay_history(timeline: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Scored windows of a row range: risk, stage, truth, traffic volume."""
    rows = timeline
    if first is not None:
        rows = rows.where(F.col("row") >= first)
    if last is not None:
        rows = rows.where(F.col("row") <= last)
    return rows.select("source", "row", "timestamp", "risk", F.col("headline_stage").alias("stage"),
                       F.col("is_attack").alias("truth"), F.col("stage").alias("truth_stage"), "flow_count")
