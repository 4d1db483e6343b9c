"""Distribution drift between a reference table and new traffic."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.config import Options
from netstate.operators.chunks import counted_quantiles, value_counts
from netstate.operators.scaling import Scaler
from netstate.operators.sequences import KEYS, history_of, with_samples
from netstate.session import materialize

BINS = 10


def background_sample(states: DataFrame, scaler: Scaler, options: Options, size: int = 100) -> DataFrame:
    """A fixed-size sample of train histories in model space (source, segment, pos, history).

    Rows are picked by the MD5 of the seed and their key, so the choice depends on neither partitioning nor engine; only the
    picked positions gather their history.
    """
    draw = F.md5(F.concat_ws("|", F.lit(str(options.seed)), *[F.col(k).cast("string") for k in (*KEYS, "pos")]))
    picked = with_samples(states, options).where("is_sample and split = 'train'").orderBy(draw).limit(size).select(*KEYS, "pos")
    return history_of(states, picked, scaler.vector(), options, few=True)


def long_values(states: DataFrame, names: list[str], value) -> DataFrame:
    """(feature, value) rows."""
    return states.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), value(n).alias("value"))
                                            for n in names])))


def _level(psi: Column) -> Column:
    return F.when(psi >= 0.25, "significant").when(psi >= 0.10, "moderate").otherwise("stable")


def reference_edges(counted: DataFrame) -> DataFrame:
    """Distinct decile edges, size and mean per feature, from counted (feature, value, _n) rows; one row per feature."""
    deciles = counted_quantiles(counted, ["feature"], "value", [i / BINS for i in range(BINS + 1)])
    edges = deciles.groupBy("feature").agg(F.array_sort(F.array_distinct(F.collect_list("q"))).alias("edges"))
    return edges.join(_totals(counted, "ref_mean", "ref_n"), "feature")


def _totals(counted: DataFrame, mean: str, n: str) -> DataFrame:
    return counted.groupBy("feature").agg((F.sum(F.col("value") * F.col("_n")) / F.sum("_n")).alias(mean), F.sum("_n").alias(n))


def _histogram(counted: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Counts per (feature, bin); the outer bins are open."""
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    return (counted.join(F.broadcast(edges), "feature")
            .select("feature", "_n", F.size(F.filter(inner, lambda e: e <= F.col("value"))).alias("bin"))
            .groupBy("feature", "bin").agg(F.sum("_n").alias(name)))


def drift_table(reference: DataFrame, new: DataFrame) -> DataFrame:
    """Population stability index and mean shift per feature of two (feature, value) tables, with a level.

    Either table is read once: its values are counted, and edges, means and bins come from the counts.
    """
    reference, new = (value_counts(side, ["feature"], "value") for side in (reference, new))
    edges = materialize(reference_edges(reference), "drift-edges")
    bins = edges.select("feature", F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))
                                             ).alias("bin"))
    totals = _totals(new, "new_mean", "new_n")
    joined = (bins.join(_histogram(reference, edges, "r"), ["feature", "bin"], "left")
              .join(_histogram(new, edges, "x"), ["feature", "bin"], "left")
              .join(edges, "feature").join(totals, "feature"))
    pr = F.greatest(F.coalesce("r", F.lit(0)) / F.col("ref_n"), F.lit(1e-4))
    px = F.greatest(F.coalesce("x", F.lit(0)) / F.col("new_n"), F.lit(1e-4))
    per = joined.groupBy("feature").agg(
        F.sum((px - pr) * F.log(px / pr)).alias("_psi"), F.first(F.size("edges")).alias("_edges"),
        (F.first("new_mean") - F.first("ref_mean")).alias("mean_shift"))
    flat = F.when(F.abs("mean_shift") < 0.5, 0.0).otherwise(1.0)
    psi = F.when(F.col("_edges") < 3, flat).otherwise(F.col("_psi"))
    return per.select("feature", psi.alias("psi"), "mean_shift").withColumn("level", _level(F.col("psi")))


def drift_overall(table: DataFrame) -> DataFrame:
    """One row: share of significantly shifted features and the overall level."""
    shares = table.agg(F.avg((F.col("psi") >= 0.25).cast("double")).alias("significant_share"),
                       F.avg((F.col("psi") >= 0.10).cast("double")).alias("moderate_share"))
    overall = (F.when(F.col("significant_share") > 0.25, "significant")
               .when((F.col("significant_share") > 0.08) | (F.col("moderate_share") > 0.3), "moderate")
               .otherwise("stable"))
    return shares.select("significant_share", overall.alias("overall"))


def drift_report(background: DataFrame, states: DataFrame, scaler: Scaler) -> DataFrame:
    """Drift of every active feature: new states against the background sample of the training data."""
    active = [(i, n) for i, (n, a) in enumerate(zip(scaler.names, scaler.active)) if a]
    windows = background.select(F.explode("history").alias("z"))
    names = [n for _, n in active]
    at = {n: i for i, n in active}
    reference = long_values(windows, names, lambda n: F.element_at("z", at[n] + 1))
    return drift_table(reference, long_values(states, names, scaler.scaled))
