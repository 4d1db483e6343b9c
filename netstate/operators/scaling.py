"""Feature scaling: fit on one split, apply anywhere, report feature mismatches."""
from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.config import Options
from netstate.schema import LOG_FEATURES, OPTIONAL_FEATURES, STATE_LABELS, feature_names

PARAMS = "feature string, position int, mean double, std double, active boolean, logged boolean"


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def signed_expm1(x: Column) -> Column:
    return F.signum(x) * F.expm1(F.abs(x))


def model_space(name: str) -> Column:
    x = F.col(name)
    return signed_log1p(x) if name in LOG_FEATURES else x


def scaler_params(states: DataFrame, options: Options) -> DataFrame:
    """One row per feature: mean, population deviation, whether it varies at all. One aggregation, no shuffle of rows."""
    names = feature_names(options)
    stats = states.agg(*[F.avg(model_space(n)).alias(f"m_{n}") for n in names],
                       *[F.stddev_pop(model_space(n)).alias(f"s_{n}") for n in names])
    active = [F.coalesce(F.col(f"s_{n}") > 1e-8, F.lit(False)) for n in names]
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(i).alias("position"), F.col(f"m_{n}").alias("mean"),
                              F.when(a, F.col(f"s_{n}")).otherwise(1.0).alias("std"), a.alias("active"),
                              F.lit(n in LOG_FEATURES).alias("logged"))
                     for i, (n, a) in enumerate(zip(names, active))])
    return stats.select(F.inline(rows))


@dataclass(frozen=True)
class Scaler:
    """Fitted parameters (one entry per feature, so their size is that of the feature list)."""

    names: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    active: tuple[bool, ...]
    clip: float = 10.0

    @staticmethod
    def fit(states: DataFrame, options: Options) -> "Scaler":
        return Scaler.from_params(scaler_params(states, options), options.clip)

    @staticmethod
    def from_params(params: DataFrame, clip: float = 10.0) -> "Scaler":
        rows = sorted(params.collect(), key=lambda r: r["position"])
        return Scaler(tuple(r["feature"] for r in rows), tuple(r["mean"] or 0.0 for r in rows),
                      tuple(r["std"] for r in rows), tuple(r["active"] for r in rows), clip)

    def params(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, i, m, s, a, n in LOG_FEATURES) for i, (n, m, s, a) in enumerate(
            zip(self.names, self.mean, self.std, self.active))], PARAMS)

    def to_json(self) -> str:
        return json.dumps({"names": self.names, "mean": self.mean, "std": self.std, "active": self.active,
                           "clip": self.clip})

    @staticmethod
    def from_json(text: str) -> "Scaler":
        d = json.loads(text)
        return Scaler(*(tuple(d[k]) for k in ("names", "mean", "std", "active")), d["clip"])

    def scaled(self, name: str, value: Column | None = None) -> Column:
        """The scaled column of one feature; ``value`` replaces the raw column."""
        i = self.names.index(name)
        if not self.active[i]:
            return F.lit(0.0)
        raw = F.col(name) if value is None else value
        raw = signed_log1p(raw) if name in LOG_FEATURES else raw
        z = (raw - F.lit(self.mean[i])) / F.lit(self.std[i])
        z = F.when(z.isNull() | F.isnan(z), 0.0).otherwise(z)
        return F.least(F.greatest(z, F.lit(-self.clip)), F.lit(self.clip))

    def vector(self) -> Column:
        """All scaled features as one array."""
        return F.array(*[self.scaled(n) for n in self.names])

    def transform(self, states: DataFrame) -> DataFrame:
        """Replace every feature by its scaled value."""
        self.check(states)
        return states.withColumns({n: self.scaled(n) for n in self.names})

    def with_vector(self, states: DataFrame, into: str = "z") -> DataFrame:
        self.check(states)
        return states.withColumn(into, self.vector())

    def unscaled(self, name: str, z: Column) -> Column:
        i = self.names.index(name)
        x = z * F.lit(self.std[i]) + F.lit(self.mean[i])
        return signed_expm1(x) if name in LOG_FEATURES else x

    def inverse(self, scaled: DataFrame) -> DataFrame:
        """From model space back to raw units."""
        return scaled.withColumns({n: self.unscaled(n, F.col(n)) for n in self.names})

    def check(self, states: DataFrame) -> None:
        missing = [n for n in self.names if n not in states.columns]
        if missing:
            raise ValueError(f"{len(missing)} feature columns are missing: {missing[:8]}")


def feature_report(states: DataFrame, scaler: Scaler, options: Options, keys: Sequence[str] = ()) -> DataFrame:
    """Where a state table and a fitted scaler disagree: (kind, feature) rows, for each of ``keys`` if there are any.

    kind: missing | extra | inactive | unavailable (the model uses it, the table has only zeros) | novel (the table has
    telemetry the model never saw).
    """
    known = {*scaler.names, *STATE_LABELS, "timestamp", "source", "filled", "segment", "label", "pos", "seg_len", "row",
             "source_rows", "given"}
    missing = [n for n in scaler.names if n not in states.columns]
    fixed = [("missing", n) for n in missing]
    fixed += [("extra", c) for c in sorted(states.columns) if c not in known]
    fixed += [("inactive", n) for n, a in zip(scaler.names, scaler.active) if not a]

    def entry(kind: str, feature: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(feature).alias("feature"))

    used = states.groupBy(*keys).agg(F.count("*").alias("_rows"), *[F.sum(F.abs(n)).alias(f"_u_{n}") for n in scaler.names if n not in missing])
    entries = [entry(k, n) for k, n in fixed]
    for n, active in zip(scaler.names, scaler.active):
        filled = F.coalesce(F.col(f"_u_{n}"), F.lit(0.0)) > 0
        if active and not missing:
            entries.append(F.when(~filled, entry("unavailable", n)))
        elif n in OPTIONAL_FEATURES and not missing:
            entries.append(F.when(filled, entry("novel", n)))
    none = F.array().cast("array<struct<kind:string,feature:string>>")
    found = F.filter(F.array(*entries), lambda e: e.isNotNull()) if entries else none
    return used.select(*keys, F.inline(found))
