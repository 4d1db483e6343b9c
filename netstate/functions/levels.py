"""Severity levels of a risk and their display names."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netstate.config import Options

# Level names in rising order and their two sets of display names.
LEVELS = ["OK", "WATCH", "WARNING", "CRITICAL"]
DISPLAY_LEVELS = {"OK": "NORMAL", "WATCH": "WATCH", "WARNING": "WARNING", "CRITICAL": "HIGH RISK"}
INCIDENT_LEVELS = {"OK": "Normal", "WATCH": "Elevated", "WARNING": "High", "CRITICAL": "Critical"}


def level_bounds(threshold: float, options: Options) -> list[tuple[str, float]]:
    return [("CRITICAL", threshold + options.critical_margin * (1.0 - threshold)), ("WARNING", threshold),
            ("WATCH", options.watch_ratio * threshold)]


def level_of(risk: Column, threshold: float, options: Options) -> Column:
    """Level of a risk; null for a null risk."""
    rule = F.when(risk.isNull(), None)
    for name, bound in level_bounds(threshold, options):
        rule = rule.when(risk >= F.lit(bound), name)
    return rule.otherwise("OK")


def _renamed(level: Column, names: dict[str, str]) -> Column:
    rule = F.when(level.isNull(), None)
    for k, v in names.items():
        rule = rule.when(level == k, v)
    return rule


def display_level(level: Column) -> Column:
    return _renamed(level, DISPLAY_LEVELS)


def incident_level(level: Column) -> Column:
    return _renamed(level, INCIDENT_LEVELS)


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)
