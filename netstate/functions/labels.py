"""Text rules: column names, dataset labels, attack stages."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.config import (BENIGN, BENIGN_LABELS, EXACT_LABELS, LABEL_PATTERNS, STAGE_ORDER, Options)


def simple_name(text: str) -> str:
    """Column-name normal form: lower case, other characters to single underscores."""
    return "_".join(re.findall("[a-z0-9]+", text.lower()))


def simple_name_of(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _rule_result(raw: Column) -> Column:
    """Stage of a label that some rule names, null when only the default is left."""
    name = simple_name_of(raw)
    benign = [simple_name(x) for x in BENIGN_LABELS] + ["", "nan", "none"]
    # the first branch answers the bulk of the rows with a plain comparison
    rule = F.when(F.lower(raw).isin(BENIGN_LABELS), BENIGN).when(raw.isNull() | name.isin(benign), BENIGN)
    by_stage: dict[str, list[str]] = {}
    for label, stage in EXACT_LABELS.items():
        by_stage.setdefault(stage, []).append(simple_name(label))
    for stage, labels in by_stage.items():
        rule = rule.when(name.isin(labels), stage)
    for pattern, stage in LABEL_PATTERNS:
        rule = rule.when(raw.rlike(f"(?i){pattern}"), stage)
    return rule


def stage_of_label(raw: Column, options: Options) -> Column:
    return F.coalesce(_rule_result(raw), F.lit(options.unknown_stage))


def unmapped_labels(flows: DataFrame) -> DataFrame:
    """Labels no rule covers, with their flow counts."""
    return (flows.where(_rule_result(F.col("raw_label")).isNull())
            .groupBy("raw_label").agg(F.count("*").alias("flows")))


def attack_stages(options: Options) -> list[str]:
    """Every stage a flow can carry except Benign, in stage order (ties are decided by this order)."""
    stages = STAGE_ORDER + list(EXACT_LABELS.values()) + [s for _, s in LABEL_PATTERNS] + [options.unknown_stage]
    return [s for s in dict.fromkeys(stages) if s != BENIGN]


def stage_rank(stage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGE_ORDER]), stage)
