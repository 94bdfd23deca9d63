"""Parameters of the pipeline as plain records; they become literals or small relations of a plan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession

TRANSFORMS = ("level", "spread", "diff_3m", "diff_6m", "diff_12m", "yoy_pct_change")
NORMALIZATIONS = ("none", "expanding_z", "rolling_z_3y", "rolling_z_5y", "rolling_z_10y")
POLARITIES = ("positive", "negative", "positive_only", "negative_only", "penalize_positive_only", "penalize_negative_only", "reward_near_zero")


@dataclass(frozen=True)
class Source:
    series_id: str
    frequency: str
    enabled: bool = True
    reason_disabled: str | None = None
    stale_after_days: int = 45
    unusable_after_days: int = 120
    publication_lag_days: int = 0


@dataclass(frozen=True)
class Feature:
    feature_id: str
    series_id: str
    transform: str = "level"
    normalization: str = "none"
    min_observations: int = 24
    enabled: bool = True
    reason_disabled: str | None = None


@dataclass(frozen=True)
class Weighted:
    """One input of a weighted roll-up; ``ordinal`` breaks ties in the order of configuration."""

    output_id: str
    input_id: str
    weight: float
    polarity: str = "positive"
    min_valid: int = 1
    min_coverage: float = 0.5
    ordinal: int = 0


def check(sources: Iterable[Source], features: Iterable[Feature], inputs: Iterable[Weighted] = ()) -> None:
    """Cross references and enumerations, before anything is planned."""
    known, made = {s.series_id for s in sources}, {f.feature_id for f in features}
    for f in features:
        if f.series_id not in known:
            raise ValueError(f"feature {f.feature_id} reads unknown series {f.series_id}")
        if f.transform not in TRANSFORMS or f.normalization not in NORMALIZATIONS:
            raise ValueError(f"feature {f.feature_id}: unknown transform or normalization")
        if f.min_observations < 1:
            raise ValueError(f"feature {f.feature_id}: min_observations must be positive")
    for w in inputs:
        if made and w.input_id not in made:
            raise ValueError(f"{w.output_id} reads unknown input {w.input_id}")
        if w.polarity not in POLARITIES or w.weight <= 0:
            raise ValueError(f"{w.output_id}: bad polarity or weight")


def relation(spark: SparkSession, records: Iterable[Source | Feature | Weighted]) -> DataFrame:
    """A small relation from records, for broadcast joins."""
    rows = list(records)
    kinds = {"str": "string", "str | None": "string", "int": "int", "float": "double", "bool": "boolean"}
    schema = ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in fields(rows[0]))
    return spark.createDataFrame([tuple(asdict(r).values()) for r in rows], schema)
