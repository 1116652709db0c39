"""Settings of an investigation: thresholds, switches, rules. Unknown keys are errors."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from .operators.rules import Rule

# The detectors, in the order that they run in, and the outlier methods.
DETECTORS = ("schema", "missingness", "duplicates", "constant", "identifier", "types", "numeric", "outliers", "categorical", "strings", "datetime", "temporal", "correlation", "redundancy", "target", "rules")
OUTLIER_METHODS = ("iqr", "zscore", "modified_zscore", "isolation_forest")

# Settings that must not exceed another one, which comes second.
ORDERED = (("missing_warning", "missing_high"), ("duplicate_warning", "duplicate_high"), ("iqr_k", "iqr_extreme_k"), ("correlation_warning", "correlation_high"), ("psi_warning", "psi_high"), ("ks_warning", "ks_high"), ("jsd_warning", "jsd_high"), ("imbalance_high", "imbalance_warning"))
#: Settings that are shares, from 0 to 1; the others but those below are from 0 on.
SHARES = ("missing_warning", "missing_high", "missing_group_min_gap", "missing_cooccurrence_phi", "duplicate_warning", "duplicate_high", "near_constant_ratio", "dominant_category_ratio", "identifier_unique_ratio", "high_cardinality_ratio", "rare_category_ratio", "type_parse_ratio", "zero_inflation_ratio", "value_spike_ratio", "outlier_warning_ratio", "correlation_warning", "correlation_high", "cramers_v_warning", "ks_warning", "ks_high", "jsd_warning", "jsd_high", "temporal_shift_gap", "target_association_warning")
#: Least and most of settings with other bounds.
BOUNDS = {"temporal_min_periods": (4, None), "gap_factor": (1, None), "imbalance_warning": (0, 0.5), "imbalance_high": (0, 0.5), "max_examples": (0, 100), "sample_rows": (1000, None), "max_pairwise_columns": (2, None), "max_group_levels": (2, None)}


def in_bounds(settings: Any) -> None:
    """An error for a number outside of its bounds."""
    for f in fields(settings):
        value = getattr(settings, f.name)
        if isinstance(value, bool) or not isinstance(value, (int, float)) or f.name == "random_state":
            continue
        low, high = BOUNDS.get(f.name, (0, 1 if f.name in SHARES else None))
        if value < low or high is not None and value > high:
            raise ValueError(f"{f.name} must be {f'from {low} to {high}' if high is not None else f'{low} or more'}")


# The thresholds and their defaults.
@dataclass(frozen=True)
class Thresholds:
    missing_warning: float = 0.10
    missing_high: float = 0.50
    missing_group_min_gap: float = 0.20
    missing_cooccurrence_phi: float = 0.5
    duplicate_warning: float = 0.001
    duplicate_high: float = 0.05
    near_constant_ratio: float = 0.99
    dominant_category_ratio: float = 0.95
    identifier_unique_ratio: float = 0.95
    high_cardinality_ratio: float = 0.5
    high_cardinality_min: int = 100
    rare_category_ratio: float = 0.005
    type_parse_ratio: float = 0.95
    skew_warning: float = 2.0
    excess_kurtosis_warning: float = 10.0
    zero_inflation_ratio: float = 0.5
    value_spike_ratio: float = 0.10
    iqr_k: float = 1.5
    iqr_extreme_k: float = 3.0
    zscore: float = 3.0
    modified_zscore: float = 3.5
    isolation_contamination: Any = "auto"
    outlier_warning_ratio: float = 0.05
    correlation_warning: float = 0.90
    correlation_high: float = 0.98
    cramers_v_warning: float = 0.90
    psi_warning: float = 0.10
    psi_high: float = 0.25
    ks_warning: float = 0.10
    ks_high: float = 0.25
    jsd_warning: float = 0.05
    jsd_high: float = 0.15
    temporal_min_periods: int = 8
    temporal_shift_gap: float = 0.15
    volume_change_ratio: float = 0.5
    gap_factor: float = 5.0
    imbalance_warning: float = 0.10
    imbalance_high: float = 0.01
    target_association_warning: float = 0.95

    def __post_init__(self):
        in_bounds(self)
        for a, b in ORDERED:
            if getattr(self, a) > getattr(self, b):
                raise ValueError(f"{a} must not exceed {b}")


@dataclass(frozen=True)
class Privacy:
    include_examples: bool = False
    max_examples: int = 5
    redact_labels: bool = False

    def __post_init__(self):
        in_bounds(self)


@dataclass(frozen=True)
class Performance:
    sample_rows: int = 200_000
    max_pairwise_columns: int = 60
    max_group_levels: int = 50
    random_state: int = 0

    def __post_init__(self):
        in_bounds(self)


@dataclass(frozen=True)
class Config:
    target: str | None = None
    time_column: str | None = None
    id_columns: tuple[str, ...] = ()
    reference_time: str | None = None
    rules: Mapping[str, Rule] = field(default_factory=dict)
    detectors: Mapping[str, bool] = field(default_factory=dict)
    outlier_methods: tuple[str, ...] = ("iqr", "modified_zscore")
    thresholds: Thresholds = field(default_factory=Thresholds)
    privacy: Privacy = field(default_factory=Privacy)
    performance: Performance = field(default_factory=Performance)

    def __post_init__(self):
        for names, known, what in ((self.detectors, DETECTORS, "detector"), (self.outlier_methods, OUTLIER_METHODS, "outlier method")):
            if bad := set(names) - set(known):
                raise ValueError(f"unknown {what}: {', '.join(sorted(bad))}")

    def enabled(self) -> list[str]:
        return [d for d in DETECTORS if self.detectors.get(d, True)]

    def to_dict(self) -> dict:
        return dataclasses.asdict(self) | {"rules": {k: dataclasses.asdict(v) for k, v in self.rules.items()}}


_PARTS = {"thresholds": Thresholds, "privacy": Privacy, "performance": Performance}


def _make(kind, values: Mapping, where: str):
    known = {f.name for f in fields(kind)}
    if bad := set(values) - known:
        raise ValueError(f"unknown key in {where}: {', '.join(sorted(bad))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def build_config(config: Config | Mapping | str | Path | None = None, **overrides) -> Config:
    """A Config from one, from a mapping, or from a YAML or JSON file; overrides win."""
    if isinstance(config, (str, Path)):
        text = Path(config).read_text()
        if str(config).endswith(".json"):
            import json

            config = json.loads(text)
        else:
            import yaml

            config = yaml.safe_load(text) or {}
    if isinstance(config, Config):
        values = {f.name: getattr(config, f.name) for f in fields(Config)}
    else:
        values = dict(config or {})
    values |= {k: v for k, v in overrides.items() if v is not None}
    for k, kind in _PARTS.items():
        if isinstance(values.get(k), Mapping):
            values[k] = _make(kind, values[k], k)
    if "rules" in values:
        values["rules"] = {c: r if isinstance(r, Rule) else _make(Rule, r, f"rules.{c}") for c, r in (values["rules"] or {}).items()}
    if isinstance(values.get("reference_time"), (dt.datetime, dt.date)):
        values["reference_time"] = str(values["reference_time"])
    return _make(Config, values, "config")
