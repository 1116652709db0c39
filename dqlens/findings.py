"""Findings: what was measured, kept apart from what it may mean."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Severities from the least to the most, and the categories in their order.
SEVERITIES = ("info", "warning", "high", "critical")
CATEGORIES = ("schema", "missingness", "duplicates", "structure", "types", "rules", "numeric", "categorical", "temporal", "relationships", "target", "drift", "pipeline")

SCHEMA = "id string, detector string, code string, category string, severity string, severity_rank int, title string, observation string, columns array<string>, evidence string, interpretation string, suggestion string, confidence double, rule string"


def to_jsonable(x: Any) -> Any:
    if isinstance(x, dict):
        return {str(k): to_jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [to_jsonable(v) for v in x]
    if isinstance(x, bool) or x is None or isinstance(x, (int, str)):
        return x
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, (dt.datetime, dt.date)):
        return x.isoformat()
    return str(x)


@dataclass(frozen=True)
class Finding:
    detector: str
    code: str
    category: str
    severity: str
    title: str
    observation: str
    columns: tuple[str, ...] = ()
    evidence: dict = field(default_factory=dict)
    interpretation: str = ""
    suggestion: str = ""
    confidence: float | None = None
    rule: str = ""

    def __post_init__(self):
        if self.severity not in SEVERITIES:
            raise ValueError(f"unknown severity {self.severity}")
        if self.confidence is not None and not 0 <= self.confidence <= 1:
            raise ValueError("confidence must be between 0 and 1")
        object.__setattr__(self, "evidence", to_jsonable(self.evidence))
        object.__setattr__(self, "columns", tuple(self.columns))

    @property
    def id(self) -> str:
        return hashlib.sha1("|".join([self.detector, self.code, *self.columns]).encode()).hexdigest()[:12]

    @property
    def rank(self) -> int:
        return SEVERITIES.index(self.severity)

    def to_dict(self) -> dict:
        return {"id": self.id, "detector": self.detector, "code": self.code, "category": self.category, "severity": self.severity, "title": self.title, "observation": self.observation, "columns": list(self.columns), "evidence": self.evidence, "interpretation": self.interpretation, "suggestion": self.suggestion, "confidence": self.confidence, "rule": self.rule}


def ordered(findings: Iterable[Finding]) -> list[Finding]:
    place = {c: i for i, c in enumerate(CATEGORIES)}
    return sorted(findings, key=lambda f: (-f.rank, place.get(f.category, 99), f.columns[:1], f.code, f.columns))


def findings_frame(spark: SparkSession, findings: Sequence[Finding]) -> DataFrame:
    """The findings as rows of one fixed schema."""
    rows = [(f.id, f.detector, f.code, f.category, f.severity, f.rank, f.title, f.observation, list(f.columns), json.dumps(f.evidence, sort_keys=True), f.interpretation, f.suggestion, f.confidence, f.rule) for f in findings]
    return spark.createDataFrame(rows, SCHEMA)


@dataclass
class Report:
    kind: str
    dataset: dict
    findings: list[Finding]
    schema: dict
    profiles: dict = field(default_factory=dict)
    sections: dict = field(default_factory=dict)
    runs: list[dict] = field(default_factory=list)
    config: dict = field(default_factory=dict)
    time_column: str | None = None
    target: str | None = None
    runtime_seconds: float = 0.0

    def filter(self, severity: str | None = None, min_severity: str | None = None, category: str | None = None, column: str | None = None, detector: str | None = None) -> list[Finding]:
        low = SEVERITIES.index(min_severity) if min_severity else 0
        return [f for f in self.findings if (severity is None or f.severity == severity) and f.rank >= low and (category is None or f.category == category) and (column is None or column in f.columns) and (detector is None or f.detector == detector)]

    def summary(self) -> dict:
        return {"total": len(self.findings), "by_severity": {s: sum(f.severity == s for f in self.findings) for s in SEVERITIES}, "by_category": {c: n for c in CATEGORIES if (n := sum(f.category == c for f in self.findings))}}

    def recommendations(self) -> list[dict]:
        seen: dict[tuple[str, str], dict] = {}
        for f in self.filter(min_severity="warning"):
            if f.suggestion:
                entry = seen.setdefault((f.code, f.suggestion), {"code": f.code, "severity": f.severity, "suggestion": f.suggestion, "columns": []})
                entry["columns"] += [c for c in f.columns if c not in entry["columns"]]
        return list(seen.values())

    def to_dict(self) -> dict:
        return to_jsonable({"kind": self.kind, "dataset": self.dataset, "time_column": self.time_column, "target": self.target, "schema": self.schema, "findings": [f.to_dict() for f in self.findings], "profiles": self.profiles, "sections": self.sections, "runs": self.runs, "config": self.config, "summary": self.summary(), "recommendations": self.recommendations(), "runtime_seconds": self.runtime_seconds})

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Report:
        d = json.loads(text)
        found = [Finding(**{k: v for k, v in f.items() if k != "id"}) for f in d["findings"]]
        return cls(d["kind"], d["dataset"], found, d["schema"], d["profiles"], d["sections"], d["runs"], d["config"], d["time_column"], d["target"], d["runtime_seconds"])

    def frame(self, spark: SparkSession) -> DataFrame:
        return findings_frame(spark, self.findings)

    def save(self, path: str, format: str | None = None) -> None:
        from .report.render import to_html, to_markdown

        kind = format or str(path).rsplit(".", 1)[-1].lower()
        make = {"json": Report.to_json, "md": to_markdown, "markdown": to_markdown, "html": to_html, "htm": to_html}
        if kind not in make:
            raise ValueError(f"unknown report format {kind!r}")
        with open(path, "w", encoding="utf-8") as f:
            f.write(make[kind](self))
