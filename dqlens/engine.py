"""inspect() and compare(): from a source to a report."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import detectors as registry
from .config import Config, build_config
from .context import Context, at_once
from .detectors import finding, pct, tiered
from .findings import Finding, Report, ordered
from .functions import columns as C
from .operators import aggregates as A
from .operators import drift as D
from .sources.load import load


def _resolve(config: Config, names: Sequence[str] | None) -> list[tuple[str, Callable]]:
    for n in names or ():
        if n not in registry.REGISTRY:
            raise ValueError(f"unknown detector {n!r}")
    return [(n, registry.REGISTRY[n]) for n in config.enabled() if names is None or n in names]


def _run(x: Context, name: str, run: Callable) -> tuple[list[Finding], dict]:
    """A detector's findings and the record of its run; a failure is reported, not raised."""
    start, error = time.time(), None
    try:
        got = list(run(x))
        n = len(got)
    except Exception as e:
        error, n = f"{type(e).__name__}: {e}"[:500], 0
        got = [finding(name, "dqlens.detector_error", "pipeline", "info", "A detector failed", f"{name} failed: {error}", evidence={"error": error})]
    return got, {"detector": name, "seconds": round(time.time() - start, 4), "findings": n, "error": error}


def inspect(source: Any, *, spark: SparkSession | None = None, config: Any = None, name: str | None = None, nrows: int | None = None, detectors: Sequence[str] | None = None, extra_detectors: Iterable[Any] = (), **overrides) -> Report:
    """Runs the detectors over a table and reports what they found. A detector that fails becomes a finding; the others go on."""
    began, cfg = time.time(), build_config(config, **overrides)
    data = load(source, spark=spark, name=name, nrows=nrows)
    now = cfg.reference_time or dt.datetime.now(dt.UTC).replace(tzinfo=None).isoformat(sep=" ")
    x = Context(data.df, cfg, data.name, now)
    found: list[Finding] = []
    runs = []
    try:
        x.schema  # noqa: B018
        own = _resolve(cfg, detectors)
        # detectors share passes but not results, so they run at once; those of the caller follow one by one
        results = at_once(data.df.sparkSession, [lambda n=n, run=run: _run(x, n, run) for n, run in own])
        results += [_run(x, e.name, e.analyze) for e in extra_detectors]
        for got, outcome in results:
            found += got
            runs.append(outcome)
        x.profiles = {n: dict(sorted(p.items())) for n, p in x.profiles.items()}
        x.sections = dict(sorted(x.sections.items()))
        schema = {n: c.to_dict() for n, c in x.schema.items()}
        for n, c in schema.items():
            x.profiles[n]["schema"] = c
        info = {"name": data.name, "rows": x.n, "columns": len(x.names), "sampled": x.sampled, "source": data.source}
        return Report("inspection", info, ordered(found), schema, x.profiles, x.sections, runs, cfg.to_dict(), x.time_column, cfg.target, round(time.time() - began, 3))
    finally:
        x.close()


investigate = inspect


def inspect_schema(source: Any, *, spark: SparkSession | None = None, config: Any = None, **overrides) -> dict[str, dict]:
    x = Context(load(source, spark=spark).df, build_config(config, **overrides))
    try:
        return {n: c.to_dict() for n, c in x.schema.items()}
    finally:
        x.close()


def compare(reference: Any, current: Any, *, spark: SparkSession | None = None, config: Any = None, **overrides) -> Report:
    """What changed from a reference table to a current one."""
    began, cfg = time.time(), build_config(config, **overrides)
    ref, cur = load(reference, spark=spark, name="reference"), load(current, spark=spark, name="current")
    a, b = Context(ref.df, cfg, ref.name, cfg.reference_time or "9999-12-31"), Context(cur.df, cfg, cur.name, cfg.reference_time or "9999-12-31")
    try:
        found, rows = _drift(a, b, cfg)
        sections: dict[str, Any] = {"drift": rows}
        if cfg.target and cfg.target in a.names and cfg.target in b.names:
            t = D.label_counts(a.df.select(F.col(a.col[cfg.target]).alias("v")), b.df.select(F.col(b.col[cfg.target]).alias("v")), "v")
            sections["target_drift"] = {r.label: {"reference": r.r, "current": r.c} for r in t.orderBy(F.desc(F.col("r") + F.col("c")), "label").limit(50).collect()}
        info = {"name": b.name, "rows": b.n, "columns": len(b.names), "reference": a.name, "reference_rows": a.n}
        return Report("comparison", info, ordered(found), {n: c.to_dict() for n, c in b.schema.items()}, {}, sections, [{"detector": "drift", "seconds": round(time.time() - began, 4), "findings": len(found), "error": None}], cfg.to_dict(), None, cfg.target, round(time.time() - began, 3))
    finally:
        a.close()
        b.close()


inspect_train_test = compare


def _drift(a: Context, b: Context, cfg: Config) -> tuple[list[Finding], list[dict]]:
    t, out, table = cfg.thresholds, [], []
    f = lambda *p, **k: out.append(finding("drift", *p, **k))
    gone, new = [n for n in a.names if n not in b.names], [n for n in b.names if n not in a.names]
    if gone:
        f("drift.columns_missing", "drift", "high", "Columns are gone", f"{len(gone)} columns of the reference are absent.", gone)
    if new:
        f("drift.columns_added", "drift", "warning", "New columns", f"{len(new)} columns aren't in the reference.", new)
    usable = []
    for n in (n for n in a.names if n in b.names):
        p, q = a.schema[n], b.schema[n]
        row: dict[str, Any] = {"column": n, "kind": None, "severity": None}
        if p.semantic_type != q.semantic_type and "unknown" not in (p.semantic_type, q.semantic_type):
            f("drift.type_changed", "drift", "high", "Type changed", f"{n} was {p.semantic_type} and is {q.semantic_type}.", [n], evidence={"reference": p.semantic_type, "current": q.semantic_type})
        gap = q.missing_ratio - p.missing_ratio
        row |= {"missing_reference": p.missing_ratio, "missing_current": q.missing_ratio}
        if abs(gap) >= t.temporal_shift_gap:
            f("drift.missingness", "drift", "warning", "Missing share changed", f"{n} misses {pct(q.missing_ratio)} instead of {pct(p.missing_ratio)}.", [n], evidence={"reference": p.missing_ratio, "current": q.missing_ratio})
        table.append(row)
        numeric = [x.schema[n].semantic_type == "numeric" for x in (a, b)]
        left, right = a.df.select(a.value(n).alias("v") if numeric[0] else F.col(a.col[n]).alias("v")), b.df.select(b.value(n).alias("v") if numeric[1] else F.col(b.col[n]).alias("v"))
        if all(numeric):
            row["kind"] = "numeric"
            if p.n_present < 2 or q.n_present < 2:
                continue
            usable.append(n)
            d, psi, off = D.ks_wasserstein(left, right, "v").head(), D.numeric_psi(left, right, "v").head().psi, D.out_of_range(left, right, "v").head()
            row |= {"ks": d.ks, "wasserstein": d.wasserstein_scaled, "psi": psi, "outside": off.n_outside / off.n if off.n else 0.0}
            worst = max((tiered(d.ks, [(t.ks_high, "high"), (t.ks_warning, "warning")], "info"), tiered(psi, [(t.psi_high, "high"), (t.psi_warning, "warning")], "info")), key=("info", "warning", "high").index)
            row["severity"] = worst
            if worst != "info":
                f("drift.numeric", "drift", worst, "Numbers drift", f"{n} is distributed differently (KS {d.ks:.3f}, PSI {psi:.3f}).", [n], evidence=dict(row), rule=f"KS >= {t.ks_warning} or PSI >= {t.psi_warning}")
            if row["outside"] >= 0.01:
                f("drift.out_of_range", "drift", "warning", "Values outside the known range", f"{pct(row['outside'])} of {n} lie outside the reference's range.", [n], evidence={"share": row["outside"]})
        elif all(x.schema[n].semantic_type in ("categorical", "boolean", "constant") for x in (a, b)):
            row["kind"] = "categorical"
            if not p.n_present or not q.n_present:
                continue
            usable.append(n)
            d = D.categorical_drift(left, right, "v").head()
            row |= {"jsd": d.jsd, "psi": d.psi, "unseen": d.unseen_share}
            worst = max((tiered(d.jsd, [(t.jsd_high, "high"), (t.jsd_warning, "warning")], "info"), tiered(d.psi, [(t.psi_high, "high"), (t.psi_warning, "warning")], "info")), key=("info", "warning", "high").index)
            row["severity"] = worst
            if worst != "info":
                f("drift.categorical", "drift", worst, "Labels drift", f"{n} has other shares of labels (JSD {d.jsd:.3f}, PSI {d.psi:.3f}).", [n], evidence=dict(row))
            if d.unseen_share >= 0.001:
                f("drift.unseen_categories", "drift", "warning", "Unseen labels", f"{d.n_unseen} labels of {n} ({pct(d.unseen_share)} of the rows) aren't in the reference.", [n], evidence={"labels": d.n_unseen, "share": d.unseen_share})
    auc = domain_auc(a, b, usable)
    if auc is not None and auc >= 0.6:
        f("drift.domain_classifier", "drift", "high" if auc >= 0.8 else "warning", "Tables can be told apart", f"A model tells the tables apart with an AUC of {auc:.3f}.", usable, evidence={"auc": auc})
    return out, table


def domain_auc(a: Context, b: Context, names: list[str], rows: int = 20_000, folds: int = 3) -> float | None:
    """How well trees tell the sides apart, on samples of both, over held-out folds."""
    if not names or min(a.n, b.n) < 50:
        return None
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    levels = {n: {v: i for i, (v, _) in enumerate(sorted(a.labels[n][:50]))} for n in names if a.schema[n].semantic_type != "numeric"}

    def side(x: Context, label: float) -> DataFrame:
        cols = []
        for i, n in enumerate(names):
            if n in levels:
                v, e = F.col(x.col[n]).cast("string"), F.lit(-1.0)
                for text, k in levels[n].items():
                    e = F.when(v == text, float(k)).otherwise(e)
                cols.append(e.alias(f"f{i}"))
            else:
                cols.append(F.coalesce(x.value(n), F.lit(-1e9)).alias(f"f{i}"))
        part = A.spread(x.df.select(*cols, F.lit(label).alias("label")), rows, x.n)
        return part.withColumn("fold", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(folds)).cast("int"))

    d = VectorAssembler(inputCols=[f"f{i}" for i in range(len(names))], outputCol="features").transform(side(a, 0.0).unionByName(side(b, 1.0))).select("features", "label", "fold").persist()
    try:
        ev, got = BinaryClassificationEvaluator(), []
        for k in range(folds):
            model = GBTClassifier(maxIter=10, maxDepth=4, seed=0).fit(d.where(F.col("fold") != k))
            got.append(ev.evaluate(model.transform(d.where(F.col("fold") == k))))
        return sum(got) / folds
    finally:
        d.unpersist()
