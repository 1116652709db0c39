"""Correlation, redundancy and the target."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..context import Context
from ..findings import Finding
from ..operators import aggregates as A
from ..functions import small as S
from . import detector, finding, pct

#: Complete rows on which a formula is guessed, complete rows in the sample that suffice for it.
SCREEN, ENOUGH = 5_000, 1_000


def selected(x: Context) -> tuple[list[str], list[str]]:
    most = x.config.performance.max_pairwise_columns
    nums = [n for n in x.numeric_like() if x.schema[n].n_unique > 1][:most]
    cats = [n for n in x.of_type("categorical", "boolean") if n not in nums and 2 <= x.schema[n].n_unique <= 4 * x.config.performance.max_group_levels][:most]
    return nums, cats


@detector("correlation")
def correlation(x: Context) -> list[Finding]:
    t, out = x.t, []
    f = lambda *a, **k: out.append(finding("correlation", *a, **k))
    nums, cats = selected(x)
    frame = x.frame
    strong: dict[tuple[str, str], tuple[float, float]] = {}
    for a, b in combinations(nums, 2):
        r, rho = S.pearson(frame[a], frame[b]), S.spearman(frame[a], frame[b])
        strong[a, b] = (r or 0.0, rho or 0.0)
        v = max(abs(r or 0.0), abs(rho or 0.0))
        if t.correlation_warning <= v and abs(r or 0.0) < 0.9999:
            f("correlation.numeric", "relationships", "warning" if v >= t.correlation_high else "info", "Correlated columns", f"{a} and {b} are correlated (r {r or 0:.3f}, rank {rho or 0:.3f}).", [a, b], evidence={"pearson": r, "spearman": rho}, rule=f"|r| >= {t.correlation_warning}")
    if len(nums) >= 2:
        x.sections["correlation"] = {"columns": nums, "pearson": {f"{a}|{b}": round(r, 4) for (a, b), (r, _) in strong.items()}, "spearman": {f"{a}|{b}": round(r, 4) for (a, b), (_, r) in strong.items()}, "sampled_rows": len(frame)}
    for a, b in combinations(cats, 2):
        v = S.cramers_v(frame[a], frame[b])
        if v >= t.cramers_v_warning:
            f("correlation.categorical", "relationships", "info", "Associated labels", f"{a} and {b} are associated (V {v:.3f}).", [a, b], evidence={"cramers_v": v})
    for a in cats:
        for b in nums:
            if x.schema[b].semantic_type != "numeric":
                continue
            v = S.correlation_ratio(frame[a], frame[b])
            if v >= t.correlation_high:
                f("correlation.mixed", "relationships", "info", "Labels fix a number", f"{a} nearly determines {b} (eta {v:.3f}).", [a, b], evidence={"eta": v})
    deep = [n for n in nums[:30] if x.schema[n].semantic_type == "numeric"]
    few = frame.head(50_000)
    for a, b in combinations(deep, 2):
        if abs(strong[a, b][1]) < 0.5:
            v = S.mutual_information(few[a], few[b])
            if v >= 0.5:
                f("correlation.nonlinear", "relationships", "info", "Non-linear relation", f"{a} and {b} depend on each other without being correlated.", [a, b], evidence={"nmi": v, "spearman": strong[a, b][1]})
    return out


def _close(left: Column, right: Column) -> Column:
    size = F.greatest(F.abs(left), F.abs(right))
    return F.abs(left - right) <= 1e-6 * F.when(size == 0, 1.0).otherwise(size) + 1e-9


def _complete(x: Context, groups: list[tuple[str, ...]]) -> Iterator[tuple[tuple[str, ...], np.ndarray]]:
    """Complete rows of groups of columns on all rows: at most SCREEN of each, those with the lowest hashes of their places."""
    d = x.df.withColumn("__h", F.xxhash64(F.monotonically_increasing_id(), F.lit(x.config.performance.random_state)))
    for at in range(0, len(groups), 4 * A.CHUNK):
        part = groups[at : at + 4 * A.CHUNK]
        parts = [F.struct(F.lit(i).alias("g"), F.array(*[x.value(n) for n in g]).alias("v")) for i, g in enumerate(part)]
        rows = d.select("__h", F.inline(F.array(*parts))).where(F.forall("v", lambda e: e.isNotNull()))
        first = rows.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("__h"))).where(f"k <= {SCREEN}")
        got: list[list] = [[] for _ in part]
        for r in first.select("g", "v").collect():
            got[r.g].append(r.v)
        for g, v in zip(part, got, strict=True):
            yield g, np.array(v, float).reshape(-1, len(g)).T


def _screens(x: Context, nums: list[str], groups: list[tuple[str, ...]]) -> Iterator[tuple[tuple[str, ...], np.ndarray, bool]]:
    """Of each group of columns: complete rows, spread over the table; and whether the columns agree in all complete rows of the sample.

    A group with few complete rows in the sample of a larger table gets its rows from the whole table.
    """
    order = np.random.default_rng(x.config.performance.random_state).permutation(len(x.frame))
    v = {n: x.frame[n].to_numpy()[order] for n in nums}
    there = {n: np.isfinite(v[n]) for n in nums}
    few = []
    for g in groups:
        at = np.flatnonzero(np.logical_and.reduce([there[n] for n in g]))
        if x.sampled and len(at) < ENOUGH:
            few.append(g)
        elif len(at) >= 20:
            rows = np.stack([v[n][at[:SCREEN]] for n in g])
            yield g, rows, len(g) == 2 and np.array_equal(rows[0], rows[1]) and np.array_equal(v[g[0]][at], v[g[1]][at])
    for g, rows in _complete(x, few):
        if rows.shape[1] >= 20:
            yield g, rows, len(g) == 2 and np.array_equal(rows[0], rows[1])


@detector("redundancy")
def redundancy(x: Context) -> list[Finding]:
    """Formulas are guessed on at most SCREEN complete rows for each group of columns and checked on all rows, together.

    Columns that differ in a row of the sample aren't equal, so no equal pair is lost.
    """
    out = []
    f = lambda *a, **k: out.append(finding("redundancy", *a, **k))
    nums = [n for n in x.numeric_like() if x.schema[n].n_unique > 2][:40]
    tests: list[tuple[str, tuple[str, ...], dict, Column, Column]] = []
    if nums and x.n >= 20:
        for (a, b), (u, w), same in _screens(x, nums, list(combinations(nums, 2))):
            if same:
                tests.append(("identical", (a, b), {}, x.value(a), x.value(b)))
            if u.std() == 0 or w.std() == 0:
                continue
            ranks = S.spearman(pd.Series(u), pd.Series(w)) or 0.0
            if abs(ranks) >= 0.95:
                slope, base = (1.0, 0.0) if same else _line(u, w)
                if (np.abs(w - slope * u - base) <= 1e-6 * np.maximum(np.abs(w), 1e-9) + 1e-9).mean() >= 0.9:
                    tests.append(("linear", (a, b), {"slope": slope, "intercept": base}, x.value(a) * slope + base, x.value(b)))
        for g, rows, _ in _screens(x, nums[:25], list(combinations(nums[:25], 3))):
            for k, z in enumerate(g):
                i, j = (m for m in range(3) if m != k)
                close = np.abs(rows[i] + rows[j] - rows[k]) <= 1e-6 * np.maximum(np.abs(rows[k]), 1e-9) + 1e-9
                if close.mean() >= 0.9 and rows[i].std() > 0 and rows[j].std() > 0:
                    tests.append(("sum", (z, g[i], g[j]), {}, x.value(g[i]) + x.value(g[j]), x.value(z)))
    tests.sort(key=lambda t: (t[0] == "sum", [nums.index(n) for n in t[1]], t[0]))
    done: set[frozenset[str]] = set()
    for at in range(0, len(tests), A.CHUNK):
        part = tests[at : at + A.CHUNK]
        row = x.df.agg(*[F.struct(F.count(F.when(p.isNotNull() & q.isNotNull(), 1)).alias("n"), F.count(F.when(p == q if kind == "identical" else _close(p, q), 1)).alias("k")).alias(f"t{i}") for i, (kind, *_, p, q) in enumerate(part)]).head()
        for i, (kind, cols, how, _, _) in enumerate(part):
            n, k = row[f"t{i}"].n, row[f"t{i}"].k
            if n < 20 or frozenset(cols) in done:
                continue
            share = k / n
            evidence = how | {"rows": n, "holds": k, "share": share}
            if kind == "identical":
                if k < n:
                    continue
                f("redundancy.identical", "relationships", "warning", "Equal columns", f"{cols[0]} and {cols[1]} are equal.", cols, evidence=evidence, suggestion="Keep one of them.")
            elif share < 0.95:
                continue
            elif kind == "linear":
                broken = share < 0.999
                f("redundancy.linear_broken" if broken else "redundancy.linear", "relationships", "warning", "Broken formula" if broken else "Linear copy", f"{cols[1]} = {how['slope']:g} * {cols[0]} + {how['intercept']:g} in {pct(share)} of the rows.", cols, evidence=evidence, suggestion="Look at the rows that break it." if broken else "Keep one of them.")
            else:
                broken = share < 0.999
                f("redundancy.sum_broken" if broken else "redundancy.sum", "relationships", "warning" if broken else "info", "Broken sum" if broken else "Sum of columns", f"{cols[0]} = {cols[1]} + {cols[2]} in {pct(share)} of the rows.", cols, evidence=evidence)
            done.add(frozenset(cols))
    cats = [n for n in x.of_type("categorical", "identifier", "boolean", "numeric") if 3 <= x.schema[n].n_unique <= 10_000][:30]
    for a, b in combinations(cats, 2):
        if x.schema[a].n_unique != x.schema[b].n_unique or "categorical" not in (x.schema[a].semantic_type, x.schema[b].semantic_type):
            continue
        r = A.one_to_one(x.df, x.col[a], x.col[b]).head()
        if r.one_to_one and r.n_a >= 3 and r.n_a < x.n:
            f("redundancy.one_to_one", "relationships", "info", "One to one", f"{a} and {b} determine each other.", [a, b], evidence={"levels": r.n_a})
    return out


def _line(u, w) -> tuple[float, float]:
    """A line through most points: least squares three times on the nearest nine tenths, figures to six digits."""
    keep = np.ones(len(u), bool)
    for _ in range(3):
        slope, base = np.polyfit(u[keep], w[keep], 1)
        rest = np.abs(w - slope * u - base)
        keep = rest <= np.quantile(rest, 0.9)
    slope = float(f"{slope:.6g}")
    base = float(np.median(w[keep] - slope * u[keep]))
    return slope, float(f"{base:.6g}") if abs(base) > 1e-6 * max(1.0, float(np.abs(w).max())) else 0.0


def task_of(x: Context, n: str) -> str:
    c = x.schema[n]
    if c.semantic_type in ("boolean", "categorical", "constant"):
        return "classification"
    if c.semantic_type == "numeric":
        return "classification" if c.n_unique <= 20 and x.numbers[n]["integer_valued"] else "regression"
    return "classification" if c.n_unique <= 50 else "regression"


@detector("target")
def target(x: Context) -> list[Finding]:
    t, out, n = x.t, [], x.config.target
    f = lambda *a, **k: out.append(finding("target", *a, **k))
    if not n or n not in x.schema or not x.n:
        return out
    c = x.schema[n]
    if c.n_missing:
        severity = "critical" if not c.n_present else "high" if c.missing_ratio >= t.missing_warning else "warning"
        f("target.missing", "target", severity, "Target is missing", f"{pct(c.missing_ratio)} of the rows have no target.", [n], evidence={"rows": c.n_missing})
    if not c.n_present:
        return out
    task = task_of(x, n)
    x.sections["target"] = {"task": task}
    labels = x.labels[n]
    if task == "classification":
        x.sections["target"]["classes"] = {x.shown(v): k for v, k in labels}
        if c.n_unique < 2:
            f("target.single_class", "target", "critical", "One class", f"{n} has a single class.", [n])
            return out
        least = min(k for _, k in labels) / c.n_present
        if least < t.imbalance_warning:
            f("target.imbalance", "target", "high" if least < t.imbalance_high else "warning", "Rare class", f"The rarest class of {n} makes {pct(least)}.", [n], evidence={"share": least}, rule=f"share < {t.imbalance_warning}")
        tiny = [v for v, k in labels if k < 10]
        if c.n_unique > 2 and tiny:
            f("target.tiny_classes", "target", "warning", "Tiny classes", f"{len(tiny)} classes of {n} have fewer than ten rows.", [n], evidence={"classes": [x.shown(v) for v in tiny[:10]]})
    scores: dict[str, float] = {}
    flags: dict[str, float] = {}
    frame = x.frame[x.frame[n].notna()]
    half = S.halves(len(frame), x.config.performance.random_state)
    text = frame[n].astype(str) if frame[n].dtype != float else frame[n].map(lambda v: f"{v:g}")
    classes = text.value_counts().index[:10].tolist() if task == "classification" else []
    goals = [(text == c).to_numpy(float) for c in (classes[:1] if len(classes) == 2 else classes)]
    for m in x.names:
        k = x.schema[m]
        if m == n or m not in frame or k.semantic_type in ("unknown", "constant", "text", "datetime"):
            continue
        level = S.levels(frame[m])
        if task == "classification":
            got = [max(a, 1 - a) for g in goals if (a := S.holdout_auc(level, g, half)) is not None]
            if got:
                scores[m] = sum(got) / len(got)
            if k.n_missing >= 20 and k.n_present >= 20 and goals:
                a = S.holdout_auc(frame[m].isna().to_numpy(int), goals[0], half)
                if a is not None:
                    flags[m] = max(a, 1 - a)
        else:
            scores[m] = S.holdout_r2(level, frame[n].to_numpy(float), half)
    x.sections["target"]["scores"] = dict(sorted(scores.items(), key=lambda i: (-i[1], i[0]))[:30])
    for m, v in scores.items():
        if v >= t.target_association_warning:
            f("target.suspicious_feature", "target", "high", "A feature that knows the target", f"{m} alone predicts {n} (score {v:.3f}).", [m, n], evidence={"score": v}, confidence=0.5, interpretation="It may be known only after the target.", rule=f"score >= {t.target_association_warning}")
        elif v >= 0.7 and x.schema[m].semantic_type == "identifier":
            f("target.identifier_predictive", "target", "warning", "Identifier predicts the target", f"{m} predicts {n} (score {v:.3f}).", [m, n], evidence={"score": v})
    for m, v in flags.items():
        if v >= 0.75:
            f("target.missingness_predictive", "target", "warning", "Missing values predict the target", f"Whether {m} is missing predicts {n} (score {v:.3f}).", [m, n], evidence={"score": v})
    return out
