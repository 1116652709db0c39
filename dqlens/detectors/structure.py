"""Schema, missing values, duplicates, constants, identifiers and rules."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import functions as F

from ..context import Context
from ..findings import Finding
from ..functions import columns as C
from ..functions import small as S
from ..operators import aggregates as A
from ..operators import rules as R
from ..operators import temporal as TM
from . import detector, finding, pct, tiered

EXPORTED = re.compile(r"^(Unnamed: ?\d+|index|level_\d+)$")


@detector("schema")
def schema(x: Context) -> list[Finding]:
    out, f = [], lambda *a, **k: out.append(finding("schema", *a, **k))
    if x.n == 0:
        f("schema.empty", "schema", "critical", "Empty table", "The table has no rows.")
    twice = sorted({n for n in x.original if x.original.count(n) > 1})
    if twice:
        f("schema.duplicate_name", "schema", "warning", "Repeated column names", f"{len(twice)} names occur more than once.", twice, suggestion="Give every column a name of its own.")
    for n in x.names:
        if n.strip() == "":
            f("schema.blank_name", "schema", "warning", "Blank column name", "A column has no name.", [n])
        elif n != n.strip():
            f("schema.name_whitespace", "schema", "info", "White space around a name", f"{n!r} has white space at its ends.", [n])
        if EXPORTED.match(n):
            f("schema.exported_index", "schema", "info", "Exported index", f"{n} looks like a written index.", [n], suggestion="Write without an index.")
    same: dict[str, list[str]] = {}
    for n in dict.fromkeys(x.original):
        same.setdefault(n.strip().lower(), []).append(n)
    for group in same.values():
        if len(group) > 1:
            f("schema.name_collision", "schema", "warning", "Colliding names", f"{', '.join(map(repr, group))} differ in case or white space only.", group)
    c = x.config
    wanted = {n: "time column" for n in [c.time_column] if n} | {n: "id column" for n in c.id_columns} | {n: "rule" for n in c.rules} | {n: "target" for n in [c.target] if n}
    for n, what in wanted.items():
        if n not in x.names:
            f("schema.config_column_missing", "schema", "critical" if what == "target" else "warning", "Configured column is absent", f"The {what} {n!r} isn't in the table.", [n])
    return out


@detector("missingness")
def missingness(x: Context) -> list[Finding]:
    t, out = x.t, []
    f = lambda *a, **k: out.append(finding("missingness", *a, **k))
    if not x.n:
        return out
    ratio = {n: x.missing[n] / x.n for n in x.names}
    x.sections["missingness"] = {"columns": {n: {"count": x.missing[n], "ratio": ratio[n]} for n in x.names}, "cells": sum(x.missing[n] for n in x.names) / (x.n * max(1, len(x.names)))}
    low = [n for n in x.names if 0 < ratio[n] < t.missing_warning]
    if low:
        f("missing.low", "missingness", "info", "Some missing values", f"{len(low)} columns miss up to {pct(max(ratio[n] for n in low))} of their values.", low, evidence={n: ratio[n] for n in low}, rule=f"0 < ratio < {t.missing_warning}")
    for n in x.names:
        if ratio[n] == 1:
            f("missing.complete", "missingness", "high", "Column without values", f"{n} has no values.", [n], evidence={"rows": x.n}, suggestion="Drop the column or repair its source.")
        elif ratio[n] >= t.missing_warning:
            f("missing.high", "missingness", tiered(ratio[n], [(t.missing_high, "high")], "warning"), "Many missing values", f"{n} misses {pct(ratio[n])} of its values.", [n], evidence={"missing": x.missing[n], "ratio": ratio[n]}, rule=f"ratio >= {t.missing_warning}", suggestion="Find out why values are missing before they are filled in.")
    some = [n for n in x.names if x.missing[n]]
    if len(x.names) >= 2 and some:
        k = sum((C.is_missing(x.df, x.col[n]).cast("int") for n in some), F.lit(0))
        row = x.df.agg(F.count(F.when(k == len(x.names), 1)).alias("empty"), F.count(F.when(k >= 0.5 * len(x.names), 1)).alias("sparse")).head()
        sparse = row.sparse >= 0.01 * x.n and row.sparse > 0
        where = x.rows_where(({"empty": (k == len(x.names), None)} if row.empty else {}) | ({"sparse": (k >= 0.5 * len(x.names), None)} if sparse else {}))
        if row.empty:
            f("missing.empty_rows", "missingness", "warning", "Empty rows", f"{row.empty} rows have no values at all.", evidence={"rows": row.empty} | where["empty"], suggestion="Drop these rows.")
        if sparse:
            f("missing.sparse_rows", "missingness", "info", "Sparse rows", f"{pct(row.sparse / x.n)} of the rows miss half of their values or more.", evidence={"rows": row.sparse} | where["sparse"])
    gaps = [n for n in some if x.missing[n] >= 10 and ratio[n] < 1]
    if not gaps:
        return out
    # by group: one job for each group column
    best: dict[str, tuple] = {}
    for g in x.of_type("categorical", "boolean"):
        if not 2 <= x.schema[g].n_unique <= x.config.performance.max_group_levels:
            continue
        levels = F.coalesce(F.col(x.col[g]).cast("string"), F.lit("<missing>")).alias("level")
        cols = [n for n in gaps if n != g]
        rows = x.df.groupBy(levels).agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(C.is_missing(x.df, x.col[n]), 1)).alias(x.col[n]) for n in cols]).collect()  # at most max_group_levels + 1 rows
        for n in cols:
            least, total = max(10, 0.01 * x.n), sum(r[x.col[n]] for r in rows)
            gap, where = max(((abs(r[x.col[n]] / r.n - (total - r[x.col[n]]) / max(1, x.n - r.n)), r.level) for r in rows if r.n >= least and r.n < x.n), default=(0, None))
            if gap >= t.missing_group_min_gap:
                v = cramers_from([(r.n - r[x.col[n]], r[x.col[n]]) for r in rows])
                if n not in best or v > best[n][0]:
                    best[n] = (v, g, where, gap, {str(r.level): r[x.col[n]] / r.n for r in rows})
    for n, (v, g, where, gap, rates) in best.items():
        f("missing.by_group", "missingness", "warning", "Missing values depend on a group", f"{n} is missing more or less often by {pct(gap)} points where {g} is {x.shown(where)}.", [n, g], evidence={"cramers_v": v, "gap": gap, "rates": {x.shown(k): r for k, r in rates.items()}}, confidence=min(0.9, 0.5 + v / 2), interpretation="Values may not be missing at random.", rule=f"gap >= {t.missing_group_min_gap}")
    # over time
    for n in gaps if x.bins else ():
        series = [b.get(f"m_{x.col[n]}") if b["n"] >= 5 else None for b in x.bins]
        found = TM.strongest_change(series)
        if found and abs(found[1]["shift"]) >= t.temporal_shift_gap:
            at, c = found
            f("missing.over_time", "missingness", "warning", "Missing values change over time", f"The missing share of {n} goes from {pct(c['before'])} to {pct(c['after'])} at {x.bins[at]['period']:%Y-%m-%d}.", [n, x.time_column], evidence={"period": x.bins[at]["period"], "before": c["before"], "after": c["after"], "statistic": c["statistic"]}, confidence=TM.change_confidence(c, len(x.bins)), rule=f"shift >= {t.temporal_shift_gap}")
    # related to a number: the gap of its distributions where the value is there and where it isn't, on the sample
    nums = x.of_type("numeric")[:20]
    for n in gaps:
        if n not in x.frame:
            continue
        gone, top = x.frame[n].isna().to_numpy(), None
        for m in nums:
            v = x.frame[m].to_numpy()
            a, b = v[gone & ~np.isnan(v)], v[~gone & ~np.isnan(v)]
            if m != n and min(len(a), len(b)) >= 30 and (top is None or S.ks(a, b) > top[0]):
                top = (S.ks(a, b), m)
        if top and top[0] >= 0.30:
            f("missing.related_numeric", "missingness", "info", "Missing values go with a number", f"Where {n} is missing, {top[1]} is distributed differently (KS {top[0]:.2f}).", [n, top[1]], evidence={"ks": top[0]}, confidence=0.6)
    # together
    if len(gaps) >= 2:
        pairs = A.phi_matrix(x.df.select(*[F.col(x.col[n]) for n in gaps[: x.config.performance.max_pairwise_columns]]), [x.col[n] for n in gaps[: x.config.performance.max_pairwise_columns]]).collect()
        back, group = {x.col[n]: n for n in gaps}, {n: n for n in gaps}

        def root(n: str) -> str:
            while group[n] != n:
                n = group[n]
            return n

        strong = [(back[r.a], back[r.b], r.r) for r in pairs if r.r is not None and r.r >= t.missing_cooccurrence_phi]
        for a, b, _ in strong:
            group[root(b)] = root(a)
        x.sections["missingness"]["pairs"] = [{"a": a, "b": b, "phi": r} for a, b, r in strong]
        for r in dict.fromkeys(root(n) for n in gaps):
            members = [n for n in gaps if root(n) == r]
            if len(members) > 1:
                f("missing.co_occurrence", "missingness", "info", "Values are missing together", f"{', '.join(members)} are missing in the same rows.", members, evidence={"phi": max(p for a, _, p in strong if a in members)}, interpretation="They may come from one source.")
    return out


def cramers_from(rows: list[tuple[int, int]]) -> float:
    """Bias-corrected Cramér's V of a table with two columns."""
    n, col = sum(map(sum, rows)), [sum(r[i] for r in rows) for i in (0, 1)]
    rows = [r for r in rows if sum(r)]
    if n < 2 or not all(col) or len(rows) < 2:
        return 0.0
    phi = sum(r[i] ** 2 / (sum(r) * col[i]) for r in rows for i in (0, 1)) - 1
    k = len(rows)
    low = min(k - (k - 1) ** 2 / (n - 1), 2 - 1 / (n - 1)) - 1
    return math.sqrt(max(0.0, phi - (k - 1) / (n - 1)) / low) if low > 0 else 0.0


@detector("duplicates")
def duplicates(x: Context) -> list[Finding]:
    t, out = x.t, []
    f = lambda *a, **k: out.append(finding("duplicates", *a, **k))
    if not x.n or not x.names:
        return out
    rate = lambda k: tiered(k / x.n, [(t.duplicate_high, "high"), (t.duplicate_warning, "warning")], "info")
    row = A.exact_duplicates(x.df).head()
    x.sections["duplicates"] = {"count": row.n_duplicates, "ratio": row.n_duplicates / x.n}
    if row.n_duplicates:
        f("duplicates.exact", "duplicates", rate(row.n_duplicates), "Exact copies", f"{row.n_duplicates} rows ({pct(row.n_duplicates / x.n)}) repeat an earlier row.", evidence={"rows": row.n_duplicates, "groups": row.n_groups, "ratio": row.n_duplicates / x.n}, suggestion="Drop the copies if rows should be unique.", rule=f"ratio >= {t.duplicate_warning}")
    ids = x.of_type("identifier")
    rest = [n for n in x.names if n not in ids]
    if ids and len(rest) >= 2:
        # copies of the content that aren't copies of the row: rows less distinct contents, less those that are exact copies
        more = A.exact_duplicates(x.df, [x.col[n] for n in rest]).head().n_duplicates - row.n_duplicates
        if more > 0:
            f("duplicates.except_ids", "duplicates", rate(more), "Copies under other ids", f"{more} rows repeat another row in everything but {', '.join(ids)}.", ids, evidence={"rows": more, "ratio": more / x.n})
    keys = [n for n in x.names if (x.schema[n].semantic_type == "identifier" and x.schema[n].unique_ratio >= t.identifier_unique_ratio) or (n in x.config.rules and x.config.rules[n].unique)]
    for n in keys:
        repeats = x.schema[n].n_present - x.schema[n].n_unique
        if repeats > 0:
            must = n in x.config.rules and x.config.rules[n].unique
            f("duplicates.key", "duplicates", "high" if must else "warning", "Repeated key", f"{repeats} values of {n} repeat an earlier one.", [n], evidence={"repeats": repeats}, confidence=0.9, rule="unique" if must else f"unique ratio >= {t.identifier_unique_ratio}")
    for n in ids:
        c = x.schema[n]
        if c.unique_ratio >= 0.99 or c.n_unique < 20:
            continue
        attrs = [m for m in x.of_type("categorical", "boolean") if m != n][:20]
        if not attrs:
            continue
        for r in A.entity_conflicts(x.df.where(F.col(x.col[n]).isNotNull()), x.col[n], [x.col[m] for m in attrs]).collect():
            m = next(a for a in attrs if x.col[a] == r.column_name)
            if r.n_keys >= 20 and 0.95 <= 1 - r.n_conflicts / r.n_keys < 1:
                f("duplicates.entity_conflict", "duplicates", "warning", "Conflicting attributes", f"{r.n_conflicts} of {r.n_keys} repeated {n} have several values of {m}.", [n, m], evidence={"keys": r.n_keys, "conflicts": r.n_conflicts}, confidence=0.7)
    return out


@detector("constant")
def constant(x: Context) -> list[Finding]:
    out = []
    for n, c in x.schema.items():
        if c.n_unique == 1:
            out.append(finding("constant", "constant.single_value", "structure", "warning", "One value", f"{n} has a single value.", [n], evidence={"rows": c.n_present}, suggestion="The column carries no information."))
            continue
        if not c.n_present or c.semantic_type not in ("numeric", "datetime", "categorical", "boolean"):
            continue
        share = x.uniques[n][1] / c.n_present
        if share >= x.t.near_constant_ratio:
            out.append(finding("constant", "constant.near", "structure", "warning", "Nearly constant", f"One value makes {pct(share)} of {n}.", [n], evidence={"share": share}, rule=f"share >= {x.t.near_constant_ratio}"))
        elif share >= x.t.dominant_category_ratio and c.semantic_type in ("categorical", "boolean"):
            out.append(finding("constant", "constant.dominant", "structure", "info", "Dominant label", f"One label makes {pct(share)} of {n}.", [n], evidence={"share": share}, rule=f"share >= {x.t.dominant_category_ratio}"))
    return out


@detector("identifier")
def identifier(x: Context) -> list[Finding]:
    out = []
    for n, c in x.schema.items():
        if c.semantic_type == "identifier":
            out.append(finding("identifier", "identifier.detected", "structure", "warning" if x.stored(n) == "number" else "info", "Identifier", f"{n} identifies rows: {'; '.join(c.reasons)}.", [n], evidence={"unique_ratio": c.unique_ratio, "reasons": c.reasons}, confidence=0.85 if len(c.reasons) >= 2 else 0.6, suggestion="Keep it out of models and statistics."))
        elif c.semantic_type == "categorical" and c.unique_ratio >= x.t.identifier_unique_ratio and c.n_unique >= 50:
            out.append(finding("identifier", "identifier.near_unique", "structure", "info", "Nearly unique labels", f"{pct(c.unique_ratio)} of the values of {n} are distinct.", [n], evidence={"unique_ratio": c.unique_ratio}))
    return out


@detector("rules")
def rules(x: Context) -> list[Finding]:
    own = {x.col[n]: r for n, r in x.config.rules.items() if n in x.col}
    back = {v: k for k, v in x.col.items()}
    says = {"min": "below the least allowed value", "max": "above the largest allowed value", "numeric": "not a number", "allowed": "not an allowed value", "pattern": "not of the required form", "nullable": "missing though a value is required"}
    found = [r for r in R.violations(x.df, own).collect() if r.n]
    broken = R.conditions(x.df, own) if found else {}
    where = x.rows_where({f"{r.column_name} {r.kind}": (broken[r.column_name, r.kind], F.col(r.column_name)) for r in found})
    return [finding("rules", f"rules.{r.kind}", "rules", "high", "Rule broken", f"{r.n} values of {back[r.column_name]} are {says[r.kind]}.", [back[r.column_name]], evidence={"rows": r.n} | where[f"{r.column_name} {r.kind}"], confidence=1.0, rule=f"{r.kind}: {getattr(own[r.column_name], r.kind, '')}") for r in found]
