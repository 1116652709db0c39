"""Datetime columns and changes over time."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..context import Context
from ..findings import Finding
from ..functions import columns as C
from ..operators import temporal as TM
from ..operators.drift import ks_wasserstein
from . import detector, finding, pct

PLANNED = re.compile(r"(expir|due|planned|scheduled|deadline|valid_(to|until)|end|next|renew|target|forecast)", re.I)


@detector("datetime")
def datetime(x: Context) -> list[Finding]:
    out = []
    f = lambda *a, **k: out.append(finding("datetime", *a, **k))
    wanted = {}
    for n, p in x.times.items():
        if p["n"] and x.schema[n].n_present > p["n"]:
            wanted[f"bad {n}"] = (x.time(n).isNull() & C.present(x.df, x.col[n]).isNotNull(), F.col(x.col[n]))
        if p["n"] and p["future"]:
            wanted[f"future {n}"] = (x.time(n) > F.lit(x.now).cast("timestamp_ntz"), None)
    where = x.rows_where(wanted)
    for n, p in x.times.items():
        c = x.schema[n]
        if not p["n"]:
            continue
        x.profiles[n]["datetime"] = {"min": p["min"], "max": p["max"], "granularity": p["granularity"], "distinct": c.n_unique}
        bad = c.n_present - p["n"]
        if bad > 0:
            f("datetime.unparseable", "temporal", "warning", "Dates that can't be read", f"{bad} values of {n} can't be read as dates.", [n], evidence={"rows": bad, "shapes": [s for s, _, _ in x.shapes[n][:5]]} | where[f"bad {n}"])
        if p["future"]:
            f("datetime.future", "temporal", "info" if PLANNED.search(n) else "warning", "Dates to come", f"{p['future']} values of {n} lie after {x.now}.", [n], evidence={"rows": p["future"], "max": p["max"]} | where[f"future {n}"])
        least = max(2, int(0.0005 * p["n"]))
        if p["default"] >= least or p["ancient"] >= least:
            f("datetime.placeholder", "temporal", "warning", "Default dates", f"{p['default']} values of {n} are dates that systems put in, {p['ancient']} lie before 1900.", [n], evidence={"default": p["default"], "before_1900": p["ancient"]}, confidence=0.6)
        if 0.5 <= p["midnight"] < 0.999 and p["n"] >= 50:
            f("datetime.mixed_granularity", "temporal", "info", "Dates and times mixed", f"{pct(p['midnight'])} of {n} lie at midnight.", [n], evidence={"midnight": p["midnight"]})
    n = x.time_column
    if not n or not x.times[n]["n"]:
        return out
    p, c = x.times[n], x.schema[n]
    rows = x.df.select(x.time(n).alias("t")).where("t IS NOT NULL")
    steps = TM.intervals(rows, "t").head()
    repeats = 1 - (steps.n_steps + 1) / p["n"]
    if steps.n_steps >= 10 and steps.median_step:
        x.profiles[n]["datetime"]["median_interval"] = steps.median_step
        near = _near(rows, steps.median_step)
        if repeats < 0.01 and near["share"] >= 0.8 and near["share"] < 1:
            gaps = near["gaps"]
            f("datetime.irregular_interval", "temporal", "warning" if gaps else "info", "Irregular steps", f"Steps of {n} are {steps.median_step:g} s as a rule; the longest is {steps.longest_step:g} s.", [n], evidence={"median": steps.median_step, "longest": steps.longest_step, "gaps": gaps})
        if 0 < repeats < 0.05 and p["n"] >= 20 and steps.n_steps >= 10:
            f("datetime.duplicate_timestamps", "temporal", "info", "Repeated times", f"{pct(repeats)} of the times of {n} repeat another one.", [n], evidence={"share": repeats})
    if x.bins:
        counts = [b["n"] for b in x.bins]
        x.sections["temporal"] = {"time_column": n, "period": x.unit, "volume": [{"period": b["period"], "n": b["n"]} for b in x.bins]}
        empty = [b["period"] for b in x.bins[1:-1] if b["n"] == 0]
        if empty and TM.median(counts) >= 5:
            f("datetime.empty_periods", "temporal", "warning", "Periods without rows", f"{len(empty)} {x.unit}s have no rows.", [n], evidence={"periods": empty[:10], "unit": x.unit})
    return out


def _near(rows, median: float) -> dict:
    """The share of steps near the median and the number of much longer ones."""
    from pyspark.sql import Window

    t = rows.distinct().withColumn("m", F.date_trunc("month", "t"))
    step = F.col("t").cast("timestamp").cast("double") - F.lag("t").over(Window.partitionBy("m").orderBy("t")).cast("timestamp").cast("double")
    r = t.select(step.alias("s")).where("s IS NOT NULL").agg(F.avg((F.abs(F.col("s") - median) <= 0.1 * median).cast("int")).alias("share"), F.count(F.when(F.col("s") > 5 * median, 1)).alias("gaps")).head()
    return {"share": r.share or 0.0, "gaps": r.gaps}


@detector("temporal")
def temporal(x: Context) -> list[Finding]:
    t, out = x.t, []
    f = lambda *a, **k: out.append(finding("temporal", *a, **k))
    if len(x.bins) < t.temporal_min_periods:
        return out
    n, unit = x.time_column, x.unit
    inner = x.bins[1:-1]
    counts = [float(b["n"]) for b in inner]
    found = TM.strongest_change(counts)
    if found:
        at, c = found
        rel = c["shift"] / c["before"] if c["before"] else float("inf")
        if abs(rel) >= t.volume_change_ratio:
            f("temporal.volume_shift", "temporal", "warning", "Volume changes", f"Rows per {unit} go from {c['before']:.1f} to {c['after']:.1f} at {inner[at]['period']:%Y-%m-%d}.", [n], evidence={"period": inner[at]["period"], "before": c["before"], "after": c["after"], "statistic": c["statistic"]}, confidence=TM.change_confidence(c, len(inner)), rule=f"relative change >= {t.volume_change_ratio}")
    peaks = TM.spikes(counts)
    if peaks:
        f("temporal.volume_spike", "temporal", "info", "Unusual volume", f"{len(peaks)} {unit}s have unusually many or few rows.", [n], evidence={"periods": [inner[i]["period"] for i in peaks[:10]]})
    for m in x.of_type("numeric")[: x.config.performance.max_pairwise_columns]:
        series = [b.get(f"x_{x.col[m]}") if (b.get(f"k_{x.col[m]}") or 0) >= 5 else None for b in x.bins]
        found = TM.strongest_change(series)
        if not found:
            continue
        at, c = found
        work = x.df.select(x.time(n).alias("t"), x.value(m).alias("v")).where("t IS NOT NULL AND v IS NOT NULL")
        edge = F.lit(x.bins[at]["period"])
        ks = ks_wasserstein(work.where(F.col("t") < edge), work.where(F.col("t") >= edge), "v").head().ks
        if ks and ks >= t.ks_high:
            f("temporal.distribution_shift", "temporal", "warning", "Values change over time", f"The median of {m} goes from {c['before']:.4g} to {c['after']:.4g} at {x.bins[at]['period']:%Y-%m-%d}.", [m, n], evidence={"period": x.bins[at]["period"], "before": c["before"], "after": c["after"], "ks": ks}, confidence=TM.change_confidence(c, len(x.bins)), rule=f"KS >= {t.ks_high}")
    periods = {b["period"]: i for i, b in enumerate(x.bins)}
    for m in x.of_type("categorical", "boolean"):
        if not 2 <= x.schema[m].n_unique <= 4 * x.config.performance.max_group_levels:
            continue
        work = x.df.select(x.time(n).alias("t"), C.present(x.df, x.col[m]).cast("string").alias("l"))
        rows = [r for r in TM.lifecycle(work, "t", unit, "l").collect() if r.n >= 0.01 * x.n]  # at most the levels
        new = [r for r in rows if periods[r.first_period] >= 0.2 * len(x.bins)]
        gone = [r for r in rows if periods[r.last_period] < 0.8 * len(x.bins)]
        if new:
            f("temporal.new_category", "temporal", "info", "Labels that come", f"{len(new)} labels of {m} first occur late.", [m, n], evidence={"labels": {x.shown(r.label): r.first_period for r in new[:10]}})
        if gone:
            f("temporal.vanished_category", "temporal", "info", "Labels that go", f"{len(gone)} labels of {m} last occur early.", [m, n], evidence={"labels": {x.shown(r.label): r.last_period for r in gone[:10]}})
    return out
