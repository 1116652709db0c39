"""Operators on time: calendars, volumes, intervals and lifecycles of categories; change points on the small results."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .aggregates import rounded

# Units of a period and their length in days.
UNITS = (("hour", 1 / 24), ("day", 1), ("week", 7), ("month", 30.44), ("quarter", 91.31), ("year", 365.25))
STEPS = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR"}


def choose_unit(days: float, least_periods: int = 8, most: int = 100) -> str | None:
    """The finest unit that needs no more than most periods for a span; None if that gives too few."""
    for unit, length in UNITS:
        if days / length + 1 <= most:
            return unit if days / length + 1 >= least_periods else None
    return None


def volume(df: DataFrame, time: str, unit: str) -> DataFrame:
    """Rows of each period between the first and the last, empty ones included: the calendar has a row a period."""
    counts = df.where(F.col(time).isNotNull()).groupBy(C.period(F.col(time), unit).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    calendar = span.where("lo IS NOT NULL").select(F.explode(F.expr(f"sequence(lo, hi, {STEPS[unit]})")).alias("period"))
    return calendar.join(counts, "period", "left").select("period", F.coalesce("n", F.lit(0)).alias("n"))


def empty_periods(df: DataFrame, time: str, unit: str) -> DataFrame:
    return volume(df, time, unit).where("n = 0").select("period")


def period_medians(df: DataFrame, time: str, unit: str, names: Sequence[str], least: int = 5) -> DataFrame:
    """Rows, missing rates and medians of columns in each period; null where there are too few rows."""
    n = F.count(F.lit(1))
    aggs = []
    for c in names:
        x = C.finite(df, c)
        aggs += [rounded(F.when(F.count(x) >= least, F.percentile(x, 0.5))).alias(f"median_{c}"), rounded(F.when(n >= least, F.avg(C.is_missing(df, c).cast("int")))).alias(f"missing_{c}")]
    return df.where(F.col(time).isNotNull()).groupBy(C.period(F.col(time), unit).alias("period")).agg(n.alias("n"), *aggs)


def lifecycle(df: DataFrame, time: str, unit: str, name: str) -> DataFrame:
    """The first and last period of each label."""
    return df.where(F.col(time).isNotNull() & F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("label")).agg(F.min(C.period(F.col(time), unit)).alias("first_period"), F.max(C.period(F.col(time), unit)).alias("last_period"), F.count(F.lit(1)).alias("n"))


def datetime_profile(df: DataFrame, names: Sequence[str], reference: str) -> DataFrame:
    """Range, granularity, midnight share, dates to come and distinct values of each time column, in one pass."""
    rows = []
    for c in names:
        x = F.col(c).cast("timestamp_ntz")
        now = F.lit(reference).cast("timestamp_ntz")
        day, minute, second = (F.bool_and(x == F.date_trunc(u, x).cast("timestamp_ntz")) for u in ("day", "minute", "second"))
        rows.append(F.struct(
            F.lit(c).alias("column_name"), F.min(x).alias("min_time"), F.max(x).alias("max_time"), F.count_distinct(x).alias("n_unique"), F.count(F.when(x > now, 1)).alias("n_future"),
            rounded(F.avg((x == F.date_trunc("day", x).cast("timestamp_ntz")).cast("int"))).alias("midnight_share"), F.when(day, "day").when(minute, "minute").when(second, "second").otherwise("sub-second").alias("granularity"),
        ))
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def default_dates(df: DataFrame, name: str) -> DataFrame:
    """How often each date that systems put in occurs, and years before 1900 (as 'before 1900')."""
    x = F.date_format(F.col(name).cast("timestamp_ntz"), "yyyy-MM-dd")
    label = F.when(x.isin(*C.DEFAULT_DATES), x).when(F.year(F.col(name)) < 1900, F.lit("before 1900"))
    return df.select(label.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def intervals(df: DataFrame, time: str) -> DataFrame:
    """Steps between distinct times: number, median, longest (seconds). Each month's times are ordered by themselves; the steps between months come from their ends."""
    t = df.select(F.col(time).cast("timestamp_ntz").alias("t")).where("t IS NOT NULL").distinct().withColumn("m", F.date_trunc("month", F.col("t")))
    sec = lambda a, b: F.unix_micros(F.col(b).cast("timestamp")) / 1e6 - F.unix_micros(F.col(a).cast("timestamp")) / 1e6
    inner = t.withColumn("p", F.lag("t").over(Window.partitionBy("m").orderBy("t"))).where("p IS NOT NULL").select(sec("p", "t").alias("step"))
    ends = t.groupBy("m").agg(F.min("t").alias("a"), F.max("t").alias("z"))  # a row a month
    between = ends.withColumn("p", F.lag("z").over(Window.orderBy("m"))).where("p IS NOT NULL").select(sec("p", "a").alias("step"))
    return inner.unionByName(between).agg(F.count(F.lit(1)).alias("n_steps"), rounded(F.percentile("step", 0.5), 3).alias("median_step"), rounded(F.max("step"), 3).alias("longest_step"))


def median(x: Sequence[float]) -> float:
    s, n = sorted(x), len(x)
    return (s[n // 2] + s[(n - 1) // 2]) / 2


def robust_sigma(x: Sequence[float]) -> float:
    """Noise of a series from its steps: MAD of differences, else their standard deviation (of a sample)."""
    d = [b - a for a, b in zip(x, x[1:], strict=False)]
    if not d:
        return 0.0
    m = median(d)
    mad = median([abs(v - m) for v in d])
    if mad > 0:
        return mad / (0.6745 * math.sqrt(2))
    mean = sum(d) / len(d)
    return math.sqrt(sum((v - mean) ** 2 for v in d) / (len(d) - 1)) / math.sqrt(2) if len(d) > 1 else 0.0


def kolmogorov_p(t: float) -> float:
    if t <= 0:
        return 1.0
    if math.isinf(t):
        return 0.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def cusum(x: Sequence[float], least: int = 3) -> dict | None:
    """The split of a series with the largest cumulative sum of deviations, both sides having least values."""
    n = len(x)
    if n < 2 * least:
        return None
    mean, sigma, total, best = sum(x) / n, robust_sigma(x), 0.0, (-1.0, 0)
    for k in range(1, n):
        total += x[k - 1] - mean
        if least <= k <= n - least and abs(total) > best[0]:
            best = (abs(total), k)
    k = best[1]
    before, after = sum(x[:k]) / k, sum(x[k:]) / (n - k)
    stat = best[0] / (sigma * math.sqrt(n)) if sigma > 0 else (math.inf if abs(before - after) > 1e-12 else 0.0)
    return {"index": k, "statistic": stat, "p_value": kolmogorov_p(stat), "before": before, "after": after, "shift": after - before}


def change_points(x: Sequence[float], limit: float = 1.628, least: int = 3, most: int = 3) -> list[dict]:
    """Splits again and again while a part's statistic reaches the limit, left parts first."""
    found: list[dict] = []

    def split(lo: int, hi: int) -> None:
        c = cusum(x[lo:hi], least) if len(found) < most else None
        if c and c["statistic"] >= limit:
            found.append(c | {"index": lo + c["index"]})
            split(lo, lo + c["index"])
            split(lo + c["index"], hi)

    split(0, len(x))
    return sorted(found, key=lambda c: c["index"])


def strongest_change(x: Sequence[float | None]) -> tuple[int, dict] | None:
    """The largest shift of a series without its gaps, with its place in the whole series."""
    kept = [(i, float(v)) for i, v in enumerate(x) if v is not None and not math.isnan(v)]
    found = change_points([v for _, v in kept]) if len(kept) >= 6 else []
    if not found:
        return None
    best = max(found, key=lambda c: abs(c["shift"]))
    return kept[best["index"]][0], best


def spikes(x: Sequence[float], limit: float = 5.0, width: int = 7) -> list[int]:
    """Places that are further than limit robust deviations from the median around them."""
    n, h = len(x), width // 2
    if n < width:
        return []
    rest = [x[i] - median(x[max(0, i - h) : i + h + 1]) for i in range(n)]
    m = median(rest)
    scale = median([abs(r - m) for r in rest]) / 0.6745
    if scale <= 0:
        mean = sum(rest) / n
        scale = math.sqrt(sum((r - mean) ** 2 for r in rest) / n)
    return [i for i in range(n) if scale > 0 and abs(rest[i]) > limit * scale]


def change_confidence(change: dict, periods: int) -> float:
    return min(0.85, 0.5 + (0.2 if change["statistic"] >= 2.5 else 0) + (0.1 if periods >= 20 else 0))
