"""Aggregating operators: a few wide passes over a table, each for all columns at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Expressions of one pass; more make generated code too large to compile.
CHUNK = 12


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def by_column(df: DataFrame, names: Sequence[str], make) -> DataFrame:
    """One row for each column of names, from one aggregation: make(name) gives a struct of aggregates. No shuffle of rows."""
    rows = [F.struct(F.lit(n).alias("column_name"), *make(n)) for n in names]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def missing_by_column(df: DataFrame, names: Sequence[str]) -> DataFrame:
    n = F.count(F.lit(1))
    miss = lambda c: F.count(F.when(C.is_missing(df, c), 1))
    return by_column(df, names, lambda c: [n.alias("n_rows"), miss(c).alias("n_missing"), rounded(miss(c) / n).alias("missing_ratio")])


def missing_by_row(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """How many rows have each number of missing values."""
    k = sum((C.is_missing(df, c).cast("int") for c in names), F.lit(0))
    return df.select(k.cast("long").alias("n_missing")).groupBy("n_missing").agg(F.count(F.lit(1)).alias("n_rows"))


def numeric_profile(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Count, moments (bias-corrected), zeros, negatives and infinities of each column; over finite values."""

    def make(c: str) -> list[Column]:
        x, n = C.finite(df, c), F.count(C.finite(df, c)).cast("double")
        g1, g2 = F.skewness(x), F.kurtosis(x)
        raw = C.present(df, c).cast("double")
        return [
            F.count(x).alias("n"), F.count(F.when(raw.isin(float("inf"), float("-inf")), 1)).alias("n_infinite"), rounded(F.avg(x)).alias("mean"), rounded(F.stddev_samp(x)).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max"), F.count(F.when(x == 0, 1)).alias("zeros"), F.count(F.when(x < 0, 1)).alias("negatives"), F.coalesce(F.bool_and(x == F.floor(x)), F.lit(False)).alias("integer_valued"),
            rounded(F.when((n > 2) & (F.stddev_pop(x) > 0), g1 * F.sqrt(n * (n - 1)) / (n - 2))).alias("skew"),
            rounded(F.when((n > 3) & (F.stddev_pop(x) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))).alias("kurtosis"),
        ]

    return by_column(df, names, make)


#: Ranges of values that running sums are dealt to, of spearman_matrix(), exact_quantiles() and areas under curves.
RANGES = 64
#: Distinct values that one task may hold.
IN_ONE_TASK = 1_000_000


def running(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """counts (keys, value, n: one row each) with before, the sum of n over lesser values of the same keys.

    Ranges of values are cut at approximate quantiles, so that no task sorts all values of a column; a row for each range is summed up.
    """
    edges = counts.groupBy(*keys).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)]).alias("__e"))
    placed = counts.join(F.broadcast(edges), list(keys)).withColumn("__g", F.size(F.filter("__e", lambda e: e < F.col(value)))).drop("__e")
    sums = placed.groupBy(*keys, "__g").agg(F.sum("n").alias("__t"))
    w = Window.partitionBy(*keys).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(*keys, "__g", F.coalesce(F.sum("__t").over(w), F.lit(0)).alias("__o"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "__g").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(start), [*keys, "__g"]).withColumn("before", F.col("__o") + inside).drop("__g", "__o")


def exact_quantiles(df: DataFrame, names: Sequence[str], probabilities: Sequence[float], value=C.finite) -> DataFrame:
    """column_name, q: exact linear quantiles of each column's value(df, name), finite ones by default, as an array; null if it has none.

    Values are counted in the cluster first, so that what one task reads doesn't grow with the tasks before it. Where a first pass estimates at most IN_ONE_TASK
    distinct values of all columns, percentile() weighs the counts; beyond, they are summed up by ranges and no task holds the distinct values of a column.
    """
    estimate = df.agg(*[F.approx_count_distinct(value(df, c)) for c in names]).head()
    pairs = F.array(*[F.struct(F.lit(i).alias("column"), value(df, c).alias("v")) for i, c in enumerate(names)])
    counts = df.select(F.inline(pairs)).where("v IS NOT NULL").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    if sum(estimate) <= IN_ONE_TASK:
        got = counts.groupBy("column").agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in probabilities]), F.col("n")).alias("q"))
    else:
        got = quantiles_by_ranges(counts, ["column"], probabilities)
    rows = [F.struct(F.lit(c).alias("column_name"), F.max(F.when(F.col("column") == i, F.col("q"))).alias("q")) for i, c in enumerate(names)]
    return got.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def quantiles_by_ranges(counts: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """keys, q: exact linear quantiles of counts (keys, v, n: one row each): running sums by ranges, and the values on either side of each place."""
    run = running(counts, keys, "v").withColumn("after", F.col("before") + F.col("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    run = run.join(F.broadcast(total), list(keys))  # a row for each of the keys
    wanted = []
    for j, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("total") - 1)
        low, high = F.floor(place), F.ceil(place)
        has = lambda k: (F.col("before") <= k) & (k < F.col("after"))
        wanted += [F.max(F.when(has(low), F.col("v"))).alias(f"__l{j}"), F.max(F.when(has(high), F.col("v"))).alias(f"__h{j}"), F.first(place - low).alias(f"__w{j}")]
    got = run.groupBy(*keys).agg(*wanted)
    # as percentile() does: a place between two values weighs both
    mixed = [F.when(F.col(f"__l{j}") == F.col(f"__h{j}"), F.col(f"__l{j}")).otherwise((1 - F.col(f"__w{j}")) * F.col(f"__l{j}") + F.col(f"__w{j}") * F.col(f"__h{j}")) for j in range(len(probabilities))]
    return got.select(*keys, F.array(*mixed).alias("q"))


def quantile_row(df: DataFrame, names: Sequence[str], probabilities: Sequence[float], prefix: str) -> DataFrame:
    """exact_quantiles() as one row: an array for each name, called prefix and the name's number."""
    q = exact_quantiles(df, names, probabilities)
    return q.agg(*[F.max(F.when(F.col("column_name") == c, F.col("q"))).alias(f"{prefix}{i}") for i, c in enumerate(names)])


def quantiles(df: DataFrame, names: Sequence[str], probabilities: Sequence[float], value=C.finite) -> dict[str, list[float]]:
    """exact_quantiles() on the driver: a row a column."""
    return {r.column_name: r.q for r in exact_quantiles(df, names, probabilities, value).collect()}


def numeric_quantiles(df: DataFrame, names: Sequence[str], probabilities: Sequence[float] = QUANTILES) -> DataFrame:
    """Linear quantiles of each column, exact."""
    values = F.array(*[F.struct(F.lit(p).alias("probability"), rounded(F.col("q")[j]).alias("value")) for j, p in enumerate(probabilities)])
    return exact_quantiles(df, names, probabilities).select("column_name", F.inline(values))


def histogram(df: DataFrame, name: str, bins: int = 30, clip: tuple[float, float] = (0.005, 0.995)) -> DataFrame:
    """Equal bins between two quantiles; values outside count in the first or last."""
    x = C.finite(df, name)
    edge = quantile_row(df, [name], clip, "e").select(F.col("e0")[0].alias("lo"), F.col("e0")[1].alias("hi"))
    v = df.select(x.alias("x")).where("x IS NOT NULL").join(F.broadcast(edge))  # one row
    k = F.least(F.floor((F.least(F.greatest("x", "lo"), F.col("hi")) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))
    return v.select(F.when(F.col("hi") > F.col("lo"), k).otherwise(F.lit(0)).cast("long").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def spread(df: DataFrame, most: int, n: int, seed: int = 0) -> DataFrame:
    """At most `most` of df's n rows, those with the lowest hashes of their places, in that order: copies of a row are chosen one by one."""
    share = (1.2 * most + 10 * most**0.5) / max(1, n)
    d = df.withColumn("__h", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)))
    # few rows pass, so that one task can sort them
    return d.where(F.pmod("__h", F.lit(1_000_000_000)) < int(1e9 * min(1.0, share)) + 1).orderBy("__h").limit(most).drop("__h")


def value_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """column_name, value, n: values as strings, of all columns in one shuffle with partial sums."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), C.present(df, c).cast("string").alias("value")) for c in names])
    return df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def top_share(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The most frequent value of each column (the least of equally frequent ones) and its share."""
    v = value_counts(df, names)
    top = v.groupBy("column_name").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("value"))).alias("t"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_unique"))
    return top.select("column_name", F.col("t.value").alias("top_value"), (-F.col("t.m")).alias("top_count"), rounded(-F.col("t.m") / F.col("total")).alias("top_share"), "n_unique")


def _with_total(counts: DataFrame) -> DataFrame:
    """counts with the sum of n for each column: a row a column is broadcast."""
    return counts.join(F.broadcast(counts.groupBy("column_name").agg(F.sum("n").alias("total"))), "column_name")


def entropy(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Shannon entropy in bits, also as a share of its maximum."""
    v = _with_total(value_counts(df, names))
    p = F.col("n") / F.col("total")
    out = v.groupBy("column_name").agg(F.sum(-p * F.log2(p)).alias("h"), F.count(F.lit(1)).alias("n_unique"))
    return out.select("column_name", rounded("h").alias("entropy"), rounded(F.when(F.col("n_unique") > 1, F.col("h") / F.log2("n_unique")).otherwise(0.0)).alias("normalised"), "n_unique")


def rare_labels(df: DataFrame, name: str, below: float) -> DataFrame:
    v = _with_total(value_counts(df, [name]))
    return v.where(F.col("n") < below * F.col("total")).select("value", "n")


def text_lengths(df: DataFrame, name: str) -> DataFrame:
    n = F.length(name)
    return df.agg(F.min(n).cast("long").alias("min_length"), F.max(n).cast("long").alias("max_length"), rounded(F.avg(n)).alias("mean_length"), F.percentile(n, 0.5).alias("median_length"))


def tukey_outliers(df: DataFrame, names: Sequence[str], k: float = 1.5) -> DataFrame:
    """Fences and the number of values outside; none where the quartiles are equal."""
    wide = quantile_row(df, names, (0.25, 0.75), "q")
    joined = df.join(F.broadcast(wide))  # one row

    def make(c: str) -> list[Column]:
        q, x = F.col(f"q{names.index(c)}"), C.finite(df, c)
        lo, hi = q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])
        return [rounded(F.first(lo)).alias("lower"), rounded(F.first(hi)).alias("upper"), F.count(F.when((q[1] > q[0]) & ((x < lo) | (x > hi)), 1)).alias("n_outliers")]

    return by_column(joined, names, make)


def zscore_outliers(df: DataFrame, names: Sequence[str], limit: float = 3.0) -> DataFrame:
    wide = df.agg(*[F.struct(F.avg(C.finite(df, c)).alias("m"), F.stddev_samp(C.finite(df, c)).alias("s")).alias(f"q{i}") for i, c in enumerate(names)])
    return by_column(df.join(F.broadcast(wide)), names, lambda c: [F.count(F.when(F.abs(C.finite(df, c) - F.col(f"q{names.index(c)}.m")) > limit * F.col(f"q{names.index(c)}.s"), 1)).alias("n_outliers")])


def robust_scores(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df with __z0, __z1 ...: modified z-scores of names by median and MAD (mean absolute deviation where MAD is 0)."""
    a = df.join(F.broadcast(quantile_row(df, names, (0.5,), "__m")))  # one row
    dev = a.select(*[F.abs(C.finite(df, c) - F.col(f"__m{i}")[0]).alias(f"d{i}") for i, c in enumerate(names)])
    means = dev.agg(*[F.avg(d).alias(f"__d{i}") for i, d in enumerate(dev.columns)])
    b = a.join(F.broadcast(quantile_row(dev, dev.columns, (0.5,), "__a"))).join(F.broadcast(means))
    out = {}
    for i, c in enumerate(names):
        off, mad, mean = C.finite(df, c) - F.col(f"__m{i}")[0], F.col(f"__a{i}")[0], F.col(f"__d{i}")
        out[f"__z{i}"] = F.when(mad > 0, 0.6745 * off / mad).when(mean > 0, off / (1.253314 * mean)).otherwise(0.0)
    return b.withColumns(out).drop(*[f"{p}{i}" for i in range(len(names)) for p in ("__m", "__a", "__d")])


def modified_z_outliers(df: DataFrame, names: Sequence[str], limit: float = 3.5) -> DataFrame:
    return by_column(robust_scores(df, names), names, lambda c: [F.count(F.when(F.abs(F.col(f"__z{names.index(c)}")) > limit, 1)).alias("n_outliers")])


#: Methods of outlier_masks().
MASKS = ("iqr", "zscore", "modified_zscore")


def outlier_masks(df: DataFrame, names: Sequence[str], iqr_k: float = 1.5, zscore: float = 3.0, modified_zscore: float = 3.5) -> DataFrame:
    """df with a boolean for each method and column, iqr_0, zscore_0, modified_zscore_0, iqr_1 ...: whether the value is an outlier by it; a missing one is none."""
    facts = df.agg(*[F.struct(F.avg(C.finite(df, c)).alias("m"), F.stddev_samp(C.finite(df, c)).alias("s")).alias(f"__f{i}") for i, c in enumerate(names)])
    out = robust_scores(df, names).join(F.broadcast(facts)).join(F.broadcast(quantile_row(df, names, (0.25, 0.75), "__q")))  # one row each
    for i, c in enumerate(names):
        x, f, q = C.finite(df, c), F.col(f"__f{i}"), F.col(f"__q{i}")
        fence = iqr_k * (q[1] - q[0])
        tests = ((q[1] > q[0]) & ((x < q[0] - fence) | (x > q[1] + fence)), (f["s"] > 0) & (F.abs(x - f["m"]) > zscore * f["s"]), F.abs(F.col(f"__z{i}")) > modified_zscore)
        out = out.withColumns({f"{m}_{i}": F.coalesce(t, F.lit(False)) for m, t in zip(MASKS, tests, strict=True)})
    return out.drop(*[f"{p}{i}" for i in range(len(names)) for p in ("__f", "__q", "__z")])


def size_adjusted_limit(n: int) -> float:
    """The robust score that a normal sample of n passes with a chance of about one in a hundred."""
    from statistics import NormalDist

    return -NormalDist().inv_cdf(0.005 / max(n, 1)) if n else float("inf")


def pearson_matrix(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Correlations of pairs over the rows where both are present, all in one pass; none below ten rows or for constants."""
    return _correlations(df, {c: C.finite(df, c) for c in names})


def _correlations(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    names = list(values)
    return _correlated(df, [(a, b, values[a], values[b]) for i, a in enumerate(names) for b in names[i + 1 :]])


def _correlated(df: DataFrame, pairs: Sequence[tuple[str, str, Column, Column]]) -> DataFrame:
    rows = []
    for a, b, u, v in pairs:
        both = u.isNotNull() & v.isNotNull()
        x, y = F.when(both, u), F.when(both, v)
        ok = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0) & (F.count(x) >= 10)
        r = F.when(ok, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rounded(r, 6).alias("r"), F.count(x).alias("n")))
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


#: Distinct values of a column whose ranks are broadcast; a value that one row in COMMON has is looked up so, too; parts that rows without a rank to join are dealt to;
#: long rows that one task sorts, about.
FEW, COMMON, PARTS, TASK_ROWS = 10_000, 1_000, 1_024, 250_000


def spearman_matrix(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rank correlations of pairs; average ranks are over the rows where both columns are present.

    A column has one ranking for each other column with missing values, and one for all others. Ranks of columns with few values are looked up
    in small tables. The other rankings are made together: values are counted, summed up by ranges, and given back to long rows, one for each
    ranking, in one shuffle, common values by broadcast, so that no task gets all rows of a value. A second shuffle brings the rows together if there are several such rankings.
    """
    base = df.select(*[C.finite(df, c).alias(f"c{i}") for i, c in enumerate(names)])
    facts = base.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in base.columns], *[F.approx_count_distinct(c).alias(f"d_{c}") for c in base.columns]).head()
    rankings: dict[tuple[int, int | None], int] = {}
    number = lambda i, j: rankings.setdefault((i, j if facts[f"c{j}"] else None), len(rankings))
    pairs = [(i, j, number(i, j), number(j, i)) for i in range(len(names)) for j in range(i + 1, len(names))]
    value = {k: F.col(f"c{i}") if j is None else F.when(F.col(f"c{j}").isNotNull(), F.col(f"c{i}")) for (i, j), k in rankings.items()}
    few = [k for (i, _), k in rankings.items() if facts[f"d_c{i}"] <= FEW][:CHUNK]
    many = [k for k in value if k not in few]

    def counted(some: list[int]) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(k).alias("ranking"), value[k].alias("v")) for k in some])
        return base.select(F.inline(entries)).where("v IS NOT NULL").groupBy("ranking", "v").agg(F.count(F.lit(1)).alias("n"))

    wide, ranks = base, {k: [] for k in few}
    if few:
        before = dict.fromkeys(few, 0)
        for k, v, n in sorted(map(tuple, counted(few).collect())):
            ranks[k].append((v, before[k] + (n + 1) / 2))
            before[k] += n
    for k, rows in ranks.items():
        small = df.sparkSession.createDataFrame(rows, f"v{k} double, r{k} double")
        wide = wide.join(F.broadcast(small), value[k] == F.col(f"v{k}"), "left").drop(f"v{k}")
    if many:
        wide = _with_ranks(wide, {k: value[k] for k in many}, few, running(counted(many), ["ranking"], "v"), facts["n"])
    return _correlated(wide, [(names[i], names[j], F.col(f"r{a}"), F.col(f"r{b}")) for i, j, a, b in pairs])


def _with_ranks(wide: DataFrame, value: dict[int, Column], held: list[int], run: DataFrame, n_rows: int) -> DataFrame:
    """r0, r1 ... of each row of wide: those in held are there, those of value come from run (ranking, v, n, before)."""
    rank = run.select("ranking", "v", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("r"))
    common = rank.where(F.col("n") * COMMON > n_rows).select("ranking", "v", F.col("r").alias("__r"))
    first, null = min(value), F.lit(None).cast("double")
    # the first long row of a row carries the ranks it has
    entry = lambda k: F.struct(F.lit(k).alias("ranking"), value[k].alias("v"), *[(F.col(f"r{f}") if k == first else null).alias(f"r{f}") for f in held])
    long = wide.withColumn("row", F.monotonically_increasing_id()).select("row", F.inline(F.array(*map(entry, value)))).where((F.col("ranking") == first) | F.col("v").isNotNull())
    long = long.join(F.broadcast(common), ["ranking", "v"], "left")
    # missing values and common ones have nothing to join: they are dealt out
    long = long.withColumn("part", F.when(F.col("v").isNull() | F.col("__r").isNotNull(), 1 + F.pmod("row", F.lit(PARTS))).otherwise(0).cast("long"))
    # 0, but not a literal: the optimizer would take that out of the keys
    # Spark normalises doubles in keys, which a repartition() by v doesn't match: keys are hashes, and v is compared beside them
    hashed = lambda v: F.xxhash64(F.col(v) + F.lit(0.0)).alias("h")
    long = long.select("*", hashed("v"))
    parts = math.ceil(n_rows * len(value) / TASK_ROWS)
    if parts > 1:
        # adaptive execution puts parts together by their compressed size, however many rows that is; a number that is asked for stays
        long = long.repartition(parts, "ranking", "h", "part")
    # 0, but not a literal: the optimizer would take that out of the keys
    right = rank.select(F.col("ranking").alias("ranking2"), F.col("v").alias("v2"), "r", hashed("v").alias("h2"), F.least("n", F.lit(0)).cast("long").alias("part2"))
    same = (F.col("ranking") == F.col("ranking2")) & (F.col("h") == F.col("h2")) & (F.col("part") == F.col("part2")) & (F.col("v") >= F.col("v2")) & (F.col("v") <= F.col("v2"))
    joined = long.join(right, same, "left").withColumn("r", F.coalesce("__r", "r"))
    if len(value) == 1:
        return joined.withColumnRenamed("r", f"r{first}")
    ranks = [F.max(F.when(F.col("ranking") == k, F.col("r"))).alias(f"r{k}") for k in value]
    return (joined.repartition(parts, "row") if parts > 1 else joined).groupBy("row").agg(*ranks, *[F.max(f"r{f}").alias(f"r{f}") for f in held])


def phi_matrix(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Correlations of the missing flags of pairs of columns."""
    return _correlations(df, {c: C.is_missing(df, c).cast("double") for c in names})


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Bias-corrected Cramér's V of two columns, from their pair counts."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("o"))
    t = pairs.withColumn("ra", F.sum("o").over(Window.partitionBy("a"))).withColumn("cb", F.sum("o").over(Window.partitionBy("b")))
    s = t.agg(F.sum("o").cast("double").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("q"), F.count_distinct("a").cast("double").alias("r"), F.count_distinct("b").cast("double").alias("k"))
    s = s.withColumn("chi2", F.col("n") * (F.col("q") - 1))
    phi = F.greatest(F.lit(0.0), F.col("chi2") / F.col("n") - (F.col("k") - 1) * (F.col("r") - 1) / (F.col("n") - 1))
    rc, kc = F.col("r") - (F.col("r") - 1) ** 2 / (F.col("n") - 1), F.col("k") - (F.col("k") - 1) ** 2 / (F.col("n") - 1)
    low = F.least(rc - 1, kc - 1)
    return s.select(rounded("chi2", 4).alias("chi2"), rounded(F.when(low > 0, F.sqrt(phi / low)).otherwise(0.0)).alias("cramers_v"))


def correlation_ratio(df: DataFrame, group: str, value: str) -> DataFrame:
    """Share of a value's spread that lies between groups, as a root."""
    x = C.finite(df, value)
    g = df.where(x.isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    t = g.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("w"))
    between = F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    return t.select(rounded(F.when(between + F.col("w") > 0, F.sqrt(between / (between + F.col("w")))).otherwise(0.0)).alias("eta"))


def bin_of(x: Column, edges: Sequence[float] | None) -> Column:
    """The number of distinct edges below a value; null for null. x should be a plain column, as each edge repeats it."""
    out = F.when(x.isNull(), None)
    for k, e in enumerate(below := sorted(set(edges or []))):
        out = out.when(x <= e, k)
    return out.otherwise(len(below)).cast("long")


def mutual_information(df: DataFrame, a: str, b: str, bins: int = 10) -> DataFrame:
    """Mutual information of two columns binned by quantiles over the mean of their entropies (geometric)."""
    edges = quantiles(df, [a, b], [i / bins for i in range(1, bins)])
    # rows are dropped before values are binned: a filter on bins would work them out again, from the columns as read
    both = df.select(C.finite(df, a).alias("a"), C.finite(df, b).alias("b")).na.drop()
    p = both.select(bin_of(F.col("a"), edges[a]).alias("a"), bin_of(F.col("b"), edges[b]).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("o"))
    t = p.withColumn("ra", F.sum("o").over(Window.partitionBy("a"))).withColumn("cb", F.sum("o").over(Window.partitionBy("b")))
    n = t.agg(F.sum("o").cast("double").alias("n"))
    t = t.join(F.broadcast(n))  # one row
    s = t.agg(F.sum(F.col("o") / F.col("n") * F.log(F.col("o") * F.col("n") / (F.col("ra") * F.col("cb")))).alias("mi"), F.sum(-F.col("o") / F.col("n") * F.log(F.col("ra") / F.col("n"))).alias("ha"), F.sum(-F.col("o") / F.col("n") * F.log(F.col("cb") / F.col("n"))).alias("hb"))
    h = F.sqrt(F.col("ha") * F.col("hb"))
    return s.select(rounded(F.when(h > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mi") / h))).otherwise(0.0)).alias("nmi"))


def exact_duplicates(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier one and groups of such, over all columns or those named."""
    g = df.groupBy(*[F.col(f"`{c}`") for c in names or df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return g.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("n_duplicates"), F.count(F.when(F.col("__n") > 1, 1)).alias("n_groups"))


def duplicate_keys(df: DataFrame, name: str) -> DataFrame:
    g = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return g.agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("n_rows"))


def entity_conflicts(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """For repeated keys: the share whose attribute is constant, for each attribute."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[(F.min(c) == F.max(c)).alias(f"__s{i}") for i, c in enumerate(names)]).where("__n > 1")
    rows = [F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_keys"), F.count(F.when(~F.col(f"__s{i}"), 1)).alias("n_conflicts")) for i, c in enumerate(names)]
    return g.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def one_to_one(df: DataFrame, a: str, b: str) -> DataFrame:
    """Whether two columns determine each other."""
    p = df.select(F.col(a).alias("a"), F.col(b).alias("b")).na.drop().distinct()
    return p.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("a").alias("n_a"), F.count_distinct("b").alias("n_b")).withColumn("one_to_one", (F.col("n_pairs") == F.col("n_a")) & (F.col("n_pairs") == F.col("n_b")))


def identity(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """How often left equals right, to a millionth of the larger."""
    size = F.greatest(F.abs(left), F.abs(right))
    ok = F.abs(left - right) <= 1e-6 * F.when(size == 0, 1.0).otherwise(size) + 1e-9
    both = left.isNotNull() & right.isNotNull()
    return df.agg(F.count(F.when(both, 1)).alias("n"), F.count(F.when(both & ok, 1)).alias("n_equal"))


def missing_by_group(df: DataFrame, group: str, names: Sequence[str]) -> DataFrame:
    """Missing rates of columns in each group (null is one), one job for all columns."""
    g = F.coalesce(F.col(group).cast("string"), F.lit("<missing>")).alias("level")
    out = df.groupBy(g).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.when(C.is_missing(df, c), 1)).alias(f"m{i}") for i, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("n_missing"), rounded(F.col(f"m{i}") / F.col("n_rows")).alias("missing_ratio")) for i, c in enumerate(names)])
    return out.select("level", "n_rows", F.inline(rows))


def similar_labels(df: DataFrame, name: str, most: int = 2) -> DataFrame:
    """Pairs a < b of distinct labels that at most `most` edits (0 to 2; a swap of neighbours is one) turn into each other.

    Labels meet over what is left of them without up to `most` of their letters: any two so near share such a rest. So labels are joined by
    rests, not each with each, and only pairs that met are compared.
    """
    from ..functions.small import within_edits

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_edits(x, y, most) for x, y in zip(a, b, strict=True)])

    labels = df.where(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("w")).distinct()
    rests = F.array("w")
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    shorter = lambda many: F.flatten(F.transform(many, lambda w: F.when(F.length(w) > 0, without(w)).otherwise(F.array(w))))
    level = rests
    for _ in range(most):
        level = F.array_distinct(shorter(level))
        rests = F.array_union(rests, level)
    met = labels.select("w", F.explode(rests).alias("rest"))
    pairs = met.select(F.col("w").alias("a"), "rest").join(met.select(F.col("w").alias("b"), "rest"), "rest").where("a < b").select("a", "b").distinct()
    return pairs.where(near("a", "b"))
