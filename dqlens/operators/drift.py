"""Operators that compare a reference with a current table. Values are counted by side first, so later steps see distinct values only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .aggregates import exact_quantiles, quantile_row, rounded

FLOOR = 1e-4


def _sides(ref: DataFrame, cur: DataFrame, name: str) -> DataFrame:
    a = ref.select(C.finite(ref, name).alias("v"), F.lit(1).alias("r"), F.lit(0).alias("c"))
    b = cur.select(C.finite(cur, name).alias("v"), F.lit(0).alias("r"), F.lit(1).alias("c"))
    return a.unionByName(b).where("v IS NOT NULL").groupBy("v").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))


def ks_wasserstein(ref: DataFrame, cur: DataFrame, name: str, ranges: int = 64) -> DataFrame:
    """Largest gap of the distribution functions, their area, and that over the reference's interquartile range.

    Running sums go by ranges of values, whose totals are a small table, so no task sorts all of them.
    """
    v = _sides(ref, cur, name)
    edges = v.agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)]).alias("e"), F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    g = v.join(F.broadcast(edges)).withColumn("g", F.size(F.filter("e", lambda e: e < F.col("v")))).drop("e")
    sums = g.groupBy("g").agg(F.sum("r").alias("tr"), F.sum("c").alias("tc"), F.min("v").alias("first"))
    w, before = Window.orderBy("g"), Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    small = sums.select("g", F.coalesce(F.sum("tr").over(before), F.lit(0)).alias("or"), F.coalesce(F.sum("tc").over(before), F.lit(0)).alias("oc"), F.lead("first").over(w).alias("after"))
    inside = Window.partitionBy("g").orderBy("v")
    gap = F.abs((F.col("or") + F.sum("r").over(inside)) / F.col("nr") - (F.col("oc") + F.sum("c").over(inside)) / F.col("nc"))
    t = g.join(F.broadcast(small), "g").select(gap.alias("gap"), (F.coalesce(F.lead("v").over(inside), F.col("after")) - F.col("v")).alias("step"))
    q = quantile_row(ref, [name], (0.25, 0.75), "q").withColumnRenamed("q0", "q").join(F.broadcast(ref.agg(F.stddev_pop(C.finite(ref, name)).alias("s"))))  # one row
    scale = F.when(F.col("q")[1] > F.col("q")[0], F.col("q")[1] - F.col("q")[0]).when(F.col("s") > 0, F.col("s")).otherwise(1.0)
    out = t.agg(F.max("gap").alias("ks"), F.sum(F.col("gap") * F.coalesce("step", F.lit(0.0))).alias("w")).join(F.broadcast(q))
    return out.select(rounded("ks").alias("ks"), rounded("w", 4).alias("wasserstein"), rounded(F.col("w") / scale).alias("wasserstein_scaled"))


def _psi(e: Column, a: Column) -> Column:
    return (a - e) * F.log(a / e)


def _shares(t: DataFrame) -> DataFrame:
    """r and c as shares of their sums, floored and normalised again: a row a bin."""
    s = t.agg(F.sum("r").alias("__nr"), F.sum("c").alias("__nc"))
    u = t.join(F.broadcast(s)).withColumn("e", F.greatest(F.col("r") / F.col("__nr"), F.lit(FLOOR))).withColumn("a", F.greatest(F.col("c") / F.col("__nc"), F.lit(FLOOR)))
    z = u.agg(F.sum("e").alias("__se"), F.sum("a").alias("__sa"))
    return u.join(F.broadcast(z)).select((F.col("e") / F.col("__se")).alias("e"), (F.col("a") / F.col("__sa")).alias("a"))


def numeric_psi(ref: DataFrame, cur: DataFrame, name: str, bins: int = 10) -> DataFrame:
    """Population stability over bins by the reference's deciles, closed on the right, the reference's minimum having its own."""
    edges = exact_quantiles(ref, [name], [i / bins for i in range(bins)]).head().q or []
    k = F.lit(0)
    for x in sorted(set(edges)):
        k = k + F.when(F.col("v") > x, 1).otherwise(0)
    counted = _sides(ref, cur, name).groupBy(k.alias("bin")).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    every = ref.sparkSession.range(len(set(edges)) + 1).select(F.col("id").cast("int").alias("bin"))
    t = every.join(counted, "bin", "left").select(F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("c", F.lit(0)).alias("c"))
    return _shares(t).agg(rounded(F.sum(_psi(F.col("e"), F.col("a")))).alias("psi"))


def label_counts(ref: DataFrame, cur: DataFrame, name: str) -> DataFrame:
    """label, r, c: how often each label occurs on each side."""
    one = lambda d, r: d.select(C.present(d, name).cast("string").alias("label"), F.lit(r).alias("r"), F.lit(1 - r).alias("c"))
    return one(ref, 1).unionByName(one(cur, 0)).where("label IS NOT NULL").groupBy("label").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))


def categorical_drift(ref: DataFrame, cur: DataFrame, name: str) -> DataFrame:
    """Jensen-Shannon divergence in bits, PSI, and the labels that are new or gone."""
    t = label_counts(ref, cur, name)
    s = t.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    u = t.join(F.broadcast(s)).withColumn("p", F.col("r") / F.col("nr")).withColumn("q", F.col("c") / F.col("nc")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    kl = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / F.col("m"))).otherwise(0.0)
    j = u.agg(rounded(F.sum((kl("p") + kl("q")) / 2)).alias("jsd"), F.count(F.when((F.col("r") == 0) & (F.col("c") > 0), 1)).alias("n_unseen"), F.count(F.when((F.col("c") == 0) & (F.col("r") > 0), 1)).alias("n_vanished"), rounded(F.sum(F.when(F.col("r") == 0, F.col("q")).otherwise(0.0))).alias("unseen_share"))
    return j.join(F.broadcast(_shares(t).agg(rounded(F.sum(_psi(F.col("e"), F.col("a")))).alias("psi"))))


def out_of_range(ref: DataFrame, cur: DataFrame, name: str) -> DataFrame:
    lim = ref.agg(F.min(C.finite(ref, name)).alias("lo"), F.max(C.finite(ref, name)).alias("hi"))
    x = C.finite(cur, name)
    return cur.join(F.broadcast(lim)).agg(F.count(x).alias("n"), F.count(F.when((x < F.col("lo")) | (x > F.col("hi")), 1)).alias("n_outside"))


def missingness(ref: DataFrame, cur: DataFrame, names: Sequence[str]) -> DataFrame:
    rate = lambda d, c: rounded(F.avg(C.is_missing(d, c).cast("int")))
    a, b = ref.agg(*[rate(ref, c).alias(f"r{i}") for i, c in enumerate(names)]), cur.agg(*[rate(cur, c).alias(f"c{i}") for i, c in enumerate(names)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"r{i}").alias("reference_ratio"), F.col(f"c{i}").alias("current_ratio")) for i, c in enumerate(names)]
    return a.join(F.broadcast(b)).select(F.inline(F.array(*rows)))
