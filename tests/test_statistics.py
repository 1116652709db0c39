"""Known distributions give known answers."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dqlens import evaluation as E
from dqlens.config import build_config
from dqlens.context import Context
from dqlens.engine import domain_auc
from dqlens.functions.small import within_edits
from dqlens.operators import aggregates as A
from dqlens.operators import drift as D
from dqlens.operators import temporal as T
from dqlens.operators.forest import scored
from dqlens.streaming import profile as P


def test_outlier_rates_on_a_normal_sample(spark):
    d = spark.range(100_000, numPartitions=4).select(F.randn(7).alias("x")).persist()
    z, i, m = (f(d, ["x"]).head().n_outliers for f in (A.zscore_outliers, A.tukey_outliers, A.modified_z_outliers))
    assert abs(z / 1e5 - 0.0027) < 0.0008 and abs(i / 1e5 - 0.0070) < 0.0015 and m / 1e5 < 0.002


def test_drift_of_a_shift(spark):
    a, b, c = (spark.range(20_000).select((F.randn(s) + k).alias("x")) for s, k in ((1, 0), (2, 0), (3, 1)))
    same, moved = D.ks_wasserstein(a, b, "x").head(), D.ks_wasserstein(a, c, "x").head()
    assert same.ks < 0.05 and D.numeric_psi(a, b, "x").head().psi < 0.02
    assert moved.ks > 0.3 and D.numeric_psi(a, c, "x").head().psi > 0.25
    assert abs(moved.wasserstein_scaled - 1 / 1.349) < 0.1 / 1.349


def test_ks_equals_brute_force(spark):
    r = np.random.default_rng(0)
    a, b = r.normal(0, 1, 300).round(1), r.normal(0.3, 1, 200).round(1)
    got = D.ks_wasserstein(*(spark.createDataFrame([(float(v),) for v in x], "x double") for x in (a, b)), "x").head()
    grid = np.unique(np.concatenate([a, b]))
    f, g = (np.searchsorted(np.sort(x), grid, "right") / len(x) for x in (a, b))
    assert abs(got.ks - np.abs(f - g).max()) < 1e-6
    assert abs(got.wasserstein - (np.abs(f - g)[:-1] * np.diff(grid)).sum()) < 1e-4


def test_association(spark):
    d = spark.range(2_000).select((F.col("id") % 5).cast("string").alias("a"), F.pmod(F.xxhash64("id"), F.lit(4)).cast("string").alias("b"), F.col("id").cast("double").alias("x"))
    assert A.cramers_v(d.withColumn("c", F.col("a")), "a", "c").head().cramers_v > 0.99
    assert A.cramers_v(d, "a", "b").head().cramers_v < 0.05
    assert A.correlation_ratio(d.withColumn("y", F.col("a").cast("double")), "a", "y").head().eta > 0.999


def test_change_points():
    r = random.Random(1)
    x = [r.gauss(0, 1) for _ in range(30)] + [r.gauss(5, 1) for _ in range(30)]
    found = T.change_points(x)
    assert any(abs(c["index"] - 30) <= 2 for c in found)
    alarms = sum(bool(T.change_points([r.gauss(0, 1) for _ in range(40)])) for _ in range(300))
    assert alarms / 300 < 0.10
    assert T.spikes([10, 11, 10, 12, 11, 10, 90, 11, 10, 12, 11]) == [6]


def plain_edits(a, b):
    """All edits and swaps of neighbours, by the table of all prefixes."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if a[i - 2 : i] == b[j - 2 : j][::-1] and i > 1 and j > 1:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(0, 3))
def test_edits(a, b, most):
    assert within_edits(a, b, most) == (plain_edits(a, b) <= most)


def test_similar_labels(spark):
    r = random.Random(4)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 7))) for _ in range(60)})
    got = {tuple(x) for x in A.similar_labels(spark.createDataFrame([(w,) for w in [*words, *words, None]], "w string"), "w", 2).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and plain_edits(a, b) <= 2}


@pytest.mark.parametrize("in_one_task", [0, 1_000_000])
def test_quantiles_and_ranks_by_ranges(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(A, "IN_ONE_TASK", in_one_task)
    import pandas as pd

    r = random.Random(6)
    rows = [(None if r.random() < 0.1 else float(r.randrange(40)), r.gauss(0, 1) if r.random() < 0.9 else None, float(i % 7), None) for i in range(500)]
    d, p = spark.createDataFrame(rows, "a double, b double, c double, d double"), pd.DataFrame(rows, columns=list("abcd"), dtype=float)
    probabilities = (0, 0.01, 0.25, 0.5, 0.9, 1)
    got = {x.column_name: x.q for x in A.exact_quantiles(d, list("abcd"), probabilities).collect()}
    assert got["d"] is None
    for c in "abc":
        assert got[c] == pytest.approx([p[c].quantile(q) for q in probabilities])
    assert A.quantiles(d, ["a"], (0.25, 0.5))["a"] == pytest.approx([p.a.quantile(0.25), p.a.median()])
    want = p.corr("spearman")
    for x in A.spearman_matrix(d, list("abcd")).collect():
        assert x.r == (None if x.b == "d" else pytest.approx(want.loc[x.a, x.b], abs=1e-6))


def test_settings_have_bounds():
    for bad in ({"thresholds": {"missing_warning": 1.5}}, {"thresholds": {"imbalance_warning": 0.6}}, {"thresholds": {"temporal_min_periods": 2}}, {"performance": {"sample_rows": 10}}, {"privacy": {"max_examples": 101}}, {"thresholds": {"psi_high": 0.01}}):
        with pytest.raises(ValueError):
            build_config(bad)


def test_outlier_rows(spark):
    rows = [(i, float(i % 10) if i else 1000.0) for i in range(200)]
    d = spark.createDataFrame(rows, "id long, v double")
    got = E.outlier_row_scores(d, spark.createDataFrame([(0, "v")], "id long, column_name string"), "id", ["v"])
    assert {m: dict(c) for m, c in got.items()} == {m: {"found": 1, "quiet": 199} for m in A.MASKS}


def test_forest_finds_the_far_point(spark):
    rows = [(random.Random(i).gauss(0, 1), random.Random(i + 999).gauss(0, 1)) for i in range(300)] + [(9.0, -9.0)]
    top = scored(spark.createDataFrame(rows, "x double, y double"), ["x", "y"]).orderBy(F.desc("score")).first()
    assert (top.x, top.y) == (9.0, -9.0)


def with_copies(spark, n, key):
    """n normal points and n copies of a point whose values hash low."""
    points = lambda rows, seed: spark.range(rows, numPartitions=4).select(F.randn(seed).alias("x"), F.randn(seed + 1).alias("y"))
    low = points(200_000, 21).orderBy(key).first()
    assert abs(low.x) < 5 and abs(low.y) < 5
    return points(n, 31), spark.range(n, numPartitions=4).select(F.lit(low.x).alias("x"), F.lit(low.y).alias("y"))


def test_forest_sees_more_than_the_copies_of_a_row(spark):
    own, copies = with_copies(spark, 25_000, F.xxhash64("x", "y", F.lit(0)))
    d = own.unionByName(copies).unionByName(spark.createDataFrame([(15.0, -15.0)], "x double, y double"))
    top = scored(d, ["x", "y"]).orderBy(F.desc("score")).limit(2).collect()
    assert (top[0].x, top[0].y) == (15.0, -15.0) and top[0].score > top[1].score


def test_sample_holds_copies_by_their_share(spark):
    own, copies = with_copies(spark, 20_000, F.pmod(F.xxhash64("x", "y", F.lit(0)), F.lit(1_000_000)))
    x = Context(copies.unionByName(own), build_config(None, performance={"sample_rows": 1_000}))
    frame = x.sample.toPandas()
    x.close()
    assert len(frame) == 1_000 and 0.4 < frame.duplicated(keep=False).mean() < 0.6


def test_domain_classifier_sees_more_than_the_copies_of_a_row(spark):
    own, copies = with_copies(spark, 25_000, F.xxhash64("x", "y"))
    a, b = (Context(copies.unionByName(d), build_config(None)) for d in (own, own.withColumn("x", F.col("x") + 6)))
    auc = domain_auc(a, b, ["x", "y"])
    a.close(), b.close()
    assert auc > 0.7


def test_sketch_and_merge(spark):
    d = spark.range(20_000).select("id", (F.col("id") % 97).cast("double").alias("v"))
    parts = P.state(d.where("id % 3 = 0")).unionByName(P.state(d.where("id % 3 > 0")))
    got = {r.column_name: r for r in P.profile(parts).collect()}
    one = d.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).head()
    assert abs(got["v"].mean - one.m) < 1e-5 and abs(got["v"].std - one.s) < 1e-5
    assert abs(got["id"].distinct_estimate - 20_000) < 1_000 and abs(got["v"].distinct_estimate - 97) <= 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=30))
def test_median_is_between(x):
    assert min(x) <= T.median(x) <= max(x)


@pytest.fixture
def reads(spark):
    """A function that gives the most records and bytes that one task has read from shuffles since the last call; shuffles have 64 parts."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(keep, ("64", "false", "-1"), strict=True):
        spark.conf.set(k, v)
    sc, jvm, seen = spark.sparkContext, spark.sparkContext._jvm, set()

    def most():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        store, records, size = sc._jsc.sc().statusStore(), 0, 0
        stages = store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        for s in (stages.apply(i) for i in range(stages.size())):
            if s.stageId() in seen or s.shuffleReadRecords() == 0:
                continue
            tasks = store.taskList(s.stageId(), s.attemptId(), 10_000)
            for m in (tasks.apply(i).taskMetrics().get().shuffleReadMetrics() for i in range(tasks.size())):
                records, size = max(records, m.recordsRead()), max(size, m.localBytesRead() + m.remoteBytesRead())
            seen.add(s.stageId())
        return records, size

    most()
    yield most
    for k, v in keep.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("few", [0, 10_000])
def test_no_task_ranks_all_rows_of_a_value(spark, monkeypatch, reads, few):
    monkeypatch.setattr(A, "FEW", few, raising=False)
    rows = spark.range(20_000, numPartitions=8).select(F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.rand(3)).alias("a"), F.when(F.col("id") % 3 > 0, F.rand(4)).alias("b"), (F.col("id") % 2).cast("double").alias("c"))
    p = rows.toPandas()
    reads()
    got = A.spearman_matrix(rows, list("abc")).collect()
    assert reads()[0] < 5_000  # half of the rows have a = 0
    want = p.corr("spearman")
    assert len(got) == 3 and all(x.r == pytest.approx(want.loc[x.a, x.b], abs=1e-6) for x in got)
    assert [x.n for x in got] == [13_333, 20_000, 13_333]


def test_long_rows_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(A, "FEW", 0)
    monkeypatch.setattr(A, "TASK_ROWS", 300)
    rows = spark.range(3_000).select(F.rand(3).alias("a"), F.when(F.col("id") % 3 > 0, F.rand(4)).alias("b"), (F.col("id") % 2).cast("double").alias("c"))
    want = rows.toPandas().corr("spearman")
    got = A.spearman_matrix(rows, list("abc"))
    assert all(x.r == pytest.approx(want.loc[x.a, x.b], abs=1e-6) for x in got.collect())


def test_forest_scaling_reads_each_value_once(spark, monkeypatch, reads):
    import dqlens.operators.forest as forest

    monkeypatch.setattr(forest, "SAMPLE", 1_000)
    d = spark.range(160_000, numPartitions=32).select((F.col("id") % 5_000 / F.lit(7.0)).alias("x"), (F.col("id") % 3).cast("double").alias("y"), F.when(F.col("id") % 9 > 0, 1.0).otherwise(float("inf")).alias("z"))
    reads()
    top = scored(d, ["x", "y"])
    assert reads()[1] < 200_000  # 32 tasks with 5,000 values each
    assert top.columns == ["x", "y", "score"]
    value = lambda t, c: F.col(c)
    q = A.quantiles(d, ["x", "z"], (0.25, 0.5, 1), value)
    assert q == {c: d.agg(F.percentile(c, F.array(*map(F.lit, (0.25, 0.5, 1.0)))).alias("q")).head().q for c in "xz"} and q["z"][2] == float("inf")


def test_mutual_information_counts_values_once(spark, reads):
    d = spark.range(80_000, numPartitions=16).select((F.col("id") % 5_000 / F.lit(7.0)).alias("x"), F.when(F.col("id") % 9 > 0, F.pmod(F.xxhash64("id"), F.lit(5_000)) / F.lit(3.0)).alias("y"))
    reads()
    assert A.mutual_information(d, "x", "x").head().nmi == 1 and A.mutual_information(d, "x", "y").head().nmi < 0.01
    assert reads()[1] < 250_000  # 16 tasks with 5,000 values of each column
    bins = spark.createDataFrame([(None,), (1.0,), (1.5,), (2.0,), (3.0,)], "v double").select(A.bin_of(F.col("v"), [1.0, 2.0, 2.0]).alias("b"))
    assert [r.b for r in bins.collect()] == [None, 0, 1, 1, 2]
