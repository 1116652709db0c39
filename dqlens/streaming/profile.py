"""Profiles of streams: mergeable state of each batch, and missing rates by window with late data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C

#: Logarithm of the values that a sketch keeps: up to so many it counts exactly. An estimate under SURE times that many can't be one of more values.
LG_K, SURE = 12, 0.85


def state(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """A row for each column that can be merged with others: rows, missing, count, mean, m2, least, largest, and a sketch of distinct values."""
    rows = []
    for n in names or df.columns:
        num = isinstance(df.schema[n].dataType, T.NumericType)
        x = C.finite(df, n) if num else F.lit(None).cast("double")
        sketch = F.theta_sketch_agg(C.present(df, n).cast("string"), LG_K)
        rows.append(F.struct(F.lit(n).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.count(F.when(C.is_missing(df, n), 1)).alias("n_missing"), F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("least"), F.max(x).alias("largest"), sketch.alias("sketch")))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def merged(states: DataFrame) -> DataFrame:
    """States of parts as one of the whole: means and squared deviations by the parallel formula, sketches by union."""
    total = F.sum("n")
    g = states.groupBy("column_name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"), total.alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")).alias("q"), F.min("least").alias("least"), F.max("largest").alias("largest"), F.theta_union_agg("sketch", LG_K).alias("sketch"))
    mean = F.try_divide("s", "n")
    return g.select("column_name", "n_rows", "n_missing", "n", mean.alias("mean"), F.greatest(F.lit(0.0), F.col("q") - F.col("s") * mean).alias("m2"), "least", "largest", "sketch")


def profile(states: DataFrame) -> DataFrame:
    """What a merged state says of each column; distinct_exact: the number of distinct values is a count, not an estimate."""
    m = merged(states)
    estimate = F.theta_sketch_estimate("sketch")
    return m.select("column_name", "n_rows", "n_missing", F.round("mean", 6).alias("mean"), F.when(F.col("n") > 1, F.round(F.sqrt(F.try_divide(F.col("m2"), F.col("n") - 1)), 6)).alias("std"), "least", "largest", estimate.alias("distinct_estimate"), (estimate <= int(SURE * 2**LG_K)).alias("distinct_exact"))


def follow(stream: DataFrame, path: str, checkpoint: str, names: Sequence[str] | None = None):
    """Starts a query that writes each batch's state to path, once for each batch even after a failure; profile() of those is that of the stream."""

    def write(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            state(batch, names).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def missing_by_window(stream: DataFrame, time: str, names: Sequence[str], window: str = "1 day", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Rows and missing rates by window of event time; rows later than the watermark are left out."""
    w = F.window(F.col(time).cast("timestamp"), window, slide) if slide else F.window(F.col(time).cast("timestamp"), window)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(C.is_missing(stream, n).cast("int")).alias(f"missing_{n}") for n in names]).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_rows", *[f"missing_{n}" for n in names])
