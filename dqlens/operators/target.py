"""Operators about a target column: classes, and how well each feature alone predicts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .aggregates import rounded, running


def classes(df: DataFrame, target: str) -> DataFrame:
    """Rows and share of each class."""
    g = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("t")))).select("label", "n", rounded(F.col("n") / F.col("t")).alias("share"))


def auc_of_levels(levels: DataFrame) -> DataFrame:
    """The exact area under the curve, ties included, from levels (prediction, pos, neg): no rows are ranked, only levels."""
    p = levels.groupBy(F.lit(0).alias("all"), F.col("prediction").alias("v")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("n"))
    t = running(p, ["all"], "v").agg(F.sum(F.col("pos") * (F.col("before") + F.col("n") / 2)).alias("u"), F.sum("pos").alias("np"), F.sum("n").alias("nn"))
    return t.select(rounded(F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("u") / (F.col("np") * F.col("nn"))), 8).alias("auc"))


def feature_auc(df: DataFrame, level: Column, positive: Column, train: Column) -> DataFrame:
    """How well a feature's levels predict a binary target on the other half: means of levels on one half, the prior for levels not seen there.

    Levels should be bounded: bin a numeric feature first.
    """
    t = df.select(F.coalesce(level.cast("string"), F.lit("<missing>")).alias("level"), positive.cast("int").alias("y"), train.alias("train")).where("y IS NOT NULL AND train IS NOT NULL")
    g = t.groupBy("level").agg(F.avg(F.when(F.col("train"), F.col("y"))).alias("m"), F.count(F.when(~F.col("train") & (F.col("y") == 1), 1)).alias("pos"), F.count(F.when(~F.col("train") & (F.col("y") == 0), 1)).alias("neg"))
    prior = t.agg(F.avg(F.when(F.col("train"), F.col("y"))).alias("prior"))
    return auc_of_levels(g.join(F.broadcast(prior)).select(F.round(F.coalesce("m", "prior"), 12).alias("prediction"), "pos", "neg"))


def missing_auc(df: DataFrame, name: str, positive: Column, train: Column) -> DataFrame:
    return feature_auc(df, C.is_missing(df, name).cast("string"), positive, train)
