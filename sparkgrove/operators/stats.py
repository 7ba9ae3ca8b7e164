"""Quantiles, scales and counts of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running


def quantile(df: DataFrame, value: Column, p: float, by: str | None = None) -> DataFrame:
    """Interpolated quantile by the (n + 1) p rule, per group. Equal values are counted
    before they are ordered."""
    keys = [by] if by else []
    g = df.where(value.isNotNull()).groupBy(*keys, value.alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    d = g.withColumns({"n": F.sum("c").over(w), "upto": F.sum("c").over(w.orderBy("v"))})
    x = F.lit(p) * (F.col("n") + 1)
    lo = F.least(F.greatest(F.floor(x), F.lit(1)), F.col("n"))
    hi, part = F.least(lo + 1, F.col("n")), F.greatest(F.least(x - lo, F.lit(1.0)), F.lit(0.0))
    d = d.withColumns({"lo": lo, "hi": hi, "part": part})
    v0, v1 = F.min(F.when(F.col("upto") >= F.col("lo"), F.col("v"))), F.min(F.when(F.col("upto") >= F.col("hi"), F.col("v")))
    return d.groupBy(*keys).agg((v0 + F.max("part") * (v1 - v0)).alias("value"))


def weighted_quantile(df: DataFrame, value: Column, weight: Column, p: float) -> DataFrame:
    """The first value whose cumulative weight reaches p of the total."""
    g = df.groupBy(value.alias("v")).agg(F.sum(weight).alias("w"))
    total = g.agg(F.sum("w").alias("w")).first()["w"] or 0
    return running(g, "v", ["w"], descending=False).agg(F.min(F.when(F.col("c_w") >= F.lit(p * total), F.col("v"))).alias("value"))


def residual_scale(df: DataFrame, residual: Column, weight: Column) -> DataFrame:
    return df.agg(F.pow(F.sum(weight * F.sqrt(F.abs(residual))) / F.sum(weight), 2).alias("scale"))


def count_classes(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.countDistinct(label).alias("classes"))


def ranked(df: DataFrame, k: int | None = None) -> DataFrame:
    """Rank within a query by score, best first, ties by row_id; at most k."""
    d = df.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "row_id")))
    return d.where(F.col("rk") <= k) if k else d
