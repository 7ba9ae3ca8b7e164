"""Quantile cuts and bins.

Cuts of a numeric feature: with at most max_bin distinct values, all but the smallest;
else values at evenly spaced weighted ranks; then a sentinel above the largest. Bin of a
value: the first cut strictly greater, clamped to the last. Categories 0..max are bins
themselves. Cuts are a small table (fidx, bin, cut); one grouped pass makes them. Ranks
are exact and weighted at any number of distinct values: beyond a bound the values of a
feature are dealt out by range, and each range adds the weight that stands below it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT_DISTINCT = 1 << 16  # distinct values of a feature up to which one task ranks them


def long(df: DataFrame, features: list[str], weight: str | Column = "weight") -> DataFrame:
    """(fidx, value, w) of the cells that are there."""
    w = F.col(weight) if isinstance(weight, str) else weight
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("fidx"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features))))
    return df.select(cells.alias("c"), w.cast("double").alias("w")).select("c.fidx", "c.value", "w").where("value IS NOT NULL AND w > 0")


def cut_table(df: DataFrame, features: list[str], max_bin: int = 256, weight: str | Column = "weight", categorical: set[str] = frozenset()) -> DataFrame:
    """(fidx, bin, cut) of all features, weighted and exact."""
    cats = {i for i, f in enumerate(features) if f in categorical}
    cells = long(df, features, weight)
    values = cells.groupBy("fidx", "value").agg(F.sum("w").alias("w"))
    # features with more distinct values are ranked in ranges
    sizes = values.groupBy("fidx").agg(F.count("*").alias("n"), F.max("value").alias("top")).collect()
    n, top = {r["fidx"]: r["n"] for r in sizes}, {r["fidx"]: r["top"] for r in sizes}
    large = [i for i in n if n[i] > max(EXACT_DISTINCT, max_bin) and i not in cats]
    parts = [exact_cuts(values.where(~F.col("fidx").isin([*large, *cats])) if large or cats else values, max_bin)]
    if large:
        parts.append(range_cuts(values.where(F.col("fidx").isin(large)), max_bin, sum(n[i] for i in large)))
    spark = df.sparkSession
    rest = [(i, b, float(b + 1)) for i in sorted(cats) for b in range(int(top.get(i, -1)) + 1)] + [(i, 0, 1e-5) for i in range(len(features)) if i not in n and i not in cats]
    if rest:
        parts.append(spark.createDataFrame(rest, "fidx int, bin int, cut double"))
    return reduce(DataFrame.unionByName, parts)


def exact_cuts(values: DataFrame, max_bin: int) -> DataFrame:
    """values(fidx, value, w), distinct -> (fidx, bin, cut)."""
    f = Window.partitionBy("fidx")
    up = f.orderBy("value")
    d = values.withColumns({"nth": F.row_number().over(up), "n": F.count("*").over(f), "cum": F.sum("w").over(up), "total": F.sum("w").over(f), "top": F.max("value").over(f)})
    # a value is picked when a rank query i * total / max_bin falls on it
    step = F.col("total") / max_bin
    first, last = F.ceil((F.col("cum") - F.col("w")) / step), F.ceil(F.col("cum") / step) - 1
    picked = F.when(F.col("n") <= max_bin, F.col("nth") > 1).otherwise((F.col("nth") > 1) & (F.greatest(first, F.lit(1)) <= F.least(last, F.lit(max_bin - 1))))
    inner = d.where(picked).select("fidx", F.col("value").alias("cut"))
    ends = values.groupBy("fidx").agg(F.max("value").alias("top")).select("fidx", (F.col("top") + (F.abs("top") + 1e-5)).alias("cut"))
    return inner.unionByName(ends).select("fidx", (F.row_number().over(Window.partitionBy("fidx").orderBy("cut")) - 1).alias("bin"), "cut")


def range_cuts(values: DataFrame, max_bin: int, size: int) -> DataFrame:
    """exact_cuts of features with more than max_bin values, without one task for a feature.
    The ranges are kept, as a second dealing might draw other bounds."""
    spark = values.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // EXACT_DISTINCT))
    dealt = values.repartitionByRange(n, "fidx", "value").withColumn("part", F.spark_partition_id()).persist()
    sums = dealt.groupBy("fidx", "part").agg(F.sum("w").alias("own"), F.min("value").alias("low"), F.max("value").alias("high"))
    below = Window.partitionBy("fidx").orderBy("part")  # one row for each range
    f = Window.partitionBy("fidx")
    sums = sums.select("fidx", "part", F.coalesce(F.sum("own").over(below.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("below"), F.sum("own").over(f).alias("total"), F.min("low").over(f).alias("low"), F.max("high").over(f).alias("top"))
    inside = Window.partitionBy("fidx", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    d = dealt.withColumn("cum", F.sum("w").over(inside)).join(F.broadcast(sums), ["fidx", "part"]).withColumn("cum", F.col("cum") + F.col("below"))
    step = F.col("total") / max_bin
    first, last = F.ceil((F.col("cum") - F.col("w")) / step), F.ceil(F.col("cum") / step) - 1
    picked = (F.col("value") > F.col("low")) & (F.greatest(first, F.lit(1)) <= F.least(last, F.lit(max_bin - 1)))
    found = {(r["fidx"], r["cut"]) for r in d.where(picked).select("fidx", F.col("value").alias("cut")).collect()}  # at most max_bin values a feature
    found |= {(r["fidx"], r["top"] + (abs(r["top"]) + 1e-5)) for r in sums.select("fidx", "top").distinct().collect()}
    dealt.unpersist()
    by: dict[int, list[float]] = {}
    for i, cut in sorted(found):
        by.setdefault(i, []).append(cut)
    return spark.createDataFrame([(i, b, c) for i, cs in by.items() for b, c in enumerate(cs)], "fidx int, bin int, cut double")


def cut_lists(cuts: DataFrame, n_features: int) -> list[list[float]]:
    """The small table on the driver: at most max_bin values for each feature."""
    got = {r["fidx"]: r["cuts"] for r in cuts.groupBy("fidx").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "cut"))), lambda x: x["cut"]).alias("cuts")).collect()}
    return [got.get(i, [1e-5]) for i in range(n_features)]


def bin_of(value: Column, cuts: list[float], categorical: bool = False) -> Column:
    """Bin of a value, null if missing. Numeric bins are found by halving: log2(bins)
    comparisons in generated code."""
    if categorical:
        return F.least(F.greatest(value.cast("int"), F.lit(0)), F.lit(len(cuts) - 1))
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < cuts[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    if len(cuts) <= 48:
        return F.when(value.isNotNull(), search(0, len(cuts) - 1)).cast("int")
    found = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts[:-1])), lambda c: c <= value))
    return F.when(value.isNotNull(), found).cast("int")


def binned(df: DataFrame, features: list[str], cuts: list[list[float]], categorical: set[str] = frozenset()) -> DataFrame:
    """df with bin columns b0, b1, ... by one vectorised pass over the feature columns."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    import numpy as np
    import pyarrow as pa

    edges = [np.array(c[:-1], float) for c in cuts]
    is_cat = [f in categorical for f in features]

    def run(batches):
        for batch in batches:
            cols = []
            for f, e, cat in zip(features, edges, is_cat):
                c = batch.column(f)
                v = c.cast(pa.float64()).to_numpy(zero_copy_only=False)
                gone = np.isnan(v)
                b = np.clip(np.nan_to_num(v, nan=0).astype(np.int64), 0, len(e)) if cat else np.searchsorted(e, v, "right")
                cols.append(pa.array(b.astype(np.int32), mask=gone))
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *(f"b{i}" for i in range(len(cols)))])

    schema = StructType([*df.schema.fields, *(StructField(f"b{i}", IntegerType()) for i in range(len(features)))])
    return df.mapInArrow(run, schema)
