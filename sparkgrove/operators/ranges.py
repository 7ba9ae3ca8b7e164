"""Running sums and places over all rows without one task that holds them.

Rows are dealt into ranges of a numeric key by fixed bounds (quantiles, taken once on the
driver), so a row's range depends on its key alone, whatever Spark recomputes. Each
range sums its own rows and adds what the ranges before it hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounds(df: DataFrame, key: str, n: int | None = None) -> list[float]:
    """Distinct upper bounds of about n ranges of key; few rows give fewer."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = df.select(F.col(key).cast("double").alias("k")).stat.approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    return sorted(set(found))


def part_of(key: Column, cuts: list[float]) -> Column:
    """The number of bounds below the key; null keys come first, NaN last."""
    if not cuts:
        return F.lit(0)
    above = reduce(lambda a, b: a + b, (F.when(key.cast("double") > F.lit(c), 1).otherwise(0) for c in cuts)) if len(cuts) <= 64 else F.size(F.filter(F.lit(cuts), lambda c: c < key.cast("double")))
    return F.when(key.isNull(), 0).otherwise(above)


def running(df: DataFrame, key: str, sums: list[str], descending: bool = True, then: tuple[str, ...] = ()) -> DataFrame:
    """df with c_<name>: the sums of all rows up to and with the row, in the order of
    key (and `then`, ascending); rows that are equal in these are taken one by one."""
    cuts = bounds(df, key)
    d = df.withColumn("__part", part_of(F.col(key), cuts))
    own = F.desc(key) if descending else F.asc(key)
    inside = Window.partitionBy("__part").orderBy(own, *then).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(F.desc("__part") if descending else F.asc("__part")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    parts = d.groupBy("__part").agg(*(F.sum(c).alias(f"__{c}") for c in sums)).select("__part", *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums))
    d = d.withColumns({f"c_{c}": F.sum(c).over(inside) for c in sums}).join(F.broadcast(parts), "__part")  # as many rows as ranges
    return d.withColumns({f"c_{c}": F.col(f"c_{c}") + F.col(f"__{c}") for c in sums}).drop("__part", *(f"__{c}" for c in sums))


def places(df: DataFrame, key: Column, row_id: str, name: str = "place") -> DataFrame:
    """df with the place (from 1) of each row in the order of key, then row_id. Rows that
    share a key are dealt on by ranges of row_id, so a common key is no single task."""
    d = df.withColumns({"__key": key, "__one": F.lit(1)})
    d = counted_ties(d, "__key", row_id, {"__tie": F.col("__one")})
    g = d.groupBy(F.col("__key").alias("__place_key")).agg(F.count("*").alias("n"))
    g = running(g, "__place_key", ["n"], descending=False).select("__place_key", (F.col("c_n") - F.col("n")).alias("__before"))
    return d.join(g, F.col("__key").eqNullSafe(F.col("__place_key"))).withColumn(name, F.col("__before") + F.col("__tie")).drop("__place_key", "__key", "__one", "__tie", "__before")


def counted_ties(df: DataFrame, key: str, row_id: str, values: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of its value over the rows of the same key up to
    and with this one, in the order of row_id."""
    d = df.withColumns({"__tie_bucket": part_of(F.col(row_id), bounds(df, row_id)), **{f"{n}_v": v for n, v in values.items()}})
    inside = Window.partitionBy(key, "__tie_bucket").orderBy(row_id).rowsBetween(Window.unboundedPreceding, 0)
    parts = d.groupBy(F.col(key).alias("__tie_key"), F.col("__tie_bucket").alias("__tie_part")).agg(*(F.sum(f"{n}_v").alias(f"{n}_s") for n in values))
    before = Window.partitionBy("__tie_key").orderBy("__tie_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    parts = parts.select("__tie_key", "__tie_part", *(F.coalesce(F.sum(f"{n}_s").over(before), F.lit(0)).alias(f"{n}_p") for n in values))
    d = d.withColumns({n: F.sum(f"{n}_v").over(inside) for n in values})
    d = d.join(parts, F.col(key).eqNullSafe(F.col("__tie_key")) & (F.col("__tie_bucket") == F.col("__tie_part")))
    return d.withColumns({n: F.col(n) + F.col(f"{n}_p") for n in values}).drop("__tie_key", "__tie_part", "__tie_bucket", *(f"{n}_{x}" for n in values for x in "vp"))
