"""Row samples: uniform by hash, and by gradient size with rescaling; pairs drawn within queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .ranges import running


def uniform(row_id: Column, share: float, seed: int) -> Column:
    """A repeatable mask: the row's hash against the share."""
    return F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(1 << 24)) < F.lit(int(share * (1 << 24)))


def gradient_size(g: Column, h: Column) -> Column:
    return F.sqrt(g * g + 0.1 * h * h)


def threshold(df: DataFrame, share: float, size: Column) -> float:
    """u with sum(min(1, size / u)) = share * rows, from sums over distinct sizes."""
    d = df.groupBy(size.alias("r")).agg(F.count("*").alias("n")).withColumn("mass", F.col("r") * F.col("n"))
    total = df.count()
    want = share * total
    d = running(d, "r", ["mass", "n"], descending=False)
    # with all rows up to r scaled, u = below / (want - rows above); it holds from r to the next size,
    # and as u - r falls with r, that is the largest r that u still reaches
    u = F.col("c_mass") / (F.lit(want) - (F.lit(total) - F.col("c_n")))
    ok = d.withColumn("u", u).where("u >= r").agg(F.max_by("u", "r").alias("u")).first()["u"]
    return float(ok) if ok else 0.0


def gradient_based(df: DataFrame, share: float, seed: int, targets: int = 1) -> DataFrame:
    """Rows kept with probability min(1, size / u), gradients divided by it."""
    g2 = sum((F.col(f"g{t}") * F.col(f"g{t}") for t in range(targets)), F.lit(0.0))
    h2 = sum((F.col(f"h{t}") * F.col(f"h{t}") for t in range(targets)), F.lit(0.0))
    size = F.sqrt(g2 + 0.1 * h2)
    u = threshold(df, share, size)
    p = F.least(F.lit(1.0), size / F.lit(u)) if u else F.lit(1.0)
    draw = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(1 << 24)) / F.lit(float(1 << 24))
    kept = df.withColumn("__p", p).withColumn("in_sample", (draw < F.col("__p")) & (F.col("__p") > 0))
    scaled = {f"{c}{t}": F.when(F.col("in_sample"), F.col(f"{c}{t}") / F.col("__p")).otherwise(0.0) for t in range(targets) for c in "gh"}
    return kept.withColumns(scaled).drop("__p")


DRAW_CELLS = 1 << 20  # draws that a task holds at once
_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def hashed(values: np.ndarray, state: np.ndarray) -> np.ndarray:
    """xxhash64 of Spark over whole numbers, from the hash of the columns before: numbers of
    64 bits as longs, of fewer as ints. The arrays may be of any shapes that fit together."""
    if values.dtype.itemsize == 8:
        h = state + (_P[4] + np.uint64(8)) ^ _rotated(values.astype(np.uint64) * _P[1], 31) * _P[0]
        h = _rotated(h, 27) * _P[0] + _P[3]
    else:
        h = state + (_P[4] + np.uint64(4)) ^ values.astype(np.int32).astype(np.uint32).astype(np.uint64) * _P[0]
        h = _rotated(h, 23) * _P[1] + _P[2]
    h ^= h >> np.uint64(33)
    h *= _P[1]
    h ^= h >> np.uint64(29)
    h *= _P[2]
    h ^= h >> np.uint64(32)
    return h


def drawn_pairs(a: DataFrame, b: DataFrame, k: int, seed: int) -> DataFrame:
    """a joined with b (its columns named with _) within qid: for each row of a the k rows of
    another label with the smallest draws, hashes of both row ids and the seed. Every pair is
    drawn, but in arrays of DRAW_CELLS, so a task holds a query and no list of its pairs."""
    if dict(a.dtypes)["row_id"] not in ("tinyint", "smallint", "int", "bigint"):
        p = a.join(b, "qid").where(F.col("label") != F.col("label_"))
        draw = F.xxhash64("row_id", "row_id_", F.lit(seed))
        return p.withColumn("__n", F.row_number().over(Window.partitionBy("qid", "row_id").orderBy(draw))).where(F.col("__n") <= k).drop("__n")
    twins = [c[:-1] for c in b.columns if c != "qid"]
    last = np.array([seed], np.int32 if -(1 << 31) <= seed < 1 << 31 else np.int64)

    def run(t: pa.Table) -> pa.Table:
        y, ids, first = t["label"].to_numpy(), t["row_id"].to_numpy(), t["__first"].to_numpy().view(np.uint64)
        gone, odd = t["label"].is_null().to_numpy(), np.isnan(y)
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        step = max(1, DRAW_CELLS // max(1, len(y)))
        for at in range(0, len(y), step):
            mine = slice(at, at + step)
            other = (y[mine, None] != y[None]) & ~(odd[mine, None] & odd[None]) & ~(gone[mine, None] | gone[None])
            draw = hashed(last, hashed(ids[None], first[mine, None])).view(np.int64)
            draw[~other] = np.iinfo(np.int64).max
            near = np.argpartition(draw, k - 1, 1)[:, :k] if k < len(y) else np.broadcast_to(np.arange(len(y)), draw.shape)
            row, place = np.nonzero(np.take_along_axis(other, near, 1))
            left.append(row + at)
            right.append(near[row, place])
        one, two = t.drop_columns(["__first"]).take(np.concatenate(left)), t.select(twins).take(np.concatenate(right))
        return pa.table([*one.columns, *two.columns], names=[*one.column_names, *(f"{c}_" for c in twins)])

    schema = StructType([*a.schema.fields, *(f for f in b.schema.fields if f.name != "qid")])
    return a.where("qid IS NOT NULL AND row_id IS NOT NULL").withColumn("__first", F.xxhash64("row_id")).groupBy("qid").applyInArrow(run, schema)
