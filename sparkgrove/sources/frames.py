"""Feature tables: sources, reserved columns, missing cells, categories, slices, folds.

A feature table is a DataFrame with one double column for each feature and reserved
columns: row_id, label, weight, base_margin, label_lower, label_upper, qid.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESERVED = ("row_id", "label", "weight", "base_margin", "label_lower", "label_upper", "qid")


@dataclass(frozen=True)
class FeatureSpec:
    """Names and types of features and the columns of the side information."""

    features: tuple[str, ...]
    categorical: frozenset[str] = frozenset()
    missing: float = float("nan")
    label: str | tuple[str, ...] | None = "label"
    weight: str | None = None
    qid: str | None = None
    base_margin: str | None = None
    label_lower: str | None = None
    label_upper: str | None = None
    row_id: str | None = None
    feature_weights: tuple[float, ...] | None = None
    categories: dict = field(default_factory=dict, hash=False)


def clean(value: Column, missing: float = float("nan")) -> Column:
    """Null for NaN, null and the missing sentinel."""
    v = value.cast("double")
    gone = v.isNull() | F.isnan(v)
    if missing == missing:
        gone |= v == missing
    return F.when(~gone, v)


def category_table(df: DataFrame, name: str) -> DataFrame:
    """(category, code) in sorted order of a column's values."""
    return df.where(F.col(name).isNotNull()).select(F.col(name).alias("category")).distinct().withColumn("code", (F.row_number().over(Window.orderBy("category")) - 1).cast("double"))


def recode(df: DataFrame, name: str, dictionary: DataFrame) -> DataFrame:
    """The column's values as codes of the dictionary, which is sent to every task (dealt by
    value, the rows of a category would be one task); unseen categories raise."""
    d = dictionary.select(F.col("category").alias(name), F.col("code").alias("__code"))
    out = df.join(F.broadcast(d), name, "left")
    unseen = F.col(name).isNotNull() & F.col("__code").isNull()
    return out.withColumn(name, F.when(unseen, F.raise_error(F.concat(F.lit(f"unseen category of {name}: "), F.col(name).cast("string"))).cast("double")).otherwise(F.col("__code"))).drop("__code")


def prepare(df: DataFrame, spec: FeatureSpec) -> tuple[DataFrame, FeatureSpec]:
    """The feature table of df and the spec with its categories filled in."""
    cats, out = dict(spec.categories), df
    for f in spec.features:
        if dict(df.dtypes)[f] == "string":
            if f not in cats:
                cats[f] = [r["category"] for r in category_table(df, f).orderBy("code").collect()]  # a dictionary, not rows
            out = recode(out, f, df.sparkSession.createDataFrame([(c, float(i)) for i, c in enumerate(cats[f])], "category string, code double"))
    cols = [clean(F.col(f), spec.missing).alias(f) for f in spec.features]
    given = {"label": spec.label, "weight": spec.weight, "qid": spec.qid, "base_margin": spec.base_margin, "label_lower": spec.label_lower, "label_upper": spec.label_upper, "row_id": spec.row_id}
    for k, c in given.items():
        if isinstance(c, (tuple, list)):
            cols.append(F.array(*(F.col(x).cast("double") for x in c)).alias(k))
        elif c and c in df.columns:
            cols.append(F.col(c).alias(k) if k in ("qid", "row_id", "base_margin") or str(dict(df.dtypes)[c]).startswith("array") else F.col(c).cast("double").alias(k))
    if not spec.row_id:
        cols.append(F.monotonically_increasing_id().alias("row_id"))
    if not spec.weight:
        cols.append(F.lit(1.0).alias("weight"))
    spec = replace(spec, categorical=spec.categorical | frozenset(cats), categories=cats)
    return out.select(*cols), spec


def validate(table: DataFrame) -> None:
    """One pass over the side information: finite labels, finite weights of zero or more."""
    tests = []
    if "label" in table.columns and not str(dict(table.dtypes)["label"]).startswith("array"):
        y = F.col("label")
        tests.append((F.isnan(y) | (F.abs(y) == float("inf")), "labels must be finite"))
    if "weight" in table.columns:
        w = F.col("weight")
        tests.append((w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf")), "weights must be finite and not negative"))
    if tests:
        row = table.agg(*(F.max(c.cast("int")).alias(f"t{i}") for i, (c, _) in enumerate(tests))).first()
        for i, (_, why) in enumerate(tests):
            if row[f"t{i}"]:
                raise ValueError(why)


# sources


def from_dense(spark: SparkSession, values, names: list[str] | None = None) -> DataFrame:
    x = np.asarray(values, float)
    names = names or [f"f{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"`{n}` double" for n in names))


def from_long(cells: DataFrame, n_features: int) -> DataFrame:
    """(row, fidx, value) -> one row for each row id, absent cells null."""
    return cells.groupBy(F.col("row").alias("row_id")).agg(*(F.max(F.when(F.col("fidx") == i, F.col("value"))).alias(f"f{i}") for i in range(n_features)))


def from_csr(spark: SparkSession, indptr, indices, values, n_features: int) -> DataFrame:
    row = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    cells = spark.createDataFrame([(int(r), int(c), float(v)) for r, c, v in zip(row, indices, values)], "row long, fidx int, value double")
    return spark.range(len(indptr) - 1).withColumnRenamed("id", "row_id").join(from_long(cells, n_features), "row_id", "left")


def from_csc(spark: SparkSession, indptr, indices, values, n_rows: int) -> DataFrame:
    col = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    cells = spark.createDataFrame([(int(r), int(c), float(v)) for r, c, v in zip(indices, col, values)], "row long, fidx int, value double")
    return spark.range(n_rows).withColumnRenamed("id", "row_id").join(from_long(cells, len(indptr) - 1), "row_id", "left")


def from_array_column(df: DataFrame, column: str, width: int) -> DataFrame:
    """An array or ML vector column as feature columns f0.."""
    if "array" not in dict(df.dtypes)[column]:
        from pyspark.ml.functions import vector_to_array

        df = df.withColumn(column, vector_to_array(column))
    return df.select("*", *(F.col(column)[i].cast("double").alias(f"f{i}") for i in range(width))).drop(column)


def read_text(spark: SparkSession, uri: str) -> DataFrame:
    """path?format=libsvm or path?format=csv (label first); the format must be given."""
    path, _, query = uri.partition("?")
    kind = dict(p.split("=") for p in query.split("#")[0].split("&") if "=" in p).get("format")
    if kind == "csv":
        raw = spark.read.csv(path)
        return raw.select(F.col(raw.columns[0]).cast("double").alias("label"), *(F.col(c).try_cast("double").alias(f"f{i}") for i, c in enumerate(raw.columns[1:])))
    if kind != "libsvm":
        raise ValueError("the URI must name its format: path?format=libsvm or path?format=csv")
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.length(F.col("p")[0]) > 0)
    head, rest = F.split(F.col("p")[0], ":"), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))
    pair = lambda x: F.split(x, ":")
    cells = F.map_from_entries(F.transform(F.filter(rest, lambda x: ~x.startswith("qid:")), lambda x: F.struct(pair(x)[0].cast("int"), pair(x)[1].cast("double"))))
    qid = F.filter(rest, lambda x: x.startswith("qid:"))
    d = parts.select(head[0].cast("double").alias("label"), F.when(F.size(head) > 1, head[1].cast("double")).otherwise(1.0).alias("weight"), F.when(F.size(qid) > 0, pair(F.get(qid, F.lit(0)))[1].cast("long")).alias("qid"), cells.alias("cells"))
    top = d.agg(F.max(F.array_max(F.map_keys("cells"))).alias("n")).first()["n"]
    return d.select("label", "weight", "qid", *(F.try_element_at("cells", F.lit(i)).alias(f"f{i}") for i in range((top or 0) + 1)))


def from_batches(spark: SparkSession, make_batch, n_batches: int, schema: str) -> DataFrame:
    """make_batch(i) -> pandas frame, called on executors; every pass over the result
    calls it again, so it may serve several."""

    def run(frames):
        for f in frames:
            for i in f["id"]:
                yield make_batch(int(i))

    return spark.range(n_batches, numPartitions=max(1, n_batches)).mapInPandas(run, schema)


def save_table(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def to_csr(table: DataFrame, features: list[str]) -> DataFrame:
    """(row_id, fidx, value) of the cells that are there."""
    return table.select("row_id", F.posexplode(F.array(*(F.col(f) for f in features))).alias("fidx", "value")).where("value IS NOT NULL")


def shape(table: DataFrame, features: list[str]) -> DataFrame:
    cells = [F.count(F.col(f)) for f in features]
    return table.agg(F.count("*").alias("num_row"), F.lit(len(features)).alias("num_col"), reduce(lambda a, b: a + b, cells).alias("num_nonmissing"))


# rows


def take_rows(table: DataFrame, ids: DataFrame, allow_groups: bool = False) -> DataFrame:
    """Rows of the given row_ids; tables with query groups must allow it."""
    if "qid" in table.columns and not allow_groups:
        raise ValueError("slicing rows breaks query groups; pass allow_groups=True")
    return table.join(ids.select("row_id"), "row_id", "left_semi")


def groups(table: DataFrame) -> DataFrame:
    return table.groupBy("qid").agg(F.count("*").alias("size"))


def unroll_group_weights(table: DataFrame, weights: DataFrame) -> DataFrame:
    return table.drop("weight").join(weights.select("qid", "weight"), "qid", "left")


def sort_groups(table: DataFrame, partitions: int) -> DataFrame:
    """Whole groups in one partition, sorted, without a global sort."""
    return table.repartition(partitions, "qid").sortWithinPartitions("qid", "row_id")


def stack(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def folds(table: DataFrame, k: int, seed: int = 0, stratified: bool = False) -> DataFrame:
    """A fold number for each row: by group where there are groups, else by id; stratified:
    dealt in turn within each label."""
    key = F.col("qid") if "qid" in table.columns else F.col("row_id")
    if stratified:
        nth = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id"))
        return table.withColumn("fold", F.pmod(nth, F.lit(k)).cast("int"))
    return table.withColumn("fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(k)).cast("int"))


#: kinds of a feature map: indicator, quantity, integer, float, categorical
FEATURE_KINDS = ("i", "q", "int", "float", "c")


def feature_map(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Names and kinds of features, by number, from a file of lines `number name kind`. The
    file is read by Spark; it has one line for each feature."""
    rows = {}
    for r in spark.read.text(path).collect():
        if not (line := r["value"].split()):
            continue
        if len(line) != 3 or not line[0].isdigit() or line[2] not in FEATURE_KINDS:
            raise ValueError(f"not a line of a feature map: {r['value']!r}")
        if int(line[0]) in rows:
            raise ValueError(f"feature {line[0]} is named twice")
        rows[int(line[0])] = (line[1], line[2])
    if sorted(rows) != list(range(len(rows))):
        raise ValueError("feature numbers must run from 0 without gaps")
    return [rows[i][0] for i in range(len(rows))], [rows[i][1] for i in range(len(rows))]
