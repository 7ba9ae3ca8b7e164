"""Every query that has an SQL twin gives the same rows at the smallest size."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkgrove import catalogue
from sparkgrove.catalogue import fixed_model
from sparkgrove.streaming.score import refit_batches, scored, windowed_accuracy

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_twins(spark, sql, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = sql.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a = sorted([tuple(plain(r[c]) for c in cols) for r in got.collect()], key=str)
    b = sorted([tuple(plain(dict(zip(want.columns, r))[c]) for c in cols) for r in want.fetchall()], key=str)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=2e-6) if all(isinstance(v, float) for v in x) else [str(v) for v in x] == [str(v) for v in y]


def test_streams(spark, tmp_path):
    schema = "l_quantity double, l_tax double, l_line double, at timestamp, y double"
    spark.range(50).select((F.col("id") % 40).cast("double").alias("l_quantity"), F.lit(0.05).alias("l_tax"), (F.col("id") % 6).cast("double").alias("l_line"), F.timestamp_seconds(F.col("id") * 10).alias("at"), (F.col("id") % 2).cast("double").alias("y")).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    out = windowed_accuracy(scored(source, fixed_model()), "at", "y", "100 seconds", "1 minute")
    q = out.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(rows) AS n FROM windows").first()["n"] == 50
    seen = []
    start = fixed_model()
    start.trees, start.features = [], ["l_quantity", "l_tax"]
    r = refit_batches(source.select("l_quantity", "l_tax", F.col("y").alias("label")), start, {"objective": "binary:logistic", "max_depth": 1}, 1, seen.append, f"{tmp_path}/state")
    r.awaitTermination()
    assert len(seen) == 1 and seen[0].rounds() == 1
