"""Steps whose tasks must not grow with the number of rows, and the results they keep."""

import duckdb
from pyspark.sql import functions as F

from sparkgrove import catalogue
from sparkgrove.sources import frames

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_leaves_are_sent_to_every_task(spark):
    got = plan(catalogue.QUERIES["leaf_lookup"](spark, SF))
    assert "BroadcastHashJoin" in got and "hashpartitioning" not in got


def test_categories_are_sent_to_every_task(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 0.0), (None, 1.0), ("b", 0.0)], "c string, label double")
    table, spec = frames.prepare(df, frames.FeatureSpec(("c",)))
    assert spec.categories == {"c": ["a", "b"]}
    assert "hashpartitioning" not in plan(table)
    assert sorted((r["c"] is not None, r["c"] or 0.0) for r in table.collect()) == [(False, 0.0), (True, 0.0), (True, 1.0), (True, 1.0)]
    empty, spec = frames.prepare(df.withColumn("c", F.lit(None).cast("string")), frames.FeatureSpec(("c",)))
    assert spec.categories == {"c": []} and empty.where("c IS NULL").count() == 4


def test_early_stop_judges_the_history_it_returns(spark, tmp_path):
    # gains below the sixth place: the full values go on falling, those of the history do not
    rows = spark.range(30_000).select((F.col("id") % 30 + 1).cast("double").alias("l_quantity"), F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax"), F.lit(1).alias("l_partkey"), F.floor(F.col("id") / 30).alias("nth"))
    rows.withColumn("l_returnflag", F.when(F.col("nth") < 300 + F.col("l_quantity") % 3, "R").otherwise("A")).drop("nth").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.QUERIES["train_early_stop"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(catalogue.ORACLE_SQL["train_early_stop"]).fetchall()
    assert len(want) < 8
    assert sorted(tuple(r) for r in got.select("data", "metric", "round", "value").collect()) == sorted(want)


def test_equal_rows_are_counted_and_train_the_same_model(spark, monkeypatch):
    from sparkgrove.plans import train as T

    df = spark.range(6000).select((F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("double")).alias("b"), F.pmod(F.xxhash64(F.col("id") % 700), F.lit(3)).cast("double").alias("label"), (F.col("id") % 2 + 1).cast("double").alias("weight"))
    seen = []

    def runs(params, **kw):
        out = []
        for share in (4, 10**9):
            monkeypatch.setattr(T, "COUNTED_SHARE", share)
            r: dict = {}
            m = T.train(params, df, 2, features=["a", "b"], evals=[(df, "train"), (df.where("a < 3"), "part")], evals_result=r, **kw)
            out.append(([(n.fidx, n.bin, round(n.cover, 6)) for t in m.trees for n in t.nodes], {k: [round(x, 9) for x in v] for s in r.values() for k, v in s.items()}))
        assert out[0] == out[1]

    count = T.counted
    monkeypatch.setattr(T, "counted", lambda d: seen.append(count(d).count()) or count(d))
    runs({"objective": "multi:softprob", "num_class": 3, "max_depth": 2, "eval_metric": ["mlogloss", "merror", "auc"]})
    runs({"objective": "reg:absoluteerror", "max_depth": 2, "tree_method": "approx"})
    runs({"objective": "count:poisson", "booster": "dart", "one_drop": True, "max_depth": 2})
    assert min(seen) < 700 and max(seen) == 6000
    seen.clear()
    runs({"objective": "reg:squarederror", "subsample": 0.5, "max_depth": 2})  # rows are drawn one by one
    runs({"objective": "reg:squarederror", "max_depth": 2}, custom_metric=lambda d: ("rows", float(d.count())))
    assert not seen


def test_drawn_pairs_are_the_smallest_hashes_without_a_list_of_pairs(spark, monkeypatch):
    from pyspark.sql import Window

    from sparkgrove.operators import sampling

    monkeypatch.setattr(sampling, "DRAW_CELLS", 64)  # several blocks a query
    base = spark.range(400).select(F.when(F.col("id") % 40 > 0, F.floor(F.sqrt("id"))).alias("qid"), (F.col("id") * 7919 - 1000).alias("row_id"), F.when(F.col("id") % 11 > 0, (F.col("id") % 3).cast("double")).alias("label"))
    for kind, seed in (("bigint", 0), ("int", -5), ("bigint", 1 << 40), ("string", 3)):
        a = base.withColumn("row_id", F.col("row_id").cast(kind))
        b = a.select("qid", F.col("row_id").alias("row_id_"), F.col("label").alias("label_"))
        nth = F.row_number().over(Window.partitionBy("qid", "row_id").orderBy(F.xxhash64("row_id", "row_id_", F.lit(seed))))
        for k in (2, 50):
            want = a.join(b, "qid").where("label <> label_").withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")
            got = sampling.drawn_pairs(a, b, k, seed)
            assert got.columns == want.columns
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "FlatMapGroupsInArrow" in plan(catalogue.QUERIES["grad_rank_mean"](spark, SF))


def test_cox_sums_few_times_on_the_driver_and_finds_ties_once(spark, monkeypatch):
    from sparkgrove.operators import objectives

    df = spark.range(500).select("id", F.col("id").alias("row_id"), ((F.col("id") * 7 % 23 + 1) * F.when(F.col("id") % 3 > 0, 1).otherwise(-1)).cast("double").alias("label"), (F.col("id") % 13 / 7 - 1).alias("m0"), F.lit(2.0).alias("weight"))
    cox, out = objectives.get("survival:cox"), []
    for most in (1 << 16, 3):
        monkeypatch.setattr(objectives, "DRIVER_TIMES", most)
        for d in (df, cox.fixed(df).persist()):
            got = cox.gradients(d)
            assert got.columns == [*d.columns, "g0", "h0"]
            out.append([(r["id"], round(r["g0"], 9), round(r["h0"], 9)) for r in got.orderBy("id").collect()])
    assert out[0] == out[1] == out[2] == out[3]
    monkeypatch.setattr(objectives, "DRIVER_TIMES", 1 << 16)
    got = plan(cox.gradients(cox.fixed(df).persist()).select("g0"))
    assert "BroadcastHashJoin" in got.split("InMemoryRelation")[0] and "Window" not in got.split("InMemoryRelation")[0]
