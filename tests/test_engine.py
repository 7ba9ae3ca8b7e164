"""The engine against golden values, plain formulas and invariants."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgrove import config, ml
from sparkgrove import params as P
from sparkgrove.catalogue import fixed_model
from sparkgrove.operators import cuts, metrics, objectives, sampling, splits
from sparkgrove.plans.model import Model
from sparkgrove.plans.train import Callback, EarlyStopping, LearningRates, cv, train
from sparkgrove.plans.update import prune, refresh
from sparkgrove.sources import frames

P4 = [0.0, 0.1, 0.9, 1.0] * 2
# Fixed values: (objective, parameters, margins, labels, g, h)
GOLDEN = [
    ("reg:squaredlogerror", {}, [0.1, 0.2, 0.4, 0.8, 1.6], [1.0] * 5, [-0.5435, -0.4257, -0.25475, -0.05855, 0.1009], [1.3205, 1.0492, 0.69215, 0.34115, 0.1091]),
    ("reg:logistic", {}, P4, [0] * 4 + [1] * 4, [0.5, 0.52, 0.71, 0.73, -0.5, -0.47, -0.28, -0.26], [0.25, 0.24, 0.20, 0.19] * 2),
    ("count:poisson", {}, [-2, -1, 0, 1] * 2, [0, 0, 0, 0, 1, 2, 3, 4], [0.14, 0.37, 1, 2.71, -0.86, -1.63, -2, -1.28], [0.068, 0.184, 0.5, 1.359, 0.568, 1.184, 2, 3.359]),
    ("reg:gamma", {}, P4, [2] * 4 + [1] * 4, [-1, -0.809, 0.187, 0.264, 0, 0.09, 0.59, 0.63], [2, 1.809, 0.813, 0.735, 1, 0.90, 0.40, 0.36]),
    ("reg:tweedie", {"tweedie_variance_power": 1.1}, P4, [0] * 4 + [1] * 4, [1, 1.09, 2.24, 2.45, 0, 0.10, 1.33, 1.55], [0.89, 0.98, 2.02, 2.21, 1, 1.08, 2.11, 2.30]),
    ("survival:cox", {}, P4, [0, -2, -2, 2, 3, 5, -10, 100], [0, 0, 0, -0.799, -0.788, -0.590, 0.910, 1.006], [0, 0, 0, 0.160, 0.186, 0.348, 0.610, 0.639]),
    ("reg:pseudohubererror", {}, [0.1, 0.2, 0.4, 0.8, 1.6], [1.0] * 5, [-0.668965, -0.624695, -0.514496, -0.196116, 0.514496], [0.410660, 0.476140, 0.630510, 0.942866, 0.630510]),
    ("binary:hinge", {}, [-1, -0.5, 0.5, 1] * 2, [0] * 4 + [1] * 4, [0, 1, 1, 1, -1, -1, -1, 0], [0, 1, 1, 1, 1, 1, 1, 0]),
    ("reg:expectileerror", {"expectile_alpha": [0.8]}, [1, 2, 3], [3, 2, 1], [-1.6, 0, 0.4], [0.8, 0.2, 0.2]),
]


@pytest.mark.parametrize("case", GOLDEN, ids=lambda c: c[0])
def test_gradients(spark, case):
    name, params, m, y, g, h = case
    df = spark.createDataFrame([(i, float(a), float(b), 1.0) for i, (a, b) in enumerate(zip(m, y))], "row_id long, m0 double, label double, weight double")
    got = objectives.get(name, P.resolve({"objective": name} | params)).gradients(df).orderBy("row_id").collect()
    assert [r["g0"] for r in got] == pytest.approx(g, abs=0.011)
    assert [r["h0"] for r in got] == pytest.approx(h, abs=0.011)


def test_softmax_gradients(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0, 2.0, 1.0, 1.0), (1, 2.0, 0.0, 1.0, 0.0, 1.0)], "row_id long, m0 double, m1 double, m2 double, label double, weight double")
    got = objectives.get("multi:softprob", P.resolve({"num_class": 3})).gradients(df).orderBy("row_id").collect()
    assert [r[f"g{k}"] for r in got for k in range(3)] == pytest.approx([0.24, -0.91, 0.66, -0.33, 0.09, 0.24], abs=0.01)
    assert [r[f"h{k}"] for r in got for k in range(3)] == pytest.approx([0.36, 0.16, 0.44, 0.45, 0.16, 0.37], abs=0.01)


@pytest.mark.parametrize(("dist", "want"), [
    ("normal", [-3.9120, -3.4013, -2.8905, -2.3798, -1.8691, -1.3583]), ("logistic", [-0.9608, -0.9355, -0.8948, -0.8305, -0.7327, -0.5910]), ("extreme", [-15, -15, -15, -9.8028, -5.4822, -2.8897])])
def test_aft_gradients(spark, dist, want):
    grid = [math.log(2.0 ** (1 + 14 * i / 19)) for i in range(6)]
    df = spark.createDataFrame([(i, m, 100.0, 100.0, 1.0) for i, m in enumerate(grid)], "row_id long, m0 double, label_lower double, label_upper double, weight double")
    got = objectives.get("survival:aft", P.resolve({"aft_loss_distribution": dist})).gradients(df).orderBy("row_id").collect()
    assert [r["g0"] for r in got] == pytest.approx(want, abs=2e-4)


def test_aft_censored(spark):
    grid = [math.log(2.0 ** (1 + 14 * i / 19)) for i in range(6)]
    o = objectives.get("survival:aft", P.resolve({"aft_loss_distribution": "logistic"}))
    left = o.gradients(spark.createDataFrame([(m, 0.0, 20.0, 1.0) for m in grid], "m0 double, label_lower double, label_upper double, weight double")).orderBy("m0").collect()
    assert [r["g0"] for r in left] == pytest.approx([0.0909, 0.1428, 0.2174, 0.3164, 0.4355, 0.5625], abs=2e-4)
    assert [r["h0"] for r in left] == pytest.approx([0.0826, 0.1224, 0.1701, 0.2163, 0.2458, 0.2461], abs=2e-4)
    right = o.gradients(spark.createDataFrame([(m, 60.0, None, 1.0) for m in grid], "m0 double, label_lower double, label_upper double, weight double")).orderBy("m0").collect()
    assert [r["g0"] for r in right] == pytest.approx([-0.9677, -0.9474, -0.9153, -0.8663, -0.7955, -0.7000], abs=2e-4)


def test_rank_gradients(spark):
    rows = [(0, 0, 0.0, 0.0, 2.0), (1, 0, 0.1, 1.0, 2.0), (2, 1, 0.0, 0.0, 0.0), (3, 1, 0.1, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "row_id long, qid long, m0 double, label double, weight double")
    got = objectives.get("rank:ndcg", P.resolve({"objective": "rank:ndcg"})).gradients(df).orderBy("row_id").collect()
    assert [r["g0"] for r in got] == pytest.approx([2.06611, -2.06611, 0, 0], abs=1e-4)
    assert [r["h0"] for r in got] == pytest.approx([2.169331, 2.169331, 0, 0], abs=1e-4)
    got = objectives.get("rank:map", P.resolve({"objective": "rank:map"})).gradients(df.withColumn("weight", F.lit(2.0))).orderBy("row_id").collect()
    assert [r["g0"] for r in got] == pytest.approx([1.2054923, -1.2054923] * 2, abs=1e-4)
    assert [r["h0"] for r in got] == pytest.approx([1.2657166] * 4, abs=1e-4)


# Fixed values: (metric, predictions, labels, weights, value)
SCORES = [
    ("rmse", [0.1, 0.9, 0.1, 0.9], [0, 0, 1, 1], None, 0.6403), ("rmse", [0.1, 0.9, 0.1, 0.9], [0, 0, 1, 1], [1, 2, 9, 8], 0.6708), ("logloss", [0.1, 0.9, 0.1, 0.9], [0, 0, 1, 1], None, 1.2039),
    ("logloss", [0.1, 0.9, 0.1, 0.9], [0, 0, 1, 1], [1, 2, 9, 8], 1.3138), ("mphe", [0.1, 0.9, 0.1, 0.9], [0, 0, 1, 1], None, 0.1751), ("poisson-nloglik", [0.1, 0.9, 0.1, 0.9], [0, 0, 1, 1], None, 1.1019),
    ("mae", [0.1, 0.9, 0.1, 0.9], [0, 0, 1, 1], None, 0.5), ("mape", [50, 400, 500, 4000], [100, 200, 500, 1000], None, 1.125), ("error", [0.1, 0.9, 0.1, 0.9], [0, 0, 1, 1], [1, 2, 9, 8], 0.55),
    ("auc", [1, 0, 0], [0, 0, 1], None, 0.25), ("auc", [0.9, 0.1, 0.4, 0.3], [0, 0, 1, 1], [1, 3, 2, 4], 0.75), ("ndcg", [0.1, 0.9, 0.1, 0.9], [0, 0, 1, 1], None, 0.6509), ("ndcg@2", [0.1, 0.9, 0.1, 0.9], [0, 0, 1, 1], None, 0.3868),
    ("map", [0.1, 0.9, 0.1, 0.9], [0, 0, 1, 1], None, 0.5), ("pre@4", [0.2, 0.3, 0.4, 0.5, 0.6, 0.7], [0, 1, 0, 0, 1, 1], None, 0.5),
]


@pytest.mark.parametrize("case", SCORES, ids=lambda c: c[0])
def test_metrics(spark, case):
    name, p, y, w, want = case
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(p, y, w or [1] * len(p)))], "row_id long, p0 double, label double, weight double")
    assert metrics.value(name, df)[1] == pytest.approx(want, abs=1e-4)


def test_metric_names():
    assert metrics.parse("ndcg@5-") == ("ndcg", "5", True) and metrics.parse("error@0.3") == ("error", "0.3", False)
    assert metrics.maximised("auc") and metrics.maximised("map@3") and not metrics.maximised("mape") and not metrics.maximised("rmse")
    with pytest.raises(ValueError):
        metrics.parse("nonsense")


def table(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(3)
    y = (x[:, 0] * 2 + np.abs(x[:, 1]) + rng.normal(size=n) * 0.2).round(4)
    y = y + 1.5 * ((np.abs(x[:, 2]) * 3).astype(int) % 6 == 2)
    rows = [(i, float(a), float(b) if i % 9 else None, float(int(abs(c) * 3) % 6), float(t), float(t > 1.0)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, label double, z double").repartition(3).cache()


def test_training_lowers_the_loss(spark):
    df = table(spark)
    for params in ({"max_depth": 3}, {"tree_method": "approx", "max_depth": 2}, {"tree_method": "exact", "max_depth": 2}, {"grow_policy": "lossguide", "max_leaves": 5}, {"booster": "gblinear", "learning_rate": 0.5}, {"objective": "reg:absoluteerror", "max_depth": 2}):
        r = {}
        train(params, df, 3, features=["a", "b", "c"], evals=[(df, "train")], evals_result=r)
        v = next(iter(r["train"].values()))
        assert all(b <= a + 1e-9 for a, b in zip(v, v[1:])), params


def test_margins_agree(spark):
    df = table(spark)
    spec = frames.FeatureSpec(("a", "b", "c"), frozenset(["c"]), row_id="row_id")
    m = train({"max_depth": 4, "max_cat_to_onehot": 2}, df, 3, spec)
    d = frames.prepare(df, spec)[0]
    rows = m.with_margin(d).orderBy("row_id").toPandas()
    x = rows[["a", "b", "c"]].to_numpy(float)
    assert rows["m0"].to_numpy() == pytest.approx(m.numpy_margin(x, np.tile(m.base, (len(x), 1)))[:, 0])
    for approximate in (True, False):
        c = np.array(m.contributions(d, approximate).orderBy("row_id").toPandas()["c0"].tolist())
        assert c.sum(1) == pytest.approx(rows["m0"].to_numpy())
    again = Model.from_json(m.to_json())
    assert again.numpy_margin(x, np.tile(m.base, (len(x), 1)))[:, 0] == pytest.approx(rows["m0"].to_numpy())
    inter = m.numpy_interactions(x[:20], np.tile(m.base, (20, 1)))
    assert inter.sum(-1) == pytest.approx(m.numpy_shap(x[:20], np.tile(m.base, (20, 1)))) and np.allclose(inter, inter.transpose(0, 1, 3, 2))
    assert any(n.is_cat for t in m.trees for n in t.nodes)


def test_shap_against_subsets():
    m = fixed_model()
    x = np.array([[10.0, np.nan, 2.0], [30.0, 0.02, 1.0], [30.0, 0.05, 5.0]])
    got = m.numpy_shap(x, np.tile(m.base, (3, 1)))[:, 0]

    def value(row, known):
        total = 0.0
        for t in m.trees:
            def walk(n):
                node = t.nodes[n]
                if node.is_leaf:
                    return node.leaf[0] * t.weight
                l, r = t.nodes[node.left].cover, t.nodes[node.right].cover
                if node.fidx not in known:
                    return (walk(node.left) * l + walk(node.right) * r) / (l + r)
                v = row[node.fidx]
                right = (int(v) in node.cats if node.is_cat else v >= node.cond) if v == v else not node.default_left
                return walk(node.right if right else node.left)
            total += walk(0)
        return total

    from itertools import combinations
    for row, c in zip(x, got):
        for i in range(3):
            rest = [j for j in range(3) if j != i]
            want = sum(math.factorial(k) * math.factorial(2 - k) / 6 * (value(row, {*s, i}) - value(row, set(s))) for k in range(3) for s in combinations(rest, k))
            assert c[i] == pytest.approx(want)


def test_distributed_search_agrees(spark, monkeypatch):
    df = table(spark)
    a = train({"max_depth": 3}, df, 1, features=["a", "b", "c"])
    monkeypatch.setattr("sparkgrove.plans.grow.DRIVER_CELLS", 0)
    b = train({"max_depth": 3}, df, 1, features=["a", "b", "c"])
    assert [(n.fidx, n.bin, n.default_left) for n in a.trees[0].nodes] == [(n.fidx, n.bin, n.default_left) for n in b.trees[0].nodes]


def test_constraints(spark):
    df = table(spark)
    m = train({"max_depth": 4, "monotone_constraints": [1, 0, 0], "interaction_constraints": [[0], [1, 2]]}, df, 2, features=["a", "b", "c"])
    grid = np.array([[v, 0.3, 1.0] for v in np.linspace(-3, 3, 61)])
    assert (np.diff(m.numpy_margin(grid, np.tile(m.base, (61, 1)))[:, 0]) >= -1e-12).all()
    for t in m.trees:
        for n in t.leaves():
            path = set()
            while t.nodes[n].parent >= 0:
                n = t.nodes[n].parent
                path.add(t.nodes[n].fidx)
            assert path <= {0} or path <= {1, 2}


def test_control(spark):
    df = table(spark)
    seen = []

    class Stop(Callback):
        def after_iteration(self, model, round_, history):
            seen.append(round_)
            return round_ == 1

    m = train({"max_depth": 2}, df, 5, features=["a", "b", "c"], evals=[(df, "t")], callbacks=[Stop(), LearningRates([0.5, 0.1, 0.1, 0.1, 0.1])])
    assert seen == [0, 1] and m.rounds() == 2 and m[0:1].rounds() == 1
    more = train({"max_depth": 2}, df, 1, features=["a", "b", "c"], init_model=m)
    assert more.rounds() == 3
    stop = EarlyStopping(1, save_best=True)
    r = {}
    m = train({"max_depth": 1, "learning_rate": 1.9}, df, 6, features=["a", "b", "c"], evals=[(df, "t")], evals_result=r, callbacks=[stop])
    assert m.best_iteration == int(np.argmin(r["t"]["rmse"][: m.best_iteration + 2]))
    out = cv({"max_depth": 2}, df, 2, nfold=2, features=["a", "b", "c"])
    assert len(out) == 2 and out[1]["test-rmse-mean"] <= out[0]["test-rmse-mean"] and out[0]["train-rmse-std"] >= 0


def test_update_and_prune(spark):
    df = table(spark)
    m = train({"max_depth": 3}, df, 1, features=["a", "b", "c"])
    d = m.objective.gradients(frames.prepare(df, frames.FeatureSpec(("a", "b", "c"), row_id="row_id"))[0].withColumn("m0", F.lit(m.base[0])))
    again = refresh(m.trees[0], m.features, d, P.resolve({}))
    assert [n.cover for n in again.nodes] == pytest.approx([n.cover for n in m.trees[0].nodes])
    assert [n.leaf[0] for n in again.nodes if n.is_leaf] == pytest.approx([n.leaf[0] for n in m.trees[0].nodes if n.is_leaf])
    assert prune(m.trees[0], P.resolve({"gamma": 1e9})).nodes[0].is_leaf
    u = train({"process_type": "update", "updater_seq": "refresh,prune"}, df, 1, features=["a", "b", "c"], init_model=m)
    assert len(u.trees) == 1


def test_samples(spark):
    df = spark.range(4000).select(F.col("id").alias("row_id"), (F.col("id") % 17 / 10 - 0.5).alias("g0"), F.lit(0.3).alias("h0"))
    assert 0.25 < df.where(sampling.uniform(F.col("row_id"), 0.3, 1)).count() / 4000 < 0.35
    got = sampling.gradient_based(df, 0.3, 5)
    assert got.where("in_sample").count() == pytest.approx(1200, abs=120)
    assert got.agg(F.sum("h0")).first()[0] == pytest.approx(1200, rel=0.15)


def test_cuts(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 4000, 3000) / 7
    df = spark.createDataFrame([(float(x), 1.0) for x in v], "x double, weight double")
    got = cuts.cut_lists(cuts.cut_table(df, ["x"], 32), 1)[0]
    assert len(got) <= 32 and got == sorted(got) and got[-1] > v.max()
    n = np.bincount(np.searchsorted(got[:-1], v, "right"))
    assert n.max() < 3 * len(v) / 32
    b = df.select("x", cuts.bin_of(F.col("x"), got).alias("b")).toPandas()
    assert (b["b"].to_numpy() == np.searchsorted(got[:-1], b["x"].to_numpy(), "right")).all()


def test_frames(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 qid:3 1:0.5 4:2\n0:2.5 qid:4 2:1\n")
    rows = frames.read_text(spark, f"{tmp_path}/a.txt?format=libsvm").orderBy("qid").collect()
    assert [(r["label"], r["weight"], r["qid"], r["f1"], r["f2"], r["f4"]) for r in rows] == [(1, 1, 3, 0.5, None, 2), (0, 2.5, 4, None, 1, None)]
    with pytest.raises(ValueError):
        frames.read_text(spark, f"{tmp_path}/a.txt")
    csr = frames.from_csr(spark, [0, 1, 1, 3], [2, 0, 1], [5.0, 6.0, 7.0], 3).orderBy("row_id").collect()
    csc = frames.from_csc(spark, [0, 1, 2, 3], [2, 2, 0], [6.0, 7.0, 5.0], 3).orderBy("row_id").collect()
    assert [tuple(r) for r in csr] == [tuple(r) for r in csc] == [(0, None, None, 5.0), (1, None, None, None), (2, 6.0, 7.0, None)]
    words = spark.createDataFrame([("b",), ("a",), (None,)], "k string")
    t, spec = frames.prepare(words.withColumn("label", F.lit(1.0)), frames.FeatureSpec(("k",)))
    assert spec.categories == {"k": ["a", "b"]} and sorted(str(r["k"]) for r in t.collect()) == ["0.0", "1.0", "None"]
    with pytest.raises(Exception, match="unseen"):
        frames.prepare(spark.createDataFrame([("z", 1.0)], "k string, label double"), spec)[0].collect()
    with pytest.raises(ValueError):
        frames.validate(spark.createDataFrame([(float("nan"), 1.0)], "label double, weight double"))
    with pytest.raises(ValueError):
        frames.take_rows(words.withColumn("qid", F.lit(1)), words)
    made = frames.from_batches(spark, lambda i: __import__("pandas").DataFrame({"x": [i, i + 0.5]}), 3, "x double")
    assert made.count() == 6 and made.count() == 6


def test_parameters():
    p = P.resolve({"eta": 0.1, "lambda": 2, "gamma": 1})
    assert (p["learning_rate"], p["reg_lambda"], p["min_split_loss"]) == (0.1, 2, 1)
    for bad in ({"eta": -1}, {"tree_method": "x"}, {"subsample": 2}, {"max_depth": 0}, {"nope": 1, "validate_parameters": True}):
        with pytest.raises(ValueError):
            P.resolve(bad)
    with config.config_context(verbosity=2):
        assert config.get_config()["verbosity"] == 2
    assert config.get_config()["verbosity"] == 1


def test_estimators(spark, tmp_path):
    df = table(spark)
    c = ml.Classifier(features_col=["a", "b", "c"], label_col="z", num_boost_round=3, max_depth=3, pred_contrib_col="contrib").fit(df)
    out = c.transform(df)
    assert out.where("prediction = z").count() > 500 and len(out.first()["probability"]) == 2 and len(out.first()["contrib"]) == 4
    c.save(spark, f"{tmp_path}/m")
    again = ml.GroveModel.load(spark, f"{tmp_path}/m").transform(df)
    assert again.where("prediction = z").count() == out.where("prediction = z").count()
    v = df.withColumn("features", F.array("a", "c")).withColumn("v", F.col("row_id") % 4 == 0)
    r = ml.Regressor(num_boost_round=2, max_depth=2, validation_indicator_col="v").fit(v)
    assert "prediction" in r.transform(v).columns and "validation" in r.summary and abs(sum(r.feature_importances.values()) - 1) < 1e-9
    f = ml.ForestRegressor(features_col=["a", "b"], num_parallel_tree=2, max_depth=2).fit(df)
    assert len(f.model.trees) == 2


def test_dumps():
    m = fixed_model()
    assert "leaf=0.4" in m.dump()[0] and json.loads(m.dump("json", True)[0])["children"][0]["leaf"] == 0.4 and m.dump("dot")[1].startswith("digraph")
    assert m.importance("total_gain") == {"l_quantity": 4.0, "l_tax": 2.0, "l_line": 1.5}


def test_candidates_match_the_finder(spark):
    h = spark.createDataFrame([(0, 0, b, float(g), float(w)) for b, (g, w) in enumerate([(3, 2), (-1, 3), (-6, 2), (2, 4)])], "node int, fidx int, bin int, g double, h double")
    t = spark.createDataFrame([(0, -1.0, 13.0)], "node int, tg double, th double")
    best = splits.best_splits(splits.scan_splits(h, t)).first()
    f = splits.Finder(P.resolve({}), [4])
    s = f.of_node(np.array([[[3.0, 2], [-1, 3], [-6, 2], [2, 4]]]), np.array([-1.0, 13.0]), [0])
    assert (best["bin"], best["dir"] == 1, best["gain"]) == (s.bin, s.default_left, pytest.approx(s.gain))
