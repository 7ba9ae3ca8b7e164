"""Trees of every method against a plain grower, model files and feature maps."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkgrove.catalogue import fixed_model
from sparkgrove.plans.model import Model
from sparkgrove.plans.train import train
from sparkgrove.sources import frames, ubjson

ROWS = 500


def rows():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(ROWS, 3)) * 4) / 4
    x[rng.random(x.shape) < 0.12] = np.nan
    y = np.nan_to_num(x[:, 0]) * 2 - np.nan_to_num(x[:, 1], nan=3) + rng.normal(size=ROWS) / 3
    return x, y, rng.integers(1, 4, ROWS).astype(float)


def plain_tree(x, g, h, depth, lam=1.0, least=1.0, gamma=0.0):
    """Leaf weights of the rows by trying each value of each feature and both ways for missing cells."""
    def score(g, h):
        return g * g / (h + lam)

    out = np.full(len(g), -g.sum() / (h.sum() + lam))
    if not depth:
        return out
    best = (max(1e-6, gamma), None)
    for f in range(x.shape[1]):
        v = x[:, f]
        for cut in np.unique(v[~np.isnan(v)]):
            for missing_left in (True, False):
                left = np.where(np.isnan(v), missing_left, v < cut)
                if h[left].sum() < least or h[~left].sum() < least:
                    continue
                gain = score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum()) - score(g.sum(), h.sum())
                if gain > best[0] + 1e-9:
                    best = (gain, left)
    if best[1] is not None:
        for side in (best[1], ~best[1]):
            out[side] = plain_tree(x[side], g[side], h[side], depth - 1, lam, least, gamma)
    return out


def plain_margins(x, y, w, logistic, rounds, depth, **kw):
    m = np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m)) if logistic else m
        g, h = (p - y) * w, (p * (1 - p) if logistic else np.ones(len(y))) * w
        m = m + 0.3 * plain_tree(x, g, h, depth, **kw)
    return m


@pytest.mark.parametrize(("method", "objective", "more"), [
    ("hist", "reg:squarederror", {}), ("approx", "reg:squarederror", {}), ("exact", "reg:squarederror", {}),
    ("hist", "binary:logistic", {}), ("approx", "binary:logistic", {}), ("exact", "binary:logistic", {}),
    ("hist", "reg:squarederror", {"lam": 5.0, "least": 20.0, "gamma": 3.0}),
])
def test_against_plain_trees(spark, method, objective, more):
    x, y, w = rows()
    logistic = objective.startswith("binary")
    y = (y > 0).astype(float) if logistic else y
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(ROWS), "label": y, "weight": w})).join(
        spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "row_id long, a double, b double, c double"), "row_id").repartition(3)
    names = {"lam": "lambda", "least": "min_child_weight", "gamma": "gamma"}
    model = train({"objective": objective, "tree_method": method, "max_depth": 3, "base_score": 0.5 if logistic else 0.0} | {names[k]: v for k, v in more.items()}, df, 3, features=["a", "b", "c"])
    got = model.with_margin(df.select("row_id", "a", "b", "c")).orderBy("row_id").toPandas()["m0"].to_numpy()
    assert got == pytest.approx(plain_margins(x, y, w, logistic, 3, 3, **more), abs=1e-6)


def test_lossguide_forest_ref_and_continuation_agree(spark):
    x, y, _ = rows()
    df = spark.createDataFrame([(i, float(t), *(None if np.isnan(v) else float(v) for v in r)) for i, (t, r) in enumerate(zip(y, x))], "row_id long, label double, a double, b double, c double").persist()
    base = {"max_depth": 2, "base_score": 0.0}
    said = lambda m: m.with_margin(df.select("row_id", "a", "b", "c")).orderBy("row_id").toPandas()["m0"].to_numpy()
    want = plain_margins(x, y, np.ones(ROWS), False, 2, 2)
    one = train(base, df, 2, features=["a", "b", "c"])
    assert said(one) == pytest.approx(want, abs=1e-6)
    assert said(train(base | {"grow_policy": "lossguide"}, df, 2, features=["a", "b", "c"])) == pytest.approx(want, abs=1e-6)
    assert said(train(base | {"num_parallel_tree": 2}, df, 2, features=["a", "b", "c"])) == pytest.approx(want, abs=1e-6)
    first = train(base, df, 1, features=["a", "b", "c"])
    assert said(train(base, df, 1, features=["a", "b", "c"], init_model=first)) == pytest.approx(want, abs=1e-6)
    other = train(base, df.where("row_id % 2 = 0"), 1, features=["a", "b", "c"], ref=one)
    assert other.cuts == one.cuts
    with pytest.raises(ValueError, match="other features"):
        train(base, df, 1, features=["a", "b"], ref=one)


def test_exact_refuses_too_many_values(spark, monkeypatch):
    from sparkgrove.plans import train as module

    monkeypatch.setattr(module, "EXACT_VALUES", 10)
    df = spark.range(40).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("a"), F.lit(1.0).alias("label"))
    with pytest.raises(ValueError, match="distinct values"):
        train({"tree_method": "exact"}, df, 1, features=["a"])


def test_binary_model_files(spark):
    m = fixed_model()
    m.categories = {"l_line": ["x", "yé"]}
    again = Model.from_ubj(m.to_ubj())
    assert json.loads(again.to_json()) == json.loads(m.to_json())
    assert [tuple(r) for r in again.category_table(spark).collect()] == [("l_line", 0, "x"), ("l_line", 1, "yé")]
    for x in (None, True, [1, -1, 200, 40_000, -(2**40), 1.5, "é", [], {}], {"a": {"b": [False]}}):
        assert ubjson.loads(ubjson.dumps(x)) == x
    assert ubjson.loads(b"[$d#i\x02" + b"\x3f\x80\x00\x00\x40\x00\x00\x00") == [1.0, 2.0] and ubjson.loads(b"{#i\x01i\x01aT") == {"a": True}
    for bad in (b"[", b"S", b"x"):
        with pytest.raises(ValueError):
            ubjson.loads(bad)


def test_feature_maps(spark, tmp_path):
    (tmp_path / "map.txt").write_text("0 size q\n1 colour c\n\n2 flag i\n")
    assert frames.feature_map(spark, str(tmp_path / "map.txt")) == (["size", "colour", "flag"], ["q", "c", "i"])
    for text in ("0 a q\n2 b q\n", "0 a\n", "0 a z\n", "0 a q\n0 b q\n"):
        (tmp_path / "bad.txt").write_text(text)
        with pytest.raises(ValueError):
            frames.feature_map(spark, str(tmp_path / "bad.txt"))


def test_shap_values_add_up(spark):
    m = fixed_model()
    df = spark.createDataFrame([(float(q), q / 100, q % 7 * 1.0) for q in range(1, 50, 6)], "l_quantity double, l_tax double, l_line double")
    got = m.with_margin(m.shap_values(df)).collect()
    assert all(len(r["shap0"]) == 3 and sum(r["shap0"]) + r["expected0"] == pytest.approx(r["m0"]) for r in got) and len(got) == 9
    assert "c0" not in got[0].asDict()


def test_crowded_tables_are_spread(spark):
    from sparkgrove.plans.train import spread

    df = spark.range(4000).withColumnRenamed("id", "row_id")
    even, crowded = df.repartition(8), df.coalesce(1)
    assert spread(even) is even
    dealt = spread(crowded)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and dealt.count() == 4000
    empty = df.where("row_id < 0")
    assert spread(empty) is empty


def test_router_and_sql_place_agree(spark):
    from sparkgrove.operators.splits import Router
    from sparkgrove.plans.grow import place
    from sparkgrove.plans.model import Node

    nodes = [Node(left=1, right=2, fidx=0, bin=3, default_left=True), Node(parent=0, left=3, right=4, fidx=1, is_cat=True, cats=(0, 2)), Node(parent=0), Node(parent=1), Node(parent=1)]
    cells = [(a, b) for a in (None, 0, 3, 4) for b in (None, 0, 1, 2)]
    got = [r["n"] for r in spark.createDataFrame(cells, "b0 int, b1 int").selectExpr(f"{place(nodes)} AS n").collect()]
    bins = [np.array([-1 if c[i] is None else c[i] for c in cells]) for i in (0, 1)]
    assert sorted(Router(nodes, 5)(bins, len(cells)).tolist()) == sorted(got)
    assert dict(zip(cells, Router(nodes, 5)(bins, len(cells)).tolist())) == {c: 2 if c[0] == 4 else 4 if c[1] in (None, 0, 2) else 3 for c in cells}
