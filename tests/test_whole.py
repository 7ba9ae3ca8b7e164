"""Queries return whole tables, as their SQL does."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkgrove import catalogue
from sparkgrove.operators import cuts, metrics, ranges

SF = "/root/testdata/sf0.001"
RANKS = ["grad_rank_pairwise", "grad_rank_ndcg", "grad_rank_map", "metric_auc_group", "metric_ndcg", "metric_map", "metric_pre", "rank_topk"]


def whole_sql(name):
    text = catalogue.ORACLE_SQL[name]
    con = duckdb.connect()
    for table in ("events", "orders"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con.sql(text)


def same(got, want):
    cols = sorted(want.columns)
    a = sorted(tuple(float(r[c]) for c in cols) for r in got.collect())
    b = sorted(tuple(float(dict(zip(want.columns, r))[c]) for c in cols) for r in want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, rel=1e-6, abs=2e-6)


@pytest.mark.parametrize("name", RANKS)
def test_ranking_on_all_events(spark, name):
    same(catalogue.QUERIES[name](spark, SF), whole_sql(name))


def test_mean_pairs_reach_all_events(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    assert catalogue.QUERIES["grad_rank_mean"](spark, SF).count() == events


@pytest.mark.parametrize("name", [f"grad_{x}" for x in catalogue._GRADS])
def test_gradients_of_all_orders(spark, name):
    got = catalogue.QUERIES[name](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    same(got, whole_sql(name))


@pytest.mark.parametrize("bound", [10, 1 << 16])
def test_weighted_cuts_beyond_the_bound(spark, monkeypatch, bound):
    rows = [(i * 37 % 1009 / 8, (i * 31 % 211) / 16, float((i * 7) % 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "x double, y double, weight double")
    monkeypatch.setattr(cuts, "EXACT_DISTINCT", bound)
    got = cuts.cut_lists(cuts.cut_table(df, ["x", "y"], 16), 2)
    for column, own in enumerate(got):
        weight = {}
        for row in rows:
            if row[2]:
                weight[row[column]] = weight.get(row[column], 0) + row[2]
        total, cum, want = sum(weight.values()), 0, []
        for nth, (value, w) in enumerate(sorted(weight.items())):
            if nth and any(cum <= k * total / 16 < cum + w for k in range(1, 16)):
                want.append(value)
            cum += w
        assert own[:-1] == want and own[-1] > max(weight)


def test_running_metrics_on_distinct_scores(spark):
    """Many distinct scores in many ranges: exact, and the same from call to call."""
    rng = np.random.default_rng(1)
    n = 20_000
    score, label, weight = rng.random(n), (rng.random(n) < 0.3).astype(float), rng.integers(1, 4, n).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"p0": score, "label": label, "weight": weight, "row_id": np.arange(n)})).repartition(7)
    order = np.argsort(-score)
    cp = np.cumsum((label * weight)[order])
    want = (((1 - label) * weight)[order] * cp).sum() / ((label * weight).sum() * ((1 - label) * weight).sum())
    times, e = np.floor(rng.random(n) * 500) + 1, np.exp(rng.normal(size=n))
    sign = np.where(rng.random(n) < 0.3, -1, 1)
    cox = spark.createDataFrame(pd.DataFrame({"p0": e, "label": times * sign, "weight": 1.0})).repartition(5)
    at_risk = np.array([e[times >= x].sum() for x in range(1, 502)])
    event = sign > 0
    cox_want = -(np.log(e[event]) - np.log(at_risk[times[event].astype(int) - 1])).sum() / event.sum()
    top = np.lexsort((np.arange(n), -score))[: int(0.15 * n)]
    s, b = (label * weight)[top].sum(), ((1 - label) * weight)[top].sum()
    ams = np.sqrt(2 * ((s + b + 10) * np.log(1 + s / (b + 10)) - s))
    for _ in range(2):
        assert metrics.frame("auc", df).first()["value"] == pytest.approx(want, rel=1e-9)
        assert metrics.frame("cox-nloglik", cox).first()["value"] == pytest.approx(cox_want, rel=1e-9)
        assert metrics.frame("ams@0.15", df).first()["value"] == pytest.approx(ams, rel=1e-9)


def test_places_with_a_common_key(spark):
    rows = [(i, 0 if i % 3 else i) for i in range(3000)]
    got = ranges.places(spark.createDataFrame(rows, "id long, k long").repartition(5), F.col("k"), "id").collect()
    want = {i: n + 1 for n, (_, i) in enumerate(sorted((k, i) for i, k in rows))}
    assert {r["id"]: r["place"] for r in got} == want
    assert ranges.places(spark.createDataFrame([], "id long, k long"), F.col("k"), "id").count() == 0
