"""Metrics: (prediction, label, weight[, qid]) -> one number, each as one aggregate or a
window pass over a DataFrame with columns p0.. (predictions), label, weight, qid, row_id.

Names parse as name, name@arg and name-.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import Distribution, arg_max, dcg_discount, dcg_gain, log_gamma, total
from .ranges import counted_ties, running

REGISTRY: dict[str, Callable] = {}


def register(*names: str):
    def put(fn):
        REGISTRY.update(dict.fromkeys(names, fn))
        return fn

    return put


def parse(name: str) -> tuple[str, str | None, bool]:
    m = re.fullmatch(r"([a-z\-]*[a-z])(?:@([\d.eE+\-]*?))?(-)?", name)
    if not m or m[1] not in REGISTRY:
        raise ValueError(f"unknown metric {name!r}; known: {sorted(REGISTRY)}")
    return m[1], m[2] or None, bool(m[3])


def frame(name: str, df: DataFrame, params: dict | None = None) -> DataFrame:
    """One row with the column value."""
    from .. import params as P

    base, arg, minus = parse(name)
    if "weight" not in df.columns:
        df = df.withColumn("weight", F.lit(1.0))
    return REGISTRY[base](df, params or P.resolve({}), arg, minus).select(F.col("value").cast("double").alias("value"))


def value(name, df: DataFrame, params: dict | None = None) -> tuple[str, float]:
    """(name, number). A callable gets the DataFrame and returns (name, value)."""
    if callable(name):
        return name(df)
    got = frame(name, df, params).first()["value"]
    return name, float("nan") if got is None else got


def maximised(name: str) -> bool:
    return name.split("@")[0].rstrip("-") != "mape" and name.startswith(("auc", "aucpr", "pre", "map", "ndcg", "ams", "interval"))


def _mean(df: DataFrame, loss: Column, finish: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    s, w = F.sum(loss * F.col("weight")), F.sum("weight")
    return df.agg(finish(F.when(w == 0, s).otherwise(s / w)).alias("value"))




def _elementwise(loss: Callable[[Column, Column, dict, str | None], Column], finish=lambda x: x):
    return lambda df, p, arg, minus: _mean(df, loss(F.col("p0"), F.col("label"), p, arg), finish)


def _log_loss(p: Column, y: Column) -> Column:
    term = lambda a, b: F.when(a == 0, 0.0).otherwise(-a * F.log(F.greatest(b, F.lit(1e-16))))
    return term(y, p) + term(1 - y, 1 - p)


def _pseudo_huber(p, y, prm, arg):
    d = prm["huber_slope"]
    return d * d * (F.sqrt(1 + F.pow((p - y) / d, 2)) - 1)


def _error(p, y, prm, arg):
    return F.when(p > float(arg or 0.5), 1 - y).otherwise(y)


def _poisson(p, y, prm, arg):
    q = F.greatest(p, F.lit(1e-16))
    return log_gamma(y + 1) + q - y * F.log(q)


def _tweedie(p, y, prm, arg):
    if arg is None:
        raise ValueError("tweedie-nloglik needs its variance power: tweedie-nloglik@1.5")
    r = float(arg)
    return -y * F.pow(p, 1 - r) / (1 - r) + F.pow(p, 2 - r) / (2 - r)


REGISTRY |= {
    "rmse": _elementwise(lambda p, y, *_: (y - p) * (y - p), F.sqrt),
    "rmsle": _elementwise(lambda p, y, *_: F.pow(F.log1p(y) - F.log1p(p), 2), F.sqrt),
    "mae": _elementwise(lambda p, y, *_: F.abs(y - p)),
    "mape": _elementwise(lambda p, y, *_: F.abs((y - p) / y)),
    "mphe": _elementwise(_pseudo_huber),
    "logloss": _elementwise(lambda p, y, *_: _log_loss(p, y)),
    "error": _elementwise(_error),
    "poisson-nloglik": _elementwise(_poisson),
    "gamma-deviance": _elementwise(lambda p, y, *_: F.log((p + 1e-6) / (y + 1e-6)) + (y + 1e-6) / (p + 1e-6) - 1, lambda x: 2 * x),
    "gamma-nloglik": _elementwise(lambda p, y, *_: y / F.greatest(p, F.lit(1e-6)) + F.log(F.greatest(p, F.lit(1e-6)))),
    "tweedie-nloglik": _elementwise(_tweedie),
}


#: metrics to which a row of weight 2 is two equal rows of weight 1
WEIGHTED = frozenset([*REGISTRY, "quantile", "expectile", "merror", "mlogloss", "auc", "aucpr", "aft-nloglik", "interval-regression-accuracy"])


def _alphas(p: dict, key: str) -> list[float]:
    a = p.get(key)
    return sorted(a if isinstance(a, (list, tuple)) else [a])


@register("quantile")
def _quantile(df, p, arg, minus):
    alphas, y = _alphas(p, "quantile_alpha"), F.col("label")
    loss = total([F.when(y >= F.col(f"p{k}"), a * (y - F.col(f"p{k}"))).otherwise((1 - a) * (F.col(f"p{k}") - y)) for k, a in enumerate(alphas)])
    return _mean(df, loss / len(alphas))


@register("expectile")
def _expectile(df, p, arg, minus):
    alphas, y = _alphas(p, "expectile_alpha"), F.col("label")
    loss = total([F.when(F.col(f"p{k}") >= y, 1 - a).otherwise(a) * F.pow(F.col(f"p{k}") - y, 2) for k, a in enumerate(alphas)])
    return _mean(df, loss / len(alphas))


def _outputs(df: DataFrame) -> list[Column]:
    n = sum(bool(re.fullmatch(r"p\d+", c)) for c in df.columns)
    return [F.col(f"p{k}") for k in range(n)]


@register("merror")
def _merror(df, p, arg, minus):
    ps = _outputs(df)
    best = F.col("p0") if len(ps) == 1 else arg_max(ps)
    return _mean(df, F.when(best != F.col("label"), 1.0).otherwise(0.0))


@register("mlogloss")
def _mlogloss(df, p, arg, minus):
    own = F.element_at(F.array(*_outputs(df)), F.col("label").cast("int") + 1)
    return _mean(df, -F.log(F.greatest(own, F.lit(1e-16))))


def by_score(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """Weight of positives and negatives by distinct score with running sums, best first.
    Scores are grouped before the window, so equal ones meet in the partial sums."""
    g = df.groupBy(score.alias("s")).agg(F.sum(F.when(positive, F.col("weight")).otherwise(0.0)).alias("dp"), F.sum(F.when(positive, 0.0).otherwise(F.col("weight"))).alias("dn"))
    return running(g, "s", ["dp", "dn"])


def _binary_auc(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """(area, tp): area under the curve and the weight of positives; null with one class."""
    d = by_score(df, score, positive)
    area = F.sum(F.col("dn") * (F.col("c_dp") - F.col("dp") / 2))
    tp, fp = F.sum("dp"), F.sum("dn")
    return d.agg(F.when((tp > 0) & (fp > 0), area / (tp * fp)).alias("area"), tp.alias("tp"))


def _pr_area(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """Area under precision and recall, interpolated between score steps."""
    d = by_score(df, score, positive)
    all_ = d.agg(F.sum("dp").alias("P"), F.sum("dn").alias("N"))
    d = d.crossJoin(F.broadcast(all_))
    tp, fp = F.col("c_dp"), F.col("c_dn")
    tp0, fp0 = tp - F.col("dp"), fp - F.col("dn")
    h = (fp - fp0) / (tp - tp0)
    b = (fp0 - h * tp0) / F.col("P")
    a = 1 + h
    ra, rb = tp0 / F.col("P"), tp / F.col("P")
    curved = (rb - ra - b / a * (F.log(a * rb + b) - F.log(a * ra + b))) / a
    step = F.when(tp == tp0, 0.0).when(b == 0, (rb - ra) / a).otherwise(curved)
    return d.agg(F.when((F.max("P") > 0) & (F.max("N") > 0), F.sum(step)).alias("area"), F.max("P").alias("tp"))


def _one_vs_rest(df: DataFrame, kind) -> DataFrame:
    parts = None
    for k, p in enumerate(_outputs(df)):
        one = kind(df, p, F.col("label") == k)
        parts = one if parts is None else parts.unionAll(one)
    return parts.agg((F.sum(F.col("area") * F.col("tp")) / F.sum("tp")).alias("value"))


@register("auc")
def _auc(df, p, arg, minus):
    if "qid" in df.columns:
        return group_auc(df)
    if len(_outputs(df)) > 1:
        return _one_vs_rest(df, _binary_auc)
    return _binary_auc(df, F.col("p0"), F.col("label") > 0).select(F.col("area").alias("value"))


def group_auc(df: DataFrame) -> DataFrame:
    """Mean over queries of the share of well-ordered pairs (ties count half); queries of
    fewer than three documents, or without such pairs, are left out."""
    a = df.select("qid", F.col("label").alias("ya"), F.col("p0").alias("pa"))
    b = df.select("qid", F.col("label").alias("yb"), F.col("p0").alias("pb"))
    sizes = df.groupBy("qid").count().where("count >= 3").select("qid")
    pairs = a.join(b, "qid").where("ya > yb").join(sizes, "qid", "left_semi")
    win = F.when(F.col("pa") > F.col("pb"), 1.0).when(F.col("pa") == F.col("pb"), 0.5).otherwise(0.0)
    return pairs.groupBy("qid").agg(F.avg(win).alias("a")).agg(F.avg("a").alias("value"))


@register("aucpr")
def _aucpr(df, p, arg, minus):
    if "qid" in df.columns:
        keys = Window.partitionBy("qid").orderBy(F.desc("p0"))
        g = df.groupBy("qid", "p0").agg(F.sum(F.col("label") * F.col("weight")).alias("dp"), F.sum((1 - F.col("label")) * F.col("weight")).alias("dn"))
        q = Window.partitionBy("qid")
        g = g.withColumns({"c_dp": F.sum("dp").over(keys), "c_dn": F.sum("dn").over(keys), "P": F.sum("dp").over(q), "N": F.sum("dn").over(q)}).where("P > 0 AND N > 0")
        tp0, fp0 = F.col("c_dp") - F.col("dp"), F.col("c_dn") - F.col("dn")
        h = F.col("dn") / F.col("dp")
        b, a = (fp0 - h * tp0) / F.col("P"), 1 + h
        ra, rb = tp0 / F.col("P"), F.col("c_dp") / F.col("P")
        step = F.when(F.col("dp") == 0, 0.0).when(b == 0, (rb - ra) / a).otherwise((rb - ra - b / a * (F.log(a * rb + b) - F.log(a * ra + b))) / a)
        return g.groupBy("qid").agg(F.sum(step).alias("a")).agg(F.avg("a").alias("value"))
    if len(_outputs(df)) > 1:
        return _one_vs_rest(df, _pr_area)
    return _pr_area(df, F.col("p0"), F.col("label") > 0).select(F.col("area").alias("value"))


def _ranked(df: DataFrame) -> DataFrame:
    if "qid" not in df.columns:
        df = df.withColumn("qid", F.lit(0))
    q = Window.partitionBy("qid")
    return df.withColumns({"rk": F.row_number().over(q.orderBy(F.desc("p0"), "row_id")), "ik": F.row_number().over(q.orderBy(F.desc("label"), "row_id")), "n": F.count("*").over(q)})


def _grouped(g: DataFrame) -> DataFrame:
    """Weighted mean over queries of column v with query weight qw."""
    return g.agg((F.sum(F.col("v") * F.col("qw")) / F.sum("qw")).alias("value"))


@register("pre")
def _pre(df, p, arg, minus):
    k = int(arg) if arg else None
    cut = F.least(F.lit(k), F.col("n")) if k else F.col("n")
    g = _ranked(df).groupBy("qid").agg(F.first("weight").alias("qw"), (F.sum(F.when(F.col("rk") <= cut, F.col("label")).otherwise(0)) / F.max(cut)).alias("v"))
    return _grouped(g)


@register("ndcg")
def _ndcg(df, p, arg, minus):
    k, gain = int(arg) if arg else 1 << 30, dcg_gain("label", p["ndcg_exp_gain"])
    d = _ranked(df)
    sums = d.groupBy("qid").agg(F.first("weight").alias("qw"), F.sum(F.when(F.col("rk") <= k, gain * dcg_discount("rk")).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("ik") <= k, gain * dcg_discount("ik")).otherwise(0.0)).alias("idcg"))
    v = F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg") * F.col("qw")).otherwise(0.0 if minus else 1.0)  # the constant is not weighted
    return sums.agg((F.sum(v) / F.sum("qw")).alias("value"))


@register("map")
def _map(df, p, arg, minus):
    k = int(arg) if arg else 1 << 30
    hits = F.sum("label").over(Window.partitionBy("qid").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0))
    d = _ranked(df).withColumn("hits", hits)
    g = d.groupBy("qid").agg(F.first("weight").alias("qw"), F.sum(F.when((F.col("rk") <= k) & (F.col("label") > 0), F.col("hits") / F.col("rk")).otherwise(0.0)).alias("s"), F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("rel"))
    return _grouped(g.withColumn("v", F.when(F.col("rel") > 0, F.col("s") / F.least(F.col("rel"), F.lit(k))).otherwise(0.0 if minus else 1.0)))


@register("ams")
def _ams(df, p, arg, minus):
    if arg is None:
        raise ValueError("ams needs a share: ams@0.15")
    n = df.count()
    top = int(float(arg) * n)
    d = df.select(F.col("p0").alias("s"), "row_id", F.when(F.col("label") > 0, F.col("weight")).otherwise(0.0).alias("ds"), F.when(F.col("label") > 0, 0.0).otherwise(F.col("weight")).alias("db"))
    s, b = F.col("c_ds"), F.col("c_db")
    ams = F.sqrt(2 * ((s + b + 10) * F.log(1 + s / (b + 10)) - s))
    if 0 < top < n:
        # scores that lie in the share as a whole, then the first rows of the score it ends in
        g = running(d.groupBy("s").agg(F.count("*").alias("n")), "s", ["n"])
        last = g.where(F.col("c_n") >= top).agg(F.max(F.struct("s", (F.lit(top) - (F.col("c_n") - F.col("n"))).alias("left"))).alias("x")).first()["x"]
        tied = counted_ties(d.where(F.col("s") == last["s"]).withColumn("one", F.lit(1)), "s", "row_id", {"rk": F.col("one")}).where(F.col("rk") <= last["left"])
        kept = d.where(F.col("s") > last["s"]).select("ds", "db").unionAll(tied.select("ds", "db"))
        return kept.agg(F.coalesce(F.sum("ds"), F.lit(0.0)).alias("c_ds"), F.coalesce(F.sum("db"), F.lit(0.0)).alias("c_db")).select(ams.alias("value"))
    g = d.groupBy("s").agg(F.sum("ds").alias("ds"), F.sum("db").alias("db"))
    return running(g, "s", ["ds", "db"]).agg(F.max(ams).alias("value"))


@register("cox-nloglik")
def _cox(df, p, arg, minus):
    g = df.groupBy(F.abs("label").alias("t")).agg(F.sum("p0").alias("e"), F.sum(F.when(F.col("label") > 0, F.log("p0")).otherwise(0.0)).alias("l"), F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("k"))
    d = running(g, "t", ["e"])
    return d.agg((-F.sum(F.col("l") - F.col("k") * F.log("c_e")) / F.sum("k")).alias("value"))


@register("aft-nloglik")
def _aft(df, p, arg, minus):
    dist, s = Distribution(p["aft_loss_distribution"]), p["aft_loss_distribution_scale"]
    lo, up, m = F.col("label_lower"), F.col("label_upper"), F.col("m0")
    zl, zu = (F.log(lo) - m) / s, (F.log(up) - m) / s
    top = up.isNull() | (up == float("inf"))
    inside = F.when(top, 1.0).otherwise(dist.cdf(zu)) - F.when(lo <= 0, 0.0).otherwise(dist.cdf(zl))
    like = F.when(lo == up, dist.pdf(zl) / (s * lo)).otherwise(inside)
    return _mean(df, -F.log(F.greatest(like, F.lit(1e-12))))


@register("interval-regression-accuracy")
def _interval(df, p, arg, minus):
    e = F.exp("m0")
    up = F.col("label_upper")
    return _mean(df, F.when((e >= F.col("label_lower")) & (up.isNull() | (e <= up)), 1.0).otherwise(0.0))
