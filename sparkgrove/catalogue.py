"""All queries of the engine by name, and the same rows in SQL.

Gradient and metric queries use margins and labels made from the keys of the tables, so
that every engine sees the same numbers; results are rounded, as logarithms and
exponentials of two engines may differ in the last place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import params as P
from . import twins
from .functions import scalar as S
from .operators import cuts as C
from .operators import metrics as M
from .operators import objectives as O
from .operators import ranges, sampling, splits, stats
from .plans import linear as L
from .plans.model import Model, Node, Tree
from .plans.train import EarlyStopping, cv, train
from .plans.update import prune, refresh
from .sources import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c, n: int = 6):
    return F.round(S.col(c), n)


def _sig(c):
    """Six places; large values, whose last places differ between engines, to hundreds."""
    return F.when(F.abs(c) < 1e6, F.round(c, 6)).otherwise(F.round(c, -2))


# ---- gradients of row-wise objectives on orders


def _k():
    return F.col("o_orderkey")


def _m():
    return (_k() % 97).cast("double") / 40 - 1.2


def _w():
    return (_k() % 3).cast("double") + 1


_SQL_M, _SQL_W = "(CAST(o_orderkey % 97 AS DOUBLE) / 40 - CAST(1.2 AS DOUBLE))", "(CAST(o_orderkey % 3 AS DOUBLE) + 1)"
_LABELS = {
    "real": (lambda: (_k() % 13).cast("double") / 4, "(CAST(o_orderkey % 13 AS DOUBLE) / 4)"),
    "positive": (lambda: (_k() % 13).cast("double") / 4 + 0.25, "(CAST(o_orderkey % 13 AS DOUBLE) / 4 + 0.25)"),
    "binary": (lambda: (_k() % 2).cast("double"), "CAST(o_orderkey % 2 AS DOUBLE)"),
}
_SIG = "(1 / (1 + exp(-m)))"
_GRADS = {  # query: (objective, label, parameters, g, h)
    "squarederror": ("reg:squarederror", "real", {}, "(m - y) * w", "w"),
    "squarederror_posweight": ("reg:squarederror", "binary", {"scale_pos_weight": 2.5}, "(m - y) * w * CASE WHEN y = 1 THEN 2.5 ELSE 1 END", "w * CASE WHEN y = 1 THEN 2.5 ELSE 1 END"),
    "squaredlogerror": ("reg:squaredlogerror", "real", {}, "(ln(1 + greatest(m, -1 + 1e-6)) - ln(1 + y)) / (greatest(m, -1 + 1e-6) + 1) * w", "greatest((1 + ln(1 + y) - ln(1 + greatest(m, -1 + 1e-6))) / pow(greatest(m, -1 + 1e-6) + 1, 2), 1e-6) * w"),
    "logistic": ("binary:logistic", "binary", {}, f"({_SIG} - y) * w", f"greatest({_SIG} * (1 - {_SIG}), 1e-16) * w"),
    "reglogistic": ("reg:logistic", "binary", {"scale_pos_weight": 3.0}, f"({_SIG} - y) * w * CASE WHEN y = 1 THEN 3 ELSE 1 END", f"greatest({_SIG} * (1 - {_SIG}), 1e-16) * w * CASE WHEN y = 1 THEN 3 ELSE 1 END"),
    "logitraw": ("binary:logitraw", "binary", {}, f"({_SIG} - y) * w", f"greatest({_SIG} * (1 - {_SIG}), 1e-16) * w"),
    "hinge": ("binary:hinge", "binary", {}, "CASE WHEN m * (2 * y - 1) < 1 THEN -(2 * y - 1) * w ELSE 0 END", "CASE WHEN m * (2 * y - 1) < 1 THEN w ELSE 1.1754943508222875e-38 END"),
    "pseudohuber": ("reg:pseudohubererror", "real", {"huber_slope": 1.5}, "(m - y) / sqrt(1 + (m - y) * (m - y) / 2.25) * w", "2.25 / ((2.25 + (m - y) * (m - y)) * sqrt(1 + (m - y) * (m - y) / 2.25)) * w"),
    "poisson": ("count:poisson", "real", {}, "(exp(m) - y) * w", "0.5 * (exp(m) + y) * w"),
    "gamma": ("reg:gamma", "positive", {}, "(1 - y / exp(m)) * w", "y / exp(m) * w"),
    "tweedie": ("reg:tweedie", "real", {"tweedie_variance_power": 1.3}, "(-y * exp(-0.3 * m) + exp(0.7 * m)) * w", "(0.3 * y * exp(-0.3 * m) + 0.7 * exp(0.7 * m)) * w"),
}


def _graded(spark, d, objective, label, params, margins=1):
    p = P.resolve({"objective": objective} | params)
    df = t(spark, d, "orders").select(_k(), _k().alias("row_id"), _LABELS[label][0]().alias("label"), _w().alias("weight"), _m().alias("m0"))
    return O.get(objective, p).gradients(df)


def _base(label: str) -> str:
    return f"SELECT o_orderkey, {_LABELS[label][1]} AS y, {_SQL_W} AS w, {_SQL_M} AS m FROM orders"


for _name, (_obj, _label, _params, _g, _h) in _GRADS.items():
    query(f"grad_{_name}", f"SELECT o_orderkey, CASE WHEN abs(g) < 1e6 THEN round(g, 6) ELSE round(g, -2) END AS g, CASE WHEN abs(h) < 1e6 THEN round(h, 6) ELSE round(h, -2) END AS h FROM (SELECT o_orderkey, {_g} AS g, {_h} AS h FROM ({_base(_label)}))")(
        lambda spark, d, o=_obj, l=_label, p=_params: _graded(spark, d, o, l, p).select("o_orderkey", _sig("g0").alias("g"), _sig("h0").alias("h")))

query("grad_absolute", f"WITH b AS ({_base('real')}), s AS (SELECT pow(sum(w * sqrt(abs(m - y))) / sum(w), 2) AS s FROM b) SELECT o_orderkey, round(w * (m - y) * s / sqrt(s * s + (m - y) * (m - y)), 6) AS g, round(w * s / sqrt(s * s + (m - y) * (m - y)), 6) AS h FROM b, s")(
    lambda spark, d: _graded(spark, d, "reg:absoluteerror", "real", {}).select("o_orderkey", r6("g0").alias("g"), r6("h0").alias("h")))

_Q = lambda k, a: f"round(0.5 * s{k} * (tanh((m{k} - y) / (0.04 * s{k})) + 1 - 2 * {a}) * w, 6) AS g{k}, round(greatest(CASE WHEN m{k} = y THEN 1 ELSE tanh((m{k} - y) / (0.04 * s{k})) / ((m{k} - y) / (0.04 * s{k})) END, 3e-4) / 0.08 * w, 6) AS h{k}"


@query("grad_quantile", f"WITH b AS (SELECT *, m AS m0, m + 0.5 AS m1 FROM ({_base('real')})), s AS (SELECT pow(sum(w * sqrt(abs(m0 - y))) / sum(w), 2) AS s0, pow(sum(w * sqrt(abs(m1 - y))) / sum(w), 2) AS s1 FROM b) SELECT o_orderkey, {_Q(0, 0.25)}, {_Q(1, 0.75)} FROM b, s")
def _grad_quantile(spark, d):
    p = P.resolve({"objective": "reg:quantileerror", "quantile_alpha": [0.25, 0.75]})
    df = t(spark, d, "orders").select(_k(), _LABELS["real"][0]().alias("label"), _w().alias("weight"), _m().alias("m0"), (_m() + 0.5).alias("m1"))
    return O.get("reg:quantileerror", p).gradients(df).select("o_orderkey", *(r6(f"{c}{k}").alias(f"{c}{k}") for k in (0, 1) for c in "gh"))


@query("grad_expectile", f"""WITH b AS (SELECT *, m + 1e-6 + greatest(m, 0) + ln(1 + exp(-abs(m))) AS p1, 1 / (1 + exp(-m)) AS s FROM ({_base('real')})),
 a AS (SELECT *, CASE WHEN m >= y THEN 0.8 ELSE 0.2 END AS a0, CASE WHEN p1 >= y THEN 0.2 ELSE 0.8 END AS a1 FROM b)
 SELECT o_orderkey, round((a0 * (m - y) + a1 * (p1 - y)) * w, 6) AS g0, round((a0 + a1) * w, 6) AS h0, round(s * a1 * (p1 - y) * w, 6) AS g1, round(s * s * a1 * w, 6) AS h1 FROM a""")
def _grad_expectile(spark, d):
    p = P.resolve({"objective": "reg:expectileerror", "expectile_alpha": [0.2, 0.8]})
    df = t(spark, d, "orders").select(_k(), _LABELS["real"][0]().alias("label"), _w().alias("weight"), _m().alias("m0"), _m().alias("m1"))
    return O.get("reg:expectileerror", p).gradients(df).select("o_orderkey", *(r6(f"{c}{k}").alias(f"{c}{k}") for k in (0, 1) for c in "gh"))


_SM = "WITH b AS (SELECT o_orderkey, o_orderkey % 3 AS y, CAST(o_orderkey % 3 AS DOUBLE) + 1 AS w, {m} AS m0, 0.5 * {m} AS m1, 0.3 - {m} AS m2 FROM orders), e AS (SELECT *, exp(m0) + exp(m1) + exp(m2) AS z FROM b), s AS (SELECT *, exp(m0) / z AS p0, exp(m1) / z AS p1, exp(m2) / z AS p2 FROM e) ".format(m=_SQL_M)


@query("grad_softmax", _SM + "SELECT o_orderkey, " + ", ".join(f"round((p{k} - CASE WHEN y = {k} THEN 1 ELSE 0 END) * w, 6) AS g{k}, round(greatest(2 * p{k} * (1 - p{k}) * w, 1e-16), 6) AS h{k}" for k in range(3)) + " FROM s")
def _grad_softmax(spark, d):
    p = P.resolve({"objective": "multi:softprob", "num_class": 3})
    df = t(spark, d, "orders").select(_k(), (_k() % 3).cast("double").alias("label"), _w().alias("weight"), _m().alias("m0"), (_m() * 0.5).alias("m1"), (F.lit(0.3) - _m()).alias("m2"))
    return O.get("multi:softprob", p).gradients(df).select("o_orderkey", *(r6(f"{c}{k}").alias(f"{c}{k}") for k in range(3) for c in "gh"))


_COX_Y = "CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 END * CAST(o_orderkey % 51 + 1 AS DOUBLE)"


@query("grad_cox", f"""WITH b AS (SELECT o_orderkey, {_COX_Y} AS y, {_SQL_M} AS m FROM orders), e AS (SELECT *, abs(y) AS tm, exp(m) AS e FROM b),
 d AS (SELECT *, sum(e) OVER (ORDER BY tm DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dn FROM e),
 c AS (SELECT *, sum(CASE WHEN y > 0 THEN 1 / dn ELSE 0 END) OVER (ORDER BY tm, o_orderkey ROWS UNBOUNDED PRECEDING) AS r, sum(CASE WHEN y > 0 THEN 1 / (dn * dn) ELSE 0 END) OVER (ORDER BY tm, o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM d)
 SELECT o_orderkey, round(e * r - CASE WHEN y > 0 THEN 1 ELSE 0 END, 6) AS g, round(e * r - e * e * s, 6) AS h FROM c""")
def _grad_cox(spark, d):
    df = t(spark, d, "orders").select(_k(), _k().alias("row_id"), F.expr(_COX_Y).alias("label"), F.lit(1.0).alias("weight"), _m().alias("m0"))
    return O.get("survival:cox").gradients(df).select("o_orderkey", r6("g0").alias("g"), r6("h0").alias("h"))


_AFT = f"SELECT o_orderkey, {_SQL_M} AS m, CAST(o_orderkey % 17 + 1 AS DOUBLE) AS lo, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN CAST(o_orderkey % 17 + 1 AS DOUBLE) ELSE CAST(o_orderkey % 17 + 4 AS DOUBLE) END AS up FROM orders"


def _aft_frame(spark, d):
    lo = (_k() % 17 + 1).cast("double")
    up = F.when(_k() % 5 == 0, F.lit(None).cast("double")).when(_k() % 5 == 1, lo).otherwise(lo + 3)
    return t(spark, d, "orders").select(_k(), _m().alias("m0"), lo.alias("label_lower"), up.alias("label_upper"), F.lit(1.0).alias("weight"))


_AFT_T = f"""WITH b AS ({_AFT}), z AS (SELECT *, (ln(lo) - m) / 1.5 AS zl, (ln(up) - m) / 1.5 AS zu FROM b), f AS (SELECT *, 1 / (1 + exp(-zl)) AS cl, coalesce(1 / (1 + exp(-zu)), 1) AS cu FROM z),
 q AS (SELECT *, cl * (1 - cl) AS fl, cu * (1 - cu) AS fu FROM f), k AS (SELECT *, fl * (1 - 2 * cl) AS dl, fu * (1 - 2 * cu) AS du, fu * (1 - 6 * cu + 6 * cu * cu) AS ddu FROM q) """


@query("grad_aft_logistic", _AFT_T + """SELECT o_orderkey, round(CASE WHEN lo = up THEN du / (1.5 * fu) ELSE (fu - fl) / (1.5 * (cu - cl)) END, 6) AS g,
 round(CASE WHEN lo = up THEN -(fu * ddu - du * du) / (2.25 * fu * fu) ELSE -((cu - cl) * (du - dl) - (fu - fl) * (fu - fl)) / (2.25 * (cu - cl) * (cu - cl)) END, 6) AS h FROM k""")
def _grad_aft(spark, d):
    p = P.resolve({"objective": "survival:aft", "aft_loss_distribution": "logistic", "aft_loss_distribution_scale": 1.5})
    return O.get("survival:aft", p).gradients(_aft_frame(spark, d)).select("o_orderkey", r6("g0").alias("g"), r6("h0").alias("h"))


@query("grad_aft_normal")
def _grad_aft_normal(spark, d):
    return O.get("survival:aft").gradients(_aft_frame(spark, d)).select("o_orderkey", r6("g0").alias("g"), r6("h0").alias("h"))


@query("grad_aft_extreme")
def _grad_aft_extreme(spark, d):
    return O.get("survival:aft", P.resolve({"aft_loss_distribution": "extreme"})).gradients(_aft_frame(spark, d)).select("o_orderkey", r6("g0").alias("g"), r6("h0").alias("h"))


# ---- ranking gradients on events (queries are users)

_EV = "SELECT user_id AS qid, event_id AS row_id, CAST(event_id % {rel} AS DOUBLE) AS y, CAST((event_id * 37) % 101 AS DOUBLE) / 50 AS s, CAST(user_id % 3 + 1 AS DOUBLE) AS qw FROM events"


def _events(spark, d, rel=4):
    e = t(spark, d, "events")
    return e.select(F.col("user_id").alias("qid"), F.col("event_id").alias("row_id"), (F.col("event_id") % rel).cast("double").alias("label"), (((F.col("event_id") * 37) % 101).cast("double") / 50).alias("m0"), (F.col("user_id") % 3 + 1).cast("double").alias("weight"))


def _rank_sql(kind: str, rel: int) -> str:
    delta = {
        "pairwise": "1.0",
        "ndcg": "abs(gh * dh + gl * dl - gl * dh - gh * dl) * CASE WHEN idcg = 0 THEN 0 ELSE 1 / idcg END",
        "map": """abs(CASE WHEN rel = 0 THEN 0 WHEN ya > yb THEN hits_a / ra - hits_b / rb + (prec_b - yb / rb - prec_a) ELSE hits_b / rb - (hits_a + 1) / ra - (prec_b - yb / rb - prec_a) END / greatest(rel, 1))""",
    }[kind]
    return f"""WITH b AS ({_EV.format(rel=rel)}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, row_id) AS rk, row_number() OVER (PARTITION BY qid ORDER BY y DESC, row_id) AS ik FROM b),
 f AS (SELECT *, pow(2, y) - 1 AS gain, 1 / log2(rk + 1) AS disc, sum(CASE WHEN ik <= 5 THEN (pow(2, y) - 1) / log2(ik + 1) ELSE 0 END) OVER (PARTITION BY qid) AS idcg, max(s) OVER (PARTITION BY qid) AS best, min(s) OVER (PARTITION BY qid) AS worst,
   sum(y) OVER (PARTITION BY qid ORDER BY rk ROWS UNBOUNDED PRECEDING) AS hits, sum(y / rk) OVER (PARTITION BY qid ORDER BY rk ROWS UNBOUNDED PRECEDING) AS prec, sum(y) OVER (PARTITION BY qid) AS rel FROM r),
 p AS (SELECT a.qid, a.rel, a.idcg, a.best, a.worst, CASE WHEN a.y > c.y THEN a.row_id ELSE c.row_id END AS hi, CASE WHEN a.y > c.y THEN c.row_id ELSE a.row_id END AS lo, CASE WHEN a.y > c.y THEN a.s ELSE c.s END AS sh, CASE WHEN a.y > c.y THEN c.s ELSE a.s END AS sl,
   greatest(a.gain, c.gain) AS gh, least(a.gain, c.gain) AS gl, CASE WHEN a.y > c.y THEN a.disc ELSE c.disc END AS dh, CASE WHEN a.y > c.y THEN c.disc ELSE a.disc END AS dl, a.y AS ya, c.y AS yb, a.rk AS ra, c.rk AS rb, a.hits AS hits_a, c.hits AS hits_b, a.prec AS prec_a, c.prec AS prec_b
   FROM f a JOIN f c ON a.qid = c.qid AND a.rk <= 5 AND c.rk > a.rk AND a.y <> c.y),
 q AS (SELECT *, {delta} AS delta FROM p), n AS (SELECT *, CASE WHEN best <> worst THEN delta / (abs(sh - sl) + 0.01) ELSE delta END AS dd, 1 / (1 + exp(sl - sh)) AS sg FROM q),
 l AS (SELECT *, (sg - 1) * dd AS lam, 2 * dd * greatest(sg * (1 - sg), 1e-16) AS hess FROM n), z AS (SELECT qid, 2 * sum(abs(lam)) AS tot FROM l GROUP BY qid),
 s AS (SELECT qid, row_id, sum(g) AS g, sum(h) AS h FROM (SELECT qid, hi AS row_id, lam AS g, hess AS h FROM l UNION ALL SELECT qid, lo, -lam, hess FROM l) GROUP BY ALL),
 w AS (SELECT count(*) / sum(qw) AS ws FROM (SELECT DISTINCT qid, qw FROM b))
 SELECT b.row_id AS event_id, round(coalesce(s.g, 0) * coalesce(CASE WHEN tot > 0 THEN log2(1 + tot) / tot ELSE 1 END, 1) * qw * ws, 6) + 0.0 AS g, round(coalesce(s.h, 0) * coalesce(CASE WHEN tot > 0 THEN log2(1 + tot) / tot ELSE 1 END, 1) * qw * ws, 6) + 0.0 AS h
 FROM b CROSS JOIN w LEFT JOIN s ON b.qid = s.qid AND b.row_id = s.row_id LEFT JOIN z ON b.qid = z.qid"""


for _kind, _rel in (("pairwise", 4), ("ndcg", 4), ("map", 2)):
    query(f"grad_rank_{_kind}", _rank_sql(_kind, _rel))(
        lambda spark, d, k=_kind, rel=_rel: O.get(f"rank:{k}", P.resolve({"lambdarank_num_pair_per_sample": 5})).gradients(_events(spark, d, rel)).select(F.col("row_id").alias("event_id"), (r6("g0") + 0.0).alias("g"), (r6("h0") + 0.0).alias("h")))


@query("grad_rank_mean")
def _grad_rank_mean(spark, d):
    return O.get("rank:ndcg", P.resolve({"lambdarank_pair_method": "mean", "lambdarank_num_pair_per_sample": 2})).gradients(_events(spark, d)).select(F.col("row_id").alias("event_id"), r6("g0").alias("g"), r6("h0").alias("h"))


@query("rank_unbiased_bias")
def _rank_unbiased(spark, d):
    o = O.get("rank:ndcg", P.resolve({"lambdarank_unbiased": True, "lambdarank_num_pair_per_sample": 8}))
    return o.update_bias(_events(spark, d)).select("pos", r6("tp").alias("tp"), r6("tm").alias("tm"))


# ---- links and intercepts

query("link_functions", f"""SELECT o_orderkey, round(1 / (1 + exp(-m)), 6) AS sigmoid, round(exp(m), 6) AS exp_, round(greatest(m, 0) + ln(1 + exp(-abs(m))), 6) AS softplus, round(lgamma(m + 3), 6) AS lgamma, CASE WHEN m >= 0.5 * m AND m >= 0.3 - m THEN 0 WHEN 0.5 * m >= 0.3 - m THEN 1 ELSE 2 END AS argmax,
 round(1 / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m))), 6) AS logistic_pdf, round(exp(m) * exp(-exp(m)), 6) AS extreme_pdf, round(exp(-m * m / 2) / sqrt(2 * pi()), 6) AS normal_pdf FROM (SELECT o_orderkey, {_SQL_M} AS m FROM orders)""")(
    lambda spark, d: t(spark, d, "orders").select("o_orderkey", r6(S.sigmoid(_m())).alias("sigmoid"), r6(F.exp(_m())).alias("exp_"), r6(S.softplus(_m())).alias("softplus"), r6(S.log_gamma(_m() + 3)).alias("lgamma"), S.arg_max([_m(), _m() * 0.5, F.lit(0.3) - _m()]).alias("argmax"),
                                                   r6(S.Distribution("logistic").pdf(_m())).alias("logistic_pdf"), r6(S.Distribution("extreme").pdf(_m())).alias("extreme_pdf"), r6(S.Distribution("normal").pdf(_m())).alias("normal_pdf")))


@query("intercepts", f"""WITH b AS (SELECT {_LABELS['real'][1]} AS y, {_LABELS['binary'][1]} AS z, {_SQL_W} AS w FROM orders) SELECT 'mean' AS kind, round(sum(w * y) / sum(w), 6) AS value FROM b
 UNION ALL SELECT 'logit', round(-ln(1 / (sum(w * z) / sum(w)) - 1), 6) FROM b UNION ALL SELECT 'log', round(ln(sum(w * y) / sum(w)), 6) FROM b UNION ALL SELECT 'stump', round(-sum(-(2 * z - 1) * w) / sum(w), 6) FROM b""")
def _intercepts(spark, d):
    o = t(spark, d, "orders").select(_LABELS["real"][0]().alias("label"), _w().alias("weight"))
    b = t(spark, d, "orders").select(_LABELS["binary"][0]().alias("label"), _w().alias("weight"))
    got = {"mean": O.get("reg:squarederror").intercept(o), "logit": O.get("binary:logistic").intercept(b), "log": O.get("count:poisson").intercept(o), "stump": O.get("binary:hinge").intercept(b)}
    return spark.createDataFrame([(k, round(v[0], 6)) for k, v in got.items()], "kind string, value double")


@query("intercept_softmax", "WITH p AS (SELECT o_orderkey % 3 AS k, ln(sum(CAST(o_orderkey % 5 + 1 AS DOUBLE)) / sum(sum(CAST(o_orderkey % 5 + 1 AS DOUBLE))) OVER ()) AS l FROM orders GROUP BY 1) SELECT CAST(k AS BIGINT) AS class, round(l - avg(l) OVER (), 6) AS value FROM p")
def _intercept_softmax(spark, d):
    df = t(spark, d, "orders").select((_k() % 3).cast("double").alias("label"), (_k() % 5 + 1).cast("double").alias("weight"))
    got = O.get("multi:softprob", P.resolve({"num_class": 3})).intercept(df)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in enumerate(got)], "class long, value double")


# ---- metrics on orders; predictions follow the margins

_PB = f"SELECT o_orderkey AS row_id, {_SQL_W} AS w, {_LABELS['real'][1]} + 0.25 AS y, CAST(o_orderkey % 2 AS DOUBLE) AS z, {_SQL_M} AS m, 1 / (1 + exp(-{_SQL_M})) AS p, exp({_SQL_M}) AS e FROM orders"
_PR = {"p": lambda: S.sigmoid(_m()), "e": lambda: F.exp(_m())}
_METRICS = {  # query: (metric, label, prediction, loss or whole expression)
    "rmse": ("rmse", "y", "e", "sqrt(sum(w * (y - e) * (y - e)) / sum(w))"),
    "rmsle": ("rmsle", "y", "e", "sqrt(sum(w * pow(ln(1 + y) - ln(1 + e), 2)) / sum(w))"),
    "mae": ("mae", "y", "e", "sum(w * abs(y - e)) / sum(w)"),
    "mape": ("mape", "y", "e", "sum(w * abs((y - e) / y)) / sum(w)"),
    "mphe": ("mphe", "y", "e", "sum(w * (sqrt(1 + (e - y) * (e - y)) - 1)) / sum(w)"),
    "logloss": ("logloss", "z", "p", "sum(w * (-z * ln(p) - (1 - z) * ln(1 - p))) / sum(w)"),
    "error": ("error", "z", "p", "sum(w * CASE WHEN p > 0.5 THEN 1 - z ELSE z END) / sum(w)"),
    "error_at": ("error@0.61", "z", "p", "sum(w * CASE WHEN p > 0.61 THEN 1 - z ELSE z END) / sum(w)"),
    "poisson": ("poisson-nloglik", "y", "e", "sum(w * (lgamma(y + 1) + e - y * ln(e))) / sum(w)"),
    "gamma_deviance": ("gamma-deviance", "y", "e", "2 * sum(w * (ln((e + 1e-6) / (y + 1e-6)) + (y + 1e-6) / (e + 1e-6) - 1)) / sum(w)"),
    "gamma_nloglik": ("gamma-nloglik", "y", "e", "sum(w * (y / e + ln(e))) / sum(w)"),
    "tweedie": ("tweedie-nloglik@1.4", "y", "e", "sum(w * (-y * pow(e, -0.4) / -0.4 + pow(e, 0.6) / 0.6)) / sum(w)"),
    "quantile": ("quantile", "y", "e", "sum(w * (CASE WHEN y >= e THEN 0.3 * (y - e) ELSE 0.7 * (e - y) END)) / sum(w)"),
    "expectile": ("expectile", "y", "e", "sum(w * (CASE WHEN e >= y THEN 0.7 ELSE 0.3 END) * (e - y) * (e - y)) / sum(w)"),
}


def _predicted(spark, d, label, pred):
    y = _LABELS["real"][0]() + 0.25 if label == "y" else _LABELS["binary"][0]()
    return t(spark, d, "orders").select(_k().alias("row_id"), y.alias("label"), _w().alias("weight"), _PR[pred]().alias("p0"), _m().alias("m0"))


for _name, (_metric, _label, _pred, _sql) in _METRICS.items():
    query(f"metric_{_name}", f"SELECT round({_sql}, 6) AS value FROM ({_PB})")(
        lambda spark, d, m=_metric, l=_label, p=_pred: M.frame(m, _predicted(spark, d, l, p), P.resolve({"quantile_alpha": 0.3, "expectile_alpha": 0.3})).select(r6("value").alias("value")))




@query("metric_multiclass", _SM + """SELECT 'merror' AS metric, round(sum(w * CASE WHEN (CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END) <> y THEN 1 ELSE 0 END) / sum(w), 6) AS value FROM s
 UNION ALL SELECT 'mlogloss', round(sum(-w * ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) / sum(w), 6) FROM s""")
def _metric_multiclass(spark, d):
    ps = S.softmax([_m(), _m() * 0.5, F.lit(0.3) - _m()])
    df = t(spark, d, "orders").select((_k() % 3).cast("double").alias("label"), _w().alias("weight"), *(p.alias(f"p{k}") for k, p in enumerate(ps)))
    one = lambda m: M.frame(m, df).select(F.lit(m).alias("metric"), r6("value").alias("value"))
    return one("merror").unionAll(one("mlogloss"))


@query("metric_auc", f"""WITH b AS ({_PB}), g AS (SELECT round(p, 9) AS s, sum(w * z) AS dp, sum(w * (1 - z)) AS dn FROM b GROUP BY 1), c AS (SELECT *, sum(dp) OVER (ORDER BY s DESC) AS cp FROM g)
 SELECT round(sum(dn * (cp - dp / 2)) / (sum(dp) * sum(dn)), 6) AS value FROM c""")
def _metric_auc(spark, d):
    df = _predicted(spark, d, "z", "p").withColumn("p0", F.round("p0", 9))
    return M.frame("auc", df).select(r6("value").alias("value"))


@query("metric_auc_multiclass", _SM.replace("round(", "round(") + """, u AS (SELECT k, round(CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 9) AS sc, w * CASE WHEN y = k THEN 1 ELSE 0 END AS wp, w * CASE WHEN y = k THEN 0 ELSE 1 END AS wn FROM s, (VALUES (0), (1), (2)) AS v(k)),
 g AS (SELECT k, sc, sum(wp) AS dp, sum(wn) AS dn FROM u GROUP BY ALL), c AS (SELECT *, sum(dp) OVER (PARTITION BY k ORDER BY sc DESC) AS cp FROM g), a AS (SELECT k, sum(dn * (cp - dp / 2)) / (sum(dp) * sum(dn)) AS area, sum(dp) AS tp FROM c GROUP BY k) SELECT round(sum(area * tp) / sum(tp), 6) AS value FROM a""")
def _metric_auc_multi(spark, d):
    ps = S.softmax([_m(), _m() * 0.5, F.lit(0.3) - _m()])
    df = t(spark, d, "orders").select((_k() % 3).cast("double").alias("label"), _w().alias("weight"), *(F.round(p, 9).alias(f"p{k}") for k, p in enumerate(ps)))
    return M.frame("auc", df).select(r6("value").alias("value"))


@query("metric_aucpr", f"""WITH b AS ({_PB}), g AS (SELECT round(p, 9) AS s, sum(w * z) AS dp, sum(w * (1 - z)) AS dn FROM b GROUP BY 1), c AS (SELECT *, sum(dp) OVER (ORDER BY s DESC) AS tp, sum(dn) OVER (ORDER BY s DESC) AS fp, sum(dp) OVER () AS tot FROM g),
 h AS (SELECT *, tp - dp AS tp0, fp - dn AS fp0, CASE WHEN dp = 0 THEN 0 ELSE dn / dp END AS h FROM c), k AS (SELECT *, (fp0 - h * tp0) / tot AS bb, 1 + h AS aa, tp0 / tot AS ra, tp / tot AS rb FROM h)
 SELECT round(sum(CASE WHEN dp = 0 THEN 0 WHEN bb = 0 THEN (rb - ra) / aa ELSE (rb - ra - bb / aa * (ln(aa * rb + bb) - ln(aa * ra + bb))) / aa END), 6) AS value FROM k""")
def _metric_aucpr(spark, d):
    df = _predicted(spark, d, "z", "p").withColumn("p0", F.round("p0", 9))
    return M.frame("aucpr", df).select(r6("value").alias("value"))


@query("metric_auc_group", f"""WITH b AS ({_EV.format(rel=4)}), k AS (SELECT qid FROM b GROUP BY 1 HAVING count(*) >= 3), p AS (SELECT a.qid, avg(CASE WHEN a.s > c.s THEN 1.0 WHEN a.s = c.s THEN 0.5 ELSE 0 END) AS v FROM b a JOIN b c ON a.qid = c.qid AND a.y > c.y WHERE a.qid IN (SELECT qid FROM k) GROUP BY 1) SELECT round(avg(v), 6) AS value FROM p""")
def _metric_auc_group(spark, d):
    return M.frame("auc", _events(spark, d).withColumnRenamed("m0", "p0")).select(r6("value").alias("value"))


_RK = f"WITH b AS ({_EV}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, row_id) AS rk, row_number() OVER (PARTITION BY qid ORDER BY y DESC, row_id) AS ik, count(*) OVER (PARTITION BY qid) AS n FROM b) "


@query("metric_ndcg", _RK.format(rel=4) + """, g AS (SELECT qid, any_value(qw) AS qw, sum(CASE WHEN rk <= 5 THEN (pow(2, y) - 1) / log2(rk + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ik <= 5 THEN (pow(2, y) - 1) / log2(ik + 1) ELSE 0 END) AS idcg FROM r GROUP BY 1)
 SELECT round(sum(CASE WHEN idcg > 0 THEN dcg / idcg * qw ELSE 1 END) / sum(qw), 6) AS value FROM g""")
def _metric_ndcg(spark, d):
    return M.frame("ndcg@5", _events(spark, d).withColumnRenamed("m0", "p0")).select(r6("value").alias("value"))


@query("metric_map", _RK.format(rel=2) + """, c AS (SELECT *, sum(y) OVER (PARTITION BY qid ORDER BY rk ROWS UNBOUNDED PRECEDING) AS hits FROM r), g AS (SELECT qid, any_value(qw) AS qw, sum(CASE WHEN rk <= 5 AND y > 0 THEN hits / rk ELSE 0 END) AS s, sum(y) AS rel FROM c GROUP BY 1)
 SELECT round(sum(qw * CASE WHEN rel > 0 THEN s / least(rel, 5) ELSE 1 END) / sum(qw), 6) AS value FROM g""")
def _metric_map(spark, d):
    return M.frame("map@5", _events(spark, d, 2).withColumnRenamed("m0", "p0")).select(r6("value").alias("value"))


@query("metric_pre", _RK.format(rel=2) + ", g AS (SELECT qid, any_value(qw) AS qw, sum(CASE WHEN rk <= 4 THEN y ELSE 0 END) / max(least(4, n)) AS v FROM r GROUP BY 1) SELECT round(sum(qw * v) / sum(qw), 6) AS value FROM g")
def _metric_pre(spark, d):
    return M.frame("pre@4", _events(spark, d, 2).withColumnRenamed("m0", "p0")).select(r6("value").alias("value"))


_AMSX = "sqrt(2 * ((s + b + 10) * ln(1 + s / (b + 10)) - s))"


@query("metric_ams", f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY round(p, 9) DESC, row_id) AS rk, count(*) OVER () AS n FROM ({_PB})), k AS (SELECT sum(w * z) AS s, sum(w * (1 - z)) AS b FROM a WHERE rk <= floor(0.15 * n)),
 g AS (SELECT round(p, 9) AS sc, sum(w * z) AS ds, sum(w * (1 - z)) AS db FROM a GROUP BY 1), c AS (SELECT sum(ds) OVER (ORDER BY sc DESC) AS s, sum(db) OVER (ORDER BY sc DESC) AS b FROM g)
 SELECT 'at' AS kind, round({_AMSX}, 6) AS value FROM k UNION ALL SELECT 'max', round(max({_AMSX}), 6) FROM c""")
def _metric_ams(spark, d):
    df = _predicted(spark, d, "z", "p").withColumn("p0", F.round("p0", 9))
    one = lambda m, k: M.frame(m, df).select(F.lit(k).alias("kind"), r6("value").alias("value"))
    return one("ams@0.15", "at").unionAll(one("ams@0", "max"))


# metrics on scores that are nearly all different

_WIDE = "SELECT l_extendedprice AS s, CAST(l_linenumber % 3 + 1 AS DOUBLE) AS w, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS z, CASE WHEN l_linenumber % 4 = 0 THEN -1.0 ELSE 1.0 END * l_extendedprice AS y, exp(l_discount * 10) AS e FROM lineitem"


def _wide(spark, d, score: str = "l_extendedprice"):
    li = t(spark, d, "lineitem")
    return li.select(F.expr(score).alias("p0"), (F.col("l_linenumber") % 3 + 1).cast("double").alias("weight"), (F.col("l_returnflag") == "R").cast("double").alias("label"))


query("metric_auc_wide", f"""WITH g AS (SELECT s, sum(w * z) AS dp, sum(w * (1 - z)) AS dn FROM ({_WIDE}) GROUP BY 1), c AS (SELECT *, sum(dp) OVER (ORDER BY s DESC) AS cp FROM g)
 SELECT round(sum(dn * (cp - dp / 2)) / (sum(dp) * sum(dn)), 6) AS value FROM c""")(
    lambda spark, d: M.frame("auc", _wide(spark, d)).select(r6("value").alias("value")))
query("metric_aucpr_wide", f"""WITH g AS (SELECT s, sum(w * z) AS dp, sum(w * (1 - z)) AS dn FROM ({_WIDE}) GROUP BY 1), c AS (SELECT *, sum(dp) OVER (ORDER BY s DESC) AS tp, sum(dn) OVER (ORDER BY s DESC) AS fp, sum(dp) OVER () AS tot FROM g),
 h AS (SELECT *, tp - dp AS tp0, fp - dn AS fp0, CASE WHEN dp = 0 THEN 0 ELSE dn / dp END AS h FROM c), k AS (SELECT *, (fp0 - h * tp0) / tot AS bb, 1 + h AS aa, tp0 / tot AS ra, tp / tot AS rb FROM h)
 SELECT round(sum(CASE WHEN dp = 0 THEN 0 WHEN bb = 0 THEN (rb - ra) / aa ELSE (rb - ra - bb / aa * (ln(aa * rb + bb) - ln(aa * ra + bb))) / aa END), 6) AS value FROM k""")(
    lambda spark, d: M.frame("aucpr", _wide(spark, d)).select(r6("value").alias("value")))
query("metric_ams_wide", f"""WITH g AS (SELECT s, sum(w * z) AS ds, sum(w * (1 - z)) AS db FROM ({_WIDE}) GROUP BY 1), c AS (SELECT sum(ds) OVER (ORDER BY s DESC) AS a, sum(db) OVER (ORDER BY s DESC) AS b FROM g)
 SELECT round(max(sqrt(2 * ((a + b + 10) * ln(1 + a / (b + 10)) - a))), 5) AS value FROM c""")(
    lambda spark, d: M.frame("ams@0", _wide(spark, d).withColumn("row_id", F.lit(0))).select(r6("value", 5).alias("value")))
query("metric_cox_wide", f"""WITH g AS (SELECT abs(y) AS tm, sum(e) AS e, sum(CASE WHEN y > 0 THEN ln(e) ELSE 0 END) AS l, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) AS k FROM ({_WIDE}) GROUP BY 1),
 c AS (SELECT *, sum(e) OVER (ORDER BY tm DESC) AS dn FROM g) SELECT round(-sum(l - k * ln(dn)) / sum(k), 6) AS value FROM c""")(
    lambda spark, d: M.frame("cox-nloglik", t(spark, d, "lineitem").select(F.exp(F.col("l_discount") * 10).alias("p0"), F.lit(1.0).alias("weight"),
                                                                          (F.when(F.col("l_linenumber") % 4 == 0, -1.0).otherwise(1.0) * F.col("l_extendedprice")).alias("label"))).select(r6("value").alias("value")))


@query("metric_cox", f"""WITH b AS (SELECT {_COX_Y} AS y, exp({_SQL_M}) AS e FROM orders), d AS (SELECT *, sum(e) OVER (ORDER BY abs(y) DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dn FROM b)
 SELECT round(-sum(CASE WHEN y > 0 THEN ln(e) - ln(dn) ELSE 0 END) / sum(CASE WHEN y > 0 THEN 1 ELSE 0 END), 6) AS value FROM d""")
def _metric_cox(spark, d):
    df = t(spark, d, "orders").select(F.expr(_COX_Y).alias("label"), F.exp(_m()).alias("p0"), _k().alias("row_id"))
    return M.frame("cox-nloglik", df).select(r6("value").alias("value"))


@query("metric_aft", _AFT_T + "SELECT 'nloglik' AS metric, round(avg(-ln(greatest(CASE WHEN lo = up THEN fl / (1.5 * lo) ELSE cu - cl END, 1e-12))), 6) AS value FROM k UNION ALL SELECT 'interval', round(avg(CASE WHEN exp(m) >= lo AND (up IS NULL OR exp(m) <= up) THEN 1.0 ELSE 0 END), 6) FROM k")
def _metric_aft(spark, d):
    p = P.resolve({"aft_loss_distribution": "logistic", "aft_loss_distribution_scale": 1.5})
    df = _aft_frame(spark, d)
    one = lambda m, k: M.frame(m, df, p).select(F.lit(k).alias("metric"), r6("value").alias("value"))
    return one("aft-nloglik", "nloglik").unionAll(one("interval-regression-accuracy", "interval"))


# ---- cuts, bins, histograms, splits on lineitem: label R, logistic gradients at margin 0

FEATURES = ["l_quantity", "l_discount", "l_tax"]
_TAXM = "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_tax END"


def _lines(spark, d):
    li = t(spark, d, "lineitem")
    return li.select("l_quantity", "l_discount", F.when(F.col("l_partkey") % 7 != 0, F.col("l_tax")).alias("l_tax"), (F.col("l_returnflag") == "R").cast("double").alias("label"), F.lit(1.0).alias("weight"))


_LB = f"l AS (SELECT l_quantity, l_discount, {_TAXM} AS l_tax, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS y FROM lineitem), x AS (SELECT 0 AS fidx, l_quantity AS v, y FROM l UNION ALL SELECT 1, l_discount, y FROM l UNION ALL SELECT 2, l_tax, y FROM l), a AS (SELECT fidx, v, count(*) AS n, sum(0.5 - y) AS g, CAST(0.25 AS DOUBLE) * count(*) AS h FROM x WHERE v IS NOT NULL GROUP BY ALL), bn AS (SELECT *, CAST(row_number() OVER (PARTITION BY fidx ORDER BY v) - 1 AS INTEGER) AS bin, lead(v) OVER (PARTITION BY fidx ORDER BY v) AS nxt, max(v) OVER (PARTITION BY fidx) AS top FROM a)"


@query("cuts_exact", f"WITH {_LB} SELECT fidx, bin, round(coalesce(nxt, top + abs(top) + 1e-5), 6) AS cut FROM bn")
def _cuts_exact(spark, d):
    return C.cut_table(_lines(spark, d), FEATURES).select("fidx", "bin", r6("cut").alias("cut"))


@query("cuts_weighted", """WITH v AS (SELECT o_totalprice AS v, sum(CAST(o_orderkey % 3 + 1 AS DOUBLE)) AS w FROM orders GROUP BY 1), c AS (SELECT *, row_number() OVER (ORDER BY v) AS nth, sum(w) OVER (ORDER BY v) AS cum, sum(w) OVER () / 16 AS step, max(v) OVER () AS top FROM v),
 p AS (SELECT v AS cut FROM c WHERE nth > 1 AND greatest(ceil((cum - w) / step), 1) <= least(ceil(cum / step) - 1, 15) UNION ALL SELECT DISTINCT top + (abs(top) + 1e-5) FROM c) SELECT row_number() OVER (ORDER BY cut) - 1 AS bin, round(cut, 4) AS cut FROM p""")
def _cuts_weighted(spark, d):
    o = t(spark, d, "orders").select("o_totalprice", _w().alias("weight"))
    return C.cut_table(o, ["o_totalprice"], max_bin=16).select("bin", r6("cut", 4).alias("cut"))


@query("cuts_categories", "SELECT 0 AS fidx, CAST(r.range AS INTEGER) AS bin FROM range(0, (SELECT max(s_nationkey) + 1 FROM supplier)) r")
def _cuts_categories(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_nationkey").cast("double").alias("c"), F.lit(1.0).alias("weight"))
    return C.cut_table(s, ["c"], categorical={"c"}).select("fidx", "bin")


@query("bin_lookup", f"WITH {_LB} SELECT fidx, bin, n AS rows FROM bn")
def _bin_lookup(spark, d):
    li = _lines(spark, d)
    cuts = C.cut_lists(C.cut_table(li, FEATURES), 3)
    bins = li.select(F.explode(F.array(*(F.struct(F.lit(i).alias("fidx"), C.bin_of(F.col(f), cuts[i]).alias("bin")) for i, f in enumerate(FEATURES)))).alias("x"))
    return bins.select("x.fidx", "x.bin").where("bin IS NOT NULL").groupBy("fidx", "bin").agg(F.count("*").alias("rows"))


def _hist(spark, d, node=None):
    li = _lines(spark, d)
    cuts = C.cut_lists(C.cut_table(li, FEATURES), 3)
    b = C.binned(li.withColumns({"g0": 0.5 - F.col("label"), "h0": F.lit(0.25)}), FEATURES, cuts).withColumn("node", F.lit(0) if node is None else node)
    h = splits.histogram(b, 3, [len(c) for c in cuts]).select("node", "fidx", "bin", F.col("g0").alias("g"), F.col("h0").alias("h"))
    return h, b.groupBy("node").agg(F.sum("g0").alias("tg"), F.sum("h0").alias("th"))


query("hist_root", f"WITH {_LB} SELECT fidx, bin, g, h FROM bn")(lambda spark, d: _hist(spark, d)[0].select("fidx", "bin", "g", "h"))


@query("hist_level1", f"WITH l AS (SELECT CASE WHEN l_quantity < 24 THEN 1 ELSE 2 END AS node, l_discount AS v, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS y FROM lineitem), k AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS bin FROM (SELECT DISTINCT v FROM l)) SELECT node, bin, sum(0.5 - y) AS g, CAST(0.25 AS DOUBLE) * count(*) AS h FROM l JOIN k USING (v) GROUP BY ALL")
def _hist_level1(spark, d):
    return _hist(spark, d, F.when(F.col("l_quantity") < 24, 1).otherwise(2))[0].where("fidx = 1").select("node", "bin", "g", "h")


@query("hist_subtract", f"WITH {_LB}, q AS (SELECT fidx, v, sum(0.5 - y) AS g, CAST(0.25 AS DOUBLE) * count(*) AS h FROM (SELECT 0 AS fidx, l_quantity AS v, y FROM l WHERE l_quantity >= 24 UNION ALL SELECT 1, l_discount, y FROM l WHERE l_quantity >= 24 UNION ALL SELECT 2, l_tax, y FROM l WHERE l_quantity >= 24) GROUP BY ALL) SELECT bn.fidx, bin, coalesce(q.g, 0) AS g, coalesce(q.h, 0) AS h FROM bn LEFT JOIN q ON q.fidx = bn.fidx AND q.v = bn.v")
def _hist_subtract(spark, d):
    parent = _hist(spark, d)[0]
    return splits.subtract(parent, _hist(spark, d, F.when(F.col("l_quantity") < 24, 1).otherwise(2))[0].where("node = 1"))


_GAIN = lambda g, h: f"({g}) * ({g}) / (({h}) + 1)"
_CAND = f"""{_LB}, tt AS (SELECT sum(0.5 - y) AS tg, CAST(0.25 AS DOUBLE) * count(*) AS th FROM l), cm AS (SELECT *, sum(g) OVER (PARTITION BY fidx ORDER BY bin) AS cg, sum(h) OVER (PARTITION BY fidx ORDER BY bin) AS ch, sum(g) OVER (PARTITION BY fidx) AS sg, sum(h) OVER (PARTITION BY fidx) AS sh, max(bin) OVER (PARTITION BY fidx) AS nb FROM bn, tt),
 cd AS (SELECT fidx, bin, 0 AS dir, cg AS gl, ch AS hl, tg - cg AS gr, th - ch AS hr, tg, th FROM cm UNION ALL SELECT fidx, bin, 1, tg - sg + cg, th - sh + ch, sg - cg, sh - ch, tg, th FROM cm WHERE abs(sh - th) > 1e-9 AND bin < nb),
 sp AS (SELECT *, {_GAIN('gl', 'hl')} + {_GAIN('gr', 'hr')} - {_GAIN('tg', 'th')} AS gain FROM cd WHERE hl >= 1 AND hr >= 1)"""

query("split_candidates", f"WITH {_CAND} SELECT fidx, bin, dir, gl, hl, gr, hr, round(gain, 6) AS gain FROM sp")(
    lambda spark, d: splits.scan_splits(*_hist(spark, d)).where("ok").select("fidx", "bin", "dir", "gl", "hl", "gr", "hr", r6("gain").alias("gain")))
_BEST = "ORDER BY round(gain, 6) DESC, fidx, dir, CASE WHEN dir = 0 THEN bin ELSE -bin END LIMIT 1"
query("split_best", f"WITH {_CAND} SELECT fidx, bin, dir, gl, hl, gr, hr, round(gain, 6) AS gain FROM sp {_BEST}")(
    lambda spark, d: splits.best_splits(splits.scan_splits(*_hist(spark, d))).select("fidx", "bin", "dir", "gl", "hl", "gr", "hr", r6("gain").alias("gain")))
query("split_monotone", f"WITH {_CAND} SELECT fidx, bin, dir, round(gain, 6) AS gain FROM sp WHERE fidx <> 0 OR -gl / (hl + 1) <= -gr / (hr + 1) {_BEST}")(
    lambda spark, d: splits.best_splits(splits.scan_splits(*_hist(spark, d), monotone={0: 1})).select("fidx", "bin", "dir", r6("gain").alias("gain")))

_CATS = "c AS (SELECT CAST(l_suppkey % 12 AS INTEGER) AS bin, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS y FROM lineitem), hh AS (SELECT bin, sum(0.5 - y) AS g, CAST(0.25 AS DOUBLE) * count(*) AS h, sum(sum(0.5 - y)) OVER () AS tg, sum(CAST(0.25 AS DOUBLE) * count(*)) OVER () AS th FROM c GROUP BY bin)"


def _cat_hist(spark, d):
    li = t(spark, d, "lineitem").select((F.col("l_suppkey") % 12).cast("int").alias("bin"), (0.5 - (F.col("l_returnflag") == "R").cast("double")).alias("g"))
    h = li.groupBy("bin").agg(F.sum("g").alias("g"), (F.count("*") * 0.25).alias("h")).select(F.lit(0).alias("node"), F.lit(0).alias("fidx"), "bin", "g", "h")
    return h, h.groupBy("node").agg(F.sum("g").alias("tg"), F.sum("h").alias("th"))


query("split_onehot", f"WITH {_CATS} SELECT bin, round({_GAIN('tg - g', 'th - h')} + {_GAIN('g', 'h')} - {_GAIN('tg', 'th')}, 6) AS gain FROM hh")(
    lambda spark, d: splits.categorical_scan(*_cat_hist(spark, d), onehot=True).select("bin", r6("gain").alias("gain")))
query("split_partition", f"WITH {_CATS}, o AS (SELECT *, row_number() OVER (ORDER BY round(-g / (h + 1), 9), bin) AS k, sum(g) OVER (ORDER BY round(-g / (h + 1), 9), bin ROWS UNBOUNDED PRECEDING) AS gr, sum(h) OVER (ORDER BY round(-g / (h + 1), 9), bin ROWS UNBOUNDED PRECEDING) AS hr FROM hh) SELECT k, bin, gr, hr, round({_GAIN('tg - gr', 'th - hr')} + {_GAIN('gr', 'hr')} - {_GAIN('tg', 'th')}, 6) AS gain FROM o WHERE th - hr > 0")(
    lambda spark, d: splits.categorical_scan(*_cat_hist(spark, d)).where("gain IS NOT NULL").select("k", "bin", "gr", "hr", r6("gain").alias("gain")))


@query("train_stump", f"""WITH {_CAND}, bs AS (SELECT * FROM sp {_BEST}) SELECT 0 AS node, fidx, round((SELECT nxt FROM bn b WHERE b.fidx = bs.fidx AND b.bin = bs.bin), 6) AS cond, round(gain, 6) AS gain, round(th, 4) AS cover, NULL::DOUBLE AS leaf FROM bs
 UNION ALL SELECT 1, -1, 0, 0, round(hl, 4), round(-0.3 * gl / (hl + 1), 6) FROM bs UNION ALL SELECT 2, -1, 0, 0, round(hr, 4), round(-0.3 * gr / (hr + 1), 6) FROM bs""")
def _train_stump(spark, d):
    m = train({"objective": "binary:logistic", "max_depth": 1, "base_score": 0.5}, _lines(spark, d), 1, features=FEATURES)
    x = m.node_table(spark)
    return x.select("node", "fidx", r6("cond").alias("cond"), r6("gain").alias("gain"), r6("cover", 4).alias("cover"), F.when(F.col("fidx") < 0, r6(F.col("leaf")[0])).alias("leaf"))


@query("train_binary_stump")
def _train_binary_stump(spark, d):
    m = train({"objective": "binary:logistic", "max_depth": 2}, _lines(spark, d), 2, features=FEATURES)
    return m.node_table(spark)


def _history(spark, r: dict) -> DataFrame:
    return spark.createDataFrame([(s, k, i, round(float(x), 6)) for s, ms in r.items() for k, v in ms.items() for i, x in enumerate(v)], "data string, metric string, round int, value double")


def _trained(params, rounds, rows, features=FEATURES, callbacks=list, **kw):
    def run(spark, d):
        r: dict = {}
        df = rows(spark, d)
        train(params, df, rounds, features=features, evals=[(df, "train")], evals_result=r, callbacks=callbacks(), **kw)
        return _history(spark, r)

    return run


QUERIES |= {
    "train_binary_10": _trained({"objective": "binary:logistic", "max_depth": 4}, 10, _lines),
    "train_approx": _trained({"objective": "binary:logistic", "tree_method": "approx", "max_depth": 3}, 2, _lines),
    "train_exact": _trained({"objective": "reg:squarederror", "tree_method": "exact", "max_depth": 3}, 2, _lines),
    "train_lossguide": _trained({"objective": "binary:logistic", "grow_policy": "lossguide", "max_leaves": 6}, 2, _lines),
    "train_dart": _trained({"objective": "binary:logistic", "booster": "dart", "rate_drop": 0.5, "max_depth": 2}, 4, _lines),
    "train_forest": _trained({"objective": "binary:logistic", "num_parallel_tree": 3, "subsample": 0.7, "colsample_bynode": 0.7, "max_depth": 3, "learning_rate": 1.0}, 1, _lines),
    "train_mvs": _trained({"objective": "binary:logistic", "subsample": 0.4, "sampling_method": "gradient_based", "max_depth": 3}, 2, _lines),
    "train_constraints": _trained({"objective": "binary:logistic", "monotone_constraints": [1, -1, 0], "interaction_constraints": [[0, 1], [2]], "max_depth": 3}, 2, _lines),
    "train_linear": _trained({"objective": "reg:squarederror", "booster": "gblinear"}, 4, _lines),
    "train_rank": _trained({"objective": "rank:ndcg", "max_depth": 2, "lambdarank_num_pair_per_sample": 4}, 2, lambda s, d: _rank_rows(s, d), features=["f0", "f1"]),
    "train_softprob": _trained({"objective": "multi:softprob", "num_class": 3, "max_depth": 2}, 2, lambda s, d: _lines(s, d).withColumn("label", F.pmod(F.col("l_quantity").cast("int"), F.lit(3)).cast("double"))),
    "train_vector_leaf": _trained({"objective": "multi:softprob", "num_class": 3, "multi_strategy": "multi_output_tree", "max_depth": 2}, 2, lambda s, d: _lines(s, d).withColumn("label", F.pmod(F.col("l_quantity").cast("int"), F.lit(3)).cast("double"))),
    "train_quantile": _trained({"objective": "reg:quantileerror", "quantile_alpha": [0.2, 0.8], "max_depth": 2}, 2, lambda s, d: _lines(s, d).withColumn("label", F.col("l_quantity") * F.col("l_discount"))),
    "train_aft": _trained({"objective": "survival:aft", "aft_loss_distribution": "logistic", "max_depth": 2}, 2, lambda s, d: _aft_rows(s, d), features=["f0", "f1"]),
    "train_early_stop": _trained({"objective": "binary:logistic", "max_depth": 2, "learning_rate": 1.0}, 8, _lines, callbacks=lambda: [EarlyStopping(2, places=6)]),
}


def _rank_rows(spark, d):
    e = _events(spark, d)
    return e.select("qid", "row_id", "label", "weight", (F.col("row_id") % 11).cast("double").alias("f0"), (F.col("row_id") % 17).cast("double").alias("f1"))


def _aft_rows(spark, d):
    return _aft_frame(spark, d).select("label_lower", "label_upper", (_k() % 17).cast("double").alias("f0"), (_k() % 5).cast("double").alias("f1"))


@query("cv_binary")
def _cv(spark, d):
    return spark.createDataFrame(cv({"objective": "binary:logistic", "max_depth": 2}, _lines(spark, d), 2, nfold=3, features=FEATURES))


# ---- a fixed model on lineitem


def fixed_model() -> Model:
    m = Model(P.resolve({"objective": "binary:logistic"}), ["l_quantity", "l_tax", "l_line"], [0.1])
    a = [Node(left=1, right=2, fidx=0, cond=20.0, gain=4.0, cover=100.0, base_weight=0.05), Node(parent=0, leaf=[0.4], cover=40.0), Node(parent=0, left=3, right=4, fidx=1, cond=0.04, default_left=True, gain=2.0, cover=60.0, base_weight=-0.1), Node(parent=2, leaf=[-0.2], cover=25.0), Node(parent=2, leaf=[0.3], cover=35.0)]
    b = [Node(left=1, right=2, fidx=2, is_cat=True, cats=(2, 5), gain=1.5, cover=90.0, default_left=True), Node(parent=0, leaf=[0.25], cover=60.0), Node(parent=0, leaf=[-0.5], cover=30.0)]
    for n in (a[0], a[2], b[0]):
        n.leaf = [0.0]
    m.trees = [Tree(a, 0, 0), Tree(b, 0, 1, 0.5)]
    return m





def _fixed_rows(spark, d):
    li = t(spark, d, "lineitem")
    return li.select("l_orderkey", "l_partkey", "l_quantity", F.when(F.col("l_partkey") % 7 != 0, F.col("l_tax")).alias("l_tax"), F.col("l_linenumber").cast("double").alias("l_line"))


_FR = f"SELECT l_orderkey, l_partkey, l_quantity, {_TAXM} AS l_tax, l_linenumber AS l_line FROM lineitem"
_T1 = "CASE WHEN l_quantity < 20 THEN 0.4 WHEN l_tax IS NULL OR l_tax < 0.04 THEN -0.2 ELSE 0.3 END"
_T2 = "CASE WHEN l_line IN (2, 5) THEN -0.5 ELSE 0.25 END"
query("predict_margin", f"SELECT l_orderkey, l_partkey, round(CAST(0.1 AS DOUBLE) + {_T1} + 0.5 * {_T2}, 6) AS margin FROM ({_FR})")(
    lambda spark, d: fixed_model().with_margin(_fixed_rows(spark, d)).select("l_orderkey", "l_partkey", r6("m0").alias("margin")))
query("predict_value", f"SELECT l_orderkey, l_partkey, round(1 / (1 + exp(-(CAST(0.1 AS DOUBLE) + {_T1} + 0.5 * {_T2}))), 6) AS p FROM ({_FR})")(
    lambda spark, d: fixed_model().predict(_fixed_rows(spark, d)).select("l_orderkey", "l_partkey", r6("p0").alias("p")))
query("predict_class", f"SELECT l_orderkey, l_partkey, CASE WHEN 0.1 + {_T1} + 0.5 * {_T2} > 0 THEN 1 ELSE 0 END AS class FROM ({_FR})")(
    lambda spark, d: fixed_model().predict(_fixed_rows(spark, d)).select("l_orderkey", "l_partkey", (F.col("p0") > 0.5).cast("int").alias("class")))
query("predict_leaf", f"SELECT l_orderkey, l_partkey, CASE WHEN l_quantity < 20 THEN 1 WHEN l_tax IS NULL OR l_tax < 0.04 THEN 3 ELSE 4 END AS leaf0, CASE WHEN l_line IN (2, 5) THEN 2 ELSE 1 END AS leaf1 FROM ({_FR})")(
    lambda spark, d: fixed_model().predict_leaf(_fixed_rows(spark, d)).select("l_orderkey", "l_partkey", F.col("leaf")[0].alias("leaf0"), F.col("leaf")[1].alias("leaf1")))
query("predict_base_margin", f"SELECT l_orderkey, l_partkey, round(CAST(l_orderkey % 4 AS DOUBLE) + {_T1} + 0.5 * {_T2}, 6) AS margin FROM ({_FR})")(
    lambda spark, d: fixed_model().with_margin(_fixed_rows(spark, d).withColumn("base_margin", (F.col("l_orderkey") % 4).cast("double"))).select("l_orderkey", "l_partkey", r6("m0").alias("margin")))
query("predict_range", f"SELECT l_orderkey, l_partkey, round(CAST(0.1 AS DOUBLE) + {_T1}, 6) AS margin FROM ({_FR})")(
    lambda spark, d: fixed_model().with_margin(_fixed_rows(spark, d), (0, 1)).select("l_orderkey", "l_partkey", r6("m0").alias("margin")))
query("predict_slice", f"SELECT l_orderkey, l_partkey, round(CAST(0.1 AS DOUBLE) + 0.5 * {_T2}, 6) AS margin FROM ({_FR})")(
    lambda spark, d: fixed_model()[1:2].with_margin(_fixed_rows(spark, d)).select("l_orderkey", "l_partkey", r6("m0").alias("margin")))
query("leaf_features", f"SELECT l_orderkey, l_partkey, CASE WHEN l_quantity < 20 THEN 1 ELSE 0 END AS a, CASE WHEN l_line IN (2, 5) THEN 1 ELSE 0 END AS b FROM ({_FR})")(
    lambda spark, d: fixed_model().leaf_features(_fixed_rows(spark, d)).select("l_orderkey", "l_partkey", F.col("leaf_onehot")[0].alias("a"), F.col("leaf_onehot")[4].alias("b")))

_INNER = "(25 * -0.2 + 35 * 0.3) / 60"
_ROOT = f"(0.4 * 0.4 + 0.6 * {_INNER})"
_ROOT2 = "0.5 * (60 * 0.25 - 30 * 0.5) / 90"
query("contrib_approx", f"""SELECT l_orderkey, l_partkey, round(CASE WHEN l_quantity < 20 THEN 0.4 ELSE {_INNER} END - {_ROOT}, 6) AS c_quantity, round(CASE WHEN l_quantity < 20 THEN 0 ELSE {_T1} - {_INNER} END, 6) AS c_tax, round(0.5 * {_T2} - {_ROOT2}, 6) AS c_line, round(0.1 + {_ROOT} + {_ROOT2}, 6) AS bias FROM ({_FR})""")(
    lambda spark, d: fixed_model().contributions(_fixed_rows(spark, d), approximate=True).select("l_orderkey", "l_partkey", *(r6(F.col("c0")[i]).alias(n) for i, n in enumerate(("c_quantity", "c_tax", "c_line", "bias")))))
_V1, _V2 = f"(CASE WHEN l_quantity < 20 THEN 0.4 ELSE {_INNER} END)", "(0.4 * 0.4 + 0.6 * CASE WHEN l_tax IS NULL OR l_tax < 0.04 THEN -0.2 ELSE 0.3 END)"
_SHAP = f"round(0.5 * (({_V1} - {_ROOT}) + ({_T1} - {_V2})), 6) + 0.0 AS c_quantity, round(0.5 * (({_V2} - {_ROOT}) + ({_T1} - {_V1})), 6) + 0.0 AS c_tax"
query("contrib_shap", f"SELECT l_orderkey, l_partkey, {_SHAP}, round(0.5 * {_T2} - {_ROOT2}, 6) AS c_line, round(0.1 + {_ROOT} + {_ROOT2}, 6) AS bias FROM ({_FR})")(
    lambda spark, d: fixed_model().contributions(_fixed_rows(spark, d)).select("l_orderkey", "l_partkey", *((r6(F.col("c0")[i]) + 0.0).alias(n) for i, n in enumerate(("c_quantity", "c_tax", "c_line", "bias")))))
query("interactions", f"SELECT l_orderkey, l_partkey, round(0.5 * ({_T1} - {_V1} - {_V2} + {_ROOT}), 6) + 0.0 AS quantity_tax FROM ({_FR})")(
    lambda spark, d: fixed_model().interactions(_fixed_rows(spark, d)).select("l_orderkey", "l_partkey", (r6(F.col("i0")[0][1]) + 0.0).alias("quantity_tax")))

_IMP = "(VALUES ('l_quantity', 4.0, 100.0), ('l_tax', 2.0, 60.0), ('l_line', 1.5, 90.0)) AS v(feature, g, c)"
for _kind, _e in (("weight", "count(*)::DOUBLE"), ("gain", "avg(g)"), ("cover", "avg(c)"), ("total_gain", "sum(g)"), ("total_cover", "sum(c)")):
    query(f"importance_{_kind}", f"SELECT feature, CAST({_e} AS DOUBLE) AS score FROM {_IMP} GROUP BY feature")(lambda spark, d, k=_kind: fixed_model().importance_table(spark, k))
query("trees_table", "SELECT * FROM (VALUES (0, 0, '0-0', 'l_quantity', 20.0, '0-1'), (0, 1, '0-1', 'Leaf', NULL, NULL), (0, 2, '0-2', 'l_tax', 0.04, '0-3'), (0, 3, '0-3', 'Leaf', NULL, NULL), (0, 4, '0-4', 'Leaf', NULL, NULL), (1, 0, '1-0', 'l_line', NULL, '1-1'), (1, 1, '1-1', 'Leaf', NULL, NULL), (1, 2, '1-2', 'Leaf', NULL, NULL)) AS v(\"Tree\", \"Node\", \"ID\", \"Feature\", \"Split\", \"Yes\")".replace("20.0,", "CAST(20.0 AS DOUBLE),").replace("0.04,", "CAST(0.04 AS DOUBLE),"))(
    lambda spark, d: fixed_model().trees_table(spark).select("Tree", "Node", "ID", "Feature", "Split", "Yes"))
query("model_dump")(lambda spark, d: spark.createDataFrame([(k, i, x) for k in ("text", "json", "dot") for i, x in enumerate(fixed_model().dump(k, True))], "kind string, tree int, dump string"))


@query("split_value_hist", f"WITH {_LB} SELECT 1.0::DOUBLE AS split_value, 1::BIGINT AS count WHERE FALSE UNION ALL SELECT 20.0, 1")
def _split_value_hist(spark, d):
    v = fixed_model().split_values("l_quantity")
    return spark.createDataFrame([(float(x),) for x in v], "split_value double").groupBy("split_value").agg(F.count("*").alias("count"))


@query("refresh_stats", f"WITH b AS (SELECT *, 0.5 - CASE WHEN l_orderkey % 2 = 0 THEN 1.0 ELSE 0 END AS g, 0.25 AS h FROM ({_FR})), p AS (SELECT 0 AS node, g, h FROM b UNION ALL SELECT CASE WHEN l_quantity < 20 THEN 1 ELSE 2 END, g, h FROM b UNION ALL SELECT CASE WHEN l_tax IS NULL OR l_tax < 0.04 THEN 3 ELSE 4 END, g, h FROM b WHERE l_quantity >= 20) SELECT node, round(CAST(sum(h) AS DOUBLE), 4) AS cover, round(CAST(-sum(g) AS DOUBLE) / (CAST(sum(h) AS DOUBLE) + 1), 6) AS base_weight FROM p GROUP BY node")
def _refresh(spark, d):
    m = fixed_model()
    df = _fixed_rows(spark, d).withColumns({"g0": 0.5 - F.when(F.col("l_orderkey") % 2 == 0, 1.0).otherwise(0.0), "h0": F.lit(0.25)})
    tree = refresh(m.trees[0], m.features, df, P.resolve({}))
    return spark.createDataFrame([(n, round(x.cover, 4), round(x.base_weight, 6)) for n, x in enumerate(tree.nodes)], "node int, cover double, base_weight double")


@query("prune", "SELECT * FROM (VALUES (0, FALSE), (1, TRUE), (2, TRUE)) AS v(node, is_leaf)")
def _prune(spark, d):
    tree = prune(fixed_model().trees[0], P.resolve({"gamma": 3.0}))
    return spark.createDataFrame([(n, x.is_leaf) for n, x in enumerate(tree.nodes) if n == 0 or x.parent >= 0], "node int, is_leaf boolean")


# ---- frames


@query("missing_filter", "SELECT l_orderkey, l_partkey, CASE WHEN l_discount = 0.05 THEN NULL ELSE l_discount END AS v FROM lineitem")
def _missing(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_partkey", frames.clean(F.col("l_discount"), 0.05).alias("v"))


@query("recode", "WITH k AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)) SELECT o_orderkey, CAST(code AS DOUBLE) AS code FROM orders JOIN k USING (o_orderpriority)")
def _recode(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return frames.recode(o, "o_orderpriority", frames.category_table(o, "o_orderpriority")).select("o_orderkey", F.col("o_orderpriority").alias("code"))


query("categories", "SELECT o_orderpriority AS category, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)")(
    lambda spark, d: frames.category_table(t(spark, d, "orders"), "o_orderpriority"))
query("slice_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 = 3")(
    lambda spark, d: frames.take_rows(t(spark, d, "orders").withColumn("row_id", _k()), t(spark, d, "orders").where(_k() % 10 == 3).select(_k().alias("row_id"))).select("o_orderkey", "o_totalprice"))
query("qid_groups", "SELECT user_id AS qid, count(*) AS size FROM events GROUP BY 1")(lambda spark, d: frames.groups(t(spark, d, "events").withColumnRenamed("user_id", "qid")))
query("group_weights", "SELECT event_id, CAST(user_id % 3 + 1 AS DOUBLE) AS weight FROM events")(
    lambda spark, d: frames.unroll_group_weights(t(spark, d, "events").select("event_id", F.col("user_id").alias("qid")), t(spark, d, "events").select(F.col("user_id").alias("qid")).distinct().withColumn("weight", (F.col("qid") % 3 + 1).cast("double"))).select("event_id", "weight"))
query("stack_batches", "SELECT o_orderkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT c_custkey, c_acctbal FROM customer")(
    lambda spark, d: frames.stack([t(spark, d, "orders").select(_k().alias("k"), F.col("o_totalprice").alias("v")), t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))]))
query("kfold_groups", "SELECT count(DISTINCT user_id) AS users, 0::BIGINT AS split_users FROM events")(
    lambda spark, d: frames.folds(t(spark, d, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("row_id")), 3).groupBy("qid").agg(F.countDistinct("fold").alias("f")).agg(F.count("*").alias("users"), F.sum(F.when(F.col("f") > 1, 1).otherwise(0)).cast("long").alias("split_users")))
query("to_csr", f"SELECT o_orderkey AS row_id, 0 AS fidx, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 1, CAST(o_custkey AS DOUBLE) FROM orders WHERE o_custkey % 5 <> 0")(
    lambda spark, d: frames.to_csr(t(spark, d, "orders").select(_k().alias("row_id"), "o_totalprice", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey").cast("double")).alias("c")), ["o_totalprice", "c"]))
query("shape", f"SELECT count(*) AS num_row, 3 AS num_col, count(l_quantity) + count(l_discount) + count({_TAXM}) AS num_nonmissing FROM lineitem")(lambda spark, d: frames.shape(_lines(spark, d), FEATURES))
query("array_features", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS f0, round(CAST(embedding[4] AS DOUBLE), 6) AS f3 FROM embeddings")(
    lambda spark, d: frames.from_array_column(t(spark, d, "embeddings"), "embedding", 64).select("vec_id", r6("f0").alias("f0"), r6("f3").alias("f3")))
query("from_long", "SELECT o_orderkey AS row_id, o_totalprice AS f0, CAST(o_custkey AS DOUBLE) AS f1 FROM orders")(
    lambda spark, d: frames.from_long(t(spark, d, "orders").select(_k().alias("row"), F.posexplode(F.array("o_totalprice", F.col("o_custkey").cast("double"))).alias("fidx", "value")), 2))


# ---- samples and linear steps

query("sample_uniform")(lambda spark, d: t(spark, d, "orders").where(sampling.uniform(_k(), 0.3, 7)).select("o_orderkey"))


@query("sample_mvs", f"""WITH b AS (SELECT round(sqrt(pow(m - y, 2) + 0.1), 6) AS r FROM ({_base('real')})), k AS (SELECT r, count(*) AS n FROM b GROUP BY 1), c AS (SELECT *, coalesce(sum(r * n) OVER (ORDER BY r), 0) AS below, sum(n) OVER (ORDER BY r) AS rows_, lead(r) OVER (ORDER BY r) AS nxt, (SELECT count(*) FROM b) AS tot FROM k),
 u AS (SELECT r, nxt, below / (0.4 * tot - (tot - rows_)) AS u FROM c) SELECT round(min(u), 6) AS u FROM u WHERE u >= r AND (nxt IS NULL OR u < nxt)""")
def _sample_mvs(spark, d):
    df = t(spark, d, "orders").select(F.round(F.sqrt(F.pow(_m() - _LABELS["real"][0](), 2) + 0.1), 6).alias("r"))
    return spark.createDataFrame([(round(sampling.threshold(df, 0.4, F.col("r")), 6),)], "u double")


@query("linear_step", f"""WITH b AS (SELECT (0.0 - y) * w AS g, w AS h, CAST(o_custkey % 10 AS DOUBLE) AS x FROM (SELECT {_LABELS['real'][1]} AS y, {_SQL_W} AS w, o_custkey FROM orders)), s AS (SELECT sum(g) AS g, sum(h) AS h, sum(g * x) AS gx, sum(h * x) AS hx, sum(h * x * x) AS hxx FROM b), c AS (SELECT *, -0.5 * g / h AS bias FROM s)
 SELECT round(bias, 6) AS bias, round(-0.5 * (gx + bias * hx) / hxx, 6) AS weight FROM c""")
def _linear_step(spark, d):
    m = Model(P.resolve({"booster": "gblinear"}), ["x"], [0.0])
    df = t(spark, d, "orders").select((_k() * 0).alias("row_id"), ((0 - _LABELS["real"][0]()) * _w()).alias("g0"), _w().alias("h0"), _w().alias("weight"), (F.col("o_custkey") % 10).cast("double").alias("x"))
    import numpy as np

    L.linear_round(df, m, P.resolve({"booster": "gblinear"}), np.random.default_rng(0))
    return spark.createDataFrame([(round(float(m.linear[1, 0]), 6), round(float(m.linear[0, 0]), 6))], "bias double, weight double")


@query("collectives", "SELECT max(o_totalprice) AS max_, min(o_totalprice) AS min_, sum(o_orderkey)::BIGINT AS sum_, bit_and(o_orderkey) AS and_, bit_or(o_orderkey) AS or_, bit_xor(o_orderkey) AS xor_ FROM orders")
def _collectives(spark, d):
    return t(spark, d, "orders").agg(F.max("o_totalprice").alias("max_"), F.min("o_totalprice").alias("min_"), F.sum(_k()).alias("sum_"), F.bit_and(_k()).alias("and_"), F.bit_or(_k()).alias("or_"), F.bit_xor(_k()).alias("xor_"))


@query("stream_score", f"WITH b AS (SELECT event_id, value AS v FROM events) SELECT event_id, round(0.1 + CASE WHEN v < 50 THEN 0.2 ELSE -0.3 END, 6) AS margin FROM b")
def _stream(spark, d):
    from .streaming.score import score_available

    m = Model(P.resolve({}), ["value"], [0.1])
    m.trees = [Tree([Node(left=1, right=2, fidx=0, cond=50.0, leaf=[0.0]), Node(parent=0, leaf=[0.2]), Node(parent=0, leaf=[-0.3])])]
    return score_available(spark, f"{d}/events.parquet", m).select("event_id", r6("m0").alias("margin"))


# ---- statistics, ranks, leaves, extension points


def _real_rows(spark, d):
    return t(spark, d, "orders").select(_k().alias("row_id"), _LABELS["real"][0]().alias("label"), _w().alias("weight"), _m().alias("m0"), F.col("o_custkey").alias("qid"))


query("quantile_interpolated", "WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS k, count(*) OVER () AS n FROM orders), q AS (SELECT max(n) AS n, 0.3 * (max(n) + 1) AS x FROM s) SELECT round((SELECT v FROM s WHERE k = floor(x)) + (x - floor(x)) * ((SELECT v FROM s WHERE k = floor(x) + 1) - (SELECT v FROM s WHERE k = floor(x))), 4) AS value FROM q")(
    lambda spark, d: stats.quantile(t(spark, d, "orders"), F.col("o_totalprice"), 0.3).select(r6("value", 4).alias("value")))
query("quantile_weighted", f"WITH g AS (SELECT o_totalprice AS v, sum({_SQL_W}) AS w FROM orders GROUP BY 1), c AS (SELECT v, sum(w) OVER (ORDER BY v) AS cum, sum(w) OVER () AS tot FROM g) SELECT min(v) AS value FROM c WHERE cum >= 0.7 * tot")(
    lambda spark, d: stats.weighted_quantile(t(spark, d, "orders"), F.col("o_totalprice"), _w(), 0.7))
query("residual_scale", f"SELECT round(pow(sum(w * sqrt(abs(m - y))) / sum(w), 2), 6) AS scale FROM ({_base('real')})")(
    lambda spark, d: stats.residual_scale(_real_rows(spark, d), F.col("m0") - F.col("label"), F.col("weight")).select(r6("scale").alias("scale")))
query("count_classes", "SELECT count(DISTINCT o_orderpriority) AS classes FROM orders")(lambda spark, d: stats.count_classes(t(spark, d, "orders"), "o_orderpriority"))
query("rank_topk", f"SELECT row_id AS event_id, rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, row_id) AS rk FROM ({_EV.format(rel=4)})) WHERE rk <= 3")(
    lambda spark, d: stats.ranked(_events(spark, d).withColumnRenamed("m0", "score"), 3).select(F.col("row_id").alias("event_id"), "rk"))
query("label_order", f"SELECT o_orderkey, row_number() OVER (ORDER BY abs({_COX_Y}), o_orderkey) AS place FROM orders")(
    lambda spark, d: t(spark, d, "orders").select("o_orderkey", F.expr(_COX_Y).alias("y")).transform(lambda o: ranges.places(o, F.abs("y"), "o_orderkey")).select("o_orderkey", "place"))
query("sorted_quantiles", f"SELECT o_orderkey, round(least({_SQL_M}, 0.5 * {_SQL_M}, 0.3 - {_SQL_M}), 6) + 0.0 AS q0, round(greatest({_SQL_M}, 0.5 * {_SQL_M}, 0.3 - {_SQL_M}), 6) AS q2 FROM orders")(
    lambda spark, d: (lambda q: t(spark, d, "orders").select("o_orderkey", (r6(q[0]) + 0.0).alias("q0"), r6(q[2]).alias("q2")))(O.get("reg:quantileerror", P.resolve({"quantile_alpha": [0.1, 0.5, 0.9]})).link([_m(), _m() * 0.5, F.lit(0.3) - _m()])))
query("partition_rows", f"SELECT CASE WHEN l_quantity < 20 THEN 1 WHEN l_tax IS NULL OR l_tax < 0.04 THEN 3 ELSE 4 END AS node, count(*) AS rows FROM ({_FR}) GROUP BY 1")(
    lambda spark, d: fixed_model().predict_leaf(_fixed_rows(spark, d)).groupBy(F.col("leaf")[0].alias("node")).agg(F.count("*").alias("rows")))


@query("leaf_lookup", f"SELECT l_orderkey, l_partkey, CAST({_T1} AS DOUBLE) AS value FROM ({_FR})")
def _leaf_lookup(spark, d):
    m = fixed_model()
    leaves = m.node_table(spark).where("tree = 0 AND left < 0").select("node", F.col("leaf")[0].alias("value"))
    return m.predict_leaf(_fixed_rows(spark, d)).withColumn("node", F.col("leaf")[0]).join(F.broadcast(leaves), "node").select("l_orderkey", "l_partkey", "value")  # a few leaves; by hash, their rows would meet in as many tasks


query("model_roundtrip", ORACLE_SQL["predict_margin"])(
    lambda spark, d: Model.from_json(fixed_model().to_json()).with_margin(_fixed_rows(spark, d)).select("l_orderkey", "l_partkey", r6("m0").alias("margin")))


query("model_ubjson", ORACLE_SQL["predict_margin"])(
    lambda spark, d: Model.from_ubj(fixed_model().to_ubj()).with_margin(_fixed_rows(spark, d)).select("l_orderkey", "l_partkey", r6("m0").alias("margin")))


def _large_backend(spark, d):
    m = fixed_model()
    return m._mapped(_fixed_rows(spark, d), lambda m, x, b: m.numpy_margin(x, b), ["m0"]).select("l_orderkey", "l_partkey", r6("m0").alias("margin"))


query("predict_margin_batches", ORACLE_SQL["predict_margin"])(_large_backend)


@query("predict_linear", "SELECT o_orderkey, round(0.5 + 0.001 * o_totalprice - 0.02 * (o_custkey % 10), 6) AS margin, round(0.001 * o_totalprice, 6) AS c_price FROM orders")
def _predict_linear(spark, d):
    import numpy as np

    m = Model(P.resolve({"booster": "gblinear"}), ["price", "x"], [0.2])
    m.linear = np.array([[0.001], [-0.02], [0.3]])
    df = t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 10).cast("double").alias("x"))
    return m.contributions(m.with_margin(df)).select("o_orderkey", r6("m0").alias("margin"), r6(F.col("c0")[0]).alias("c_price"))


query("custom_objective", f"SELECT o_orderkey, round(2 * (m - y) * w, 6) AS g, round(2 * w, 6) AS h FROM ({_base('real')})")(
    lambda spark, d: O.get(lambda m, y, w: (2 * (m[0] - y) * w, 2 * w)).gradients(_real_rows(spark, d)).select(F.col("row_id").alias("o_orderkey"), r6("g0").alias("g"), r6("h0").alias("h")))
query("custom_metric", f"SELECT round(max(abs(m - y)), 6) AS value FROM ({_base('real')})")(
    lambda spark, d: spark.createDataFrame([(M.value(lambda x: ("max_error", x.agg(r6(F.max(F.abs(F.col("m0") - F.col("label"))))).first()[0]), _real_rows(spark, d))[1],)], "value double"))


@query("source_libsvm", "SELECT o_orderkey AS qid, CAST(o_orderkey % 2 AS DOUBLE) AS label, o_totalprice AS f1, CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS f2 FROM orders")
def _source_libsvm(spark, d):
    import tempfile
    import uuid

    folder = (spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="grove_text_")).rstrip("/") + f"/libsvm-{uuid.uuid4().hex}"
    cells = F.concat(F.lit("1:"), F.col("o_totalprice").cast("string")), F.when(F.col("o_custkey") % 5 != 0, F.concat(F.lit("2:"), F.col("o_custkey").cast("string")))
    t(spark, d, "orders").select(F.concat_ws(" ", (_k() % 2).cast("string"), F.concat(F.lit("qid:"), _k().cast("string")), *cells).alias("value")).write.text(folder)
    return frames.read_text(spark, f"{folder}?format=libsvm").select("qid", "label", "f1", "f2")


QUERIES |= {
    "train_continue": lambda spark, d: _trained({"objective": "binary:logistic", "max_depth": 2}, 1, _lines, init_model=train({"objective": "binary:logistic", "max_depth": 2}, _lines(spark, d), 1, features=FEATURES))(spark, d),
    "train_update": lambda spark, d: train({"objective": "binary:logistic", "process_type": "update", "updater_seq": "refresh,prune"}, _lines(spark, d), 1, features=FEATURES, init_model=train({"objective": "binary:logistic", "max_depth": 2}, _lines(spark, d), 1, features=FEATURES)).node_table(spark),
    "train_absolute": _trained({"objective": "reg:absoluteerror", "max_depth": 2}, 2, lambda s, d: _lines(s, d).withColumn("label", F.col("l_quantity") * F.col("l_discount"))),
    "train_cox": _trained({"objective": "survival:cox", "max_depth": 2}, 2, lambda s, d: t(s, d, "orders").select(_k().alias("row_id"), F.expr(_COX_Y).alias("label"), (_k() % 7).cast("double").alias("f0"), (_k() % 5).cast("double").alias("f1")), features=["f0", "f1"]),
    "train_categorical": _trained({"objective": "binary:logistic", "max_depth": 3}, 2, lambda s, d: t(s, d, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("label"), "l_linestatus", "l_quantity"), features=["l_linestatus", "l_quantity"]),
    "cuts_export": lambda spark, d: spark.createDataFrame([(i, b, float(c)) for i, x in enumerate(train({"max_depth": 1, "max_bin": 16}, _lines(spark, d), 1, features=FEATURES).cuts) for b, c in enumerate(x)], "fidx int, bin int, cut double"),
}

# ---- training in SQL

_SRC = f"SELECT l_quantity AS f0, l_discount AS f1, {_TAXM} AS f2, {{}} AS y FROM lineitem"
_FLAG, _THREE, _PRODUCT = "CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END", "CAST(CAST(l_quantity AS INTEGER) % 3 AS DOUBLE)", "CAST(l_quantity * l_discount AS DOUBLE)"
_SRC_CAT = f"SELECT CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS f0, l_quantity AS f1, {_FLAG} AS y FROM lineitem"
ORACLE_SQL |= {
    "train_binary_10": twins.boosted(_SRC.format(_FLAG), 3, twins.LOGISTIC, 10, 4),
    "train_approx": twins.boosted(_SRC.format(_FLAG), 3, twins.LOGISTIC, 2, 3),
    "train_exact": twins.boosted(_SRC.format(_FLAG), 3, twins.SQUARED, 2, 3),
    "train_lossguide": twins.boosted(_SRC.format(_FLAG), 3, twins.LOGISTIC, 2, 5, best_first=True),
    "train_constraints": twins.boosted(_SRC.format(_FLAG), 3, twins.LOGISTIC, 2, 3, monotone={0: 1, 1: -1}, sets={0: 0, 1: 0, 2: 1}),
    "train_softprob": twins.boosted(_SRC.format(_THREE), 3, twins.softmax(3), 2, 2),
    "train_vector_leaf": twins.boosted(_SRC.format(_THREE), 3, twins.softmax(3), 2, 2, vector=True),
    "train_quantile": twins.boosted(_SRC.format(_PRODUCT), 3, twins.quantiles(0.2, 0.8), 2, 2),
    "train_absolute": twins.boosted(_SRC.format(_PRODUCT), 3, twins.ABSOLUTE, 2, 2),
    "train_categorical": twins.boosted(_SRC_CAT, 2, twins.LOGISTIC, 2, 3),
    "train_linear": twins.linear(_SRC.format(_FLAG), 3, 4),
    "train_early_stop": twins.stopped(twins.boosted(_SRC.format(_FLAG), 3, twins.LOGISTIC, 8, 2, eta=1.0), 2),
    "train_continue": f"SELECT data, metric, 0 AS round, value FROM ({twins.boosted(_SRC.format(_FLAG), 3, twins.LOGISTIC, 2, 2)}) WHERE round = 1",
    "cuts_export": f"""WITH l AS ({_SRC.format("0")}), x AS (SELECT 0 AS fidx, f0 AS v FROM l UNION ALL SELECT 1, f1 FROM l UNION ALL SELECT 2, f2 FROM l), g AS (SELECT fidx, v, count(*) AS w FROM x WHERE v IS NOT NULL GROUP BY ALL),
 c AS (SELECT *, row_number() OVER (PARTITION BY fidx ORDER BY v) AS nth, count(*) OVER (PARTITION BY fidx) AS n, sum(w) OVER (PARTITION BY fidx ORDER BY v) AS cum, sum(w) OVER (PARTITION BY fidx) / 16 AS step FROM g),
 p AS (SELECT fidx, v AS cut FROM c WHERE nth > 1 AND (n <= 16 OR greatest(ceil((cum - w) / step), 1) <= least(ceil(cum / step) - 1, 15)) UNION ALL SELECT fidx, max(v) + (abs(max(v)) + 1e-5) FROM c GROUP BY fidx)
 SELECT fidx, CAST(row_number() OVER (PARTITION BY fidx ORDER BY cut) - 1 AS INTEGER) AS bin, cut FROM p""",
}
