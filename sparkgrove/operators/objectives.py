"""Objectives: (margin, label, weight, ...) -> (g, h), links, intercepts, label checks.

A registry maps names to objects. Row-wise objectives are Column expressions; those that
need a statistic of all rows make one aggregate first; ranking ones join documents of a
query with each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import EPS, Distribution, arg_max, dcg_discount, dcg_gain, sigmoid, softmax, softplus, total
from . import sampling
from .ranges import counted_ties, running

REGISTRY: dict[str, Callable[[dict], Objective]] = {}  # noqa: F821
FLT_MIN = 1.1754943508222875e-38
DRIVER_TIMES = 1 << 16  # distinct times up to which the driver sums risk sets


def register(*names: str):
    def put(cls):
        for n in names:
            REGISTRY[n] = lambda params, cls=cls, n=n: cls(params, n)
        return cls

    return put


def get(name, params: dict | None = None) -> Objective:  # noqa: F821
    from .. import params as P

    params = params or P.resolve({})
    if isinstance(name, Objective):
        return name
    if callable(name):
        return Custom(params, name)
    if name not in REGISTRY:
        raise ValueError(f"unknown objective {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](params)


class Objective:
    """df has label, weight and margin columns m0..m{K-1}; gradients() adds g0.., h0..
    weighted: a row of weight 2 counts as two equal rows of weight 1."""

    metric, check, stump, weighted = "rmse", None, False, True

    def __init__(self, params: dict, name: str = ""):
        self.p, self.name = params, name

    @property
    def outputs(self) -> int:
        return max(1, self.p.get("num_target", 1))

    def row(self, m: Column, y: Column, w: Column) -> tuple[Column, Column]:
        raise NotImplementedError

    def gradients(self, df: DataFrame) -> DataFrame:
        y = (lambda k: F.col("label")[k]) if self.outputs > 1 else (lambda k: F.col("label"))
        cols = {}
        for k in range(self.outputs):
            g, h = self.row(F.col(f"m{k}"), y(k), F.col("weight"))
            cols |= {f"g{k}": g, f"h{k}": h}
        return df.withColumns(cols)

    def link(self, m: list[Column]) -> list[Column]:
        return m

    def eval_link(self, m: list[Column]) -> list[Column]:
        return self.link(m)

    def inverse(self, p: float) -> float:
        return p

    def forward(self, m: float) -> float:
        return m

    def positive_weight(self, y: Column, w: Column) -> Column:
        s = self.p.get("scale_pos_weight", 1.0)
        return w if s == 1.0 else F.when(y == 1, w * s).otherwise(w)

    def validate(self, df: DataFrame) -> None:
        if self.check is None:
            return
        bad = df.where(~self.check(F.col("label")) | F.col("label").isNull()).limit(1).count()
        if bad:
            raise ValueError(f"labels are not valid for {self.name}")

    def fixed(self, df: DataFrame) -> DataFrame:
        """df with what gradients need that no margin changes, found once for all rounds."""
        return df

    def intercept(self, df: DataFrame) -> list[float]:
        """Margins to start from, one for each output."""
        if self.stump or self.p.get("scale_pos_weight", 1.0) != 1.0:
            zero = df.withColumns({f"m{k}": F.lit(0.0) for k in range(self.outputs)})
            sums = self.gradients(zero).agg(*(F.sum(f"{c}{k}").alias(f"{c}{k}") for c in "gh" for k in range(self.outputs))).first()
            return [self.inverse(self.forward(-(sums[f"g{k}"] or 0.0) / max(sums[f"h{k}"] or 0.0, 1e-6))) for k in range(self.outputs)]
        y = [F.col("label")[k] for k in range(self.outputs)] if self.outputs > 1 else [F.col("label")]
        r = df.agg(F.sum("weight").alias("w"), *(F.sum(F.col("weight") * x).alias(f"s{k}") for k, x in enumerate(y))).first()
        return [self.inverse((r[f"s{k}"] or 0.0) / r["w"]) if r["w"] else 0.0 for k in range(self.outputs)]


@register("reg:squarederror", "reg:linear")
class SquaredError(Objective):
    def row(self, m, y, w):
        w = self.positive_weight(y, w)
        return (m - y) * w, w * 1.0


@register("reg:squaredlogerror")
class SquaredLog(Objective):
    metric, stump = "rmsle", True
    check = staticmethod(lambda y: y > -1)

    def row(self, m, y, w):
        q = F.greatest(m, F.lit(-1 + 1e-6))
        d = F.log1p(q) - F.log1p(y)
        return d / (q + 1) * w, F.greatest((1 - d) / F.pow(q + 1, 2), F.lit(1e-6)) * w


class _Logistic(Objective):
    check = staticmethod(lambda y: (y >= 0) & (y <= 1))

    def row(self, m, y, w):
        w, s = self.positive_weight(y, w), sigmoid(m)
        return (s - y) * w, F.greatest(s * (1 - s), F.lit(EPS)) * w

    def link(self, m):
        return [sigmoid(x) for x in m]

    def inverse(self, p):
        p = min(max(p, 1e-16), 1 - 1e-16)
        return -math.log(1 / p - 1)

    def forward(self, m):
        return 1 / (1 + math.exp(-m))


@register("reg:logistic")
class RegLogistic(_Logistic):
    metric = "rmse"


@register("binary:logistic")
class BinaryLogistic(_Logistic):
    metric = "logloss"


@register("binary:logitraw")
class LogitRaw(_Logistic):
    metric = "logloss"

    def link(self, m):
        return m


@register("binary:hinge")
class Hinge(Objective):
    metric, stump, weighted = "error", True, False  # the smallest h is not weighted

    def row(self, m, y, w):
        t = 2 * y - 1
        near = m * t < 1
        return F.when(near, -t * w).otherwise(0.0), F.when(near, w * 1.0).otherwise(FLT_MIN)

    def link(self, m):
        return [F.when(x > 0, 1.0).otherwise(0.0) for x in m]


@register("reg:pseudohubererror")
class PseudoHuber(Objective):
    metric, stump = "mphe", True

    def row(self, m, y, w):
        d2, z = self.p["huber_slope"] ** 2, m - y
        r = F.sqrt(1 + z * z / d2)
        return z / r * w, d2 / ((d2 + z * z) * r) * w


@register("reg:absoluteerror")
class AbsoluteError(Objective):
    """A smooth surrogate whose scale is one statistic of all residuals."""

    metric = "mae"

    def gradients(self, df):
        r = F.col("m0") - F.col("label")
        got = df.agg(F.sum(F.col("weight") * F.sqrt(F.abs(r))).alias("s"), F.sum("weight").alias("w")).first()
        s = ((got["s"] or 0.0) / got["w"]) ** 2 if got["w"] else 0.0
        c = F.when((F.lit(s) == 0) & (r == 0), 1.0).otherwise(F.lit(s) / F.hypot(F.lit(s), r))
        return df.withColumns({"g0": F.col("weight") * r * c, "h0": F.col("weight") * c})

    def intercept(self, df):
        mean = super().intercept(df)[0]
        sums = self.gradients(df.withColumn("m0", F.lit(mean))).agg(F.sum("g0").alias("g"), F.sum("h0").alias("h")).first()
        return [mean - (sums["g"] or 0.0) / max(sums["h"] or 0.0, 1e-6)]


@register("reg:quantileerror")
class QuantileError(Objective):
    metric, stump = "quantile", True

    @property
    def alphas(self) -> list[float]:
        a = self.p.get("quantile_alpha")
        a = a if isinstance(a, (list, tuple)) else [a]
        if a[0] is None:
            raise ValueError("quantile_alpha is required")
        return sorted(a)

    @property
    def outputs(self):
        return len(self.alphas)

    def gradients(self, df):
        w, ks = F.col("weight"), range(self.outputs)
        r = [F.col(f"m{k}") - F.col("label") for k in ks]
        got = df.agg(F.sum("weight").alias("w"), *(F.sum(w * F.sqrt(F.abs(r[k]))).alias(f"s{k}") for k in ks)).first()
        cols = {}
        for k, a in enumerate(self.alphas):
            s = ((got[f"s{k}"] or 0.0) / got["w"]) ** 2 if got["w"] else 0.0
            if not s:
                cols |= {f"g{k}": F.lit(0.0), f"h{k}": F.lit(0.0)}
                continue
            x = r[k] / (0.04 * s)
            slope = F.when(x == 0, 1.0).otherwise(F.tanh(x) / x)
            cols |= {f"g{k}": 0.5 * s * (F.tanh(x) + 1 - 2 * a) * w, f"h{k}": F.greatest(slope, F.lit(3e-4)) / (2 * 0.04) * w}
        return df.withColumns(cols)

    def link(self, m):
        if len(m) == 1:
            return m
        a = F.array_sort(F.array(*m))
        return [a[k] for k in range(len(m))]


@register("reg:expectileerror")
class ExpectileError(Objective):
    """Non-crossing outputs: each adds a positive step to the one before."""

    metric = "expectile"
    STEP = 1e-6

    @property
    def alphas(self) -> list[float]:
        a = self.p.get("expectile_alpha")
        a = a if isinstance(a, (list, tuple)) else [a]
        if a[0] is None:
            raise ValueError("expectile_alpha is required")
        return sorted(a)

    @property
    def outputs(self):
        return len(self.alphas)

    def link(self, m):
        out = [m[0]]
        for x in m[1:]:
            out.append(out[-1] + self.STEP + softplus(x))
        return out

    def gradients(self, df):
        y, w, k = F.col("label"), F.col("weight"), self.outputs
        m = [F.col(f"m{j}") for j in range(k)]
        pred = self.link(m)
        a = [F.when(p >= y, 1 - al).otherwise(al) for p, al in zip(pred, self.alphas)]
        cols = {}
        for j in range(k):
            s = F.lit(1.0) if j == 0 else sigmoid(m[j])
            cols[f"g{j}"] = s * total([a[i] * (pred[i] - y) for i in range(j, k)]) * w
            cols[f"h{j}"] = s * s * total([a[i] for i in range(j, k)]) * w
        return df.withColumns(cols)

    def intercept(self, df):
        mean = super().intercept(df)[0]
        y, w = F.col("label"), F.col("weight")
        side = [F.when(F.lit(mean) >= y, 1 - a).otherwise(a) for a in self.alphas]
        got = df.agg(*(F.sum(s * (F.lit(mean) - y) * w).alias(f"g{i}") for i, s in enumerate(side)), *(F.sum(s * w).alias(f"h{i}") for i, s in enumerate(side))).first()
        at = [mean - (got[f"g{i}"] or 0.0) / max(got[f"h{i}"] or 0.0, 1e-6) for i in range(len(side))]
        out = [at[0]]
        for i in range(1, len(at)):
            gap = max(at[i] - max(at[:i]) - self.STEP, 1e-6)
            out.append(gap + math.log(-math.expm1(-gap)))
        return out


class _LogLink(Objective):
    def link(self, m):
        return [F.exp(x) for x in m]

    def inverse(self, p):
        return math.log(max(p, 1e-16))

    def forward(self, m):
        return math.exp(m)


@register("count:poisson")
class Poisson(_LogLink):
    metric = "poisson-nloglik"
    check = staticmethod(lambda y: y >= 0)

    def row(self, m, y, w):
        e = F.exp(m)
        return (e - y) * w, 0.5 * (e + y) * w


@register("reg:gamma")
class Gamma(_LogLink):
    metric = "gamma-deviance"
    check = staticmethod(lambda y: y > 0)

    def row(self, m, y, w):
        w, q = self.positive_weight(y, w), y / F.exp(m)
        return (1 - q) * w, q * w


@register("reg:tweedie")
class Tweedie(_LogLink):
    check = staticmethod(lambda y: y >= 0)

    @property
    def metric(self):
        return f"tweedie-nloglik@{self.p['tweedie_variance_power']:g}"

    def row(self, m, y, w):
        r = self.p["tweedie_variance_power"]
        a, b = F.exp((1 - r) * m), F.exp((2 - r) * m)
        return (-y * a + b) * w, (-y * (1 - r) * a + (2 - r) * b) * w


@register("survival:cox")
class Cox(_LogLink):
    """Breslow risk sets: the denominator moves with |label|, event sums row by row."""

    metric, stump, weighted = "cox-nloglik", True, False

    def gradients(self, df):
        event = F.col("label") > 0
        d = df.withColumns({"__t": F.abs("label"), "__e": F.exp("m0"), "__event": event.cast("double")})
        times = d.groupBy("__t").agg(F.sum("__e").alias("e"), F.sum("__event").alias("k"))
        few = times.limit(DRIVER_TIMES + 1).collect()  # rows that share a time would meet in one task of a join by time
        if len(few) <= DRIVER_TIMES and all(r["e"] is not None and r["__t"] is not None and r["__t"] == r["__t"] for r in few):
            past = F.broadcast(self._past_of(df.sparkSession, few))
        else:
            # the risk set of a time is what is left then; event sums of the times before it
            risk = running(times, "__t", ["e"]).select("__t", F.col("c_e").alias("__d"), (F.col("k") / F.col("c_e")).alias("r"), (F.col("k") / F.col("c_e") / F.col("c_e")).alias("s"))
            past = running(risk, "__t", ["r", "s"], descending=False).select(F.col("__t").alias("__time"), "__d", (F.col("c_r") - F.col("r")).alias("__r"), (F.col("c_s") - F.col("s")).alias("__s"))
        d = (d if "__ties" in df.columns else self.fixed(d)).withColumn("__k", F.col("__ties"))
        d = d.join(past, F.col("__t").eqNullSafe(F.col("__time")))
        own = F.col("__k") / F.col("__d")
        r, s = F.col("__r") + own, F.col("__s") + own / F.col("__d")
        g = F.col("__e") * r - F.col("__event")
        h = F.col("__e") * r - F.col("__e") * F.col("__e") * s
        return d.withColumns({"g0": g * F.col("weight"), "h0": h * F.col("weight")}).drop("__t", "__e", "__d", "__r", "__s", "__k", "__event", "__time", *([] if "__ties" in df.columns else ["__ties"]))

    def fixed(self, df):
        """df with the events of a row's time up to and with it, in the order of row ids."""
        d = df.withColumns({"__tied": F.abs("label"), "__event_here": (F.col("label") > 0).cast("double")})
        return counted_ties(d, "__tied", "row_id" if "row_id" in df.columns else "label", {"__ties": F.col("__event_here")}).drop("__tied", "__event_here")

    @staticmethod
    def _past_of(spark, rows: list) -> DataFrame:
        """The sums of running over few times (t, e, k), on the driver."""
        rows = sorted(rows, key=lambda r: r["__t"])
        left = np.cumsum([r["e"] for r in rows][::-1])[::-1]
        own = [(r["k"] / a, r["k"] / a / a) if a else (math.nan, math.nan) for r, a in zip(rows, left)]
        sums = np.cumsum(np.array([(0.0, 0.0), *own], float), axis=0)
        return spark.createDataFrame([(r["__t"], float(a), float(s[0]), float(s[1])) for r, a, s in zip(rows, left, sums)], "__time double, __d double, __r double, __s double")


@register("survival:aft")
class Aft(_LogLink):
    """label_lower and label_upper bound the time; null or infinite upper: right-censored."""

    metric = "aft-nloglik"

    def gradients(self, df):
        g, h = aft_terms(F.col("m0"), F.col("label_lower"), F.col("label_upper"), self.p["aft_loss_distribution"], self.p["aft_loss_distribution_scale"])
        return df.withColumns({"g0": g * F.col("weight"), "h0": h * F.col("weight")})

    def intercept(self, df):
        return [math.log(0.5)]


def aft_terms(m: Column, lower: Column, upper: Column, name: str, sigma: float) -> tuple[Column, Column]:
    """Gradient in [-15, 15] and Hessian in [1e-16, 15]; limits where terms vanish."""
    dist = Distribution(name)
    top = upper.isNull() | (upper == float("inf"))
    zl, zu = (F.log(lower) - m) / sigma, (F.log(upper) - m) / sigma
    # where the density underflows the derivatives take their limits: (left, right) of the distribution
    far = {"normal": ((-15.0, 1 / sigma**2), (15.0, 1 / sigma**2)), "logistic": ((-1 / sigma, EPS), (1 / sigma, EPS)), "extreme": ((-15.0, 15.0), (1 / sigma, EPS))}[name]

    def limit(z, k):
        return F.when(z > 0, far[0][k]).otherwise(far[1][k])

    f, f1, f2 = dist.pdf(zu), dist.grad(zu), dist.hess(zu)
    exact = lower == upper
    ge, he = f1 / (sigma * f), -(f * f2 - f1 * f1) / (sigma * sigma * f * f)
    ge, he = F.when(f < 1e-12, limit(zu, 0)).otherwise(ge), F.when(f < 1e-12, limit(zu, 1)).otherwise(he)
    low = lower <= 0
    fu, fl = F.when(top, 0.0).otherwise(dist.pdf(zu)), F.when(low, 0.0).otherwise(dist.pdf(zl))
    cu, cl = F.when(top, 1.0).otherwise(dist.cdf(zu)), F.when(low, 0.0).otherwise(dist.cdf(zl))
    du, dl = F.when(top, 0.0).otherwise(dist.grad(zu)), F.when(low, 0.0).otherwise(dist.grad(zl))
    c, d = cu - cl, fu - fl
    gc, hc = d / (sigma * c), -(c * (du - dl) - d * d) / (sigma * sigma * c * c)
    z = F.when(top, zl).when(low, zu).otherwise(F.when(F.abs(zl) < F.abs(zu), zl).otherwise(zu))
    gl = F.when(top & (z <= 0), 0.0).when(~top & low & (z > 0), 0.0).otherwise(limit(z, 0))
    hl = F.when(top & (z <= 0), EPS).when(~top & low & (z > 0), EPS).otherwise(limit(z, 1))
    gc, hc = F.when(c < 1e-12, gl).otherwise(gc), F.when(c < 1e-12, hl).otherwise(hc)
    g, h = F.when(exact, ge).otherwise(gc), F.when(exact, he).otherwise(hc)
    return F.greatest(F.least(g, F.lit(15.0)), F.lit(-15.0)), F.greatest(F.least(h, F.lit(15.0)), F.lit(EPS))


class _Multi(Objective):
    @property
    def outputs(self):
        k = self.p.get("num_class", 0)
        if k < 1:
            raise ValueError("num_class is required")
        return k

    def validate(self, df):
        k = self.outputs
        self.check = lambda y: (y >= 0) & (y < k) & (y == F.floor(y))
        super().validate(df)

    def gradients(self, df):
        w, ps = F.col("weight"), softmax([F.col(f"m{k}") for k in range(self.outputs)])
        cols = {}
        for k, p in enumerate(ps):
            cols[f"g{k}"] = (p - F.when(F.col("label") == k, 1.0).otherwise(0.0)) * w
            cols[f"h{k}"] = F.greatest(2 * p * (1 - p) * w, F.lit(EPS))
        return df.withColumns(cols)

    def eval_link(self, m):
        return softmax(m)

    def intercept(self, df):
        got = {int(r["label"]): r["w"] for r in df.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
        all_ = sum(got.values()) or 1.0
        logs = [math.log(max(got.get(k, 0.0) / all_, 1e-6)) for k in range(self.outputs)]
        mean = sum(logs) / len(logs)
        return [x - mean for x in logs]


@register("multi:softmax")
class SoftMax(_Multi):
    metric = "mlogloss"

    def link(self, m):
        return [arg_max(m).cast("double")]


@register("multi:softprob")
class SoftProb(_Multi):
    metric = "mlogloss"

    def link(self, m):
        return softmax(m)


class _Rank(Objective):
    """Pairs of a query's documents: the top k by score against all below them, or each
    document against sampled others. Weights are per query."""

    kind, stump, weighted = "pairwise", True, False

    @property
    def k(self) -> int:
        n = self.p.get("lambdarank_num_pair_per_sample")
        return n if n else (32 if self.p["lambdarank_pair_method"] == "topk" else 1)

    @property
    def metric(self):
        return f"{'map' if self.kind == 'map' else 'ndcg'}@{self.k if self.p['lambdarank_pair_method'] == 'topk' else 32}"

    def pairs(self, df: DataFrame, bias: DataFrame | None = None) -> DataFrame:
        """(qid, hi, lo, lam, hess): one row for each pair, hi being the better label."""
        exp_gain = self.p["ndcg_exp_gain"]
        by_label = Window.partitionBy("qid").orderBy(F.desc("label"), "row_id")
        d = df.select("qid", "row_id", "label", F.col("m0").alias("s")).withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "row_id")))
        d = d.withColumn("ideal", F.row_number().over(by_label)).withColumn("n", F.count("*").over(Window.partitionBy("qid")))
        q = Window.partitionBy("qid")
        cut = self.k if self.p["lambdarank_pair_method"] == "topk" else None
        gain = dcg_gain("label", exp_gain)
        ideal = F.sum(F.when(F.lit(cut is None) | (F.col("ideal") <= (cut or 0)), gain * dcg_discount("ideal")).otherwise(0.0)).over(q)
        d = d.withColumns({"gain": gain, "disc": dcg_discount("rk"), "idcg": ideal, "best": F.max("s").over(q), "worst": F.min("s").over(q)})
        upto = Window.partitionBy("qid").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumns({"hits": F.sum("label").over(upto), "prec": F.sum(F.col("label") / F.col("rk")).over(upto), "rel": F.sum("label").over(q)})
        a, b = d, d.select("qid", *(F.col(c).alias(f"{c}_") for c in ("row_id", "label", "s", "rk", "gain", "disc", "hits", "prec")))
        if self.p["lambdarank_pair_method"] == "topk":
            p = a.join(b, "qid").where((F.col("rk") <= cut) & (F.col("rk_") > F.col("rk")) & (F.col("label") != F.col("label_")))
        else:
            p = sampling.drawn_pairs(d, b, self.k, self.p["seed"])
        up = F.col("label") > F.col("label_")
        pick = lambda c: (F.when(up, F.col(c)).otherwise(F.col(f"{c}_")), F.when(up, F.col(f"{c}_")).otherwise(F.col(c)))
        (hi, lo), (sh, sl), (rh, rl), (gh, gl), (dh, dl) = (pick(c) for c in ("row_id", "s", "rk", "gain", "disc"))
        if self.kind == "ndcg":
            delta = F.abs(gh * dh + gl * dl - gl * dh - gh * dl) * F.when(F.col("idcg") == 0, 0.0).otherwise(1 / F.col("idcg"))
        elif self.kind == "map":
            first, second = F.least("rk", "rk_"), F.greatest("rk", "rk_")
            at = lambda c: F.when(F.col("rk") < F.col("rk_"), F.col(c)).otherwise(F.col(f"{c}_"))
            after = lambda c: F.when(F.col("rk") < F.col("rk_"), F.col(f"{c}_")).otherwise(F.col(c))
            swap_up = F.when(F.col("rel") == 0, 0.0)
            down = (after("hits") / second - (at("hits") + 1) / first - (after("prec") - after("label") / second - at("prec"))) / F.col("rel")
            lift = (at("hits") / first - after("hits") / second + (after("prec") - after("label") / second - at("prec"))) / F.col("rel")
            delta = F.abs(swap_up.when(at("label") > after("label"), lift).otherwise(down))
        else:
            delta = F.lit(1.0)
        p = p.select("qid", hi.alias("hi"), lo.alias("lo"), sh.alias("sh"), sl.alias("sl"), rh.alias("rank_hi"), rl.alias("rank_lo"), delta.alias("delta"), "best", "worst")
        if self.p["lambdarank_score_normalization"]:
            p = p.withColumn("delta", F.when(F.col("best") != F.col("worst"), F.col("delta") / (F.abs(F.col("sh") - F.col("sl")) + 0.01)).otherwise(F.col("delta")))
        s = sigmoid(F.col("sh") - F.col("sl"))
        p = p.withColumns({"lam": (s - 1) * F.col("delta"), "hess": 2 * F.col("delta") * F.greatest(s * (1 - s), F.lit(EPS))})
        if bias is not None:
            tp, tm = bias.select((F.col("pos") + 1).alias("rank_hi"), F.col("tp")), bias.select((F.col("pos") + 1).alias("rank_lo"), F.col("tm"))
            p = p.join(tp, "rank_hi", "left").join(tm, "rank_lo", "left")
            div = F.coalesce("tp", F.lit(1.0)) * F.coalesce("tm", F.lit(1.0))
            p = p.withColumns({"cost": F.log1p(F.exp(-(F.col("sh") - F.col("sl")))) * F.col("delta"), "lam": F.col("lam") / div, "hess": F.col("hess") / div})
        return p

    def gradients(self, df, bias: DataFrame | None = None):
        side = lambda row, lam: F.struct(F.col(row).alias("row_id"), lam.alias("g"))
        both = self.pairs(df, bias).select("qid", "hess", F.explode(F.array(side("hi", F.col("lam")), side("lo", -F.col("lam")))).alias("x"))  # the pairs are made once
        sums = both.groupBy("qid", F.col("x.row_id").alias("row_id")).agg(F.sum("x.g").alias("g"), F.sum("hess").alias("h"), F.sum(F.abs("x.g")).alias("lam"))
        groups = df.groupBy("qid").agg(F.first("weight").alias("qw"))
        scale = groups.agg((F.count("*") / F.sum("qw")).alias("ws")).first()["ws"] or 1.0
        out = df.join(sums, ["qid", "row_id"], "left")
        norm = F.lit(1.0)
        if self.p["lambdarank_normalization"] and self.p["lambdarank_pair_method"] == "topk":
            out = out.withColumn("lam", F.sum("lam").over(Window.partitionBy("qid")))  # each pair is there from both sides
            norm = F.when(F.col("lam") > 0, F.log2(1 + F.col("lam")) / F.col("lam")).otherwise(1.0)
        elif self.p["lambdarank_normalization"]:
            norm = F.lit(1.0 / self.k)
        f = norm * F.col("weight") * scale
        return out.withColumns({"g0": F.coalesce("g", F.lit(0.0)) * f, "h0": F.coalesce("h", F.lit(0.0)) * f}).drop("g", "h", "lam")

    def update_bias(self, df: DataFrame, bias: DataFrame | None = None) -> DataFrame:
        """(pos, tp, tm): position propensities after one round of unbiased training."""
        spark = df.sparkSession
        start = bias if bias is not None else spark.range(self.k).select(F.col("id").cast("int").alias("pos"), F.lit(1.0).alias("tp"), F.lit(1.0).alias("tm"))
        p = self.pairs(df, start).withColumns({"tp": F.coalesce("tp", F.lit(1.0)), "tm": F.coalesce("tm", F.lit(1.0))})
        li = p.groupBy((F.col("rank_hi") - 1).alias("pos")).agg(F.sum(F.col("cost") / F.col("tm")).alias("li"))
        lj = p.groupBy((F.col("rank_lo") - 1).alias("pos")).agg(F.sum(F.col("cost") / F.col("tp")).alias("lj"))
        both = start.select("pos").join(li, "pos", "left").join(lj, "pos", "left").fillna(0.0, ["li", "lj"])
        first = both.where("pos = 0").first()
        power = 1.0 / (1.0 + self.p["lambdarank_bias_norm"])
        share = lambda c, x: F.pow(F.col(c) / F.lit(x), power) if x else F.lit(1.0)
        return both.select("pos", share("li", first["li"]).alias("tp"), share("lj", first["lj"]).alias("tm"))


@register("rank:ndcg")
class RankNdcg(_Rank):
    kind = "ndcg"


@register("rank:map")
class RankMap(_Rank):
    kind = "map"


@register("rank:pairwise")
class RankPairwise(_Rank):
    kind = "pairwise"


class Custom(Objective):
    """A user's function of Columns (margins, label, weight) -> list of (g, h)."""

    weighted = False

    def __init__(self, params, fn):
        super().__init__(params, getattr(fn, "__name__", "custom"))
        self.fn = fn

    @property
    def outputs(self):
        return max(1, self.p.get("num_class", 0), self.p.get("num_target", 1))

    def gradients(self, df):
        got = self.fn([F.col(f"m{k}") for k in range(self.outputs)], F.col("label"), F.col("weight"))
        got = [got] if isinstance(got, tuple) else got
        return df.withColumns({f"{c}{k}": x for k, gh in enumerate(got) for c, x in zip("gh", gh)})

    def intercept(self, df):
        return [0.5] * self.outputs
