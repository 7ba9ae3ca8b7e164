"""Links, probability distributions, gain algebra and ranking terms as Columns.

Everything stays in the JVM; only the normal distribution's CDF needs a vectorised
Python function.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EPS = 1e-16


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def logit(p) -> Column:
    return -F.log(F.lit(1.0) / col(p) - F.lit(1.0))


def softplus(x) -> Column:
    x = col(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def softplus_inv(y) -> Column:
    y = col(y)
    return y + F.log(-F.expm1(-y))


def total(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def softmax(xs: list[Column]) -> list[Column]:
    top = F.greatest(*xs) if len(xs) > 1 else xs[0]
    e = [F.exp(x - top) for x in xs]
    s = total(e)
    return [x / s for x in e]


def arg_max(xs: list[Column]) -> Column:
    """Index of the first largest."""
    a = F.array(*xs)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def log_gamma(x) -> Column:
    """ln Gamma(x), x > 0: Stirling's series after a shift by eight."""
    x = col(x)
    shift = total([F.log(x + k) for k in range(8)])
    y = x + 8.0
    inv = F.lit(1.0) / y
    series = inv / 12 - F.pow(inv, 3) / 360 + F.pow(inv, 5) / 1260 - F.pow(inv, 7) / 1680 + F.pow(inv, 9) / 1188
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return pd.Series(np.array([0.5 * math.erfc(-v / math.sqrt(2)) if v == v else float("nan") for v in z.to_numpy()]))


class Distribution:
    """Density, cumulative distribution and two derivatives of the density at z."""

    def __init__(self, name: str):
        self.name = name

    def pdf(self, z: Column) -> Column:
        if self.name == "normal":
            return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        if self.name == "logistic":
            w = F.exp(-F.abs(z))
            return w / ((1 + w) * (1 + w))
        w = F.exp(z)
        return F.when(w > 1e300, 0.0).otherwise(w * F.exp(-w))

    def cdf(self, z: Column) -> Column:
        if self.name == "normal":
            return normal_cdf(z)
        if self.name == "logistic":
            return sigmoid(z)
        return -F.expm1(-F.exp(z))

    def grad(self, z: Column) -> Column:
        if self.name == "normal":
            return -z * self.pdf(z)
        if self.name == "logistic":
            w = F.exp(-F.abs(z))
            return F.signum(z) * self.pdf(z) * (w - 1) / (1 + w)
        return (1 - F.exp(z)) * self.pdf(z)

    def hess(self, z: Column) -> Column:
        if self.name == "normal":
            return (z * z - 1) * self.pdf(z)
        if self.name == "logistic":
            w = F.exp(-F.abs(z))
            return self.pdf(z) * (w * w - 4 * w + 1) / ((1 + w) * (1 + w))
        w = F.exp(z)
        return F.when(w > 1e150, 0.0).otherwise((w * w - 3 * w + 1) * self.pdf(z))


def threshold_l1(g, alpha: float) -> Column:
    g = col(g)
    if not alpha:
        return g
    return F.when(g > alpha, g - alpha).when(g < -alpha, g + alpha).otherwise(F.lit(0.0))


def leaf_weight(g, h, reg_lambda: float = 1.0, reg_alpha: float = 0.0, max_delta_step: float = 0.0) -> Column:
    g, h = col(g), col(h)
    w = -threshold_l1(g, reg_alpha) / (h + reg_lambda)
    if max_delta_step:
        w = F.greatest(F.least(w, F.lit(max_delta_step)), F.lit(-max_delta_step))
    return F.when(h <= 0, 0.0).otherwise(w)


def leaf_gain(g, h, reg_lambda: float = 1.0, reg_alpha: float = 0.0, max_delta_step: float = 0.0) -> Column:
    """-(2Gw + (H + lambda)w^2 + 2 alpha |w|) at the best w."""
    g, h = col(g), col(h)
    if not max_delta_step:
        t = threshold_l1(g, reg_alpha)
        return F.when(h <= 0, 0.0).otherwise(t * t / (h + reg_lambda))
    w = leaf_weight(g, h, reg_lambda, reg_alpha, max_delta_step)
    return F.when(h <= 0, 0.0).otherwise(-(2 * g * w + (h + reg_lambda) * w * w + 2 * reg_alpha * F.abs(w)))


def dcg_gain(rel, exp_gain: bool = True) -> Column:
    return F.pow(F.lit(2.0), col(rel)) - 1 if exp_gain else col(rel).cast("double")


def dcg_discount(rank_from_one) -> Column:
    return F.lit(1.0) / F.log2(col(rank_from_one) + F.lit(1.0))
