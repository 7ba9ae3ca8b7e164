"""The linear booster: coordinate descent on sums over rows.

A round makes one pass: sums of g, h and of all products needed come from one aggregate
of F^2 terms, so that every coordinate's step afterwards is arithmetic on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delta(g: float, h: float, w: float, alpha: float, lam: float) -> float:
    """Soft-thresholded Newton step of one weight."""
    if h < 1e-5:
        return 0.0
    g, h = g + lam * w, h + lam
    step = w - g / h
    return max(-(g + alpha) / h, -w) if step >= 0 else min(-(g - alpha) / h, -w)


def order(kind: str, n: int, rng, gain=None, top_k: int = 0) -> list[int]:
    if kind == "cyclic":
        return list(range(n))
    if kind == "shuffle":
        return rng.permutation(n).tolist()
    if kind == "random":
        return rng.integers(0, n, n).tolist()
    ranked = np.argsort(-np.abs(gain), kind="stable").tolist()
    return ranked[: top_k or n]


def linear_round(graded: DataFrame, model, p: dict, rng) -> bool:
    """One round over all outputs; true when the largest step is below the tolerance."""
    fs, k = model.features, model.outputs
    if model.linear is None:
        model.linear = np.zeros((len(fs) + 1, k))
    x = [F.coalesce(F.col(f), F.lit(0.0)) for f in fs]
    biggest = 0.0
    for t in range(k):
        g, h = F.col(f"g{t}"), F.col(f"h{t}")
        d = graded.where(h >= 0)
        terms = {"w": F.sum("weight"), "g": F.sum(g), "h": F.sum(h)}
        for i in range(len(fs)):
            terms |= {f"g{i}": F.sum(g * x[i]), f"h{i}": F.sum(h * x[i])}
            terms |= {f"h{i}_{j}": F.sum(h * x[i] * x[j]) for j in range(i + 1)}
        s = d.agg(*(c.alias(n) for n, c in terms.items())).first().asDict()
        s = {n: v or 0.0 for n, v in s.items()}
        alpha, lam, lr = p["reg_alpha"] * s["w"], p["reg_lambda"] * s["w"], p["learning_rate"]
        hess = np.array([[s[f"h{max(i, j)}_{min(i, j)}"] for j in range(len(fs))] for i in range(len(fs))])
        hx, gx = np.array([s[f"h{i}"] for i in range(len(fs))]), np.array([s[f"g{i}"] for i in range(len(fs))])
        bias = lr * (-s["g"] / s["h"] if s["h"] else 0.0)
        model.linear[-1, t] += bias
        gx = gx + bias * hx
        biggest = max(biggest, abs(bias))
        todo = len(fs) if p["feature_selector"] in ("greedy",) else 1
        plan = None
        for step in range(todo if p["feature_selector"] == "greedy" else 1):
            gains = np.array([delta(gx[i], hess[i, i], model.linear[i, t], alpha, lam) for i in range(len(fs))])
            plan = order(p["feature_selector"], len(fs), rng, gains, p["top_k"])
            if p["feature_selector"] == "greedy":
                if step >= (p["top_k"] or len(fs)):
                    break
                plan = plan[:1]
            for i in plan:
                dw = lr * delta(gx[i], hess[i, i], model.linear[i, t], alpha, lam)
                model.linear[i, t] += dw
                gx = gx + dw * hess[:, i]
                biggest = max(biggest, abs(dw))
    return p["tolerance"] > 0 and biggest <= p["tolerance"]
