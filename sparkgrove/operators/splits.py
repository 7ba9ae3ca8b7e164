"""Histograms of gradients and the search for the best split of a node.

Histograms are partial sums in each task (vectorised over bins) and one shuffle of at
most nodes x features x bins rows. A level whose histogram is within DRIVER_CELLS is
searched on the driver, where the larger child is its parent minus the smaller; beyond
that each (node, feature) is searched where the shuffle puts it and only one candidate
for each comes back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DRIVER_CELLS = 2_000_000
MIN_GAIN = 1e-6


@dataclass
class Split:
    gain: float = -np.inf
    fidx: int = -1
    bin: int = 0
    default_left: bool = False
    cats: tuple = ()
    left: np.ndarray = field(default_factory=lambda: np.zeros(2))
    right: np.ndarray = field(default_factory=lambda: np.zeros(2))
    is_cat: bool = False


class Router:
    """The nodes that rows reach in a growing tree, found for whole batches at once."""

    def __init__(self, nodes: list, width: int):
        self.split = np.array([x.left >= 0 for x in nodes])
        self.feature, self.bin = np.array([x.fidx for x in nodes]), np.array([x.bin for x in nodes])
        self.left, self.right, self.missing_left = np.array([x.left for x in nodes]), np.array([x.right for x in nodes]), np.array([x.default_left for x in nodes])
        self.is_cat = np.array([x.is_cat for x in nodes])
        self.cats = np.zeros((len(nodes) if self.is_cat.any() else 1, width), bool)
        for n in np.flatnonzero(self.is_cat):
            self.cats[n, list(nodes[n].cats)] = True

    def __call__(self, bins: list[np.ndarray], rows: int) -> np.ndarray:
        """bins: one array for each feature, -1 where the cell is missing."""
        node, cells = np.zeros(rows, np.int64), np.stack(bins) if self.split[0] else None
        at = np.arange(rows) if self.split[0] else np.empty(0, np.int64)
        while len(at):
            n = node[at]
            b = cells[self.feature[n], at]
            right = b > self.bin[n]
            if self.is_cat.any():
                right = np.where(self.is_cat[n], self.cats[np.where(self.is_cat[n], n, 0), np.maximum(b, 0)], right)
            node[at] = np.where(np.where(b < 0, ~self.missing_left[n], right), self.right[n], self.left[n])
            at = at[self.split[node[at]]]
        return node


def histogram(df: DataFrame, n_features: int, n_bins: list[int], targets: int = 1, route: Router | None = None, wanted: list[int] | None = None) -> DataFrame:
    """df(node, b0.., g0.., h0..) -> (node, fidx, bin, sums of g and h). With route, rows are
    sent through the tree by it, in place of the column node, and only the wanted nodes are
    summed: the plan is the same at every level, and a task keeps one array for them."""
    width = max(n_bins)
    names = [f"{c}{t}" for t in range(targets) for c in "gh"]

    def run(batches):
        slots = {n: i for i, n in enumerate(wanted)} if route else {}
        sums = np.zeros((len(slots), n_features, width, len(names)))
        slot_of = np.full(len(route.split), -1) if route else None
        for n, i in slots.items():
            slot_of[n] = i
        for batch in batches:
            bins = [pc.fill_null(batch.column(f"b{f}"), -1).to_numpy() for f in range(n_features)]
            if route:
                slot = slot_of[route(bins, batch.num_rows)]
            else:
                ids, slot = np.unique(batch.column("node").to_numpy(), return_inverse=True)
                slot = np.array([slots.setdefault(n, len(slots)) for n in ids.tolist()], np.int64)[slot]
                sums = np.concatenate([sums, np.zeros((len(slots) - len(sums), *sums.shape[1:]))])
            vals = [batch.column(c).to_numpy() for c in names]
            for f, b in enumerate(bins):
                there = (slot >= 0) & (b >= 0)
                cell = slot[there] * width + b[there]
                for k, v in enumerate(vals):
                    sums[:, f, :, k] += np.bincount(cell, v[there], len(slots) * width).reshape(len(slots), width)
        for n, i in slots.items():
            f, b = np.nonzero(sums[i].any(2))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(f), n, np.int32)), pa.array(f.astype(np.int32)), pa.array(b.astype(np.int32)), *(pa.array(sums[i, f, b, k]) for k in range(len(names)))], names=["node", "fidx", "bin", *names])

    cols = [*([] if route else ["node"]), *(f"b{f}" for f in range(n_features)), *names]
    part = df.selectExpr(*(f"cast({c} AS {'int' if c == 'node' or c[0] == 'b' else 'double'}) AS {c}" for c in cols)).mapInArrow(run, "node int, fidx int, bin int, " + ", ".join(f"{c} double" for c in names))
    return part.groupBy("node", "fidx", "bin").agg(*(F.sum(c).alias(c) for c in names))


class Finder:
    """Finds the best split from a node's histogram; holds parameters and cuts."""

    def __init__(self, params: dict, n_bins: list[int], categorical: set[int] = frozenset(), monotone: list[int] | None = None, targets: int = 1):
        self.p, self.n_bins, self.cat, self.targets = params, n_bins, set(categorical), targets
        self.monotone = monotone or [0] * len(n_bins)

    def weight(self, g, h, lo=-np.inf, hi=np.inf):
        a, lam, d = self.p["reg_alpha"], self.p["reg_lambda"], self.p["max_delta_step"]
        with np.errstate(divide="ignore", invalid="ignore"):
            w = np.where(h > 0, -np.sign(g) * np.maximum(np.abs(g) - a, 0) / (h + lam), 0.0)
        if d:
            w = np.clip(w, -d, d)
        return np.clip(w, lo, hi)

    def gain_at(self, g, h, w):
        return np.where(h > 0, -(2 * g * w + (h + self.p["reg_lambda"]) * w * w + 2 * self.p["reg_alpha"] * np.abs(w)), 0.0)

    def gain(self, s, lo=-np.inf, hi=np.inf):
        g, h = s[..., 0::2], s[..., 1::2]
        return self.gain_at(g, h, self.weight(g, h, lo, hi)).sum(-1)

    def judge(self, left, right, root_gain, fidx, lo, hi):
        """Loss change of candidate children (.., 2T); -inf where not valid."""
        hl, hr = left[..., 1::2].mean(-1), right[..., 1::2].mean(-1)
        ok = (hl > 0) & (hr > 0) & (hl >= self.p["min_child_weight"]) & (hr >= self.p["min_child_weight"])
        out = self.gain(left, lo, hi) + self.gain(right, lo, hi) - root_gain
        m = self.monotone[fidx]
        if m:
            wl, wr = self.weight(left[..., 0], left[..., 1], lo, hi), self.weight(right[..., 0], right[..., 1], lo, hi)
            ok &= wl <= wr if m > 0 else wl >= wr
        return np.where(ok & np.isfinite(out), out, -np.inf)

    def of_feature(self, fidx: int, hist: np.ndarray, total: np.ndarray, root_gain: float, lo=-np.inf, hi=np.inf) -> Split:
        """hist: (bins, 2T) sums of one feature; total: the node's sums with missing cells."""
        n = self.n_bins[fidx]
        hist = hist[:n]
        there = hist.sum(0)
        missing = not np.allclose(there, total, rtol=1e-9, atol=1e-9)
        best = Split()

        def offer(left, right, bins, default_left, cats=None):
            nonlocal best
            gains = self.judge(left, right, root_gain, fidx, lo, hi)
            k = int(np.argmax(gains)) if len(gains) else -1
            if k >= 0 and gains[k] > best.gain:
                best = Split(float(gains[k]), fidx, int(bins[k]), default_left, tuple(cats[k]) if cats else (), left[k], right[k], cats is not None)

        if fidx not in self.cat:
            cum = np.cumsum(hist, axis=0)
            offer(cum, total - cum, np.arange(n), False)
            if missing:
                right = np.cumsum(hist[::-1], axis=0)  # from the last bin down; the last candidate sends all values right
                offer(total - right, right, np.arange(n - 2, -2, -1), True)
            return best
        if n < self.p["max_cat_to_onehot"]:
            cats = [(c,) for c in range(n)]
            offer(total - hist, hist, np.arange(n), True, cats)
            if missing:
                offer(there - hist, hist + (total - there), np.arange(n), False, cats)
            return best
        used = np.flatnonzero(hist[:, 1] > 0)
        order = used[np.argsort(self.weight(hist[used, 0], hist[used, 1]), kind="stable")]
        most = min(self.p["max_cat_threshold"], max(0, len(order) - 1))
        for o in (order, order[::-1]):
            right = np.cumsum(hist[o], axis=0)[:most]
            cats = [sorted(int(c) for c in o[: k + 1]) for k in range(most)]
            offer(total - right, right, np.arange(most), True, cats)
            if missing:
                offer(there - right, right + (total - there), np.arange(most), False, cats)
        return best

    def of_node(self, hist: np.ndarray, total: np.ndarray, features, lo=-np.inf, hi=np.inf) -> Split:
        root_gain, best = self.gain(total, lo, hi), Split()
        for f in sorted(features):
            s = self.of_feature(f, hist[f], total, root_gain, lo, hi)
            if s.gain > best.gain:
                best = s
        return best


def dense(rows: list, n_features: int, width: int, targets: int) -> dict[int, np.ndarray]:
    """Collected histogram rows by node."""
    out: dict[int, np.ndarray] = {}
    for r in rows:
        h = out.setdefault(r[0], np.zeros((n_features, width, 2 * targets)))
        h[r[1], r[2]] = r[3:]
    return out


def search_distributed(hist: DataFrame, finder: Finder, totals: dict[int, np.ndarray], features: dict[int, list[int]], bounds: dict[int, tuple]) -> dict[int, Split]:
    """One task group for each (node, feature); only candidates come back."""
    names = [f"{c}{t}" for t in range(finder.targets) for c in "gh"]

    def one(t: pa.Table) -> pa.Table:
        node, f = t["node"][0].as_py(), t["fidx"][0].as_py()
        h = np.zeros((finder.n_bins[f], len(names)))
        h[t["bin"].to_numpy()] = np.stack([t[c].to_numpy() for c in names], 1)
        s = finder.of_feature(f, h, totals[node], finder.gain(totals[node], *bounds[node]), *bounds[node]) if f in features[node] else Split()
        return pa.table({"node": pa.array([node], pa.int32()), "gain": [s.gain], "fidx": pa.array([s.fidx], pa.int32()), "bin": pa.array([s.bin], pa.int32()), "dl": [s.default_left], "is_cat": [s.is_cat],
                         "cats": pa.array([list(s.cats)], pa.list_(pa.int32())), "l": pa.array([s.left.tolist()], pa.list_(pa.float64())), "r": pa.array([s.right.tolist()], pa.list_(pa.float64()))})

    got = hist.groupBy("node", "fidx").applyInArrow(one, "node int, gain double, fidx int, bin int, dl boolean, is_cat boolean, cats array<int>, l array<double>, r array<double>")
    out: dict[int, Split] = {n: Split() for n in totals}
    for r in sorted(got.where(F.col("gain") > float("-inf")).collect(), key=lambda r: r["fidx"]):
        if r["gain"] > out[r["node"]].gain:
            out[r["node"]] = Split(r["gain"], r["fidx"], r["bin"], r["dl"], tuple(r["cats"]), np.array(r["l"]), np.array(r["r"]), r["is_cat"])
    return out


def scan_splits(hist: DataFrame, totals: DataFrame, reg_lambda: float = 1.0, reg_alpha: float = 0.0, min_child_weight: float = 1.0, monotone: dict[int, int] | None = None) -> DataFrame:
    """All numeric candidates by running sums in Spark alone: hist(node, fidx, bin, g, h) and
    totals(node, tg, th) -> node, fidx, bin, dir (0: missing right, 1: missing left), gl, hl,
    gr, hr, gain, ok."""
    from pyspark.sql import Window

    from ..functions.scalar import leaf_gain, leaf_weight

    w = Window.partitionBy("node", "fidx")
    up = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    d = hist.join(totals, "node").withColumns({"cg": F.sum("g").over(up), "ch": F.sum("h").over(up), "sg": F.sum("g").over(w), "sh": F.sum("h").over(w), "nb": F.max("bin").over(w)})
    fwd = d.select("node", "fidx", "bin", F.lit(0).alias("dir"), F.col("cg").alias("gl"), F.col("ch").alias("hl"), (F.col("tg") - F.col("cg")).alias("gr"), (F.col("th") - F.col("ch")).alias("hr"), "tg", "th")
    back = d.where((F.abs(F.col("sh") - F.col("th")) > 1e-9) & (F.col("bin") < F.col("nb"))).select("node", "fidx", "bin", F.lit(1).alias("dir"), (F.col("tg") - F.col("sg") + F.col("cg")).alias("gl"), (F.col("th") - F.col("sh") + F.col("ch")).alias("hl"), (F.col("sg") - F.col("cg")).alias("gr"), (F.col("sh") - F.col("ch")).alias("hr"), "tg", "th")
    c = fwd.unionAll(back)
    gain = leaf_gain("gl", "hl", reg_lambda, reg_alpha) + leaf_gain("gr", "hr", reg_lambda, reg_alpha) - leaf_gain("tg", "th", reg_lambda, reg_alpha)
    ok = (F.col("hl") > 0) & (F.col("hr") > 0) & (F.col("hl") >= min_child_weight) & (F.col("hr") >= min_child_weight)
    for f, m in (monotone or {}).items():
        wl, wr = leaf_weight("gl", "hl", reg_lambda, reg_alpha), leaf_weight("gr", "hr", reg_lambda, reg_alpha)
        ok &= (F.col("fidx") != f) | ((wl <= wr) if m > 0 else (wl >= wr))
    return c.withColumns({"gain": gain, "ok": ok}).drop("tg", "th")


def best_splits(candidates: DataFrame) -> DataFrame:
    """The best valid candidate of each node: larger gain, lower feature, forward first,
    then scan order (bins up forwards, down backwards)."""
    from pyspark.sql import Window

    scan = F.when(F.col("dir") == 0, F.col("bin")).otherwise(-F.col("bin"))
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.desc(F.round("gain", 6)), "fidx", "dir", scan))
    return candidates.where("ok").withColumn("nth", nth).where("nth = 1").drop("nth", "ok")


def subtract(parent: DataFrame, built: DataFrame) -> DataFrame:
    """A sibling's histogram: the parent's minus the built child's."""
    b = built.select("fidx", "bin", F.col("g").alias("bg"), F.col("h").alias("bh"))
    return parent.join(b, ["fidx", "bin"], "left").select("fidx", "bin", (F.col("g") - F.coalesce("bg", F.lit(0.0))).alias("g"), (F.col("h") - F.coalesce("bh", F.lit(0.0))).alias("h"))


def categorical_scan(hist: DataFrame, totals: DataFrame, reg_lambda: float = 1.0, onehot: bool = False) -> DataFrame:
    """hist(node, fidx, bin, g, h) of categories -> candidates: `bin` is the rank in order of
    leaf weight (one-hot: the category), categories up to it go right, missing left."""
    from pyspark.sql import Window

    from ..functions.scalar import leaf_gain, leaf_weight

    d = hist.where("h > 0").join(totals, "node")
    if onehot:
        d = d.withColumns({"gr": F.col("g"), "hr": F.col("h"), "k": F.col("bin")})
    else:
        order = Window.partitionBy("node", "fidx").orderBy(F.round(leaf_weight("g", "h", reg_lambda), 9), "bin")
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumns({"k": F.row_number().over(order), "gr": F.sum("g").over(upto), "hr": F.sum("h").over(upto)})
    gain = leaf_gain(F.col("tg") - F.col("gr"), F.col("th") - F.col("hr"), reg_lambda) + leaf_gain("gr", "hr", reg_lambda) - leaf_gain("tg", "th", reg_lambda)
    return d.select("node", "fidx", "bin", "k", "gr", "hr", F.when(F.col("th") - F.col("hr") > 0, gain).alias("gain"))
