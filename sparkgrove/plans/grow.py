"""Growing one tree on binned rows, level by level or best first."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.splits import DRIVER_CELLS, Finder, Router, Split, dense, histogram, search_distributed
from .model import Node, Tree


def allowed_features(path: set[int], constraints: list[list[int]] | None, n: int) -> set[int]:
    """Features that may follow those of the path: its own and all of every set that holds it."""
    if not constraints or not path:
        return set(range(n)) if not constraints else {f for c in constraints for f in c} | (set(range(n)) - {f for c in constraints for f in c})
    out = set(path)
    for c in constraints:
        if path <= set(c):
            out |= set(c)
    return out


class ColumnSampler:
    """Nested samples of columns by tree, level and node; with weights, by the largest
    ln(u) / w."""

    def __init__(self, params: dict, n: int, rng: np.random.Generator, weights: list[float] | None = None):
        self.p, self.rng, self.w, self.levels = params, rng, weights, {}
        self.tree = self._some(list(range(n)), params["colsample_bytree"])

    def _some(self, features: list[int], share: float) -> list[int]:
        if share >= 1:
            return features
        k = max(1, int(share * len(features)))
        w = np.array([self.w[f] if self.w else 1.0 for f in features])
        with np.errstate(divide="ignore"):
            key = np.log(self.rng.random(len(features))) / w
        return sorted(features[i] for i in np.argsort(-key, kind="stable")[:k])

    def at(self, depth: int) -> list[int]:
        if depth not in self.levels:
            self.levels[depth] = self._some(self.tree, self.p["colsample_bylevel"])
        return self._some(self.levels[depth], self.p["colsample_bynode"])


def grow(df: DataFrame, params: dict, cuts: list[list[float]], categorical: set[int], rng: np.random.Generator, targets: int = 1, feature_weights=None, exact_values: list[list[float]] | None = None, learning_rate: float | None = None) -> tuple[Tree, Callable[[DataFrame], DataFrame]]:
    """df(b0.., g0.., h0.., in_sample) -> the tree and a function that adds each row's leaf as
    the column node. Rows outside the sample take no part but get a leaf."""
    n_bins = [len(c) for c in cuts]
    width, nf = max(n_bins), len(cuts)
    finder = Finder(params, n_bins, categorical, params["monotone_constraints"], targets)
    columns = ColumnSampler(params, nf, rng, feature_weights)
    eta = params["learning_rate"] if learning_rate is None else learning_rate
    rows = df.where("in_sample")
    names = [f"{c}{t}" for t in range(targets) for c in "gh"]
    sums = rows.agg(*(F.sum(c).alias(c) for c in names)).first()
    total = {0: np.array([sums[c] or 0.0 for c in names])}
    nodes, bounds, paths, hists = [Node()], {0: (-np.inf, np.inf)}, {0: set()}, {}
    tree = Tree(nodes)

    def settle(n: int) -> None:
        s = total[n]
        w = finder.weight(s[0::2], s[1::2], *bounds[n])
        nodes[n].cover, nodes[n].base_weight, nodes[n].leaf = float(s[1::2].mean()), float(w[0]), [float(eta * x) for x in w]

    def best_of(fresh: list[int]) -> dict[int, Split]:
        """Best splits of new nodes: histograms of the smaller siblings, the others by difference."""
        feats = {n: sorted(set(columns.at(tree.depth(n))) & allowed_features(paths[n], params["interaction_constraints"], nf)) for n in fresh}
        if len(fresh) * nf * width > DRIVER_CELLS:
            h = histogram(rows, nf, n_bins, targets, Router(nodes, width), fresh)
            return search_distributed(h, finder, {n: total[n] for n in fresh}, feats, bounds)
        build = []
        for n in fresh:
            p = nodes[n].parent
            twin = (nodes[p].left + nodes[p].right - n) if p >= 0 else -1
            if p < 0 or p not in hists or twin not in fresh or total[n][1::2].sum() < total[twin][1::2].sum() or (total[n][1::2].sum() == total[twin][1::2].sum() and n == nodes[p].left):
                build.append(n)
        got = dense(histogram(rows, nf, n_bins, targets, Router(nodes, width), build).collect(), nf, width, targets)
        for n in build:
            hists[n] = got.get(n, np.zeros((nf, width, 2 * targets)))
        for n in fresh:
            if n not in hists:
                p = nodes[n].parent
                hists[n] = hists[p] - hists[nodes[p].left + nodes[p].right - n]
        for n in fresh:
            if (p := nodes[n].parent) >= 0 and nodes[p].left in hists and nodes[p].right in hists:
                hists.pop(p, None)
        return {n: finder.of_node(hists[n], total[n], feats[n], *bounds[n]) for n in fresh}

    def good(n: int, s: Split) -> bool:
        deep = params["max_depth"] and tree.depth(n) >= params["max_depth"]
        return not deep and s.gain > 1e-6 and s.gain >= params["min_split_loss"]

    def apply(n: int, s: Split) -> list[int]:
        x = nodes[n]
        x.fidx, x.bin, x.default_left, x.is_cat, x.cats, x.gain = s.fidx, s.bin, s.default_left, s.is_cat, s.cats, s.gain
        if not s.is_cat:
            if exact_values is not None and 0 <= s.bin:
                v = exact_values[s.fidx]
                x.cond = (v[s.bin] + v[s.bin + 1]) / 2 if s.bin + 1 < len(v) else v[s.bin] + abs(v[s.bin]) + 1e-6
            else:
                x.cond = cuts[s.fidx][s.bin] if s.bin >= 0 else -np.inf
        x.left, x.right = len(nodes), len(nodes) + 1
        nodes.extend([Node(parent=n), Node(parent=n)])
        total[x.left], total[x.right] = s.left, s.right
        lo, hi = bounds[n]
        bounds[x.left], bounds[x.right] = (lo, hi), (lo, hi)
        m = finder.monotone[s.fidx]
        if m:
            mid = float((finder.weight(s.left[0], s.left[1], lo, hi) + finder.weight(s.right[0], s.right[1], lo, hi)) / 2)
            bounds[x.left], bounds[x.right] = ((lo, mid), (mid, hi)) if m > 0 else ((mid, hi), (lo, mid))
        for c in (x.left, x.right):
            paths[c] = paths[n] | {s.fidx}
            settle(c)
        return [x.left, x.right]

    settle(0)
    leaves = 1
    most = params["max_leaves"] or (1 << 31)
    ready = best_of([0])
    if params["grow_policy"] == "depthwise":
        level = ready
        while level:
            done = []
            for n in sorted(level):
                if good(n, level[n]) and leaves < most:
                    apply(n, level[n])
                    done.append(n)
                    leaves += 1
            if not done:
                break
            fresh = [c for n in done for c in (nodes[n].left, nodes[n].right)]
            open_ = [c for c in fresh if (not params["max_depth"] or tree.depth(c) < params["max_depth"]) and total[c][1::2].sum() > 0]
            level = best_of(open_) if open_ and leaves < most else {}
    else:
        heap = [(-s.gain, n, s) for n, s in ready.items()]
        heapq.heapify(heap)
        while heap and leaves < most:
            _, n, s = heapq.heappop(heap)
            if not good(n, s):
                continue
            fresh = apply(n, s)
            leaves += 1
            if leaves < most and (not params["max_depth"] or tree.depth(fresh[0]) < params["max_depth"]):
                for c, t in best_of(fresh).items():
                    heapq.heappush(heap, (-t.gain, c, t))

    return tree, lambda d: d.withColumn("node", F.expr(place(nodes)))


def place(nodes: list[Node], n: int = 0) -> str:
    """SQL of the leaf that a row with bins b0.. reaches; one comparison for each level."""
    x = nodes[n]
    if x.left < 0:
        return str(n)
    right = f"b{x.fidx} IN ({', '.join(str(int(c)) for c in x.cats)})" if x.is_cat else f"b{x.fidx} > {int(x.bin)}"
    return f"if(coalesce({right}, {'false' if x.default_left else 'true'}), {place(nodes, x.right)}, {place(nodes, x.left)})"
