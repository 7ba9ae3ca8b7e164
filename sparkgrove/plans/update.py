"""Refreshing and pruning trees that are there already."""

from __future__ import annotations

import copy

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.splits import Finder
from .model import Model, Tree


def node_sums(tree: Tree, features: list[str], df: DataFrame, g: str = "g0", h: str = "h0") -> dict[int, tuple[float, float]]:
    """Sums of g and h of all nodes on the rows' paths: by leaf in Spark, then up the tree."""
    got = df.withColumn("node", tree.case(features, lambda n, x: n)).groupBy("node").agg(F.sum(g).alias("g"), F.sum(h).alias("h")).collect()
    out: dict[int, list[float]] = {}
    for r in got:
        n = r["node"]
        while n >= 0:
            s = out.setdefault(n, [0.0, 0.0])
            s[0] += r["g"]
            s[1] += r["h"]
            n = tree.nodes[n].parent
    return {n: (s[0], s[1]) for n, s in out.items()}


def refresh(tree: Tree, features: list[str], df: DataFrame, params: dict) -> Tree:
    """Statistics, gains and (with refresh_leaf) leaf values from new rows."""
    tree, f = copy.deepcopy(tree), Finder(params, [1])
    sums = node_sums(tree, features, df)
    for n, x in enumerate(tree.nodes):
        s = np.array(sums.get(n, (0.0, 0.0)))
        x.cover, x.base_weight = float(s[1]), float(f.weight(s[0], s[1]))
        if x.is_leaf:
            if params["refresh_leaf"]:
                x.leaf = [params["learning_rate"] * x.base_weight]
        else:
            l, r = np.array(sums.get(x.left, (0.0, 0.0))), np.array(sums.get(x.right, (0.0, 0.0)))
            x.gain = float(f.gain(l) + f.gain(r) - f.gain(s))
    return tree


def prune(tree: Tree, params: dict) -> Tree:
    """Collapses splits over two leaves while their gain is below min_split_loss or they
    lie too deep."""
    tree = copy.deepcopy(tree)
    again = True
    while again:
        again = False
        for n, x in enumerate(tree.nodes):
            if x.is_leaf or (n and x.parent < 0) or not (tree.nodes[x.left].is_leaf and tree.nodes[x.right].is_leaf):
                continue
            if x.gain < params["min_split_loss"] or (params["max_depth"] and tree.depth(n) >= params["max_depth"]):
                tree.nodes[x.left].parent = tree.nodes[x.right].parent = -1
                x.left = x.right = -1
                x.leaf = [params["learning_rate"] * x.base_weight]
                again = True
    return tree


def refresh_model(model: Model, table: DataFrame, params: dict) -> Model:
    """process_type=update: the updaters run over the existing trees in order."""
    steps = [s for s in (params["updater_seq"] or "refresh").split(",") if s]
    out = copy.deepcopy(model)
    done = copy.copy(out)
    done.trees = []
    for t in out.trees:
        graded = out.objective.gradients(done.with_margin(table)).withColumns({"g0": F.col(f"g{t.group}"), "h0": F.col(f"h{t.group}")})
        for s in steps:
            t = refresh(t, out.features, graded, params) if s == "refresh" else prune(t, params)
        done.trees = [*done.trees, t]
    out.trees = done.trees
    return out
