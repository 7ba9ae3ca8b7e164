"""Trees and models: tables, JSON, dumps, slices, importance, CASE compilation and
vectorised scoring and explanation."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "tree int, node int, parent int, left int, right int, fidx int, cond double, default_left boolean, is_cat boolean, cats array<int>, leaf array<double>, gain double, cover double, base_weight double"
CASE_NODES = 2000  # model size up to which scoring is a generated expression


@dataclass
class Node:
    parent: int = -1
    left: int = -1
    right: int = -1
    fidx: int = -1
    cond: float = 0.0
    default_left: bool = False
    is_cat: bool = False
    cats: tuple = ()
    leaf: list = field(default_factory=list)
    gain: float = 0.0
    cover: float = 0.0
    base_weight: float = 0.0
    bin: int = 0

    @property
    def is_leaf(self) -> bool:
        return self.left < 0


@dataclass
class Tree:
    nodes: list
    group: int = 0
    iteration: int = 0
    weight: float = 1.0

    def depth(self, n: int = 0) -> int:
        d = 0
        while self.nodes[n].parent >= 0:
            n, d = self.nodes[n].parent, d + 1
        return d

    def leaves(self) -> list[int]:
        seen, todo = [], [0]
        while todo:
            n = todo.pop()
            x = self.nodes[n]
            if x.is_leaf:
                seen.append(n)
            else:
                todo += [x.right, x.left]
        return seen

    def case(self, features: list[str], value) -> Column:
        """The tree as nested CASE; value(node number, node) is a leaf's result."""

        def walk(n: int) -> Column:
            x = self.nodes[n]
            if x.is_leaf:
                return F.lit(value(n, x))
            c = F.col(features[x.fidx])
            left, right = walk(x.left), walk(x.right)
            go_right = c.cast("long").isin(list(x.cats)) if x.is_cat else c >= F.lit(x.cond)
            return F.when(c.isNull(), left if x.default_left else right).when(go_right, right).otherwise(left)

        return walk(0)

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of x (rows, features), NaN missing."""
        at = np.zeros(len(x), np.int64)
        a = self.arrays()
        rows = np.arange(len(x))
        while True:
            inner = a["left"][at] >= 0
            if not inner.any():
                return at
            v = x[rows, np.maximum(a["fidx"][at], 0)]
            gone = np.isnan(v)
            right = v >= a["cond"][at]
            for n in np.unique(at[inner & a["is_cat"][at]]).tolist():
                mine = at == n
                right[mine] = np.isin(np.nan_to_num(v[mine], nan=-1).astype(np.int64), self.nodes[n].cats)
            left = np.where(gone, a["default_left"][at], ~right)
            at = np.where(inner, np.where(left, a["left"][at], a["right"][at]), at)

    def arrays(self) -> dict:
        return {k: np.array([getattr(n, k) for n in self.nodes]) for k in ("left", "right", "fidx", "cond", "default_left", "is_cat", "cover")}

    def values(self) -> np.ndarray:
        width = max((len(n.leaf) for n in self.nodes), default=1)
        return np.array([list(n.leaf) + [0.0] * (width - len(n.leaf)) for n in self.nodes], float) * self.weight

    def means(self) -> np.ndarray:
        """Cover-weighted mean leaf value below each node."""
        out = self.values()
        for n in range(len(self.nodes) - 1, -1, -1):
            x = self.nodes[n]
            if not x.is_leaf:
                l, r = self.nodes[x.left].cover, self.nodes[x.right].cover
                out[n] = (out[x.left] * l + out[x.right] * r) / (l + r) if l + r else 0.5 * (out[x.left] + out[x.right])
        return out


class Model:
    """Trees (or linear weights) with features, objective and intercepts."""

    def __init__(self, params: dict, features: list[str], base: list[float], categories: dict[str, list] | None = None):
        self.params, self.features, self.base = params, list(features), list(base)
        self.trees: list[Tree] = []
        self.linear: np.ndarray | None = None  # (features + 1, outputs), bias last
        self.categories = categories or {}
        self.attributes: dict[str, str] = {}
        self.best_iteration: int | None = None
        self.best_score: float | None = None
        self.cuts: list[list[float]] | None = None

    @property
    def outputs(self) -> int:
        return len(self.base)

    @property
    def objective(self):
        from ..operators import objectives

        return objectives.get(self.params["objective"], self.params)

    def rounds(self) -> int:
        return 1 + max((t.iteration for t in self.trees), default=-1)

    def chosen(self, iteration_range: tuple[int, int] | None = None) -> list[Tree]:
        if iteration_range is None or iteration_range == (0, 0):
            return self.trees
        a, b = iteration_range
        return [t for t in self.trees if a <= t.iteration < (b or self.rounds())]

    def __getitem__(self, s: slice) -> Model:
        keep = list(range(self.rounds()))[s]
        out = copy.copy(self)
        out.trees = [copy.copy(t) for t in self.trees if t.iteration in set(keep)]
        for t in out.trees:
            t.iteration = keep.index(t.iteration)
        return out

    # tables

    def node_rows(self) -> list[tuple]:
        return [(i, n, x.parent, x.left, x.right, x.fidx, float(x.cond), bool(x.default_left), bool(x.is_cat), [int(c) for c in x.cats], [float(v) for v in x.leaf], float(x.gain), float(x.cover), float(x.base_weight))
                for i, t in enumerate(self.trees) for n, x in enumerate(t.nodes) if n == 0 or x.parent >= 0]

    def node_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.node_rows(), NODE_SCHEMA)

    def trees_table(self, spark: SparkSession) -> DataFrame:
        """Tree, Node, ID, Feature, Split, Yes, No, Missing, Gain, Cover, Category."""
        rows = []
        for i, t in enumerate(self.trees):
            for n, x in enumerate(t.nodes):
                if n and x.parent < 0:
                    continue
                name = lambda k: f"{i}-{k}"
                if x.is_leaf:
                    rows.append((i, n, name(n), "Leaf", None, None, None, None, float(x.leaf[t.group if len(x.leaf) > 1 else 0]), float(x.cover), None))
                else:
                    rows.append((i, n, name(n), self.features[x.fidx], None if x.is_cat else float(x.cond), name(x.left), name(x.right), name(x.left if x.default_left else x.right), float(x.gain), float(x.cover), [int(c) for c in x.cats] if x.is_cat else None))
        return spark.createDataFrame(rows, "Tree int, Node int, ID string, Feature string, Split double, Yes string, No string, Missing string, Gain double, Cover double, Category array<int>")

    def importance(self, kind: str = "weight") -> dict[str, float]:
        if self.linear is not None:
            return dict(zip(self.features, self.linear[:-1].sum(1).tolist()))
        n, s = {}, {}
        for t in self.trees:
            for x in t.nodes:
                if not x.is_leaf:
                    n[x.fidx] = n.get(x.fidx, 0) + 1
                    s[x.fidx] = s.get(x.fidx, 0.0) + (x.gain if "gain" in kind else x.cover)
        if kind not in ("weight", "gain", "cover", "total_gain", "total_cover"):
            raise ValueError(f"unknown importance {kind!r}")
        return {self.features[f]: float(n[f]) if kind == "weight" else s[f] if kind.startswith("total_") else s[f] / n[f] for f in sorted(n)}

    def importance_table(self, spark: SparkSession, kind: str = "weight", top: int | None = None) -> DataFrame:
        d = spark.createDataFrame(list(self.importance(kind).items()) or [], "feature string, score double").orderBy(F.desc("score"), "feature")
        return d.limit(top) if top else d

    def split_values(self, feature: str) -> list[float]:
        return sorted(x.cond for t in self.trees for x in t.nodes if not x.is_leaf and not x.is_cat and self.features[x.fidx] == feature)

    # scoring

    def margin_columns(self, df: DataFrame, iteration_range=None) -> list[Column]:
        """Margins as expressions: base_margin, where given, replaces the intercept."""
        out = []
        for k in range(self.outputs):
            start = F.coalesce(F.col("base_margin") if self.outputs == 1 else F.col("base_margin")[k], F.lit(self.base[k])) if "base_margin" in df.columns else F.lit(float(self.base[k]))
            terms = [t.case(self.features, lambda n, x, t=t: float(x.leaf[k if len(x.leaf) > 1 else 0] * t.weight)) for t in self.chosen(iteration_range) if len(t.nodes[0].leaf) > 1 or t.group == k]
            if self.linear is not None:
                terms += [F.coalesce(F.col(f), F.lit(0.0)) * float(self.linear[i, k]) for i, f in enumerate(self.features)] + [F.lit(float(self.linear[-1, k]))]
            for x in terms:
                start = start + x
            out.append(start)
        return out

    def size(self) -> int:
        return sum(len(t.nodes) for t in self.trees)

    def numpy_margin(self, x: np.ndarray, base: np.ndarray, iteration_range=None) -> np.ndarray:
        out = base.astype(float).copy()
        if self.linear is not None:
            out += np.nan_to_num(x) @ self.linear[:-1] + self.linear[-1]
        for t in self.chosen(iteration_range):
            v = t.values()[t.route(x)]
            if v.shape[1] > 1:
                out += v
            else:
                out[:, t.group] += v[:, 0]
        return out

    def with_margin(self, df: DataFrame, iteration_range=None, prefix: str = "m") -> DataFrame:
        """df with margin columns; generated code for small models, Arrow batches for large."""
        if self.size() <= CASE_NODES:
            return df.withColumns({f"{prefix}{k}": c for k, c in enumerate(self.margin_columns(df, iteration_range))})
        return self._mapped(df, lambda m, x, b: m.numpy_margin(x, b, iteration_range), [f"{prefix}{k}" for k in range(self.outputs)])

    def _mapped(self, df: DataFrame, fn, names: list[str], kind: str = "double") -> DataFrame:
        from pyspark.sql.types import StructField, StructType, _parse_datatype_string

        packed = df.sparkSession.sparkContext.broadcast(self)  # a model is bounded by its nodes
        features, base = self.features, np.array(self.base)

        def run(batches):
            model = packed.value
            for batch in batches:
                x = np.stack([batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features], 1) if features else np.zeros((batch.num_rows, 0))
                b = np.tile(base, (batch.num_rows, 1))
                if "base_margin" in batch.schema.names:
                    given = batch.column("base_margin").to_pylist()
                    for i, v in enumerate(given):
                        if v is not None:
                            b[i] = v
                got = fn(model, x, b)
                cols = [pa.array(got[:, k].tolist()) if got[:, k].ndim > 1 else pa.array(got[:, k]) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *names])

        t = _parse_datatype_string(kind)
        return df.mapInArrow(run, StructType([*df.schema.fields, *(StructField(n, t) for n in names)]))

    def predict(self, df: DataFrame, output_margin: bool = False, iteration_range=None) -> DataFrame:
        """df with p0.. (and m0..): predictions after the link."""
        if iteration_range is None and self.best_iteration is not None:
            iteration_range = (0, self.best_iteration + 1)
        d = self.with_margin(df, iteration_range)
        m = [F.col(f"m{k}") for k in range(self.outputs)]
        return d.withColumns({f"p{k}": c for k, c in enumerate(m if output_margin else self.objective.link(m))})

    def predict_leaf(self, df: DataFrame, iteration_range=None) -> DataFrame:
        trees = self.chosen(iteration_range)
        return df.withColumn("leaf", F.array(*(t.case(self.features, lambda n, x: n) for t in trees)))

    def leaf_features(self, df: DataFrame) -> DataFrame:
        """One indicator for each leaf of each tree."""
        d = self.predict_leaf(df)
        return d.withColumn("leaf_onehot", F.array(*(F.when(F.col("leaf")[i] == n, 1).otherwise(0) for i, t in enumerate(self.trees) for n in sorted(t.leaves())))).drop("leaf")

    def contributions(self, df: DataFrame, approximate: bool = False, iteration_range=None) -> DataFrame:
        """df with c0..: per output an array of feature contributions and the bias; they
        add up to the margin."""
        if approximate and self.outputs == 1 and self.linear is None and self.size() <= CASE_NODES and all(len(t.nodes[0].leaf) <= 1 for t in self.trees):
            return df.withColumn("c0", F.array(*self._path_columns(df, iteration_range)))
        fn = (lambda m, x, b: m.numpy_saabas(x, b, iteration_range)) if approximate else (lambda m, x, b: m.numpy_shap(x, b, iteration_range))
        return self._mapped(df, fn, [f"c{k}" for k in range(self.outputs)], "array<double>")

    def shap_values(self, df: DataFrame, iteration_range=None) -> DataFrame:
        """df with shap0.. (per output an array of one value for each feature) and
        expected0.. (the bias), as explanation plots take them."""
        n = len(self.features)
        d = self.contributions(df, iteration_range=iteration_range)
        return d.withColumns({name: c for k in range(self.outputs) for name, c in ((f"shap{k}", F.slice(f"c{k}", 1, n)), (f"expected{k}", F.col(f"c{k}")[n]))}).drop(*(f"c{k}" for k in range(self.outputs)))

    def _path_columns(self, df, iteration_range) -> list[Column]:
        n = len(self.features)
        base = F.coalesce(F.col("base_margin"), F.lit(self.base[0])) if "base_margin" in df.columns else F.lit(float(self.base[0]))
        sums = [F.lit(0.0)] * n + [base]
        for t in self.chosen(iteration_range):
            means = t.means()[:, 0]
            sums[n] = sums[n] + float(means[0])
            for f in {x.fidx for x in t.nodes if not x.is_leaf}:
                def along(leaf, _, f=f, t=t, means=means):
                    out, n_ = 0.0, leaf
                    while t.nodes[n_].parent >= 0:
                        p = t.nodes[n_].parent
                        if t.nodes[p].fidx == f:
                            out += means[n_] - means[p]
                        n_ = p
                    return float(out)
                sums[f] = sums[f] + t.case(self.features, along)
        return sums

    def numpy_saabas(self, x, base, iteration_range=None) -> np.ndarray:
        n = len(self.features)
        out = np.zeros((len(x), self.outputs, n + 1))
        out[:, :, n] = base
        self._linear_parts(x, out)
        for t in self.chosen(iteration_range):
            means, at = t.means(), t.route(x)
            groups = range(self.outputs) if means.shape[1] > 1 else [t.group]
            for leaf in np.unique(at).tolist():
                mine, k = at == leaf, leaf
                while t.nodes[k].parent >= 0:
                    p = t.nodes[k].parent
                    for j, g in enumerate(groups):
                        out[mine, g, t.nodes[p].fidx] += means[k, j] - means[p, j]
                    k = p
            for j, g in enumerate(groups):
                out[:, g, n] += means[0, j]
        return out

    def _linear_parts(self, x, out) -> None:
        if self.linear is not None:
            for k in range(self.outputs):
                out[:, k, :-1] += np.nan_to_num(x) * self.linear[:-1, k]
                out[:, k, -1] += self.linear[-1, k]

    def _paths(self, t: Tree, x: np.ndarray):
        """Of each leaf: its features, the cover ratio and the row's indicator of each."""
        for leaf in t.leaves():
            ratio: dict[int, float] = {}
            ok: dict[int, np.ndarray] = {}
            k = leaf
            while t.nodes[k].parent >= 0:
                p = t.nodes[k].parent
                q = t.nodes[p]
                v = x[:, q.fidx]
                right = np.isin(np.nan_to_num(v, nan=-1).astype(np.int64), q.cats) if q.is_cat else v >= q.cond
                left = np.where(np.isnan(v), q.default_left, ~right)
                here = left if q.left == k else ~left
                ratio[q.fidx] = ratio.get(q.fidx, 1.0) * (t.nodes[k].cover / q.cover if q.cover else 0.5)
                ok[q.fidx] = ok.get(q.fidx, np.ones(len(x), bool)) & here
                k = p
            yield leaf, list(ratio), np.array(list(ratio.values())), np.stack([ok[f] for f in ratio], 1).astype(float) if ratio else np.zeros((len(x), 0))

    def numpy_shap(self, x, base, iteration_range=None) -> np.ndarray:
        """Shapley values of the cover-weighted trees: each leaf's game is a product over
        its features, whose values are integrals of polynomials, exact by quadrature."""
        n = len(self.features)
        out = np.zeros((len(x), self.outputs, n + 1))
        out[:, :, n] = base
        self._linear_parts(x, out)
        for t in self.chosen(iteration_range):
            vals, means = t.values(), t.means()
            groups = range(self.outputs) if vals.shape[1] > 1 else [t.group]
            for j, g in enumerate(groups):
                out[:, g, n] += means[0, j]
            for leaf, fs, r, o in self._paths(t, x):
                pts, w = _quadrature(len(fs))
                diff = o - r
                terms = r[None, None] + diff[:, None, :] * pts[None, :, None]
                for i, f in enumerate(fs):
                    rest = np.prod(np.delete(terms, i, axis=2), axis=2) @ w
                    for j, g in enumerate(groups):
                        out[:, g, f] += vals[leaf, j] * diff[:, i] * rest
        return out

    def numpy_interactions(self, x, base, iteration_range=None) -> np.ndarray:
        """(rows, outputs, features + 1, features + 1), symmetric; rows add up to SHAP values."""
        n = len(self.features)
        shap = self.numpy_shap(x, base, iteration_range)
        out = np.zeros((len(x), self.outputs, n + 1, n + 1))
        for t in self.chosen(iteration_range):
            vals = t.values()
            groups = range(self.outputs) if vals.shape[1] > 1 else [t.group]
            for leaf, fs, r, o in self._paths(t, x):
                pts, w = _quadrature(len(fs))
                diff = o - r
                terms = r[None, None] + diff[:, None, :] * pts[None, :, None]
                for a in range(len(fs)):
                    for b in range(a):
                        rest = np.prod(np.delete(terms, [a, b], axis=2), axis=2) @ w
                        for j, g in enumerate(groups):
                            both = 0.5 * vals[leaf, j] * diff[:, a] * diff[:, b] * rest
                            out[:, g, fs[a], fs[b]] += both
                            out[:, g, fs[b], fs[a]] += both
        for i in range(n + 1):
            out[:, :, i, i] = shap[:, :, i] - (out[:, :, i].sum(-1) - out[:, :, i, i])
        return out

    def interactions(self, df: DataFrame, iteration_range=None) -> DataFrame:
        return self._mapped(df, lambda m, x, b: m.numpy_interactions(x, b, iteration_range), [f"i{k}" for k in range(self.outputs)], "array<array<double>>")

    # storage

    def to_json(self) -> str:
        p = {k: v for k, v in self.params.items() if not k.startswith("_") and not callable(v) and v == v}
        return json.dumps({
            "version": [1, 0], "params": p, "features": self.features, "base": self.base, "categories": self.categories, "attributes": self.attributes, "best_iteration": self.best_iteration, "best_score": self.best_score, "cuts": self.cuts,
            "linear": None if self.linear is None else self.linear.tolist(),
            "trees": [{"group": t.group, "iteration": t.iteration, "weight": t.weight, "nodes": [{k: (list(v) if isinstance(v, tuple) else v) for k, v in vars(x).items()} for x in t.nodes]} for t in self.trees]}, default=lambda v: v.item())

    @classmethod
    def from_json(cls, text: str) -> Model:
        from .. import params as P

        d = json.loads(text)
        out = cls(P.resolve(d["params"]), d["features"], d["base"], d["categories"])
        out.attributes, out.best_iteration, out.best_score, out.cuts = d["attributes"], d["best_iteration"], d["best_score"], d["cuts"]
        out.linear = None if d["linear"] is None else np.array(d["linear"])
        for t in d["trees"]:
            out.trees.append(Tree([Node(**{**x, "cats": tuple(x["cats"])}) for x in t["nodes"]], t["group"], t["iteration"], t["weight"]))
        return out

    def to_ubj(self) -> bytes:
        """The document of to_json in its binary form."""
        from ..sources import ubjson

        return ubjson.dumps(json.loads(self.to_json()))

    @classmethod
    def from_ubj(cls, raw: bytes) -> Model:
        from ..sources import ubjson

        return cls.from_json(json.dumps(ubjson.loads(raw)))

    def category_table(self, spark: SparkSession) -> DataFrame:
        """feature, code, category: the dictionaries the model was trained with."""
        rows = [(f, code, value) for f, values in self.categories.items() for code, value in enumerate(values)]
        return spark.createDataFrame(rows, "feature string, code int, category string")

    def save(self, spark: SparkSession, path: str) -> None:
        """A one-row table, so that any store that Spark writes will do."""
        spark.createDataFrame([(self.to_json(),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        return cls.from_json(spark.read.parquet(path).first()["model"])

    def config(self) -> str:
        return json.dumps({k: v for k, v in self.params.items() if not k.startswith("_") and not callable(v) and v == v}, sort_keys=True)

    def dump(self, kind: str = "text", with_stats: bool = False) -> list[str]:
        return [_dump(t, self.features, kind, with_stats) for t in self.trees]


def _quadrature(n: int):
    pts, w = np.polynomial.legendre.leggauss(max(1, n // 2 + 1))
    return (pts + 1) / 2, w / 2


def _dump(t: Tree, features: list[str], kind: str, stats: bool) -> str:
    def text(n, depth):
        x = t.nodes[n]
        tail = (f",gain={x.gain:g},cover={x.cover:g}" if not x.is_leaf else f",cover={x.cover:g}") if stats else ""
        if x.is_leaf:
            return ["\t" * depth + f"{n}:leaf=" + ",".join(f"{v:g}" for v in x.leaf) + tail]
        test = f"{features[x.fidx]}:{{{','.join(map(str, x.cats))}}}" if x.is_cat else f"{features[x.fidx]}<{x.cond:g}"
        yes, no = (x.right, x.left) if x.is_cat else (x.left, x.right)
        line = "\t" * depth + f"{n}:[{test}] yes={yes},no={no},missing={x.left if x.default_left else x.right}" + tail
        return [line, *text(x.left, depth + 1), *text(x.right, depth + 1)]

    def tree(n, depth):
        x = t.nodes[n]
        extra = {"cover": x.cover} | ({} if x.is_leaf else {"gain": x.gain}) if stats else {}
        if x.is_leaf:
            return {"nodeid": n, "leaf": x.leaf[0] if len(x.leaf) == 1 else x.leaf} | extra
        return {"nodeid": n, "depth": depth, "split": features[x.fidx], "split_condition": list(x.cats) if x.is_cat else x.cond, "yes": x.right if x.is_cat else x.left, "no": x.left if x.is_cat else x.right,
                "missing": x.left if x.default_left else x.right} | extra | {"children": [tree(x.left, depth + 1), tree(x.right, depth + 1)]}

    if kind == "json":
        return json.dumps(tree(0, 0))
    if kind == "dot":
        lines = ["digraph {", "  graph [rankdir=TB]"]
        for n, x in enumerate(t.nodes):
            if n and x.parent < 0:
                continue
            if x.is_leaf:
                lines.append(f'  {n} [label="leaf={x.leaf[0]:g}"]')
            else:
                test = f"{features[x.fidx]}:{{{','.join(map(str, x.cats))}}}" if x.is_cat else f"{features[x.fidx]}<{x.cond:g}"
                lines.append(f'  {n} [label="{test}"]')
                for k, side in ((x.left, "no" if x.is_cat else "yes"), (x.right, "yes" if x.is_cat else "no")):
                    miss = ", missing" if (k == x.left) == x.default_left else ""
                    lines.append(f'  {n} -> {k} [label="{side}{miss}" color="{"#0000FF" if side == "yes" else "#FF0000"}"]')
        return "\n".join([*lines, "}"])
    return "\n".join(text(0, 0)) + "\n"
