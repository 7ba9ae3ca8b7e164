"""Training: the boosting loop, callbacks, cross-validation, continuation, updates."""

from __future__ import annotations

import copy
import math
import statistics
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..operators import cuts as C
from ..operators import metrics, objectives, sampling
from ..sources.frames import FeatureSpec, folds, prepare, validate
from .grow import grow
from .linear import linear_round
from .model import Model, Tree

CHECKPOINT_ROUNDS = 10
COUNTED_SHARE = 4  # rows a distinct row stands for, at least, where rows are counted
EXACT_VALUES = 4_000_000  # distinct values of all features that tree_method exact takes


class Callback:
    """Hooks of the training loop; a true result of after_iteration stops it."""

    def before_training(self, model: Model) -> None: ...
    def after_training(self, model: Model) -> None: ...
    def before_iteration(self, model: Model, round_: int, history: dict) -> bool: ...
    def after_iteration(self, model: Model, round_: int, history: dict) -> bool: ...


class LearningRates(Callback):
    def __init__(self, rates: Callable[[int], float] | list[float]):
        self.rates = rates

    def before_iteration(self, model, round_, history):
        model.params["learning_rate"] = self.rates(round_) if callable(self.rates) else self.rates[round_]
        return False


class EarlyStopping(Callback):
    """Stops after `rounds` without gain of the last metric of the last set, unless others are
    named. With places, values are judged as rounded to them, as a printed history shows them."""

    def __init__(self, rounds: int, metric_name: str | None = None, data_name: str | None = None, maximize: bool | None = None, save_best: bool = False, min_delta: float = 0.0, places: int | None = None):
        self.rounds, self.metric, self.data, self.maximize, self.save_best, self.delta, self.places = rounds, metric_name, data_name, maximize, save_best, min_delta, places
        self.best, self.at, self.wait = None, 0, 0

    def after_iteration(self, model, round_, history):
        data = self.data or list(history)[-1]
        name = self.metric or list(history[data])[-1]
        now = history[data][name][-1] if self.places is None else round(float(history[data][name][-1]), self.places)
        up = metrics.maximised(name) if self.maximize is None else self.maximize
        better = self.best is None or (now > self.best + self.delta if up else now < self.best - self.delta)
        if better:
            self.best, self.at, self.wait = now, round_, 0
            model.best_iteration, model.best_score = round_, now
            model.attributes |= {"best_iteration": str(round_), "best_score": str(now)}
        else:
            self.wait += 1
        return self.wait >= self.rounds

    def after_training(self, model):
        if self.save_best and model.best_iteration is not None:
            model.trees = model[: model.best_iteration + 1].trees


class Monitor(Callback):
    def __init__(self, period: int = 1, log: Callable[[str], None] = print):
        self.period, self.log = period, log

    def after_iteration(self, model, round_, history):
        if round_ % self.period == 0:
            self.log(f"[{round_}]" + "".join(f"\t{d}-{m}:{v[-1]:.5f}" for d, ms in history.items() for m, v in ms.items()))
        return False


class Checkpoints(Callback):
    """Saves the model every `every` rounds into a folder that all executors share."""

    def __init__(self, spark, folder: str, name: str = "model", every: int = 100):
        self.spark, self.folder, self.name, self.every = spark, folder, name, every

    def after_iteration(self, model, round_, history):
        if (round_ + 1) % self.every == 0:
            model.save(self.spark, f"{self.folder}/{self.name}_{round_}")
        return False


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder, where one is set; else the plan goes on."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df


def spread(table: DataFrame) -> DataFrame:
    """The table by row_id over as many tasks as there are cores, if one task holds more than
    twice its share (a file of one row group, say); else as it is. Every level of every tree
    reads it, so one shuffle pays."""
    parts = table.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("rows"), F.count("*").alias("parts")).first()
    cores = table.sparkSession.sparkContext.defaultParallelism
    if not parts["rows"] or parts["most"] <= 2 * parts["rows"] / cores:
        return table
    return table.repartition(max(cores, parts["parts"]), "row_id")


def counted(table: DataFrame) -> DataFrame:
    """Rows that agree in everything but row_id as one row of their summed weight, if they
    are at most one in COUNTED_SHARE of all; else the table as it is. Such rows keep equal
    margins, so sums of gradients and losses stay what they were."""
    keys = [c for c in table.columns if c not in ("row_id", "weight")]
    seen = table.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64(*keys, "weight")).alias("kinds")).first()  # an estimate, for the choice of the plan alone
    if seen["kinds"] * COUNTED_SHARE > seen["rows"]:
        return table
    rows = table.groupBy(*keys, F.col("weight").alias("__weight")).agg(F.count("*").alias("__rows"), F.min("row_id").alias("row_id"))
    return rows.withColumn("weight", F.col("__weight") * F.col("__rows")).select(*table.columns)


def _countable(p: dict, obj, names: list, custom_metric, table: DataFrame) -> bool:
    """Whether a row's weight may stand for several rows: no rule looks at single rows."""
    whole = all(isinstance(n, str) and n.split("@")[0].rstrip("-") in metrics.WEIGHTED for n in names)
    return obj.weighted and whole and custom_metric is None and p["subsample"] >= 1 and p["process_type"] != "update" and "qid" not in table.columns


def _metric_names(p: dict, obj) -> list:
    names = p["eval_metric"] or []
    names = list(names) if isinstance(names, (list, tuple)) else [names]
    return names or ([] if p["disable_default_eval_metric"] else [obj.metric])


def evaluate(model: Model, table: DataFrame, names: list, custom_metric=None, iteration_range=None) -> list[tuple[str, float]]:
    d = table if "m0" in table.columns else model.with_margin(table, iteration_range)
    obj = model.objective
    d = d.withColumns({f"p{k}": c for k, c in enumerate(obj.eval_link([F.col(f"m{k}") for k in range(model.outputs)]))})
    out = [metrics.value(n, d, model.params) for n in names]
    if custom_metric is not None:
        out.append(custom_metric(d))
    return out


def train(params: dict, df: DataFrame, num_boost_round: int = 10, spec: FeatureSpec | None = None, features: list[str] | None = None, label="label", evals: list[tuple[DataFrame, str]] | None = None, obj=None,
          early_stopping_rounds: int | None = None, evals_result: dict | None = None, init_model: Model | None = None, callbacks: list[Callback] | None = None, custom_metric=None, maximize: bool | None = None, ref: Model | None = None) -> Model:
    """Trains a model on df. Everything at the scale of rows is a DataFrame step; the
    driver sees cut tables, histograms of a level and nodes. With ref, hist takes the cuts
    of that model, as a validation table takes those of its training table."""
    p = P.resolve(params | ({"objective": obj} if obj is not None else {}))
    spec = spec or FeatureSpec(tuple(features or [c for c in df.columns if c not in ("label", "weight", "qid", "row_id", "base_margin", "label_lower", "label_upper")]), label=label,
                               **{k: k for k in ("weight", "qid", "base_margin", "label_lower", "label_upper", "row_id") if k in df.columns})
    if init_model is not None:
        from dataclasses import replace

        spec = replace(spec, categories=init_model.categories)
    table, spec = prepare(df, spec)
    objective = objectives.get(p["objective"], p)
    names = _metric_names(p, objective)
    shrink = counted if _countable(p, objective, names, custom_metric, table) else lambda d: d
    table = objective.fixed(shrink(table)).persist()
    held = [table]
    try:
        dealt = spread(table)
        if dealt is not table:
            table = dealt.persist()
            held.append(table)
        validate(table)
        if len(held) > 1:  # dealt out by now
            held.pop(0).unpersist()
        objective.validate(table) if "label" in table.columns else None
        sets = []
        for d, name in evals or []:
            part = prepare(d, spec)[0] if d is not df else table
            few = shrink(part) if d is not df else part
            if few is not part:  # as few rows as kinds
                held.append(few.persist())
            sets.append((few, name))
        if p["process_type"] == "update":
            from .update import refresh_model

            return refresh_model(init_model, table, p)
        if init_model is not None:
            model = copy.deepcopy(init_model)
            model.params = p
        else:
            fit_base = p["base_score"] is None and p["boost_from_average"]
            if fit_base:
                base = objective.intercept(table)
            else:
                b = p["base_score"] if p["base_score"] is not None else 0.5
                b = list(b) if isinstance(b, (list, tuple)) else [b] * objective.outputs
                base = [objective.inverse(x) if not isinstance(objective, objectives._Multi) else x for x in b]
            model = Model(p, list(spec.features), base, spec.categories)
        cat = {i for i, f in enumerate(spec.features) if f in spec.categorical}
        calls = list(callbacks or [])
        if early_stopping_rounds:
            calls.append(EarlyStopping(early_stopping_rounds, maximize=maximize))
        history: dict = {}
        work = model.with_margin(table)
        exact_values, cuts = None, None
        if p["booster"] == "gbtree" and p["tree_method"] != "approx":
            if ref is not None and ref.cuts and p["tree_method"] != "exact":
                if ref.features != list(spec.features):
                    raise ValueError("ref was trained on other features")
                cuts = ref.cuts
            elif p["tree_method"] == "exact":
                values = C.long(table, list(spec.features)).select("fidx", "value").distinct().count()
                if values > EXACT_VALUES:  # each is a candidate that the driver holds
                    raise ValueError(f"tree_method exact handles up to {EXACT_VALUES} distinct values, not {values}; use hist")
                cuts = C.cut_lists(C.exact_cuts(C.long(table, list(spec.features)).groupBy("fidx", "value").agg(F.sum("w").alias("w")), 1 << 30), len(spec.features))
                low = table.agg(*(F.min(f).alias(f) for f in spec.features)).first()
                exact_values = [[low[f], *c[:-1]] if low[f] is not None else [0.0] for f, c in zip(spec.features, cuts)]
            else:
                cuts = C.cut_lists(C.cut_table(table, list(spec.features), p["max_bin"], categorical=spec.categorical), len(spec.features))
            model.cuts = cuts
            work = C.binned(work, list(spec.features), cuts, spec.categorical)
        work = work.persist()
        held.append(work)
        eval_work, own = [(model.with_margin(d), name) for d, name in sets], [d is df for d, _ in (evals or [])]
        for c in calls:
            c.before_training(model)
        first, bias = model.rounds(), None
        dart = p["rate_drop"] > 0 or p["one_drop"]
        for round_ in range(first, first + num_boost_round):
            if any([c.before_iteration(model, round_, history) for c in calls]):
                break
            rng = np.random.default_rng([p["seed"], round_])
            dropped = _dropped(model, p, rng) if dart else []
            source = work
            if dropped:
                minus = copy.copy(model)
                minus.trees = [t for t in model.trees if t not in dropped]
                source = minus.with_margin(work.drop(*(f"m{k}" for k in range(model.outputs))))
            if p["lambdarank_unbiased"] and isinstance(objective, objectives._Rank):
                graded = objective.gradients(source, bias)
                bias = objective.update_bias(source, bias)
                bias = table.sparkSession.createDataFrame(bias.collect(), bias.schema)  # as many rows as positions
            else:
                graded = objective.gradients(source)
            if p["booster"] == "gblinear":
                done = linear_round(graded, model, p, rng)
                new_trees, columns = [], None
            else:
                if p["tree_method"] == "approx":
                    cuts = C.cut_lists(C.cut_table(graded, list(spec.features), p["max_bin"], weight="h0", categorical=spec.categorical), len(spec.features))
                    graded = C.binned(graded, list(spec.features), cuts, spec.categorical)
                done = False
                new_trees, columns = _round(graded, model, p, cuts, cat, rng, round_, spec.feature_weights, exact_values)
            if dropped:
                _normalise(dropped, new_trees, p)
            model.trees += new_trees
            if dropped or columns is None:
                nxt = model.with_margin(work.drop(*(f"m{k}" for k in range(model.outputs))))
            else:
                nxt = columns(work if p["tree_method"] != "approx" else C.binned(work, list(spec.features), cuts, spec.categorical))
                if p["tree_method"] == "approx":
                    nxt = nxt.drop(*(f"b{i}" for i in range(len(cuts))))
            nxt = nxt.persist() if (round_ - first + 1) % CHECKPOINT_ROUNDS else cut_lineage(nxt).persist()
            if not (any(own) and names):  # else the first metric keeps it
                nxt.count()
            held.append(nxt)
            for i, (d, name) in enumerate(eval_work):
                step = copy.copy(model)
                if own[i]:  # the training table has its margins already
                    d = nxt
                elif dropped or p["booster"] == "gblinear":
                    d = model.with_margin(sets[i][0])
                else:
                    step.trees, step.linear, step.base = new_trees, None, [0.0] * model.outputs
                    d = step.with_margin(d.drop("base_margin"), prefix="__d").withColumns({f"m{k}": F.col(f"m{k}") + F.col(f"__d{k}") for k in range(model.outputs)}).drop(*(f"__d{k}" for k in range(model.outputs)))
                    if (round_ - first + 1) % CHECKPOINT_ROUNDS == 0:
                        d = cut_lineage(d)
                eval_work[i] = (d, name)
                for metric, v in evaluate(model, d, names, custom_metric):
                    history.setdefault(name, {}).setdefault(metric, []).append(v)
            held.remove(work)
            work.unpersist()
            work = nxt
            if any([c.after_iteration(model, round_, history) for c in calls]) or done:
                break
        for c in calls:
            c.after_training(model)
        if evals_result is not None:
            evals_result |= history
        return model
    finally:
        for d in held:
            d.unpersist()


def _round(graded: DataFrame, model: Model, p: dict, cuts, cat, rng, round_: int, feature_weights, exact_values):
    """The trees of one round, and a function that adds their leaves to the margins."""
    k, together = model.outputs, p["multi_strategy"] == "multi_output_tree" and model.outputs > 1
    eta = p["learning_rate"] / p["num_parallel_tree"]
    split = getattr(model.objective, "split_grad", None)
    keep = ["row_id", *(f"b{i}" for i in range(len(cuts))), *(f"{c}{t}" for t in range(k) for c in "gh")]
    base = graded.select(*keep).persist()
    made = []
    try:
        for parallel in range(p["num_parallel_tree"]):
            seed = int(rng.integers(1 << 31))
            rows = base
            if p["subsample"] < 1 and p["sampling_method"] == "gradient_based":
                rows = sampling.gradient_based(rows, p["subsample"], seed, k)
            else:
                rows = rows.withColumn("in_sample", sampling.uniform(F.col("row_id"), p["subsample"], seed) if p["subsample"] < 1 else F.lit(True))
            for group in [0] if together else range(k):
                one = rows if together or k == 1 else rows.withColumns({"g0": F.col(f"g{group}"), "h0": F.col(f"h{group}")})
                if split is not None and together:
                    tree, place = grow(split(one), p, cuts, cat, rng, 1, feature_weights, exact_values, eta)
                    _refit(tree, place(one), k, p, eta)
                else:
                    tree, place = grow(one, p, cuts, cat, rng, k if together else 1, feature_weights, exact_values, eta)
                tree.group, tree.iteration = group, round_
                made.append((tree, place))
    finally:
        base.unpersist()

    def add(work: DataFrame) -> DataFrame:
        for tree, place in made:
            work = place(work)
            for t in range(len(tree.nodes[0].leaf)):
                m = f"m{t if together else tree.group}"
                values = ", ".join(f"double('{float(x.leaf[t] if x.is_leaf else 0.0)!r}')" for x in tree.nodes)
                work = work.withColumn(m, F.expr(f"{m} + get(array({values}), node)"))
            work = work.drop("node")
        return work

    return [t for t, _ in made], add


def _refit(tree: Tree, placed: DataFrame, k: int, p: dict, eta: float) -> None:
    """Leaf values of a tree grown on a reduced gradient, from the value gradient."""
    sums = {r["node"]: r for r in placed.groupBy("node").agg(*(F.sum(f"{c}{t}").alias(f"{c}{t}") for t in range(k) for c in "gh")).collect()}
    for n, x in enumerate(tree.nodes):
        r = sums.get(n)
        x.leaf = [eta * -(r[f"g{t}"]) / (r[f"h{t}"] + p["reg_lambda"]) if r is not None and r[f"h{t}"] > 0 else 0.0 for t in range(k)]


def _dropped(model: Model, p: dict, rng) -> list[Tree]:
    if not model.trees or rng.random() < p["skip_drop"]:
        return []
    w = np.array([t.weight for t in model.trees])
    rate = p["rate_drop"] if p["sample_type"] == "uniform" else np.minimum(1, p["rate_drop"] * len(w) * w / w.sum())
    gone = [t for t, hit in zip(model.trees, rng.random(len(w)) < rate) if hit]
    if not gone and p["one_drop"]:
        gone = [model.trees[int(rng.choice(len(w), p=None if p["sample_type"] == "uniform" else w / w.sum()))]]
    return gone


def _normalise(dropped: list[Tree], new: list[Tree], p: dict) -> None:
    k, lr = len(dropped), p["learning_rate"] / max(1, len(new))
    factor, fresh = (k / (k + lr), 1 / (k + lr)) if p["normalize_type"] == "tree" else (1 / (1 + lr), 1 / (1 + lr))
    for t in dropped:
        t.weight *= factor
    for t in new:
        t.weight = fresh


def cv(params: dict, df: DataFrame, num_boost_round: int = 10, nfold: int = 3, spec: FeatureSpec | None = None, stratified: bool = False, fold_column: str | None = None, seed: int = 0, fpreproc=None, **kw) -> list[dict]:
    """Mean and population deviation over folds of each metric, by round."""
    if fold_column:
        with_fold = df.withColumn("fold", F.col(fold_column))
    else:
        with_fold = folds(df if "row_id" in df.columns else df.withColumn("row_id", F.monotonically_increasing_id()), nfold, seed, stratified)
    parts = sorted(r["fold"] for r in with_fold.select("fold").distinct().collect())
    results = []
    for k in parts:
        a, b, p = with_fold.where(F.col("fold") != k).drop("fold"), with_fold.where(F.col("fold") == k).drop("fold"), params
        if fpreproc:
            a, b, p = fpreproc(a, b, dict(params))
        r: dict = {}
        train(p, a, num_boost_round, spec, evals=[(a, "train"), (b, "test")], evals_result=r, **kw)
        results.append(r)
    out = []
    for i in range(min(len(v) for r in results for m in r.values() for v in m.values())):
        row = {"round": i}
        for data in ("train", "test"):
            for m in results[0][data]:
                v = [r[data][m][i] for r in results]
                row |= {f"{data}-{m}-mean": math.fsum(v) / len(v), f"{data}-{m}-std": statistics.pstdev(v)}
        out.append(row)
    return out
