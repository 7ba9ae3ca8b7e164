"""Estimators in the style of pyspark.ml: regressor, classifier, ranker, forests.

Each takes training parameters as keywords, besides the columns: features (a list of
columns, or one array or vector column), label, weight, qid, base margin, validation
indicator. fit returns a model whose transform adds prediction columns.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.model import Model
from .plans.train import train
from .sources.frames import FeatureSpec, from_array_column

_COLUMNS = {"features_col": "features", "label_col": "label", "weight_col": None, "qid_col": None, "base_margin_col": None, "prediction_col": "prediction", "raw_prediction_col": "rawPrediction", "probability_col": "probability",
            "pred_contrib_col": None, "leaf_col": None, "validation_indicator_col": None, "num_boost_round": 100, "early_stopping_rounds": None, "missing": float("nan"), "label_lower_col": None, "label_upper_col": None, "categorical": (), "callbacks": None}


class _Base(Estimator):
    objective: str | None = None
    kind = "regressor"
    defaults: dict = {}

    def __init__(self, **kw):
        super().__init__()
        if "n_estimators" in kw:
            kw["num_boost_round"] = kw.pop("n_estimators")
        self.columns = {k: kw.pop(k, v) for k, v in _COLUMNS.items()}
        self.train_params = self.defaults | kw

    def _wide(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        f = self.columns["features_col"]
        if isinstance(f, (list, tuple)):
            return df, list(f)
        first = df.select(f).first()[0]
        return from_array_column(df, f, len(first)), [f"f{i}" for i in range(len(first))]

    def _fit(self, dataset: DataFrame) -> GroveModel:
        c, p = self.columns, dict(self.train_params)
        p.setdefault("objective", self.objective)
        df, features = self._wide(dataset)
        if self.kind == "classifier":
            n = df.agg(F.countDistinct(c["label_col"]).alias("n")).first()["n"]
            if n > 2:
                p |= {"num_class": n, "objective": "multi:softprob"}
        evals = []
        if c["validation_indicator_col"]:
            held = F.coalesce(F.col(c["validation_indicator_col"]), F.lit(False))
            evals, df = [(df.where(held), "validation")], df.where(~held)
        spec = FeatureSpec(tuple(features), frozenset(c["categorical"]), c["missing"], c["label_col"], c["weight_col"], c["qid_col"], c["base_margin_col"], c["label_lower_col"], c["label_upper_col"])
        history: dict = {}
        model = train(p, df, c["num_boost_round"], spec, evals=evals, evals_result=history, early_stopping_rounds=c["early_stopping_rounds"], callbacks=c["callbacks"])
        return GroveModel(model, self.kind, {k: v for k, v in c.items() if k != "callbacks"}, history)


class GroveModel(Transformer):
    def __init__(self, model: Model, kind: str, columns: dict, summary: dict | None = None):
        super().__init__()
        self.model, self.kind, self.columns, self.summary = model, kind, columns, summary or {}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        c, f = self.columns, self.columns["features_col"]
        df = dataset
        for x in [] if isinstance(f, (list, tuple)) else [f]:
            df = from_array_column(df.withColumn("__features", F.col(x)), "__features", len(self.model.features))
        if c["base_margin_col"]:
            df = df.withColumn("base_margin", F.col(c["base_margin_col"]))
        d = self.model.predict(df)
        k = self.model.outputs
        if self.kind == "classifier":
            m, p = [F.col(f"m{i}") for i in range(k)], self.model.objective.eval_link([F.col(f"m{i}") for i in range(k)])
            raw, prob = (F.array(-m[0], m[0]), F.array(1 - p[0], p[0])) if k == 1 else (F.array(*m), F.array(*p))
            d = d.withColumns({c["raw_prediction_col"]: raw, c["probability_col"]: prob})
            d = d.withColumn(c["prediction_col"], (F.array_position(F.col(c["probability_col"]), F.array_max(c["probability_col"])) - 1).cast("double"))
        else:
            d = d.withColumn(c["prediction_col"], F.col("p0") if k == 1 else F.array(*(F.col(f"p{i}") for i in range(k))))
        if c["leaf_col"]:
            d = self.model.predict_leaf(d).withColumnRenamed("leaf", c["leaf_col"])
        if c["pred_contrib_col"]:
            d = self.model.contributions(d).withColumnRenamed("c0", c["pred_contrib_col"])
        return d.drop(*(f"{x}{i}" for x in "mp" for i in range(k)), *([] if isinstance(f, (list, tuple)) else self.model.features))

    @property
    def feature_importances(self) -> dict[str, float]:
        got = self.model.importance("gain" if self.model.linear is None else "weight")
        total = sum(got.values()) or 1.0
        return {k: v / total for k, v in got.items()}

    @property
    def coefficients(self):
        if self.model.linear is None:
            raise AttributeError("only linear models have coefficients")
        return self.model.linear[:-1]

    @property
    def intercept(self):
        return self.model.base if self.model.linear is None else [b + w for b, w in zip(self.model.base, self.model.linear[-1])]

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({"kind": self.kind, "columns": {k: v for k, v in self.columns.items() if v == v}, "summary": self.summary, "model": self.model.to_json()})
        spark.createDataFrame([(text,)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GroveModel:
        d = json.loads(spark.read.parquet(path).first()["model"])
        return cls(Model.from_json(d["model"]), d["kind"], _COLUMNS | d["columns"], d["summary"])


class Regressor(_Base):
    objective = "reg:squarederror"


class Classifier(_Base):
    objective, kind = "binary:logistic", "classifier"


class Ranker(_Base):
    objective, kind = "rank:ndcg", "ranker"


class ForestRegressor(Regressor):
    defaults = {"num_parallel_tree": 100, "learning_rate": 1.0, "subsample": 0.8, "colsample_bynode": 0.8, "reg_lambda": 1e-5}

    def __init__(self, **kw):
        super().__init__(**({"num_boost_round": 1} | kw))


class ForestClassifier(Classifier):
    defaults = ForestRegressor.defaults

    def __init__(self, **kw):
        super().__init__(**({"num_boost_round": 1} | kw))
