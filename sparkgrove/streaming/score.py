"""Stateless scoring of streams: the same expressions as for tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import Model


def scored(stream: DataFrame, model: Model) -> DataFrame:
    """Margins and predictions of a stream, without state."""
    d = model.with_margin(stream)
    return d.withColumns({f"p{k}": c for k, c in enumerate(model.objective.link([F.col(f"m{k}") for k in range(model.outputs)]))})


def score_available(spark: SparkSession, path: str, model: Model, folder: str | None = None) -> DataFrame:
    """Scores what a folder or file holds as one stream run, written under folder (by
    default in the shared checkpoint folder), and reads the result."""
    base = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        base = tempfile.mkdtemp(prefix="grove_stream_")
    out = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rstrip("/").rpartition("/")
    glob = name if name.endswith(".parquet") else "*"
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{parent}/{name}" if _is_folder(spark, path) else parent) if _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(parent)
    run = scored(source, model).writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/data")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def windowed_accuracy(stream: DataFrame, time: str, label: str, width: str, late: str) -> DataFrame:
    """Mean squared error by time window with a watermark for late rows."""
    err = F.pow(F.col("p0") - F.col(label), 2)
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.sqrt(F.avg(err)).alias("rmse"), F.count("*").alias("rows"))


def refit_batches(stream: DataFrame, model: Model, params: dict, rounds: int, keep, state: str):
    """Continues training on each micro-batch; keep(model) gets every new model."""
    from ..plans.train import train

    held = {"model": model}

    def one(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            held["model"] = train(params, batch, rounds, features=held["model"].features, init_model=held["model"])
            keep(held["model"])

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", state).trigger(availableNow=True).start()
