"""Saved pipelines and the table that describes them."""

import hashlib
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from hearthgrid.models.estimators import params_text

# Fixed value: how a save time is written.
TIME_FORMAT = "yyyyMMdd_HHmmss"
SCHEMA = ("model_name string, saved_at string, saved_time timestamp, model_type string, "
          "params_hash string, data_hash string, best_params string, path string")


def params_hash(params):
    """First 8 hex digits of the md5 of the sorted parameters."""
    return hashlib.md5(params_text(params).encode()).hexdigest()[:8]


def params_hash_expr(params):
    """The same for a column ``MAP<STRING, STRING>``, as SQL text."""
    pairs = f"transform(array_sort(map_entries({params})), e -> concat(e.key, '=', e.value))"
    return f"substr(md5(array_join({pairs}, ',')), 1, 8)"


def data_hash(df):
    """Fingerprint of a table that does not depend on the order of its rows."""
    row = df.select(F.xxhash64(*df.columns).alias("h")) \
        .agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(h)").alias("x"),
             F.expr("sum(h % 1000003)").alias("s")).first()
    return hashlib.md5(str(tuple(row)).encode()).hexdigest()[:16]


class ModelRegistry:
    """Models below ``root``; a model is found by its name, its parameters and its data."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, root.rstrip("/")

    def metadata(self):
        try:
            return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/metadata")
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def save(self, model, name, params, data, best=None):
        """Save a pipeline with its scaling, and describe it. Untrained models are an error."""
        if model is None:
            raise ValueError("there is no model to save")
        path = f"{self.root}/models/{name}-{uuid.uuid4().hex}"
        model.write().save(path)
        kind = type(model.stages[-1]).__name__
        row = (name, kind, params_hash(params), data, params_text(best or params), path)
        self.spark.createDataFrame(
            [row], "model_name string, model_type string, params_hash string, data_hash string, "
                   "best_params string, path string") \
            .withColumn("saved_time", F.current_timestamp()) \
            .withColumn("saved_at", F.date_format("saved_time", TIME_FORMAT)) \
            .select(*[c.split()[0] for c in SCHEMA.split(", ")]) \
            .coalesce(1).write.mode("append").parquet(f"{self.root}/metadata")
        return path

    def latest(self, by=("model_name",)):
        """The newest model per name, as a table."""
        return self.metadata().groupBy(*by).agg(
            F.max_by("path", "saved_time").alias("path"), F.max("saved_at").alias("saved_at"))

    def load_latest(self, name, params=None, data=None):
        """The newest saved model, or None. Only models of these parameters and data if given."""
        rows = self.metadata().filter(F.col("model_name") == name)
        if params is not None:
            rows = rows.filter(F.col("params_hash") == params_hash(params))
        if data is not None:
            rows = rows.filter(F.col("data_hash") == data)
        path = rows.agg(F.max_by("path", "saved_time")).first()[0]
        return PipelineModel.load(path) if path else None

    def load_or_train(self, name, params, data, train):
        """A saved model of the same name, parameters and data, else a newly trained and saved one.

        ``train`` returns the pipeline and the parameters that were chosen.
        """
        model = self.load_latest(name, params, data)
        if model is None:
            model, best = train()
            self.save(model, name, params, data, best)
        return model
