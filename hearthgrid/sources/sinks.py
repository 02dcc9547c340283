"""Parquet and text sinks."""

from pyspark.sql import functions as F

from hearthgrid.operators.metrics import with_error


def write_table(df, path, mode="overwrite"):
    """Parquet; missing folders are made by the writer."""
    df.write.mode(mode).parquet(path)


def write_predictions(predictions, path, importances=None, text=False, mode="overwrite"):
    """Predictions with their errors, one folder per model; importances beside them if given.

    With ``text`` the same tables are written as CSV, for tools that want plain numbers.
    """
    def put(df, name):
        writer = df.write.mode(mode).partitionBy("model")
        writer.csv(f"{path}/{name}") if text else writer.parquet(f"{path}/{name}")

    put(with_error(predictions), "predictions")
    if importances is not None:
        put(importances.select("model", "feature", F.col("importance")), "importances")
