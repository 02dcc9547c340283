"""Job 2: an attribute table becomes all numbers."""

from pyspark.sql import functions as F

from hearthgrid.config import GEOMETRY, TARGET, TARGET_QUANTILE
from hearthgrid.operators import columns as c


def clean_attributes(df, skip=(GEOMETRY,), quantile=None, target=TARGET):
    """Leak columns dropped, numeric text cast, all other text turned into label codes.

    ``quantile`` keeps the rows at or below that quantile of the target; by default all stay.
    """
    kept = c.drop_leaks(df)
    kinds = c.column_kinds(kept, skip)
    labels = [name for name, kind in kinds.items() if kind == "label"]
    out = c.to_numeric(kept, kinds)
    if labels:
        out = c.encode_labels(out, labels, c.label_dictionary(out, labels))
    if quantile is None:
        return out
    limit = c.exact_quantile(kept, target, quantile).scalar()  # before the joins, which its passes can do without
    return out.filter(F.expr(c.measured(f"CAST({target} AS DOUBLE)")) & (F.col(target) <= limit))


def target_report(df, target=TARGET, quantile=TARGET_QUANTILE):
    """One row: all rows, the quantile of the target, and the rows at or below it."""
    limit = c.exact_quantile(df, target, quantile).scalar()
    return df.selectExpr(f"CAST({target} AS DOUBLE) AS v").withColumn("quantile", limit) \
        .selectExpr("v", "quantile", f"{c.measured('v')} AND v <= quantile AS kept") \
        .agg(F.count(F.lit(1)).alias("n_rows"), F.max("quantile").alias("quantile"),
             F.count_if("kept").alias("n_kept"))
