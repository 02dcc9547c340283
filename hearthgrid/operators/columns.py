"""Column and row operators on attribute tables."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.config import GEOMETRY, LEAK_COLUMNS, MISSING_LABEL, TARGET, TARGET_QUANTILE
from hearthgrid.functions.sql import num
from hearthgrid.layer import require_columns
from hearthgrid.session import materialize


def drop_leaks(df):
    """Without the identifier and sex-age counts; the ones that are absent are ignored."""
    return df.drop(*LEAK_COLUMNS)


def drop_required(df, names):
    """Drop columns that must be there."""
    return require_columns(df, names).drop(*names)


def by_type(pois, poi_type):
    """One POI type; an unknown type gives an empty layer."""
    return pois.with_df(pois.df.filter(F.col("poi_type") == F.lit(poi_type)))


def measured(column):
    """True for numbers: neither null nor NaN. Text, since it is used inside filters."""
    return f"{column} IS NOT NULL AND NOT isnan({column})"


# Size of the sketch that brackets a quantile, half the width of the bracket as a share of all ranks (twice the
# sketch's rank error), the pieces a bracket is cut into, and the number of values that are few enough to be ranked in one task.
_SKETCH = 4096
_MARGIN = 0.0025
_PIECES = 1000
_FEW = 100_000


def exact_quantile(df, column=TARGET, q=TARGET_QUANTILE, few=_FEW):
    """One row ``quantile``: the linearly interpolated quantile of the measured values.

    ``df`` is read twice. The first pass merges sketches of all values, which bracket the answer. The second counts what lies below
    the bracket and writes the distinct values inside with their counts, a small part of the rows; what is left to do
    reads those. Should a bracket miss, which the sketch makes very unlikely, a wider one is read.
    """
    values = df.selectExpr(f"CAST({column} AS DOUBLE) AS v").filter(measured("v"))
    spark, margin = df.sparkSession, _MARGIN
    ends = [f"kll_sketch_get_quantile_double(sketch, {num(p)})" for p in (max(0.0, q - margin), min(1.0, q + margin))]
    n, low, high = values.agg(F.count("v").alias("n"), F.expr(f"kll_sketch_agg_double(v, {_SKETCH})").alias("sketch")) \
        .selectExpr("n", *[f"if(n > 0, {e}, NULL)" for e in ends]).first()
    if n == 0:
        return spark.sql("SELECT CAST(NULL AS DOUBLE) AS quantile")
    rank = q * (n - 1)
    first = math.floor(rank)
    ranks = (first, min(first + 1, n - 1))
    if n <= few:
        low, high = None, None
    while True:
        below, inside, within = _bracket(values, low, high)
        if below <= ranks[0] and ranks[1] < below + within:
            break
        low, high = None, None
    a, b = _values_at(inside, below, *ranks, few)
    found = a if a == b else a + (rank - first) * (b - a)
    return spark.createDataFrame([(found,)], "quantile double")


def _double(value):
    return num(value) if math.isfinite(value) else f"double('{value}')"


def _bracket(values, low, high):
    """Values below the bracket, a table ``v, n`` of those in it, and their number; without ends, all values."""
    zone = "0" if low is None else f"CASE WHEN v < {_double(low)} THEN -1 WHEN v > {_double(high)} THEN 1 ELSE 0 END"
    counted = values.selectExpr(f"{zone} AS zone", "v").selectExpr("zone", "if(zone = 0, v, NULL) AS v") \
        .groupBy("zone", "v").agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted, "quantile")
    sums = {r["zone"]: r["n"] for r in counted.groupBy("zone").agg(F.sum("n").alias("n")).collect()}
    return sums.get(-1, 0), counted.filter("zone = 0").select("v", "n"), sums.get(0, 0)


def _values_at(inside, below, a, b, few):
    """The values at the neighbouring ranks ``a`` and ``b`` (from 0) of a table ``v, n`` with ``below`` values before it."""
    while inside.count() > few:
        cuts = ", ".join(num(k / _PIECES) for k in range(1, _PIECES))
        pivots = sorted(set(inside.agg(F.expr(f"percentile_approx(v, array({cuts}), {10 * _PIECES})")).first()[0]))
        piece = f"aggregate(array({', '.join(map(_double, pivots))}), 0, (k, p) -> k + if(p < v, 1, 0))"
        parts = inside.selectExpr("v", "n", f"{piece} AS piece").groupBy("piece") \
            .agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("piece").collect()
        upto, chosen = below, []
        for r in parts:
            chosen += [(r, upto)] * (upto <= a < upto + r["n"] or upto <= b < upto + r["n"])
            upto += r["n"]
        if len(chosen) > 1:
            return chosen[0][0]["hi"], chosen[1][0]["lo"]
        (r, below), = chosen
        inside = inside.filter(f"v BETWEEN {_double(r['lo'])} AND {_double(r['hi'])}")
    rows = inside.orderBy("v").collect()  # ``few`` at most
    out, upto = [], below
    for r in rows:
        upto += r.n
        out += [r.v] * (len(out) == 0 and a < upto)
        if b < upto:
            return out[0], r.v


def at_most_quantile(df, column=TARGET, q=TARGET_QUANTILE):
    """Rows whose value is at or below the quantile; unmeasured values drop out."""
    limit = exact_quantile(df, column, q).scalar()
    return df.filter(F.expr(measured(f"CAST({column} AS DOUBLE)")) & (F.col(column) <= limit))


def fill(df, zeros=(), infinities=(), labels=(), label=None):
    """Defaults for missing values: 0 for counts, infinity for distances, a label for text."""
    out = {c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in zeros}
    out |= {c: F.coalesce(F.col(c), F.lit(float("inf"))) for c in infinities}
    out |= {c: F.coalesce(F.col(c), F.lit(label)) for c in labels}
    return df.withColumns(out)


def clean_non_finite(df, columns):
    """Null, NaN and both infinities become 0 in all the given columns, in one projection."""
    return df.selectExpr(*[
        f"{finite_or_zero(c)} AS `{c}`" if c in columns else f"`{c}`" for c in df.columns])


def finite_or_zero(column):
    """The value as a double, or 0 for null, NaN and both infinities, as SQL text."""
    v = f"CAST(`{column}` AS DOUBLE)"
    return f"if({v} IS NULL OR isnan({v}) OR abs({v}) = double('Infinity'), 0D, {v})"


def feature_names(df, target=TARGET, ignore=(GEOMETRY,)):
    """Every column but the target and the ignored ones, in table order."""
    require_columns(df, [target])
    return [c for c in df.columns if c != target and c not in ignore]


def union_layers(*frames):
    """Union by column name; a column that one frame lacks is null there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def lookup(df, table, key, value, default):
    """Add ``value`` from ``table`` by ``key``, with a default where there is none."""
    found = table.select(key, value)
    return df.join(found, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def first_rows(df, order, n=5):
    """The first ``n`` rows in the order of a key (a table has no order of its own)."""
    return df.orderBy(order).limit(n)


# --- typing and label codes -------------------------------------------------------

# What counts as a number in text form, besides blank and signed infinity.
NUMBER = r"^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"
INFINITE = r"^[+-]?(inf|infinity)$"


def _trimmed(c):
    """Without white space of any kind at either end."""
    return rf"trim(BOTH ' \t\n\r\u000B\u000C' FROM {c})"


def _is_number(c):
    t = _trimmed(c)
    return f"({t} = '' OR {t} RLIKE '{NUMBER}' OR lower({t}) RLIKE '{INFINITE}')"


def _to_double(c):
    text = f"lower({_trimmed(c)})"
    return (f"CASE WHEN {text} RLIKE '{INFINITE}' "
            f"THEN if({text} LIKE '-%', -double('Infinity'), double('Infinity')) "
            f"ELSE try_cast(nullif({text}, '') AS DOUBLE) END")


def column_kinds(df, skip=(GEOMETRY,)):
    """What each text column should become: ``bigint``, ``double`` or ``label``.

    One aggregate over the table answers this for all columns at once. A column is numeric only if
    every value that is there parses; it is whole if in addition none is missing or fractional.
    """
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]
    if not names:
        return {}
    facts = []
    for i, c in enumerate(names):
        q = f"`{c}`"
        whole = rf"{_trimmed(q)} RLIKE '^[+-]?\\d+$' AND try_cast({_trimmed(q)} AS BIGINT) IS NOT NULL"
        facts += [f"count_if({q} IS NOT NULL AND NOT {_is_number(q)}) AS text_{i}",
                  f"count_if({q} IS NULL OR NOT ({whole})) AS loose_{i}"]
    row = df.agg(*[F.expr(f) for f in facts]).first()
    kinds = {}
    for i, c in enumerate(names):
        kinds[c] = "label" if row[f"text_{i}"] else "double" if row[f"loose_{i}"] else "bigint"
    return kinds


def to_numeric(df, kinds):
    """Cast the numeric text columns; booleans become 0 and 1, everything else stays."""
    out = []
    for f in df.schema:
        q = f"`{f.name}`"
        kind = kinds.get(f.name)
        if kind == "bigint":
            out.append(f"CAST({_trimmed(q)} AS BIGINT) AS {q}")
        elif kind == "double":
            out.append(f"{_to_double(q)} AS {q}")
        elif isinstance(f.dataType, T.BooleanType):
            out.append(f"CAST({q} AS DOUBLE) AS {q}")
        else:
            out.append(q)
    return df.selectExpr(*out)


# Labels in a dictionary that is sent to every task: some ten megabytes at most.
SMALL_DICTIONARY = 100_000


def label_dictionary(df, columns, missing=MISSING_LABEL):
    """Codes for all label columns, as ``column, label, code``: from 0, in sorted label order.

    Null counts as the ``missing`` label. The distinct labels are range-sorted and numbered within
    their partitions; one row per partition then gives the offsets, so no task ever holds a whole
    dictionary, however many labels there are.
    """
    pairs = ", ".join(f"'{c}', coalesce(`{c}`, '{missing}')" for c in columns)
    labels = df.selectExpr(f"stack({len(columns)}, {pairs}) AS (column, label)").distinct()
    placed = labels.repartitionByRange("column", "label").sortWithinPartitions("column", "label") \
        .withColumn("place", F.monotonically_increasing_id())
    # Written out so that the places stay as they are wherever the table is used.
    placed = materialize(placed, "labels")
    placed = placed.selectExpr("column", "label", "shiftright(place, 33) AS part",
                               "place & 8589934591L AS row")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = placed.join(F.broadcast(offsets), "part") \
        .select("column", "label", (F.col("row") + F.col("offset")).alias("rank"))
    first = ranked.groupBy("column").agg(F.min("rank").alias("first"))
    return ranked.join(F.broadcast(first), "column") \
        .select("column", "label", (F.col("rank") - F.col("first")).alias("code"))


def encode_labels(df, columns, dictionary, missing=MISSING_LABEL, small=SMALL_DICTIONARY):
    """Replace label columns by their codes.

    A dictionary of at most ``small`` labels is sent to every task, one lookup per column and no shuffle.
    A larger one is joined once for all columns: the labels are unpivoted with a row number, joined
    by column and label, and put back together by row. Missing labels are answered without a
    join, so that they are no hot key, and the other columns of the table stay out of it.
    """
    dictionary = materialize(dictionary, "codes")
    blank = {r["column"]: r["code"] for r in dictionary.filter(F.col("label") == missing).collect()}  # one per column
    if dictionary.count() <= small:
        out = df
        for c in columns:
            codes = dictionary.filter(F.col("column") == c) \
                .select(F.col("label").alias("_label"), F.col("code").alias("_code"))
            out = out.withColumn("_label", F.coalesce(F.col(c), F.lit(missing))) \
                .join(F.broadcast(codes), "_label", "left").withColumn(c, F.col("_code")).drop("_label", "_code")
        return out.select(*df.columns)
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "labelled")
    pairs = ", ".join(f"{i}, `{c}`" for i, c in enumerate(columns))
    numbers = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    codes = dictionary.select(numbers[F.col("column")].alias("_column"), F.col("label").alias("_label"), "code")
    found = rows.selectExpr("_row", f"stack({len(columns)}, {pairs}) AS (_column, _label)") \
        .filter(F.col("_label").isNotNull() & (F.col("_label") != missing)) \
        .join(codes, ["_column", "_label"]).groupBy("_row") \
        .agg(*[F.max(F.when(F.col("_column") == i, F.col("code"))).alias(f"_code_{i}") for i in range(len(columns))])
    coded = rows.join(found, "_row", "left")
    place = {c: i for i, c in enumerate(columns)}
    return coded.select(*[
        F.coalesce(F.col(f"_code_{place[c]}"), F.lit(blank.get(c)).cast("bigint")).alias(c) if c in place else F.col(f"`{c}`")
        for c in df.columns])


def label_preview(dictionary, n=5):
    """The first ``n`` codes of every label column."""
    return dictionary.filter(F.col("code") < n)
