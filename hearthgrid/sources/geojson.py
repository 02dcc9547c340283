"""GeoJSON in and out."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.functions.geometry import mixed
from hearthgrid.functions.sql import let
from hearthgrid.layer import Layer
from hearthgrid.operators.profile import file_stem
from hearthgrid.operators.columns import union_layers
from hearthgrid.session import scratch_path
from hearthgrid.sources.geojson_ranges import document_features

# Array levels of the coordinates by GeoJSON type.
_LEVELS = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}
_PARTS = {"points": ("Point", "MultiPoint"), "lines": ("LineString", "MultiLineString"), "polygons": ("Polygon", "MultiPolygon")}
_COLLECTION = "GeometryCollection"
_KIND_TYPES = {"point": ("Point", None), "line": ("LineString", "MultiLineString"),
               "polygon": ("Polygon", "MultiPolygon")}
# A whole feature, and what else may stand on a line of a collection with one feature per line.
_FEATURE_LINE = r'^\{.*"type"\s*:\s*"Feature"\s*[,}]'
_OTHER_LINE = r'^([\[\]{},\s]*|\{?\s*"(type|name|crs|bbox|features|xy_coordinate_resolution)"\s*:.*)$'
# Where a collection names its reference system, and the name that stands for degrees.
_CRS_NAME = r'"crs"\s*:\s*\{.*?"name"\s*:\s*"([^"]*)"'
_DEGREES = "CRS84"


def _nested(levels):
    kind = "double"
    for _ in range(levels):
        kind = f"array<{kind}>"
    return kind


def _points(coords, levels):
    """Coordinate arrays to ``STRUCT<x, y>``; a third coordinate is dropped."""
    if levels == 1:
        return f"struct({coords}[0] AS x, {coords}[1] AS y)"
    part = f"c{levels}"
    return f"transform({coords}, {part} -> {_points(part, levels - 1)})"


def geometry_of(raw, kind):
    """Geometry from ``raw.type`` and ``raw.coordinates`` (JSON text), as SQL text.

    Lines and polygons come out in their multi-part form, so that single and multi-part features
    can share a column. Empty coordinates give null; geometry of any other type is an error.
    """
    if kind == "mixed":
        return _mixed_of(raw)
    single, multi = _KIND_TYPES[kind]
    one, many = _LEVELS[single], _LEVELS.get(multi)
    text = f"nullif({raw}.coordinates, '[]')"
    first = _points(f"from_json({text}, '{_nested(one)}')", one)
    known = f"'{single}'" if multi is None else f"'{single}', '{multi}'"
    other = (f"WHEN {raw}.type NOT IN ({known}) THEN raise_error(concat("
             f"'a {kind} layer cannot hold geometry of type ', {raw}.type))")
    if multi is None:
        return f"CASE {other} WHEN {text} IS NOT NULL THEN {first} END"
    rest = _points(f"from_json({text}, '{_nested(many)}')", many)
    return (f"CASE {other} WHEN {text} IS NULL THEN NULL WHEN {raw}.type = '{single}' THEN array({first}) "
            f"ELSE {rest} END")


def _mixed_of(raw):
    """Geometry of any type, those of a collection put together; null if it is empty."""
    own = f"array(struct({raw}.type AS type, {raw}.coordinates AS coordinates))"
    parts = f"if({raw}.type = '{_COLLECTION}', {raw}.geometries, {own})"
    known = ", ".join(f"'{t}'" for types in _PARTS.values() for t in types)
    found = []
    for single, multi in _PARTS.values():
        text = "nullif(gp.coordinates, '[]')"
        first = _points(f"from_json({text}, '{_nested(_LEVELS[single])}')", _LEVELS[single])
        rest = _points(f"from_json({text}, '{_nested(_LEVELS[multi])}')", _LEVELS[multi])
        taken = (f"CASE WHEN gp.type NOT IN ({known}) THEN raise_error(concat('unknown geometry type ', gp.type)) "
                 f"WHEN {text} IS NULL THEN NULL WHEN gp.type = '{single}' THEN array({first}) "
                 f"WHEN gp.type = '{multi}' THEN {rest} END")
        found.append(f"flatten(filter(transform({parts}, gp -> {taken}), a -> a IS NOT NULL))")
    made = let("mx", mixed(f"{raw}.type", *found), "if(size(mx.points) + size(mx.lines) + size(mx.polygons) = 0, NULL, mx)")
    return f"if({raw} IS NULL, NULL, {made})"


def _feature_fields(properties):
    part = T.StructType([T.StructField("type", T.StringType()),
                         T.StructField("coordinates", T.StringType())])
    raw = T.StructType([*part, T.StructField("geometries", T.ArrayType(part))])
    return [T.StructField("type", T.StringType()), T.StructField("properties", properties),
            T.StructField("geometry", raw)]


def _collection_schema(properties):
    """A feature, or a collection of features with the name of its reference system."""
    name = T.StructType([T.StructField("name", T.StringType())])
    fields = _feature_fields(properties)
    return T.StructType([*fields, T.StructField("features", T.ArrayType(T.StructType(fields))),
                         T.StructField("crs", T.StructType([T.StructField("properties", name)]))])


def _wrong_system(name, srid):
    """Whether a reference system's name is there and says anything but ``srid``."""
    code = F.when(name.endswith(_DEGREES), F.lit("4326")).otherwise(F.regexp_extract(name, r"(\d+)$", 1))
    return name.isNotNull() & (name != "") & (code != str(srid))


def _refuse(text, shown):
    return F.raise_error(F.concat(F.lit(text), F.left(shown, F.lit(80))))


def _file_path():
    """The file's path as it is written on disk; Spark reports it as part of a URL."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_features(spark, paths, properties=None, collection=False, srid=4326):
    """Features as ``properties`` (struct), ``geometry`` (type and coordinate text) and ``file``.

    By default each feature stands on a line of its own, so that a large file is split over many
    tasks. That covers newline-delimited GeoJSON and collections written one feature per line, as
    the common writers do. A collection on a single line is read as well, by one task; any other
    layout is an error. ``collection`` reads a file that is one document, however it is laid out,
    which takes one task per file; ``collection="ranges"`` reads it by many tasks, as long as it is a collection of
    features. A file that names another reference system than ``srid`` is an
    error. ``properties`` is a struct type; without it the types are inferred by a first pass.
    """
    if properties is None:
        properties = _infer_properties(spark, paths, collection)
    whole = _collection_schema(properties)
    if collection == "ranges":
        return _ranged_features(spark, paths, properties, srid)
    if collection:
        rows = spark.read.schema(whole).option("multiLine", True).json(paths) \
            .select(F.struct(*[F.col(n) for n in whole.names]).alias("f"), _file_path().alias("file"))
    else:
        # The head and the tail of a collection are not features; the comma after one is cut off.
        # Only features reach the parser, whatever filters end up around it.
        line = F.regexp_replace(F.trim("value"), ",$", "")
        named = F.regexp_extract(line, _CRS_NAME, 1)
        line = F.when(line.rlike(_FEATURE_LINE), line) \
            .when(line.rlike(_OTHER_LINE), F.when(_wrong_system(named, srid), _refuse("another reference system: ", named))) \
            .otherwise(_refuse("not one feature per line: ", line))
        rows = spark.read.text(paths).select(line.alias("line"), _file_path().alias("file")) \
            .select(F.from_json("line", whole, {"mode": "FAILFAST"}).alias("f"), "file") \
            .filter("f IS NOT NULL")
    one = F.array(F.struct("f.type", "f.properties", "f.geometry"))
    name = F.col("f.crs.properties.name")
    found = F.when(_wrong_system(name, srid), _refuse("another reference system: ", name)) \
        .when(F.col("f.type") == "Feature", one).when(F.col("f.features").isNotNull(), F.col("f.features")) \
        .otherwise(_refuse("neither a feature nor a collection: ", F.coalesce("f.type", F.lit("no type"))))
    return rows.select(F.explode(found).alias("f"), "file").select("f.properties", "f.geometry", "file")


def _ranged_features(spark, paths, properties, srid):
    """The same from documents that many tasks read together."""
    features, between = document_features(spark, paths)
    one = T.StructType(_feature_fields(properties))
    parsed = features.select(F.from_json("text", one, {"mode": "FAILFAST"}).alias("f"), F.col("file").alias("url")) \
        .filter("f.type = 'Feature'")
    path = F.url_decode(F.replace(F.col("url"), F.lit("+"), F.lit("%2B")))
    # The reference system stands outside the features; the check joins in, so that it cannot be skipped.
    named = F.regexp_extract("text", _CRS_NAME, 1)
    checked = between.select(F.col("file").alias("url"), F.when(
        _wrong_system(named, srid), _refuse("another reference system: ", named)).cast("string").alias("bad"))
    return parsed.join(checked, "url").filter("bad IS NULL").select("f.properties", "f.geometry", path.alias("file"))


def _infer_properties(spark, paths, collection):
    if collection == "ranges":
        path = scratch_path(spark, "features")
        document_features(spark, paths)[0].select(F.regexp_replace("text", r"[\r\n]+", " ").alias("text")).write.text(path)
        kind = spark.read.json(path).schema
        return kind["properties"].dataType if "properties" in kind.names and isinstance(
            kind["properties"].dataType, T.StructType) else T.StructType([])
    kind = spark.read.option("multiLine", collection).json(paths).schema
    if "properties" not in kind.names and "features" in kind.names:
        kind = kind["features"].dataType.elementType
    if "properties" not in kind.names or not isinstance(kind["properties"].dataType, T.StructType):
        return T.StructType([])
    return kind["properties"].dataType


def read_geojson(spark, paths, kind, properties=None, geom="geometry", srid=4326, collection=False):
    """Properties as columns plus the geometry column."""
    rows = read_features(spark, paths, properties, collection, srid)
    return rows.select("properties.*", F.expr(geometry_of("geometry", kind)).alias(geom))


def read_geojson_layer(spark, paths, key, kind, properties=None, geom="geometry", srid=4326,
                       collection=False):
    df = read_geojson(spark, paths, kind, properties, geom, srid, collection)
    return Layer(df, key, geom, kind, srid)


def read_poi_folder(spark, folder, key="poi_id", properties=None, srid=4326, target=4326, kind="mixed",
                    collection=False):
    """All POI files of a folder as one layer; the type of a POI is the stem of its file's name.

    The files may hold geometry of any kind, also side by side. A file may itself be a folder of parts, as Spark
    writes it. An empty folder is an error, and so is a file that cannot be parsed or, if another
    ``kind`` than mixed is asked for, holds other geometry than that.
    """
    rows = read_features(spark, f"{folder.rstrip('/')}/*.geojson", properties, collection, srid)
    named = F.regexp_replace("file", r"/part-[^/]*$", "")
    layers = rows.withColumn("file", named).select(
        "properties.*", F.expr(file_stem("file")).alias("poi_type"),
        F.expr(geometry_of("geometry", kind)).alias("geometry"))
    return Layer(layers, key, "geometry", kind, srid).to_srid(target)


def union_poi_layers(*layers):
    """POI layers in the system of the first, as one layer; of any kind if theirs differ."""
    moved = [layer.to_srid(layers[0].require_srid()) for layer in layers]
    if len({layer.kind for layer in moved}) > 1:
        moved = [layer.any_kind() for layer in moved]
    return moved[0].with_df(union_layers(*[layer.df for layer in moved]))


# --- writing ---------------------------------------------------------------------


def _coordinates(geom, levels):
    if levels == 0:
        return f"array({geom}.x, {geom}.y)"
    part = f"w{levels}"
    return f"transform({geom}, {part} -> {_coordinates(part, levels - 1)})"


def to_features(layer):
    """One JSON text per feature, in a column ``value``."""
    if layer.kind == "mixed":
        return _mixed_features(layer)
    geom, kind = (layer.multi(), layer.kind) if layer.kind != "point" else (layer.geom, "point")
    single, multi = _KIND_TYPES[kind]
    name = multi or single
    coords = _coordinates(geom, _LEVELS[name] - 1)
    rest = [f"`{c}`" for c in layer.df.columns if c != layer.geom]
    body = (f"if(`{layer.geom}` IS NULL, NULL, struct('{name}' AS type, {coords} AS coordinates))")
    return layer.df.selectExpr(
        f"to_json(struct('Feature' AS type, struct({', '.join(rest)}) AS properties, "
        f"{body} AS geometry), map('ignoreNullFields', 'false')) AS value")


def _mixed_features(layer):
    """Features of a mixed layer, each with the type it was read with."""
    geom = f"`{layer.geom}`"

    def shape(name, value):
        return f"to_json(struct('{name}' AS type, {_coordinates(value, _LEVELS[name] - 1)} AS coordinates))"

    cases, members = [], []
    for part, (single, multi) in _PARTS.items():
        cases.append(f"WHEN '{single}' THEN {shape(single, f'{geom}.{part}[0]')} WHEN '{multi}' THEN {shape(multi, f'{geom}.{part}')}")
        members.append(f"transform({geom}.{part}, member -> {shape(single, 'member')})")
    whole = f"concat('{{\"type\":\"{_COLLECTION}\",\"geometries\":[', array_join(concat({', '.join(members)}), ','), ']}}')"
    body = f"if({geom} IS NULL, 'null', CASE {geom}.kind {' '.join(cases)} ELSE {whole} END)"
    rest = ", ".join(f"`{c}`" for c in layer.df.columns if c != layer.geom)
    return layer.df.selectExpr(
        f"concat('{{\"type\":\"Feature\",\"properties\":', to_json(struct({rest}), map('ignoreNullFields', 'false')), "
        f"',\"geometry\":', {body}, '}}') AS value")


def write_geojson(layer, path, mode="overwrite"):
    """One feature per line, one file per partition, coordinates in degrees as GeoJSON asks for."""
    to_features(layer.to_srid(4326)).write.mode(mode).text(path)
