"""Administrative areas: filter points by area, tag buildings with their area."""

import math

from pyspark.sql import functions as F

from hearthgrid.config import AREA_COLUMNS
from hearthgrid.functions import crs
from hearthgrid.functions.sql import let, num
from hearthgrid.layer import require_columns, require_same_srid
from hearthgrid.operators.spatial_join import polygons_around

# Pieces per side, four times as many at most, that an area's outline is cut into.
_CUTS = 8


def _side(areas):
    """Longer side of a polygon's outline, as SQL text."""
    xs, ys = (f"transform(flatten(flatten({areas.multi()})), q -> q.{v})" for v in "xy")
    return f"greatest(array_max({xs}) - array_min({xs}), array_max({ys}) - array_min({ys}))"


def with_levels(areas, level="_level"):
    """The areas with the quadtree level of their cells: 4^level is an eighth to a 32nd of the outline.

    Areas smaller than the average share the level of the average one, so that a point is looked up on few levels:
    as many as the largest outline has powers of four over the average.
    """
    step = let("sd", _side(areas), f"if(sd > 0 AND sd < double('Infinity'), CAST(floor(ln(sd / {num(_CUTS)}) / ln(4D)) AS INT), NULL)")
    classed = areas.df.withColumn(level, F.expr(step))
    mean = areas.df.agg(F.expr(f"avg(nullif({_side(areas)}, double('Infinity')))")).first()[0]
    least = math.floor(math.log(mean / _CUTS, 4)) if mean else 0
    return areas.with_df(classed.withColumn(level, F.greatest(F.coalesce(F.col(level), F.lit(least)), F.lit(least))))


def areas_at(spots, query_key, areas):
    """The containing areas of each point."""
    return polygons_around(spots, query_key, with_levels(areas.with_df(areas.df.select(areas.key, areas.geom))))


def points_in_areas(points, areas):
    """Inner join: a point in k overlapping areas comes k times; only its own columns are kept."""
    points, areas = require_same_srid(points, areas)
    hits = areas_at(points.located(), [points.key], areas)
    return points.df.join(hits.select(points.key), points.key)


def rename_areas(df):
    """``FNAME`` to ``area_FNAME`` and so on, after a check that all are there."""
    require_columns(df, AREA_COLUMNS)
    return df.withColumnsRenamed({c: f"area_{c}" for c in AREA_COLUMNS})


def layer_bounds(df, x="x", y="y"):
    """Extent of a point frame as one row."""
    return df.agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"),
                  F.min(y).alias("y_min"), F.max(y).alias("y_max"))


def layer_extent(layer):
    """Extent of a layer over all its vertices as one row."""
    if layer.kind == "point":
        return layer_bounds(layer.located())
    levels = "flatten({})" if layer.kind == "line" else "flatten(flatten({}))"
    vertices = levels.format(layer.multi())
    ends = [f"{f}(array_{f}(transform({vertices}, q -> q.{v}))) AS {v}_{f}" for v in "xy" for f in ("min", "max")]
    return layer.df.agg(*[F.expr(e) for e in ends])


def layer_utm(layer):
    """UTM system of a layer: the zone of the middle of its extent."""
    box = layer_extent(layer.to_srid(4326))
    middle = crs.utm_srid("(x_min + x_max) / 2D", "(y_min + y_max) / 2D")
    return box.selectExpr(f"{middle} AS srid").first()[0]


def area_features(buildings, areas):
    """Left join: each building with the areas its centroid lies in, as ``area_*`` columns.

    A building in k overlapping areas comes k times, one in none stays with nulls. The centroid is
    taken in the UTM zone of the layer; a point building is its own centroid in any system.
    """
    require_columns(areas.df, AREA_COLUMNS)
    buildings = buildings.to_srid(areas.require_srid())
    if buildings.kind == "point":
        spots = buildings.located()
    else:
        utm = layer_utm(buildings)
        x, y = crs.reproject_xy("x", "y", utm, areas.srid)
        spots = buildings.located(srid=utm) \
            .selectExpr(buildings.key, f"inline(array(struct({x}, {y}))) AS (x, y)")
    hits = areas_at(spots, [buildings.key], areas)
    names = rename_areas(areas.df.withColumn("_area", F.col(areas.key)).select("_area", *AREA_COLUMNS))
    tagged = hits.select(buildings.key, F.col(areas.key).alias("_area"))
    return buildings.df.join(tagged, buildings.key, "left").join(names, "_area", "left").drop("_area")
