"""Job 1: one wide feature row per building."""

from pyspark.sql import functions as F

from hearthgrid.config import LAND_AREA, POI_RADIUS, ROAD_RADIUS, WATER_RADIUS
from hearthgrid.operators import neighbours as nb
from hearthgrid.operators.areas import area_features
from hearthgrid.operators.raster import sample_places
from hearthgrid.operators.skew import attach
from hearthgrid.session import materialize


def building_features(buildings, raster, pois, water, roads, areas=None,
                      poi_radius=POI_RADIUS, water_radius=WATER_RADIUS, road_radius=ROAD_RADIUS, sides=None):
    """Population, POI, water and road features, and the lowest area id if ``areas`` is given.

    The raster comes as pixels or as tiles, POI as geometry of any kind. ``sides`` searches POI and water in
    a regular polygon in place of the circle.

    Everything is worked out once per distinct place and attached to the buildings at the end, so
    the wide building rows are shuffled for nothing but that.
    """
    buildings = buildings.with_df(buildings.df.drop(LAND_AREA))
    layer = buildings.projected()
    both = f"inline(array(struct({layer.centroid()} AS c, {layer.inner_point()} AS i)))"
    spots = materialize(layer.df.selectExpr(layer.key, both).selectExpr(
        layer.key, "c.x AS cx", "c.y AS cy", "i.x AS ix", "i.y AS iy"), "located")

    centres = nb.places(spots, "cx", "cy")
    names, by_poi = nb.poi_by_place(centres, pois, poi_radius, sides=sides)
    by_centre = sample_places(centres.select(*nb.PLACE), raster) \
        .join(by_poi, "place", "left") \
        .join(nb.road_by_place(centres, roads, road_radius), "place", "left").drop("place")
    inners = nb.places(spots, "ix", "iy")
    by_inner = nb.at_places(nb.water_by_place(inners, water, water_radius, sides=sides), inners)

    centre, inner = {"x": "cx", "y": "cy"}, {"x": "ix", "y": "iy"}
    out = attach(spots, by_centre.withColumnsRenamed(centre), ["cx", "cy"],
                 centres.withColumnsRenamed(centre), layer.key)
    out = attach(out, by_inner.withColumnsRenamed(inner), ["ix", "iy"],
                 inners.withColumnsRenamed(inner), layer.key)
    out = nb.fill_counts(out.drop("cx", "cy", "ix", "iy"), names).fillna(0.0, ["population"])
    out = buildings.df.join(nb.fill_roads(nb.fill_water(out)), buildings.key, "left")
    if areas is None:
        return out
    tags = area_features(buildings.with_df(buildings.df.select(buildings.key, buildings.geom)), areas)
    first = tags.groupBy(buildings.key).agg(*[
        F.min_by(c, "area_OBJECTID").alias(c)
        for c in ("area_FNAME", "area_Eng_Name")], F.min("area_OBJECTID").alias("area_OBJECTID"))
    return out.join(first, buildings.key, "left")
