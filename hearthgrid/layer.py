"""A layer: a DataFrame whose geometry column, key and reference system are known."""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.config import WEB_MERCATOR
from hearthgrid.functions import crs, geometry as g


@dataclass(frozen=True)
class Layer:
    """``geom`` names a column holding

    * point: ``STRUCT<x, y>``
    * line: ``ARRAY<STRUCT<x, y>>``, one more array level if multi-part
    * polygon: ``ARRAY<ARRAY<STRUCT<x, y>>>`` (ring 0 outer, the rest holes), one more level
      if multi-part
    * mixed: ``STRUCT<kind, points, lines, polygons>``, any of them per row, in their multi-part forms

    All coordinates of a layer share one ``srid``.
    """

    df: DataFrame
    key: str
    geom: str
    kind: str
    srid: int | None

    def __post_init__(self):
        if self.kind not in ("point", "line", "polygon", "mixed"):
            raise ValueError(f"unknown geometry kind: {self.kind}")
        require_columns(self.df, [self.key, self.geom])

    def require_srid(self):
        if self.srid is None:
            raise ValueError(f"layer keyed by {self.key!r} has no reference system")
        return self.srid

    def to_srid(self, srid):
        """Layer in another reference system; unchanged if it is already there."""
        if self.require_srid() == srid:
            return self
        if self.kind == "mixed":
            moved = crs.reproject_mixed(self.geom, self.srid, srid)
        else:
            moved = crs.reproject(self.geom, g.depth(self.df, self.geom), self.srid, srid)
        return replace(self, df=self.df.withColumn(self.geom, F.expr(moved)), srid=srid)

    def with_df(self, df):
        return replace(self, df=df)

    def multi(self):
        """The geometry in its multi-part form, as SQL text (points stay as they are)."""
        return g.as_multi(self.df, self.geom, self.kind)

    def centroid(self):
        """Centroid ``STRUCT<x, y>`` in the layer's own system, as SQL text."""
        return g.centroid(self.multi(), self.kind)

    def inner_point(self):
        """A point inside the shape (the centroid may lie outside it), as SQL text."""
        if self.kind == "polygon":
            return g.inner_point(self.multi())
        if self.kind == "mixed":
            inner = g.inner_point(f"{self.geom}.polygons")
            return f"if(size({self.geom}.polygons) > 0, {inner}, {self.centroid()})"
        return self.centroid()

    def any_kind(self):
        """The same layer with geometry of any kind."""
        made = self.df.withColumn(self.geom, F.expr(g.as_mixed(self.multi(), self.kind)))
        return replace(self, df=made, kind="mixed")

    def located(self, *keep, inner=False, srid=None, names=("x", "y")):
        """The key, ``keep`` and the centroid (or inner point) as two columns.

        ``srid`` is where the point is taken and reported, by default the layer's own system.
        """
        layer = self if srid is None else self.to_srid(srid)
        spot = layer.inner_point() if inner else layer.centroid()
        # inline() works the point out once per row; plain columns would be copied into every
        # filter that is pushed below them.
        return layer.df.selectExpr(layer.key, *keep, f"inline(array({spot})) AS ({', '.join(names)})")

    def projected(self):
        return self.to_srid(WEB_MERCATOR)


def require_columns(df, names):
    """Raise with the missing names unless ``df`` has every column in ``names``."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def require_same_srid(left, right):
    """Both layers in one system: the right one is moved to the left one's if they differ."""
    return left, right.to_srid(left.require_srid())
