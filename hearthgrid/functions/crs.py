"""Reference systems as SQL expressions: 4326, 3857 and the UTM zones (326zz, 327zz)."""

import math

from hearthgrid.functions.sql import let, num

# The spherical radius of 3857, and the WGS84 ellipsoid and UTM grid constants.
MERCATOR_RADIUS = 6378137.0
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_EASTING = 500000.0
UTM_SOUTH_NORTHING = 10000000.0

# Third flattening, and the transverse Mercator series coefficients derived from it.
_N = WGS84_F / (2 - WGS84_F)
_ECC = 2 * math.sqrt(_N) / (1 + _N)
_RECT = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
_INVERSE = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]
_LATITUDE = [
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
]
_K = num(UTM_SCALE * _RECT)


def to_mercator(lon, lat):
    """4326 degrees to 3857 metres, as a pair of expressions."""
    r = num(MERCATOR_RADIUS)
    return (f"{r} * radians({lon})",
            f"{r} * ln(tan(pi() / 4.0D + radians({lat}) / 2.0D))")


def from_mercator(x, y):
    """3857 metres to 4326 degrees, as a pair of expressions."""
    r = num(MERCATOR_RADIUS)
    return (f"degrees(({x}) / {r})",
            f"degrees(2.0D * atan(exp(({y}) / {r})) - pi() / 2.0D)")


def utm_zone(lon):
    """Zone number 1 to 60 of a longitude in degrees."""
    return f"CAST(greatest(1, least(60, floor((({lon}) + 180.0D) / 6.0D) + 1)) AS BIGINT)"


def utm_srid(lon, lat):
    """326zz north of the equator, 327zz south of it."""
    return f"CAST(if(({lat}) >= 0.0D, 32600, 32700) + {utm_zone(lon)} AS BIGINT)"


def _meridian(srid):
    return f"radians((({srid}) % 100) * 6.0D - 183.0D)"


def _false_northing(srid):
    return f"if(({srid}) >= 32700, {num(UTM_SOUTH_NORTHING)}, 0.0D)"


def _series(coefficients, first, second, xi, eta):
    return " + ".join(f"{num(c)} * {first}({2 * k} * {xi}) * {second}({2 * k} * {eta})"
                      for k, c in enumerate(coefficients, start=1))


def to_utm(lon, lat, srid):
    """Degrees to UTM metres; ``srid`` is an expression, so that zones may differ by row."""
    e, lam = num(_ECC), f"(radians({lon}) - {_meridian(srid)})"
    sin = f"sin(radians({lat}))"
    conformal = f"sinh(atanh({sin}) - {e} * atanh({e} * {sin}))"
    sphere = let("ct", conformal, f"struct(atan2(ct, cos({lam})) AS xi, "
                                  f"atanh(sin({lam}) / sqrt(1.0D + ct * ct)) AS eta)")
    east = f"sp.eta + {_series(_FORWARD, 'cos', 'sinh', 'sp.xi', 'sp.eta')}"
    north = f"sp.xi + {_series(_FORWARD, 'sin', 'cosh', 'sp.xi', 'sp.eta')}"
    return (let("sp", sphere, f"{num(UTM_EASTING)} + {_K} * ({east})"),
            let("sp", sphere, f"{_false_northing(srid)} + {_K} * ({north})"))


def from_utm(x, y, srid):
    """UTM metres to degrees."""
    given = f"struct((({y}) - {_false_northing(srid)}) / {_K} AS xi, " \
            f"(({x}) - {num(UTM_EASTING)}) / {_K} AS eta)"
    back = [-c for c in _INVERSE]
    sphere = let("gv", given,
                 f"struct(gv.xi + {_series(back, 'sin', 'cosh', 'gv.xi', 'gv.eta')} AS xi, "
                 f"gv.eta + {_series(back, 'cos', 'sinh', 'gv.xi', 'gv.eta')} AS eta)")
    lon = f"degrees({_meridian(srid)} + atan2(sinh(sp.eta), cos(sp.xi)))"
    lat = "la + " + " + ".join(f"{num(d)} * sin({2 * k} * la)"
                               for k, d in enumerate(_LATITUDE, start=1))
    lat = let("la", "asin(sin(sp.xi) / cosh(sp.eta))", f"degrees({lat})")
    return let("sp", sphere, lon), let("sp", sphere, lat)


def reproject_xy(x, y, source, target):
    """Move one coordinate pair between two systems given as integers."""
    if source == target:
        return x, y
    lon, lat = x, y
    if source == 3857:
        lon, lat = from_mercator(x, y)
    elif _is_utm(source):
        lon, lat = from_utm(x, y, source)
    elif source != 4326:
        raise ValueError(f"unsupported reference system: {source}")
    if target == 4326:
        return lon, lat
    if target == 3857:
        return to_mercator(lon, lat)
    if _is_utm(target):
        return to_utm(lon, lat, target)
    raise ValueError(f"unsupported reference system: {target}")


def _is_utm(srid):
    return 32601 <= srid <= 32660 or 32701 <= srid <= 32760


def reproject(geom, levels, source, target):
    """Move a geometry with ``levels`` array levels around its ``STRUCT<x, y>`` points."""
    if levels == 0:
        x, y = reproject_xy(f"{geom}.x", f"{geom}.y", source, target)
        return f"if({geom} IS NULL, NULL, struct({x} AS x, {y} AS y))"
    part = f"g{levels}"
    return f"transform({geom}, {part} -> {reproject(part, levels - 1, source, target)})"


def reproject_mixed(geom, source, target):
    """Move a geometry of any kind."""
    parts = [f"{reproject(f'{geom}.{part}', levels, source, target)} AS {part}"
             for part, levels in (("points", 1), ("lines", 2), ("polygons", 3))]
    return f"if({geom} IS NULL, NULL, struct({geom}.kind AS kind, {', '.join(parts)}))"
