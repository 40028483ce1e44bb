"""Geographic and planar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# WGS84
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)


def utm_zone(lon: Column) -> Column:
    """UTM zone number of a longitude."""
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def _kruger() -> tuple[float, list[float]]:
    """Rectifying radius and the series coefficients of the transverse Mercator projection, to n^6."""
    n = _N
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    # fixed values: Krueger's series in the third flattening n
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]
    return radius, alpha


def to_utm(lon: Column, lat: Column, zone: Column, south: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing in metres of WGS84 degrees in a zone."""
    radius, alpha = _kruger()
    e = (_F * (2 - _F)) ** 0.5
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    north, east = xi, eta
    for j, a in enumerate(alpha, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    x, y = 500000 + 0.9996 * radius * east, 0.9996 * radius * north
    return x, y if south is None else F.when(south, y + 10000000).otherwise(y)


def from_utm(x: Column, y: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of metres in a UTM zone of WGS84."""
    radius, n = _kruger()[0], _N
    # fixed values: the inverse of Krueger's series in the third flattening n
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
        4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
        4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
        20648693 * n**6 / 638668800,
    ]
    xi = F.when(south, y - 10000000).otherwise(y) / (0.9996 * radius)
    eta = (x - 500000) / (0.9996 * radius)
    north, east = xi, eta
    for j, b in enumerate(beta, 1):
        north = north - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    e = (_F * (2 - _F)) ** 0.5
    conformal = F.asin(F.sin(north) / F.cosh(east))
    lat = conformal
    for _ in range(6):  # the latitude of a conformal one; each step adds three digits
        s = F.sin(lat)
        lat = 2 * F.atan(F.tan(F.lit(0.7853981633974483) + conformal / 2) * F.pow((1 + e * s) / (1 - e * s), F.lit(e / 2))) - F.lit(1.5707963267948966)
    return F.degrees(F.atan2(F.sinh(east), F.cos(north))) + (zone * 6 - 183), F.degrees(lat)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in kilometres."""
    p, q = F.radians(lat1), F.radians(lat2)
    u, v = F.sin((q - p) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = u * u + F.cos(p) * F.cos(q) * v * v
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north in [0, 360); 0 without displacement."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def turn(before: Column, after: Column) -> Column:
    """Change of bearing, wrapped to [-180, 180)."""
    return F.pmod(after - before + 180, F.lit(360.0)) - 180


def point_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment, which may be a point itself."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length))).otherwise(0.0)
    return planar(px, py, x1 + t * dx, y1 + t * dy)


def _side(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_meet(p: tuple[Column, Column, Column, Column], q: tuple[Column, Column, Column, Column]) -> Column:
    """Whether two closed segments (x1, y1, x2, y2) share a point; touching counts."""
    ax, ay, bx, by = p
    cx, cy, dx, dy = q
    s1, s2 = _side(ax, ay, bx, by, cx, cy), _side(ax, ay, bx, by, dx, dy)
    s3, s4 = _side(cx, cy, dx, dy, ax, ay), _side(cx, cy, dx, dy, bx, by)
    boxes = (F.least(ax, bx) <= F.greatest(cx, dx)) & (F.least(cx, dx) <= F.greatest(ax, bx)) & (F.least(ay, by) <= F.greatest(cy, dy)) & (F.least(cy, dy) <= F.greatest(ay, by))
    return boxes & (s1 * s2 <= 0) & (s3 * s4 <= 0)


def register(spark) -> None:
    """SQL functions haversine_km(lon1, lat1, lon2, lat2) and utm_zone(lon)."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE) RETURNS DOUBLE
        RETURN 2 * {EARTH_KM} * asin(least(1D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))""")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION utm_zone(lon DOUBLE) RETURNS INT RETURN CAST(floor((lon + 180) / 6) + 1 AS INT)")
