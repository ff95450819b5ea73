"""Geography as Columns: distances, windows, grids, projections and hit tests."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
EARTH_KM = 6371.0
METRES_PER_PIXEL = 156543.03392
MERCATOR_M = 20037508.342789244
MERCATOR_LATITUDE = 85.0511287798066
WORLD_EDGE = 1e-5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite (Spark's order puts NaN above all numbers)."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def usable(lat: Column, lon: Column) -> Column:
    return F.coalesce(finite(lat) & finite(lon) & lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, in the form that is exact for near points."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_asin_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The same by the arc sine, its argument held within 0 and 1."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def wrap_lon(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def _wrap(x: float) -> float:
    return (x + 180) % 360 - 180


@dataclass(frozen=True)
class BBox:
    """A query window; west beyond east means over the antimeridian."""

    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float
    zoom: float | None = None

    def snapped(self) -> BBox:
        """The window on a grid that widens as the zoom falls, outwards; below zoom 3 the whole world."""
        z = self.zoom or 5
        if z < 3:
            return BBox(-90, 90, -180, 180, _half_up(z))
        grid = 20 if z < 4 else 10 if z < 7 else 5 if z < 10 else 2
        south, north = max(-90, math.floor(self.min_lat / grid) * grid), min(90, math.ceil(self.max_lat / grid) * grid)
        west, east = math.floor(self.min_lon / grid) * grid, math.ceil(self.max_lon / grid) * grid
        if east - west >= 360:
            return BBox(south, north, -180, 180, _half_up(z))
        return BBox(south, north, _wrap(west), _wrap(east), _half_up(z))

    def widened(self, by: float = WORLD_EDGE) -> BBox:
        return replace(self, min_lat=self.min_lat - by, max_lat=self.max_lat + by, min_lon=self.min_lon - by, max_lon=self.max_lon + by)

    def is_global(self, slack: float = 1.0) -> bool:
        return self.min_lat <= -90 + slack and self.max_lat >= 90 - slack and self.min_lon <= -180 + slack and self.max_lon >= 180 - slack


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def within(lat: Column, lon: Column, box: BBox) -> Column:
    """Whether a point is in the window; null coordinates are not.  Wide or low-zoom windows only bound the latitude."""
    inside = lat.isNotNull() & lon.isNotNull() & lat.between(box.min_lat, box.max_lat)
    if (box.zoom is not None and box.zoom < 3) or box.max_lon - box.min_lon >= 360:
        return inside
    west, east, x = _wrap(box.min_lon), _wrap(box.max_lon), wrap_lon(lon)
    return inside & ((x >= west) | (x <= east) if west > east else x.between(west, east))


def valid_tile(z: Column, x: Column, y: Column) -> Column:
    top = F.pow(F.lit(2.0), z) - 1
    return z.between(0, 16) & (x >= 0) & (x <= top) & (y >= 0) & (y <= top)


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Web Mercator metres (x, y) of a point."""
    return lon * (MERCATOR_M / 180), F.ln(F.tan(F.radians(lat) / 2 + math.pi / 4)) * (MERCATOR_M / math.pi)


def inverse_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) of Web Mercator metres."""
    return F.degrees(2 * F.atan(F.exp(y * (math.pi / MERCATOR_M))) - math.pi / 2), x * (180 / MERCATOR_M)


def metres_per_pixel(lat: Column, zoom: Column) -> Column:
    return METRES_PER_PIXEL * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), zoom)


def in_polygon(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a point is in a ring, array<struct<lat, lon>>, by counting the edges that a ray crosses."""
    ahead = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    pairs = F.zip_with(ring, ahead, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
        return spans & F.coalesce(lon < at, F.lit(False))

    return F.size(F.filter(pairs, crosses)) % 2 == 1


def segment_metres(lat: Column, lon: Column, a: Column, b: Column) -> Column:
    """Metres from a point to a segment between two structs of lat and lon, on the plane that touches the earth there."""
    metres = math.radians(1) * EARTH_KM * 1000
    across = F.cos(F.radians(lat)) * metres
    ax, ay = wrap_lon(a["lon"] - lon) * across, (a["lat"] - lat) * metres
    # the segment goes the short way round the earth, whatever side of it the point is on
    dx, dy = wrap_lon(b["lon"] - a["lon"]) * across, (b["lat"] - a["lat"]) * metres
    t = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))


def on_line(lat: Column, lon: Column, line: Column, zoom: Column, size: Column) -> Column:
    """Whether a point is on a drawn line, array<struct<lat, lon>>: within its width and a half on either side, or 5 m."""
    pairs = F.zip_with(F.slice(line, F.lit(1), F.size(line) - 1), F.slice(line, F.lit(2), F.size(line)), lambda a, b: segment_metres(lat, lon, a, b))
    slack = F.greatest(F.lit(5.0), F.coalesce(size, F.lit(4.0)) * metres_per_pixel(lat, zoom) * 2.5)
    return F.coalesce(F.array_min(pairs) < slack, F.lit(False))


def on_point(lat: Column, lon: Column, at_lat: Column, at_lon: Column, zoom: Column, size: Column) -> Column:
    """Whether a point is on a drawn one: within six times its size, or 10 m."""
    slack = F.greatest(F.lit(10.0), F.coalesce(size, F.lit(4.0)) * 6 * metres_per_pixel(lat, zoom))
    return haversine_km(lat, lon, at_lat, at_lon) * 1000 < slack


def without_repeats(points: Column) -> Column:
    """Points, array<struct<lon, lat>>, that are finite, none like the one before it."""
    fine = F.filter(points, lambda p: finite(p["lon"]) & finite(p["lat"]))
    return let(fine, lambda all_: F.filter(all_, lambda p, i: (i == 0) | (p != F.get(all_, i - 1))))


def to_world(point: Column) -> Column:
    """A point as struct<x, y> of the Web Mercator square of side 1."""
    phi = F.radians(F.least(F.lit(MERCATOR_LATITUDE), F.greatest(F.lit(-MERCATOR_LATITUDE), point["lat"])))
    return F.struct(((point["lon"] + 180) / 360).alias("x"), ((1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2).alias("y"))


def from_world(point: Column) -> Column:
    y = F.least(F.lit(1.0), F.greatest(F.lit(0.0), point["y"]))
    return F.struct((point["x"] * 360 - 180).alias("lon"), F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y)))).alias("lat"))


def unwrapped(world: Column) -> Column:
    """Points of the square of side 1, each moved by whole worlds to within half a one of the point before it."""
    near = lambda last, p: F.struct((p["x"] - F.round(p["x"] - last["x"])).alias("x"), p["y"].alias("y"))
    return F.aggregate(F.slice(world, F.lit(2), F.size(world)), F.slice(world, 1, 1), lambda done, p: F.concat(done, F.array(near(F.element_at(done, -1), p))))


def smooth_line(points: Column, zoom: float, step_pixels: float = 3.0, most: int = 64) -> Column:
    """A drawn line as a Catmull-Rom curve through its points, array<struct<lon, lat>>, in steps of about so many pixels.

    Fewer than three different points stay as they are; the last point is the last of the line.
    """
    pixels = 512 * 2 ** max(0.0, zoom)

    def curve(a: Column, b: Column, c: Column, d: Column, t: Column) -> Column:
        axis = lambda n: (2 * b[n] + (c[n] - a[n]) * t + (2 * a[n] - 5 * b[n] + 4 * c[n] - d[n]) * t * t + (3 * b[n] - a[n] - 3 * c[n] + d[n]) * t * t * t) / 2
        return from_world(F.struct(axis("x").alias("x"), axis("y").alias("y")))

    def piece(world: Column, i: Column) -> Column:
        top = F.size(world) - 1
        a, b, c, d = (F.get(world, F.greatest(F.lit(0), F.least(top, i + k))) for k in (-1, 0, 1, 2))
        far = lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])
        long = F.greatest(far(b, c), (far(a, b) + far(b, c) + far(c, d)) / 3) * pixels
        n = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(long / step_pixels))).cast("int")
        return let(n, lambda n_: F.transform(F.sequence(F.lit(0), n_ - 1), lambda k: curve(a, b, c, d, k / n_)))

    def whole(clean: Column) -> Column:
        made = let(unwrapped(F.transform(clean, to_world)), lambda w: F.flatten(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: piece(w, i))))
        last = F.element_at(clean, -1)
        end = lambda before: F.struct((last["lon"] - 360 * F.round((last["lon"] - before["lon"]) / 360)).alias("lon"), last["lat"].alias("lat"))
        return F.when(F.size(clean) < 3, clean).otherwise(let(made, lambda m: F.concat(m, F.array(end(F.element_at(m, -1))))))

    return let(without_repeats(points), whole)


def public_ipv4(ip: Column) -> Column:
    """Whether an IPv4 address is public: not of a private, local, shared, documentation, multicast or reserved range."""
    parts = F.transform(F.split(ip, r"\."), lambda p: p.try_cast("int"))
    a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
    shape = ip.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") & F.forall(parts, lambda p: p.between(0, 255))
    private = a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
    private = private | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    return F.coalesce(shape & ~private, F.lit(False))


def public_address(ip: Column) -> Column:
    """Whether an IPv4 or IPv6 address, in brackets or not, is public.

    Of version 6 the unspecified, loopback, link-local, unique local and multicast addresses are not; addresses that
    embed one of version 4 are judged by it.
    """
    v4 = r"(?:^|:)([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"

    def written_out(bare: Column) -> Column:
        """A version 4 tail as two groups of version 6; null if it is none."""
        octets = F.transform(F.array(*[F.regexp_extract(bare, v4, i) for i in range(1, 5)]), lambda x: x.try_cast("bigint"))
        pair = lambda o, i: F.lower(F.hex(F.get(o, F.lit(i)) * 256 + F.get(o, F.lit(i + 1))))
        tail = lambda o: F.when(F.forall(o, lambda x: x.between(0, 255)), F.concat(F.regexp_replace(bare, r"[0-9.]+$", ""), pair(o, 0), F.lit(":"), pair(o, 2)))
        return F.when(bare.contains("."), let(octets, tail)).otherwise(bare)

    def groups(plain: Column) -> Column:
        """The eight groups as text, or none where the address has another form."""
        chunks = lambda x: F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))
        halves = F.transform(F.split(plain, "::"), chunks)

        def filled(h: Column) -> Column:
            head, tail = F.get(h, F.lit(0)), F.coalesce(F.get(h, F.lit(1)), F.array().cast("array<string>"))
            gap = 8 - F.size(head) - F.size(tail)
            fits = ((F.size(h) == 1) & (gap == 0)) | ((F.size(h) == 2) & (gap >= 1))
            return F.when(fits, F.concat(head, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), tail))

        return let(halves, filled)

    def judged(parts: Column) -> Column:
        number = F.transform(parts, lambda c: F.when(c.rlike("^[0-9a-f]{1,4}$"), F.conv(c, 16, 10).cast("int")))

        def public(n: Column) -> Column:
            at = lambda i: F.get(n, F.lit(i))
            zeros = lambda k: F.forall(F.slice(n, 1, k), lambda x: x == 0)
            low = F.concat_ws(".", F.shiftright(at(6), 8), at(6).bitwiseAND(0xFF), F.shiftright(at(7), 8), at(7).bitwiseAND(0xFF))
            own = (at(0).bitwiseAND(0xFFC0) == 0xFE80) | (at(0).bitwiseAND(0xFE00) == 0xFC00) | (at(0).bitwiseAND(0xFF00) == 0xFF00)
            return F.forall(n, lambda x: x.isNotNull()) & F.when(zeros(6) | (zeros(5) & (at(5) == 0xFFFF)), let(low, public_ipv4)).otherwise(~own)

        return let(number, public)

    bare = F.lower(F.regexp_replace(ip, r"^\[|\]$", ""))
    six = lambda b: let(let(written_out(b), groups), judged)
    return F.coalesce(let(bare, lambda b: F.when(b.contains(":"), six(b)).otherwise(public_ipv4(b))), F.lit(False))
