"""Coordinates and map links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions.text import blank_if_null, let, strip

#: Fixed values.
EARTH_RADIUS_M, CONFLICT_M = 6_371_000.0, 250.0
MAP_SEARCH = "https://www.google.com/maps/search/?api=1&query="
_N = r"([-+]?[0-9]+(?:\.[0-9]+)?)"
#: The coordinate shapes of map URLs, most explicit first.
LINK_SHAPES = (
    rf"[?&]query={_N}%2C\s*{_N}",
    rf"[?&]query={_N}\s*,\s*{_N}",
    rf"[?&]q={_N}\s*,\s*{_N}",
    rf"[?&]ll={_N}\s*,\s*{_N}",
    rf"@{_N}\s*,\s*{_N}",
    rf"!3d{_N}!4d{_N}",
)


def _point(text: Column, shape: str) -> Column:
    lat, lon = (F.regexp_extract(text, shape, i).try_cast("double") for i in (1, 2))
    fits = lambda p: F.when(p["latitude"].between(-90, 90) & p["longitude"].between(-180, 180), p)
    return F.when(text.rlike(shape), let(F.struct(lat.alias("latitude"), lon.alias("longitude")), fits))


def parse_latlon(c: Column) -> Column:
    """``lat, lon`` in range to struct<latitude, longitude>, else null."""
    return let(blank_if_null(c), lambda text: _point(text, rf"(?U)^\s*{_N}\s*,\s*{_N}\s*$"))


def parse_map_link(c: Column) -> Column:
    return let(strip(blank_if_null(c)), lambda text: F.coalesce(*[_point(text, s) for s in LINK_SHAPES]))


def format_latlon(p: Column) -> Column:
    """Six decimals. Ties in the seventh round half up, from the decimal text."""
    return let(p, lambda p: F.when(p.isNotNull(), F.format_string("%.6f, %.6f", p["latitude"], p["longitude"])))


def map_url(p: Column) -> Column:
    return let(p, lambda p: F.when(p.isNotNull(), F.concat(F.lit(MAP_SEARCH), F.format_string("%.6f,%.6f", p["latitude"], p["longitude"]))))


def haversine_m(a: Column, b: Column) -> Column:
    def metres(a: Column, b: Column) -> Column:
        la, lb = F.radians(a["latitude"]), F.radians(b["latitude"])
        dlat, dlon = lb - la, F.radians(b["longitude"]) - F.radians(a["longitude"])
        inner = F.pow(F.sin(dlat / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin(dlon / 2), 2)
        return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(inner)))

    return let(a, lambda a: let(b, lambda b: metres(a, b)))


def materially_different(a: Column, b: Column, metres: float = CONFLICT_M) -> Column:
    return haversine_m(a, b) > metres
