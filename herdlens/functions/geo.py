"""Great-circle geometry and the box grid of the neighbour search.

Distances are compared as haversines ``h = sin^2(d / 2R)``, which grow with the
distance, so no arc-sine is needed per pair.

A box is small enough that any two points in it are within ``eps``: its sides
have haversine ``h_eps / 2`` each. Bands have their own whole number of boxes
around the globe, so boxes meet at +-180 degrees.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from herdlens.config import EARTH_RADIUS_KM
from herdlens.functions.numeric import lit_double

_MARGIN = 1e-7  # keeps rounding errors on the safe side of every bound


def haversine(lat_gap: str, lon_gap: str, cos_a: str, cos_b: str) -> str:
    return (
        f"(pow(sin(radians({lat_gap}) / 2D), 2D)"
        f" + ({cos_a}) * ({cos_b}) * pow(sin(radians({lon_gap}) / 2D), 2D))"
    )


@dataclass(frozen=True)
class Bounds:
    """Names of a table's bounding-rectangle columns."""

    lat_low: str
    lat_high: str
    lon_low: str
    lon_high: str

    @staticmethod
    def of(prefix: str) -> "Bounds":
        return Bounds(*[f"{prefix}{n}" for n in ("lat_low", "lat_high", "lon_low", "lon_high")])

    def aggregates(self, lat: str, lon: str) -> list:
        return [
            F.min(lat).alias(self.lat_low), F.max(lat).alias(self.lat_high),
            F.min(lon).alias(self.lon_low), F.max(lon).alias(self.lon_high),
        ]

    def columns(self) -> list:
        return [self.lat_low, self.lat_high, self.lon_low, self.lon_high]


def _cos_range(b: Bounds) -> tuple[str, str]:
    """Least and greatest cosine of latitude within the bounds."""
    low, high = f"cos(radians({b.lat_low}))", f"cos(radians({b.lat_high}))"
    most = f"CASE WHEN {b.lat_low} <= 0 AND {b.lat_high} >= 0 THEN 1D ELSE greatest({low}, {high}) END"
    return f"least({low}, {high})", most


def nearest_and_farthest(a: Bounds, b: Bounds) -> tuple[Column, Column]:
    """Lower and upper bound of the haversine between points of two rectangles.

    For two single points both equal the haversine between them.
    """
    # b as seen from a across +-180 degrees
    gap = f"({a.lon_low} + {a.lon_high} - {b.lon_low} - {b.lon_high}) / 2D"
    shift = f"360D * rint({gap} / 360D)"
    b_low, b_high = f"({b.lon_low} + {shift})", f"({b.lon_high} + {shift})"

    lat_near = f"greatest(0D, {b.lat_low} - {a.lat_high}, {a.lat_low} - {b.lat_high})"
    lat_far = f"greatest({b.lat_high} - {a.lat_low}, {a.lat_high} - {b.lat_low})"
    lon_near = f"greatest(0D, {b_low} - {a.lon_high}, {a.lon_low} - {b_high})"
    lon_far = f"least(180D, greatest({b_high} - {a.lon_low}, {a.lon_high} - {b_low}))"
    a_least, a_most = _cos_range(a)
    b_least, b_most = _cos_range(b)
    return (
        F.expr(haversine(lat_near, lon_near, a_least, b_least)),
        F.expr(haversine(lat_far, lon_far, a_most, b_most)),
    )


@dataclass(frozen=True)
class Grid:
    """Boxes in which all points are neighbours, for one ``eps_km``."""

    eps_km: float

    @property
    def half_angle(self) -> float:
        return min(self.eps_km / (2.0 * EARTH_RADIUS_KM), math.pi / 2.0)

    @property
    def limit(self) -> float:
        """Haversine of ``eps_km``."""
        return math.sin(self.half_angle) ** 2

    @property
    def height(self) -> float:
        """Degrees of latitude per band."""
        return math.degrees(2.0 * math.asin(math.sin(self.half_angle) / math.sqrt(2.0))) * (1.0 - _MARGIN)

    @property
    def reach(self) -> int:
        """How many bands away a neighbour can be."""
        return int(math.degrees(2.0 * self.half_angle) / self.height) + 1

    @property
    def bands(self) -> int:
        return int(180.0 / self.height) + 1

    def band(self, lat: Column) -> Column:
        return F.floor((lat + lit_double(90.0)) / lit_double(self.height)).cast("bigint")

    def _edges(self, band: Column) -> tuple[Column, Column]:
        low = band.cast("double") * lit_double(self.height) - lit_double(90.0)
        return low, low + lit_double(self.height)

    def boxes_in_band(self, band: Column) -> Column:
        low, high = self._edges(band)
        nearest_equator = F.when((low <= 0) & (high >= 0), lit_double(0.0)).otherwise(
            F.least(F.abs(low), F.abs(high))
        )
        side = lit_double(math.sin(self.half_angle) / math.sqrt(2.0))
        sine = F.least(lit_double(1.0), side / F.greatest(F.cos(F.radians(nearest_equator)), lit_double(1e-12)))
        width = F.degrees(lit_double(2.0) * F.asin(sine)) * lit_double(1.0 - _MARGIN)
        return F.ceil(lit_double(360.0) / width).cast("bigint")

    def lon_reach(self, band_a: Column, band_b: Column) -> Column:
        """Degrees of longitude within which neighbours of two bands lie."""
        edges = [F.abs(e) for band in (band_a, band_b) for e in self._edges(band)]
        farthest = F.least(lit_double(90.0), F.greatest(*edges))
        sine = lit_double(math.sin(self.half_angle)) / F.greatest(F.cos(F.radians(farthest)), lit_double(1e-12))
        arc = F.degrees(lit_double(2.0) * F.asin(F.least(lit_double(1.0), sine))) * lit_double(1.0 + _MARGIN)
        return F.when(sine >= lit_double(1.0), lit_double(180.0)).otherwise(arc)

    @staticmethod
    def lon_place(lon: Column, boxes: Column) -> Column:
        """Position along a band, in boxes."""
        return (lon + lit_double(180.0)) / lit_double(360.0) * boxes.cast("double")

    @staticmethod
    def box(band: Column, column: Column) -> Column:
        return F.shiftleft(band, 32) + column
