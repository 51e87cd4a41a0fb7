"""Geographic coordinates to the metric plane of the panel, as closed-form columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Conic:
    """Lambert conformal conic with two standard parallels on an ellipsoid; degrees and metres."""

    parallel_1: float
    parallel_2: float
    latitude_0: float
    longitude_0: float
    easting_0: float
    northing_0: float
    axis: float
    flattening: float

    @property
    def eccentricity(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    def _m(self, lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - (self.eccentricity * math.sin(lat)) ** 2)

    def _t(self, lat: float) -> float:
        e = self.eccentricity
        return math.tan(math.pi / 4 - lat / 2) / ((1 - e * math.sin(lat)) / (1 + e * math.sin(lat))) ** (e / 2)

    @property
    def cone(self) -> tuple[float, float, float]:
        """The cone's constant, its scale and the radius at the origin."""
        a, b, o = (math.radians(x) for x in (self.parallel_1, self.parallel_2, self.latitude_0))
        n = (math.log(self._m(a)) - math.log(self._m(b))) / (math.log(self._t(a)) - math.log(self._t(b)))
        scale = self._m(a) / (n * self._t(a) ** n)
        return n, scale, self.axis * scale * self._t(o) ** n

    def columns(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(x, y) of longitudes and latitudes; null where either is null."""
        n, scale, origin = self.cone
        e = self.eccentricity
        phi = F.radians(lat)
        bent = e * F.sin(phi)
        t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - bent) / (1 + bent), F.lit(e / 2))
        radius = self.axis * scale * F.pow(t, F.lit(n))
        angle = n * (F.radians(lon) - math.radians(self.longitude_0))
        return self.easting_0 + radius * F.sin(angle), self.northing_0 + origin - radius * F.cos(angle)

    def point(self, lon: float, lat: float) -> tuple[float, float]:
        n, scale, origin = self.cone
        radius = self.axis * scale * self._t(math.radians(lat)) ** n
        angle = n * math.radians(lon - self.longitude_0)
        return self.easting_0 + radius * math.sin(angle), self.northing_0 + origin - radius * math.cos(angle)


# Fixed values of EPSG:26986 on GRS 80.
MASSACHUSETTS = Conic(41 + 43 / 60, 42 + 41 / 60, 41.0, -71.5, 200_000.0, 750_000.0, 6_378_137.0, 1 / 298.257222101)
