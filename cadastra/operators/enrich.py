"""Enrichment of the panel: neighbourhood, income, employment distance and zoning, by parcel."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions import scalars as s
from cadastra.functions.crs import MASSACHUSETTS, Conic

from .panel import first_points
from .spatial import pip_join, reprojected

# Fixed values.
NAME_COLUMNS = ("name", "neighborhood", "neighborhood_name", "NBHD", "NBH_NAME")
ID_COLUMNS = ("neighborhood_id", "id", "OBJECTID")
ZONING_NAMES = {"Zoning_Sub": "zoning_use", "Max_FAR": "max_far", "Max_Height": "max_height", "Max_Number": "max_floors"}
EMPLOYMENT_CENTERS = (
    ("Downtown Boston CBD", 42.3555, -71.0605),
    ("Back Bay", 42.3493, -71.0799),
    ("Seaport", 42.3503, -71.0446),
    ("Longwood Medical Area", 42.3360, -71.1057),
    ("Kendall Square", 42.3626, -71.0863),
)


def spread_back(panel: DataFrame, by_parcel: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``panel`` with ``columns`` of each parcel on all its rows, replacing what was there."""
    return panel.drop(*columns).join(by_parcel.select(*keys, *columns), list(keys), "left")


def plane(polygons: DataFrame, geom: str, crs: Conic | None) -> DataFrame:
    return polygons if crs is None else polygons.withColumn(geom, reprojected(F.col(geom), crs))


def first_matches(points: DataFrame, polygons: DataFrame, columns: Sequence[str], ordinal: str, geom: str, key: str, whole_row: bool, equal: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(key, equal keys, columns) from the first polygon, by ``ordinal``, that a point is in.

    ``whole_row``: all columns come from that polygon, nulls included; otherwise each column comes from
    the first polygon where it isn't null.
    """
    numbered = polygons.withColumn("_pid", F.struct(*(q for _, q in equal), ordinal))
    pid = F.sha2(F.to_json("_pid"), 256)
    numbered = numbered.withColumn("_poly", pid)
    located = points.withColumn("_pt", F.struct(key, *(p for p, _ in equal)))
    spots = located.withColumn("_point", F.to_json("_pt"))
    hits = pip_join(spots, numbered, "_point", "_poly", "centroid_x", "centroid_y", geom, equal)
    met = hits.join(numbered.select("_poly", F.col(ordinal).alias("_o"), *(F.col(c).alias(f"_v_{c}") for c in columns)), "_poly").join(spots.select("_point", key, *(p for p, _ in equal)), "_point")
    group = [key, *(p for p, _ in equal)]
    if whole_row:
        row = F.min_by(F.struct(*(F.col(f"_v_{c}").alias(c) for c in columns)), F.col("_o"))
        return met.groupBy(*group).agg(row.alias("_r")).select(*group, *(F.col(f"_r.{c}").alias(c) for c in columns))
    first = lambda c: F.min_by(F.col(f"_v_{c}"), F.when(F.col(f"_v_{c}").isNotNull(), F.col("_o")))
    return met.groupBy(*group).agg(*(first(c).alias(c) for c in columns))


def with_neighborhood(panel: DataFrame, boundaries: DataFrame, geom: str = "geom", ordinal: str = "ordinal", name: str | None = None, id_name: str | None = None, crs: Conic | None = MASSACHUSETTS) -> DataFrame:
    """neighborhood_name and neighborhood_id: first name and, apart from it, first id that aren't null.

    Without an id column the ids are the boundaries' ordinals. Boundaries without any shape, or without a
    name column, are an error.
    """
    name = name or s.choose_column(boundaries.columns, NAME_COLUMNS)
    if name is None:
        raise ValueError(f"no name column among {boundaries.columns}")
    if boundaries.where(F.col(geom).isNotNull()).isEmpty():
        raise ValueError("boundaries have no shapes")
    id_name = id_name or s.choose_column(boundaries.columns, ID_COLUMNS)
    ids = F.col(id_name) if id_name else F.col(ordinal)
    areas = plane(boundaries.where(F.col(geom).isNotNull()), geom, crs).select(F.col(name).cast("string").alias("neighborhood_name"), ids.alias("neighborhood_id"), geom, ordinal)
    found = first_matches(first_points(panel), areas, ["neighborhood_name", "neighborhood_id"], ordinal, geom, "geo_pid", False)
    return spread_back(panel, found, ["geo_pid"], ["neighborhood_name", "neighborhood_id"])


def with_zoning(panel: DataFrame, districts: DataFrame, geom: str = "geom", ordinal: str = "ordinal", crs: Conic | None = MASSACHUSETTS) -> DataFrame:
    """zoning_use, max_far, max_height, max_floors of the first district that holds the parcel, nulls included."""
    areas = plane(districts.where(F.col(geom).isNotNull()), geom, crs).withColumnsRenamed(ZONING_NAMES)
    areas = areas.withColumns({c: s.clean_numeric(F.col(c)) for c in ("max_far", "max_height", "max_floors")})
    columns = list(ZONING_NAMES.values())
    found = first_matches(first_points(panel), areas, columns, ordinal, geom, "geo_pid", True)
    return spread_back(panel, found, ["geo_pid"], columns)


def with_income(panel: DataFrame, tracts: DataFrame, income: DataFrame, geom: str = "geom", ordinal: str = "ordinal", column: str = "median_hh_income", null_sentinels: bool = False, crs: Conic | None = MASSACHUSETTS) -> DataFrame:
    """Median income of the tract that holds the parcel, of the survey year that belongs to the fiscal year.

    ``tracts``: GEOID, acs_year, shape; ``income``: GEOID, acs_year, income. All vintages are one join with
    the survey year as a key. Missing-value sentinels are kept unless ``null_sentinels``.
    """
    value = F.col("income").cast("double")
    income = income.select("GEOID", "acs_year", (F.when(value >= 0, value) if null_sentinels else value).alias(column))
    areas = plane(tracts.where(F.col(geom).isNotNull()), geom, crs).join(income, ["GEOID", "acs_year"], "left").withColumnRenamed("acs_year", "_vintage")
    rows = panel.withColumn("acs_year", s.survey_vintage(F.col("fy")))
    spots = rows.where(F.col("acs_year").isNotNull() & F.col("geo_pid").isNotNull() & F.col("centroid_x").isNotNull() & F.col("centroid_y").isNotNull())
    spots = spots.groupBy("geo_pid", "fy", "acs_year").agg(F.min_by(F.struct("centroid_x", "centroid_y"), F.struct("parcel_id")).alias("p")).select("geo_pid", "acs_year", "fy", "p.*")
    found = first_matches(spots.withColumn("_parcel", F.struct("geo_pid", "fy")), areas, [column], ordinal, geom, "_parcel", False, [("acs_year", "_vintage")])
    found = found.select("_parcel.geo_pid", "_parcel.fy", column)
    return spread_back(panel, found, ["geo_pid", "fy"], [column])


def with_employment_distance(panel: DataFrame, centers: Sequence[tuple[str, float, float]] = EMPLOYMENT_CENTERS, column: str = "emp_dist_m", crs: Conic = MASSACHUSETTS) -> DataFrame:
    """Distance in metres from the parcel to the nearest centre."""
    spots = [crs.point(lon, lat) for _, lat, lon in centers]
    away = first_points(panel).withColumn(column, s.nearest_distance(F.col("centroid_x"), F.col("centroid_y"), spots))
    return spread_back(panel, away, ["geo_pid"], [column])


def amenities(features: DataFrame, tags: dict[str, dict[str, object]], category: str = "category") -> DataFrame:
    """Features by category: any tag of the category with an allowed value; True allows any value.

    ``features`` has a map column ``tags``. A feature can be in several categories; a category without
    features has no rows. Features that are in none at all go, and if none is left that is an error.
    """

    def wanted(rules: dict[str, object]) -> Column:
        hits = []
        for key, allowed in rules.items():
            value = F.try_element_at("tags", F.lit(key))
            hits.append(value.isNotNull() if allowed is True else value.isin(*(allowed if isinstance(allowed, list) else [allowed])))
        return F.coalesce(reduce(Column.__or__, (F.coalesce(h, F.lit(False)) for h in hits)), F.lit(False))

    found = F.array_compact(F.array(*(F.when(wanted(rules), F.lit(name)) for name, rules in tags.items())))
    out = features.withColumn(category, F.explode(found))
    if out.isEmpty():
        raise ValueError("no feature is an amenity of any category")
    return out
