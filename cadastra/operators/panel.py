"""The parcel-year panel: harmonised rows, keys with fallback, collapsed state, representative rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.functions import scalars as s

# Unified name, name up to FY2020, name from FY2021.
SCHEMA_MAP = (
    ("parcel_id", "PID", "PID"),
    ("gis_id", "GIS_ID", "GIS_ID"),
    ("zip_code", "ZIPCODE", "ZIP_CODE"),
    ("land_use_code", "LU", "LU"),
    ("land_use_desc", None, "LU_DESC"),
    ("bldg_type", None, "BLDG_TYPE"),
    ("assessed_land", "AV_LAND", "LAND_VALUE"),
    ("assessed_bldg", "AV_BLDG", "BLDG_VALUE"),
    ("assessed_total", "AV_TOTAL", "TOTAL_VALUE"),
    ("land_sf", "LAND_SF", "LAND_SF"),
    ("gross_area", "GROSS_AREA", "GROSS_AREA"),
    ("living_area", "LIVING_AREA", "LIVING_AREA"),
    ("yr_built", "YR_BUILT", "YR_BUILT"),
    ("yr_remodel", "YR_REMOD", "YR_REMODEL"),
    ("structure_class", "STRUCTURE_CLASS", "STRUCTURE_CLASS"),
    ("overall_cond", "R_OVRALL_CND", "OVERALL_COND"),
    ("bedrooms", "R_BDRMS", "BED_RMS"),
    ("full_baths", "R_FULL_BTH", "FULL_BTH"),
    ("half_baths", "R_HALF_BTH", "HLF_BTH"),
    ("total_rooms", "R_TOTAL_RMS", "TT_RMS"),
    ("com_units", "S_UNIT_COM", "COM_UNITS"),
    ("num_floors", "NUM_FLOORS", "RES_FLOOR"),
    ("num_parking", "U_NUM_PARK", "NUM_PARKING"),
)
FIRST_NEW_YEAR = 2021
PANEL_YEARS = range(2016, 2026)
PANEL_NUMBERS = ("assessed_land", "assessed_bldg", "assessed_total", "land_sf", "gross_area", "living_area")
SUMMED = ("living_area", "gross_area", "assessed_total", "assessed_land", "assessed_bldg", "land_sf")
STATE_COLUMNS = ("zip_code", "overall_cond", "centroid_x", "centroid_y", "neighborhood_name", "median_hh_income", "emp_dist_m", "walkability", "zoning_use", "max_far", "max_height", "max_floors")
PRICE_COLUMNS = ("land_use_desc", "bldg_type", "structure_class", "bedrooms", "full_baths", "half_baths", "total_rooms", "num_parking", "num_floors")


def harmonized(raw: DataFrame, fy: Column | int, new_names: bool, res_units: str | None = None) -> DataFrame:
    """One year's file under the unified names, all text; a column that the file lacks is null.

    Header blanks are stripped and tokens for missing values are null. ``res_units`` names a source
    column for recorded units, which no generation has under a name of its own.
    """
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    have = set(raw.columns)
    pick = lambda c: s.null_tokens(F.col(f"`{c}`").cast("string")) if c in have else F.lit(None).cast("string")
    columns = [pick(new if new_names else old).alias(name) for name, old, new in SCHEMA_MAP]
    out = raw.select(*columns, (pick(res_units) if res_units else F.lit(None).cast("string")).alias("res_units"), (fy if isinstance(fy, Column) else F.lit(fy)).cast("int").alias("fy"))
    return out.withColumns({"parcel_id": s.normalize_pid(F.col("parcel_id")), "gis_id": s.normalize_pid(F.col("gis_id")), "overall_cond": s.normalize_condition(F.col("overall_cond")), "res_units": s.clean_numeric(F.col("res_units"))})


def stacked(years: Sequence[DataFrame]) -> DataFrame:
    """Years under one another by name, money and areas as numbers."""
    panel = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), years)
    return panel.withColumns({c: s.clean_numeric(F.col(c)) for c in PANEL_NUMBERS})


def with_geo_key(panel: DataFrame, shapes: DataFrame, id_column: str = "parcel_id", year: str = "fy", shape_id: str = "geo_pid") -> DataFrame:
    """``panel`` with geo_pid and the shape's point: the account's own parcel, else its base parcel, else null.

    ``shapes`` has one row a parcel and year: ``shape_id``, ``year``, centroid_x, centroid_y.
    """
    points = shapes.select(F.col(shape_id).alias("_s"), F.col(year).alias("_f"), F.col("centroid_x").alias("_x"), F.col("centroid_y").alias("_y"))
    own = points.withColumnsRenamed({"_s": "_s1", "_f": "_f1", "_x": "_x1", "_y": "_y1"})
    base = points.withColumnsRenamed({"_s": "_s2", "_f": "_f2", "_x": "_x2", "_y": "_y2"})
    out = panel.drop("geo_pid", "centroid_x", "centroid_y")
    out = out.join(own, (F.col(id_column) == F.col("_s1")) & (F.col(year) == F.col("_f1")), "left")
    out = out.join(base, (s.base_pid(F.col(id_column)) == F.col("_s2")) & (F.col(year) == F.col("_f2")), "left")
    found = F.col("_s1").isNotNull()
    return out.withColumns({"geo_pid": F.coalesce("_s1", "_s2"), "centroid_x": F.when(found, F.col("_x1")).otherwise(F.col("_x2")), "centroid_y": F.when(found, F.col("_y1")).otherwise(F.col("_y2"))}).drop(*(f"_{c}{i}" for c in "sfxy" for i in (1, 2)))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def with_year_dummies(df: DataFrame, years: Sequence[int], fy: str = "fy") -> DataFrame:
    """A 0/1 column for each of ``years`` but the first, present in the data or not."""
    return df.select(*(c for c in df.columns if c not in {f"y_{y}" for y in years}), *s.year_dummies(F.col(fy), sorted(years)[1:]))


def parcel_state(panel: DataFrame, tie_break: Sequence[str] = ("parcel_id",), key: str = "geo_pid", year: str = "fy", extra: Sequence[str] = PRICE_COLUMNS) -> DataFrame:
    """One row for each parcel and year: its representative account's attributes, sums over all accounts, units.

    A condominium master stands for its parcel, then other accounts, then unit accounts; ties go to the
    smallest ``tie_break``. All of it is one aggregation: attributes travel in a struct under ``min_by``.
    Rows without a parcel are left out; a parcel of unit accounts only counts as a condominium.
    """
    have = set(panel.columns)
    numeric = [c for c in (*SUMMED, "yr_built", "res_units") if c in have]
    carried = [c for c in dict.fromkeys([*STATE_COLUMNS, *extra]) if c in have]
    df = panel.where(F.col(key).isNotNull()).withColumns({c: s.number(F.col(c)) if panel.schema[c].dataType.typeName() == "string" else F.col(c).cast("double") for c in numeric})
    for c in (*SUMMED, "yr_built", "res_units"):
        if c not in have:
            df = df.withColumn(c, F.lit(None).cast("double"))
    use = s.normalize_land_use(F.col("land_use_code"))
    is_unit = F.coalesce(use.isin(*s.CONDO_UNIT_USES), F.lit(False))
    df = df.withColumns({"_lu": use, "_unit": is_unit.cast("long"), "_rank": s.account_rank(use)})
    own = F.struct(F.col("_lu").alias("lu"), "res_units", "parcel_id", *carried)
    rank = F.struct("_rank", *(c for c in tie_break))
    out = df.groupBy(key, year).agg(F.min_by(own, rank).alias("_r"), *(F.sum(c).alias(c) for c in SUMMED), F.max("yr_built").alias("yr_built"), F.sum("_unit").alias("n_unit_rows"))
    out = out.select(key, year, *(F.col(f"_r.{c}").alias(c) for c in ("lu", "res_units", "parcel_id", *carried)), *SUMMED, "yr_built", "n_unit_rows")
    out = out.withColumn("lu", F.when(F.col("lu").isin(*s.CONDO_UNIT_USES), F.lit("CM")).otherwise(F.col("lu")))
    out = out.withColumn("units", s.derived_units(F.col("lu"), F.col("res_units"), F.col("n_unit_rows"), F.col("living_area")))
    return out.withColumn("unit_category", s.unit_category(F.col("lu"), F.col("units")))


def first_points(panel: DataFrame, key: str = "geo_pid", order: Sequence[str] = ("parcel_id", "fy")) -> DataFrame:
    """(key, centroid_x, centroid_y): of each parcel, the point of its first located row in panel order."""
    located = panel.where(F.col(key).isNotNull() & F.col("centroid_x").isNotNull() & F.col("centroid_y").isNotNull())
    p = located.groupBy(key).agg(F.min_by(F.struct("centroid_x", "centroid_y"), F.struct(*order)).alias("p"))
    return p.select(key, "p.centroid_x", "p.centroid_y")


def upsert(existing: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` rows whose key isn't in ``batch``, and the batch."""
    return existing.join(batch.select(*keys).distinct(), list(keys), "left_anti").unionByName(batch)


def sampled(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows by a hash of the key and the seed; the same rows on any cluster."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
