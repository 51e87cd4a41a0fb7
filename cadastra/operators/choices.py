"""Developer choices: predecessors by overlap, development events, outcomes, activity and prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.functions import scalars as s

from .panel import STATE_COLUMNS
from .spatial import events_within, overlay

# Fixed values.
LEAST_OVERLAP = 0.50
CHOICE_YEARS = tuple(range(2021, 2026))
EVENT_YEARS = tuple(range(2017, 2021))
ACTIVITY_RADIUS = 600.0


def best_predecessors(shapes: DataFrame, cell: float, least: float = LEAST_OVERLAP, key: str = "geo_pid", year: str = "fy", geom: str = "geom") -> DataFrame:
    """(key, year, prev_geo_pid, overlap_share): the parcel of the year before with the largest share of this one.

    All pairs of years are one overlay with the year as a key, so years that are missing are skipped. The
    least share is asked of the best only; ties, to nine digits, go to the smaller predecessor. Pairs that
    can't reach it by their boxes can't be returned and aren't clipped.
    """
    prior = shapes.select(F.col(key).alias("prev_geo_pid"), (F.col(year) + 1).cast(shapes.schema[year].dataType).alias("_next"), F.col(geom))
    met = overlay(shapes, prior, cell, key, "prev_geo_pid", geom, [(year, "_next")], least)
    order = Window.partitionBy(key, year).orderBy(F.desc_nulls_last(F.round("overlap_share", 9)), "prev_geo_pid")
    best = met.withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
    return best.where(F.round("overlap_share", 9) >= least).select(key, year, "prev_geo_pid", "overlap_share")


def development_events(state: DataFrame, predecessors: DataFrame, years: Sequence[int] = EVENT_YEARS, key: str = "geo_pid", year: str = "fy") -> DataFrame:
    """(key, year, net_new_units, centroid_x, centroid_y): located parcels with more units than their predecessor."""
    now = state.select(key, year, "units", "centroid_x", "centroid_y")
    before = state.select(F.col(key).alias("prev_geo_pid"), (F.col(year) + 1).alias("_next"), F.col("units").alias("units_prior"))
    joined = predecessors.where(F.col(year).isin(*years)).join(now, [key, year]).join(before, ["prev_geo_pid"]).where(F.col("_next") == F.col(year))
    out = joined.withColumn("net_new_units", s.net_new(F.col("units"), F.col("units_prior")))
    return out.where((F.col("net_new_units") > 0) & F.col("centroid_x").isNotNull() & F.col("centroid_y").isNotNull()).select(key, year, "net_new_units", "centroid_x", "centroid_y")


def choice_set(state: DataFrame, predecessors: DataFrame, years: Sequence[int] = CHOICE_YEARS, key: str = "geo_pid", year: str = "fy") -> DataFrame:
    """One row for each present parcel and choice year with its predecessor's state and what was developed."""
    have = [c for c in STATE_COLUMNS if c in state.columns]
    now = state.select(key, year, F.col("lu").alias("current_lu"), F.col("unit_category").alias("current_unit_category"))
    before = state.select(
        F.col(key).alias("prev_geo_pid"), (F.col(year) + 1).alias("_next"), "parcel_id", F.col("lu").alias("prior_lu"), F.col("unit_category").alias("prior_unit_category"), F.col("assessed_total").alias("acquisition_cost"), "land_sf", *have
    )
    out = predecessors.where(F.col(year).isin(*years)).join(now, [key, year], "left")
    right = before.withColumnRenamed("prev_geo_pid", "_prev")
    out = out.join(right, (F.col("prev_geo_pid") == F.col("_prev")) & (F.col(year) == F.col("_next")), "left").drop("_prev", "_next")
    out = out.withColumn("in_choice_set", F.coalesce(F.col("prior_lu").isin(*s.RESIDENTIAL_USES), F.lit(False)))
    return out.withColumn("dev_outcome", s.outcome(F.col("current_unit_category"), F.col("prior_unit_category"), F.col("prior_lu")))


def with_activity(choices: DataFrame, events: DataFrame, radius: float = ACTIVITY_RADIUS) -> DataFrame:
    """dev_activity_600m and dev_units_600m: number and units of the pooled events around the parcel."""
    return events_within(choices, events, "net_new_units", radius)


def with_market_price(choices: DataFrame, prices: DataFrame | None) -> DataFrame:
    """market_price_psf by the prior use, and by year if the prices have one; a null use matches a null use.

    Without a price table the column is null. Columns lu and price_per_sqft are other names of
    land_use_code and market_price_psf. Of repeated keys the first row counts, null price or not: by a
    column ``ordinal`` if the prices have one, else in the order in which their file is read.
    """
    choices = choices.drop("market_price_psf")
    if prices is None:
        return choices.withColumn("market_price_psf", F.lit(None).cast("double"))
    names = {old: new for old, new in (("lu", "land_use_code"), ("price_per_sqft", "market_price_psf")) if old in prices.columns and new not in prices.columns}
    prices = prices.withColumnsRenamed(names)
    if not {"land_use_code", "market_price_psf"} <= set(prices.columns):
        raise ValueError("prices need land_use_code and market_price_psf")
    by_year = "fy" in prices.columns
    keys = [s.normalize_land_use(F.col("land_use_code")).alias("_lu"), *([F.col("fy").alias("_fy")] if by_year else [])]
    at = F.col("ordinal") if "ordinal" in prices.columns else F.monotonically_increasing_id()
    rows = prices.select(*keys, F.struct(F.col("market_price_psf").cast("double").alias("p")).alias("_p"), at.alias("_at"))
    lookup = rows.groupBy("_lu", *["_fy"] * by_year).agg(F.min_by("_p", "_at").alias("_p")).select("_lu", *["_fy"] * by_year, F.col("_p.p").alias("market_price_psf"))
    on = F.col("prior_lu").eqNullSafe(F.col("_lu"))
    if by_year:
        on = on & F.col("fy").eqNullSafe(F.col("_fy"))
    return choices.join(lookup, on, "left").drop("_lu", "_fy")
