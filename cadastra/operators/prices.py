"""The price panel: winsorised values by year, the prior-price lag, the model's input table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.functions import scalars as s
from cadastra.session import durable

from .spatial import prior_within

# Column, lower and upper quantile by year; the lower clip comes first.
YEARLY_CLIPS = (
    ("assessed_total", 0.02, 0.98),
    ("land_sf", None, 0.99),
    ("gross_area", None, 0.95),
    ("living_area", None, 0.95),
    ("price_per_sqft", 0.01, 0.99),
    ("median_hh_income", 0.01, None),
)
FIXED_CLIPS = (("land_sf", 500.0, None), ("gross_area", 500.0, None), ("living_area", 500.0, None), ("num_floors", 1.0, None), ("yr_built", None, 2030.0))
LAG_RADIUS = 300.0
DUMMY_YEARS = tuple(range(2016, 2026))
NUMBERS = ("assessed_total", "assessed_land", "assessed_bldg", "living_area", "gross_area", "land_sf", "yr_built", "num_floors", "res_units", "units")
PLACE = ("geo_pid", "centroid_x", "centroid_y", "neighborhood_name", "median_hh_income", "emp_dist_m", "walkability")
ATTRIBUTES = ("land_use_code", "land_use_desc", "bldg_type", "overall_cond", "structure_class", "bedrooms", "full_baths", "half_baths", "total_rooms", "num_parking", "zip_code")
REQUIRED = ("assessed_total", "living_area", "land_sf", "yr_built", "land_use_code", "geo_pid", "prior_sales_avg")


RANK_ACCURACY = 10_000  # a bracket holds at most 8 in so many of a group's rows
BROADCAST_GROUPS = 10_000  # up to which so many short rows are broadcast


def _with_groups(df: DataFrame, by: str, groups: DataFrame) -> DataFrame:
    """``df`` with the ``groups`` of its ``by``, named _by there; broadcast if they are as few as years are."""
    few = groups.limit(BROADCAST_GROUPS + 1).toArrow()  # a list of rows would come back through Python workers
    if few.num_rows <= BROADCAST_GROUPS:
        groups = F.broadcast(df.sparkSession.createDataFrame(few, groups.schema))
    else:
        groups = durable(groups)
    return df.join(groups, F.col(by) == F.col("_by"), "left")


def quantiles(df: DataFrame, wanted: Sequence[tuple[str, float]], by: str) -> DataFrame:
    """(_by, _q_<column>, ...): exact interpolated quantiles of each group, nulls left out.

    No task holds a group's values. Sketches, merged map-side, bracket the two order statistics of a
    quantile within three times their error; a second pass counts the values beside the bracket and, by
    value, those inside it, and only these are put in order. The bracket of no more than 4 x
    ``RANK_ACCURACY`` values, where ranks are rounded too coarsely, is everything. A column of a group
    without values has a null quantile. ``df`` is read twice.
    """
    e = 3 / RANK_ACCURACY
    end = lambda c, q: F.when(F.count(c) > 4 * RANK_ACCURACY, F.percentile_approx(c, F.lit(q), F.lit(RANK_ACCURACY))).cast("double")
    brackets = df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("_by")).agg(
        *(end(c, max(q - e, 0.0)).alias(f"_lo{i}") for i, (c, q) in enumerate(wanted)), *(end(c, min(q + e, 1.0)).alias(f"_hi{i}") for i, (c, q) in enumerate(wanted))
    )
    values = df.where(F.col(by).isNotNull()).select(F.col(by).alias("_g"), *(F.col(c).cast("double").alias(f"_v{i}") for i, (c, _) in enumerate(wanted)))
    met = _with_groups(values, "_g", brackets)
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q"), F.col(f"_v{i}").alias("v"), F.col(f"_lo{i}").alias("lo"), F.col(f"_hi{i}").alias("hi")) for i, (_, q) in enumerate(wanted)))
    long = met.select("_by", F.inline(each)).where("v is not null")
    # what lies below and above a bracket is one row of a group each, so its rows are few before they are put in order
    side = F.when(F.col("v") < F.col("lo"), -1).when(F.col("v") > F.col("hi"), 1).otherwise(0)
    counts = long.groupBy("_by", "i", "q", side.alias("side"), F.when(side == 0, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("_by", "i")
    upto = F.sum("n").over(whole.orderBy("side", "v"))
    placed = counts.select("*", upto.alias("upto"), ((F.sum("n").over(whole) - 1) * F.col("q")).alias("at"))
    # the value at a rank is the only one whose run of ranks holds it
    first, last = F.floor("at"), F.ceil("at")
    holds = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
    outside = F.max(F.when((holds(first) | holds(last)) & (F.col("side") != 0), 1))
    low, high, at = F.max(F.when(holds(first), F.col("v"))), F.max(F.when(holds(last), F.col("v"))), F.first("at")
    value = F.when(outside == 1, F.raise_error(F.lit("a quantile lies outside its bracket"))).when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
    found = placed.groupBy("_by", "i").agg(value.alias("value"))
    return found.groupBy("_by").agg(*(F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"_q_{c}") for i, (c, _) in enumerate(wanted)))


def winsorized(df: DataFrame, clips: Sequence[tuple[str, float | None, float | None]], by: str = "fy") -> DataFrame:
    """Columns clipped at exact quantiles of their group; an upper quantile is of the lower-clipped column.

    Quantiles are aggregated by group and joined back, two passes where both bounds exist: a group is a
    row of the small side, never a window over its rows.
    """
    for low_pass in (True, False):
        todo = [(c, q) for c, low, high in clips if c in df.columns and (q := low if low_pass else high) is not None]
        if not todo:
            continue
        df = _with_groups(df, by, quantiles(df, todo, by))
        df = df.withColumns({c: s.clipped(F.col(c), F.col(f"_q_{c}") if low_pass else None, None if low_pass else F.col(f"_q_{c}")) for c, _ in todo})
        df = df.drop("_by", *(f"_q_{c}" for c, _ in todo))
    return df


def price_panel(state: DataFrame, radius: float = LAG_RADIUS, years: Sequence[int] = DUMMY_YEARS) -> DataFrame:
    """The hedonic input from parcel states.

    Order is meaning: residential rows first, price before clipping, clips by year before fixed ones, the
    lag on the clipped price before incomplete rows go. Dummies of years that don't occur are zero.
    """
    df = state.where(F.col("lu").isin(*s.RESIDENTIAL_USES))
    df = df.withColumn("land_use_code", s.price_band(F.col("units"))).drop("lu", "unit_category")
    have = set(df.columns)
    df = df.withColumns({c: s.number(F.col(c)) if df.schema[c].dataType.typeName() == "string" else F.col(c).cast("double") for c in NUMBERS if c in have})
    df = df.withColumn("price_per_sqft", s.price_per_sqft(F.col("assessed_total"), F.col("living_area")))
    # each pass over the years reads its input twice, the lag three times: both inputs are kept
    df = winsorized(durable(df), YEARLY_CLIPS)
    df = durable(df.withColumns({c: s.clipped(F.col(c), low, high) for c, low, high in FIXED_CLIPS if c in df.columns}))
    df = prior_within(df, "price_per_sqft", radius)
    df = df.select("*", *s.year_dummies(F.col("fy"), sorted(years)[1:]))
    dummies = [f"y_{y}" for y in sorted(years)[1:]]
    order = ["parcel_id", "fy", *dummies, "prior_sales_avg", "prior_sales_count", *PLACE, *ATTRIBUTES, *NUMBERS, "price_per_sqft"]
    return df.dropna(subset=[c for c in REQUIRED if c in df.columns]).select(*(c for c in order if c in df.columns))
