"""Scalar rules of the panel as Spark columns: identifiers, numbers from text, code normalisation, units, scores.

Null is the only missing value. None of these call Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the assessment codes.
CONDO_UNIT_USES = ("CD", "CP", "CC")
RESIDENTIAL_USES = ("R1", "R2", "R3", "R4", "A", "CD", "CP", "CC", "CM", "RC", "RL")
CATEGORY_OF_USE = {"R1": "1 Unit", "R2": "2 Units", "R3": "3 Units", "R4": "4-6 Units"}
CONDITION_NAMES = {"EX": "E", "E": "E", "VG": "VG", "G": "G", "AVG": "A", "A": "A", "F": "F", "P": "P", "VP": "VP", "US": "US", "U": "US"}
SQFT_PER_UNIT = 850.0
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def null_tokens(c: Column) -> Column:
    """Text that stands for a missing value becomes null."""
    return F.when(~c.isin(*MISSING_TOKENS), c)


def zero_filled(c: Column, width: int) -> Column:
    """Zeros on the left up to ``width``; longer values stay whole (``lpad`` would cut them)."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def normalize_pid(c: Column) -> Column:
    """Digits only, at least ten of them; null gives ten zeros."""
    return zero_filled(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[^0-9]", ""), 10)


def base_pid(pid: Column) -> Column:
    """The parcel of an account: its first seven characters and three zeros."""
    return F.concat(F.substring(pid, 1, 7), F.lit("000"))


def number(c: Column) -> Column:
    """Text as double; null if it isn't a plain number (Java would read "10d")."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def clean_numeric(c: Column) -> Column:
    """Money text as double: commas and dollar signs go."""
    return number(F.translate(c.cast("string"), ",$", ""))


def clean_year(c: Column) -> Column:
    """Years from text; the literal 20198 is 2019, other five-digit years lose a digit if that gives 1600 to 2030."""
    y = clean_numeric(c)
    cut = F.floor(y / 10).cast("double")
    return F.when(y == 20198, F.lit(2019.0)).when(y.between(10000, 99999) & cut.between(1600, 2030), cut).otherwise(y)


def normalize_land_use(c: Column) -> Column:
    """Upper case, what stands before the first hyphen."""
    return F.trim(F.element_at(F.split(F.upper(F.trim(c)), r"\s*-\s*", 2), 1))


def mapped(c: Column, names: dict[str, str]) -> Column:
    """``names[c]``, else null."""
    return reduce(lambda acc, kv: acc.when(c == kv[0], F.lit(kv[1])), list(names.items())[1:], F.when(c == next(iter(names)), F.lit(next(iter(names.values())))))


def normalize_condition(c: Column) -> Column:
    return mapped(normalize_land_use(c), CONDITION_NAMES)


def categorize_units(u: Column) -> Column:
    """Unit band; fractions between the bands fall to the last one, null stays null."""
    return (
        F.when(u.isNull(), F.lit(None).cast("string"))
        .when(u <= 0, "No Development")
        .when(u == 1, "1 Unit")
        .when(u == 2, "2 Units")
        .when(u == 3, "3 Units")
        .when(u.between(4, 6), "4-6 Units")
        .when(u.between(7, 20), "7-20 Units")
        .otherwise("21+ Units")
    )


def derived_units(use: Column, res_units: Column, unit_rows: Column, living_area: Column) -> Column:
    """Units of a parcel-year: by code, then condo unit accounts, recorded units, and floor area."""
    by_area = F.ceil(living_area / SQFT_PER_UNIT).cast("double")
    by_use = (
        F.when(use == "RL", 0.0)
        .when(use.isin("RC", "A"), by_area)
        .when(use == "R1", 1.0)
        .when(use == "R2", 2.0)
        .when(use == "R3", 3.0)
        .when(use == "CM", F.coalesce(res_units, unit_rows.cast("double")))
    )
    return F.coalesce(by_use, F.when(res_units > 0, res_units), by_area)


def unit_category(use: Column, units: Column) -> Column:
    return F.coalesce(mapped(use, CATEGORY_OF_USE), categorize_units(units))


def price_band(units: Column) -> Column:
    band = categorize_units(units)
    return F.coalesce(F.when(band == "No Development", "Land").otherwise(band), F.lit("Other"))


def year_dummies(fy: Column, years: Iterable[int], prefix: str = "y_") -> list[Column]:
    """0/1 columns for ``years``; the caller leaves out the base year."""
    return [(fy == y).cast("int").alias(f"{prefix}{y}") for y in years]


def price_per_sqft(total: Column, area: Column) -> Column:
    return F.when(area > 0, total / area)


def clipped(c: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Within the bounds; null stays null, a null bound doesn't bind."""
    out = c
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(c.isNotNull(), out)


def log_positive(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def decay_score(distance: Column, longest: float, exponent: float = 1.0) -> Column:
    """100 at no distance, falling to 0 at ``longest`` and beyond; null without a distance."""
    score = 100.0 * (1.0 - F.pow(F.greatest(distance / longest, F.lit(0.0)), F.lit(float(exponent))))
    return F.when(distance.isNotNull(), clipped(score, 0.0, 100.0))


def mean_known(columns: Sequence[Column]) -> Column:
    """Mean of those that aren't null."""
    total = reduce(Column.__add__, (F.coalesce(c, F.lit(0.0)) for c in columns))
    known = reduce(Column.__add__, (c.isNotNull().cast("int") for c in columns))
    return F.when(known > 0, total / known)


def nearest_distance(x: Column, y: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Distance to the nearest of a few fixed points."""
    away = [F.sqrt((x - px) * (x - px) + (y - py) * (y - py)) for px, py in points]
    return away[0] if len(away) == 1 else F.when(x.isNotNull() & y.isNotNull(), F.least(*away))


def survey_vintage(fy: Column, first: int = 2016, last: int = 2025) -> Column:
    """The survey year that belongs to a fiscal year: two before."""
    return F.when(fy.between(first, last), fy - 2)


def net_new(units: Column, before: Column) -> Column:
    return clipped(units - before, 0.0)


def outcome(now: Column, before: Column, prior_use: Column) -> Column:
    """What was developed: the present category where it changed on residential land."""
    none = F.lit("No Development")
    changed = F.coalesce(now, none) != F.coalesce(before, none)
    return F.when(changed & F.coalesce(prior_use.isin(*RESIDENTIAL_USES), F.lit(False)), F.coalesce(now, none)).otherwise(none)


def account_rank(use: Column) -> Column:
    """Which account stands for a parcel: condominium masters first, unit accounts last."""
    return F.when(F.coalesce(use == "CM", F.lit(False)), -1).when(F.coalesce(use.isin(*CONDO_UNIT_USES), F.lit(False)), 2).otherwise(0)


def choose_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate that is there, whatever its case."""
    known = {c.lower(): c for c in columns}
    return next((known[c.lower()] for c in candidates if c.lower() in known), None)
