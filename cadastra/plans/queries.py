"""Registered queries of the panel operators and the SQL that gives the same rows.

The driver's tables have no parcels, so each query first gives them a panel's shape: an account is a
line item, its parcel the part, its fiscal year the ship year; points come from the embeddings.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions import scalars as s
from cadastra.functions.crs import MASSACHUSETTS
from cadastra.operators import choices, enrich, graph, logit, panel, prices, spatial, stats
from cadastra.sources import files

YEARS = tuple(range(1995, 2002))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Identifiers, numbers and codes.


@query("""
WITH raw AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN c_name || '-12345' ELSE c_name END AS raw FROM customer),
d AS (SELECT c_custkey, regexp_replace(coalesce(raw, ''), '[^0-9]', '', 'g') AS d FROM raw),
p AS (SELECT c_custkey, CASE WHEN length(d) < 10 THEN lpad(d, 10, '0') ELSE d END AS pid FROM d)
SELECT c_custkey, pid, substr(pid, 1, 7) || '000' AS base_pid FROM p
""")
def normalize_pid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, F.concat("c_name", F.lit("-12345"))).otherwise(F.col("c_name"))
    pid = s.normalize_pid(raw)
    return table(spark, sf_dir, "customer").select("c_custkey", pid.alias("pid"), s.base_pid(pid).alias("base_pid"))


_MONEY = """CASE o_orderkey % 7 WHEN 0 THEN '$' || (o_orderkey % 900 + 100) || ',' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || '.50'
  WHEN 1 THEN ' ' || (o_orderkey % 77) || ' ' WHEN 2 THEN (o_orderkey % 10) || 'd' WHEN 3 THEN 'nan' WHEN 4 THEN '' WHEN 5 THEN '1e' || (o_orderkey % 4) ELSE NULL END"""


@query(f"""
WITH raw AS (SELECT o_orderkey, trim(translate({_MONEY}, ',$', '')) AS t FROM orders)
SELECT o_orderkey, CASE WHEN regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(t AS DOUBLE) END AS amount FROM raw
""")
def clean_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    m = k % 7
    raw = (
        F.when(m == 0, F.concat(F.lit("$"), text(k % 900 + 100), F.lit(","), F.lpad(text(k % 1000), 3, "0"), F.lit(".50")))
        .when(m == 1, F.concat(F.lit(" "), text(k % 77), F.lit(" ")))
        .when(m == 2, F.concat(text(k % 10), F.lit("d")))
        .when(m == 3, F.lit("nan"))
        .when(m == 4, F.lit(""))
        .when(m == 5, F.concat(F.lit("1e"), text(k % 4)))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", s.clean_numeric(raw).alias("amount"))


@query("""
WITH y AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 20198 WHEN 1 THEN (19000 + o_orderkey % 900) WHEN 2 THEN 1900 + o_orderkey % 120 WHEN 3 THEN 99999 ELSE NULL END::DOUBLE AS y FROM orders)
SELECT o_orderkey, CASE WHEN y = 20198 THEN 2019.0 WHEN y BETWEEN 10000 AND 99999 AND floor(y / 10) BETWEEN 1600 AND 2030 THEN floor(y / 10) ELSE y END AS year FROM y
""")
def clean_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, F.lit("20198")).when(k % 5 == 1, (19000 + k % 900).cast("string")).when(k % 5 == 2, (1900 + k % 120).cast("string")).when(k % 5 == 3, F.lit("99,999"))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.clean_year(raw).alias("year"))


@query("""
WITH c AS (SELECT o_orderkey, o_orderpriority, CASE o_orderkey % 8 WHEN 0 THEN 'EX - Excellent' WHEN 1 THEN 'a' WHEN 2 THEN 'AVG - Default' WHEN 3 THEN 'ZZ' WHEN 4 THEN NULL WHEN 5 THEN ' vg ' WHEN 6 THEN 'U' ELSE 'us-Unsound' END AS raw FROM orders),
h AS (SELECT o_orderkey, trim(regexp_split_to_array(upper(trim(o_orderpriority)), '\\s*-\\s*')[1]) AS land_use, trim(regexp_split_to_array(upper(trim(raw)), '\\s*-\\s*')[1]) AS cond FROM c)
SELECT o_orderkey, land_use, CASE cond WHEN 'EX' THEN 'E' WHEN 'E' THEN 'E' WHEN 'VG' THEN 'VG' WHEN 'G' THEN 'G' WHEN 'AVG' THEN 'A' WHEN 'A' THEN 'A' WHEN 'F' THEN 'F' WHEN 'P' THEN 'P' WHEN 'VP' THEN 'VP' WHEN 'US' THEN 'US' WHEN 'U' THEN 'US' END AS condition FROM h
""")
def normalize_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 8
    names = ("EX - Excellent", "a", "AVG - Default", "ZZ", None, " vg ", "U", "us-Unsound")
    raw = reduce(lambda acc, i: acc.when(k == i, F.lit(names[i])), range(1, 8), F.when(k == 0, F.lit(names[0])))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.normalize_land_use(F.col("o_orderpriority")).alias("land_use"), s.normalize_condition(raw).alias("condition"))


_BAND = "CASE WHEN {u} IS NULL THEN NULL WHEN {u} <= 0 THEN 'No Development' WHEN {u} = 1 THEN '1 Unit' WHEN {u} = 2 THEN '2 Units' WHEN {u} = 3 THEN '3 Units' WHEN {u} BETWEEN 4 AND 6 THEN '4-6 Units' WHEN {u} BETWEEN 7 AND 20 THEN '7-20 Units' ELSE '21+ Units' END"


@query(f"""
WITH u AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size / 2.0 WHEN 2 THEN p_size - 3.0 ELSE CASE WHEN p_partkey % 12 = 3 THEN NULL ELSE p_size % 5 END END AS u FROM part)
SELECT p_partkey, {_BAND.format(u="u")} AS category, coalesce(CASE WHEN u <= 0 THEN 'Land' ELSE {_BAND.format(u="u")} END, 'Other') AS band FROM u
""")
def categorize_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    u = F.when(k % 4 == 0, size).when(k % 4 == 1, size / 2).when(k % 4 == 2, size - 3).when(k % 12 != 3, size % 5)
    return table(spark, sf_dir, "part").select("p_partkey", s.categorize_units(u).alias("category"), s.price_band(u).alias("band"))


@query("SELECT o_orderkey, " + ", ".join(f"(year(o_orderdate) = {y})::INTEGER AS y_{y}" for y in YEARS[1:]) + " FROM orders")
def year_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("fy"))
    return panel.with_year_dummies(df, YEARS).drop("fy")


# The panel.

_ACCOUNT = ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")

_PANEL_SQL = """
panel AS (
  SELECT lpad(l_orderkey::VARCHAR, 10, '0') || '-' || l_linenumber || '-' || lpad(l_suppkey::VARCHAR, 6, '0') || '-' || lpad(round(l_extendedprice * 100)::BIGINT::VARCHAR, 12, '0') AS parcel_id,
    l_partkey AS geo_pid, year(l_shipdate)::INTEGER AS fy,
    CASE l_returnflag || l_linestatus || (l_linenumber % 3) WHEN 'AF0' THEN 'R1' WHEN 'AF1' THEN 'r4 - four' WHEN 'AF2' THEN 'CM' WHEN 'NF0' THEN 'CD' WHEN 'NF1' THEN 'A' WHEN 'NF2' THEN 'RL'
      WHEN 'NO0' THEN 'R2' WHEN 'NO1' THEN 'CD' WHEN 'NO2' THEN 'CP' WHEN 'RF0' THEN 'R3' WHEN 'RF1' THEN 'RC' ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'E' ELSE NULL END END AS land_use_code,
    CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE (l_linenumber % 9)::DOUBLE END AS res_units,
    l_extendedprice AS assessed_total, CASE WHEN l_quantity < 4 THEN NULL WHEN l_quantity < 9 THEN 0 ELSE l_quantity * 100 END AS living_area, l_quantity * 120 AS gross_area,
    round(l_extendedprice * 0.4, 2) AS assessed_land, round(l_extendedprice * 0.6, 2) AS assessed_bldg, l_quantity * 60 + 200 AS land_sf, (1880 + l_suppkey % 160)::DOUBLE AS yr_built, (1 + l_linenumber % 4)::DOUBLE AS num_floors,
    ((l_partkey % 50) * 100)::DOUBLE AS centroid_x, (((l_partkey - l_partkey % 50) / 50)::BIGINT * 100)::DOUBLE AS centroid_y,
    'N' || (l_partkey % 6) AS neighborhood_name
  FROM lineitem
)"""


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n, sup, price, qty = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity"))
    part = F.col("l_partkey")
    kind = F.concat("l_returnflag", "l_linestatus", (n % 3).cast("string"))
    codes = {"AF0": "R1", "AF1": "r4 - four", "AF2": "CM", "NF0": "CD", "NF1": "A", "NF2": "RL", "NO0": "R2", "NO1": "CD", "NO2": "CP", "RF0": "R3", "RF1": "RC"}
    cents = F.lpad(F.round(price * 100).cast("long").cast("string"), 12, "0")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.lpad(key.cast("string"), 10, "0"), n.cast("string"), F.lpad(sup.cast("string"), 6, "0"), cents).alias("parcel_id"),
        part.alias("geo_pid"),
        F.year("l_shipdate").alias("fy"),
        F.when(kind.isin(*codes), s.mapped(kind, codes)).otherwise(F.when(sup % 2 == 0, F.lit("E"))).alias("land_use_code"),
        F.when(sup % 3 != 0, (n % 9).cast("double")).alias("res_units"),
        price.alias("assessed_total"),
        F.when(qty >= 9, qty * 100).when(qty >= 4, 0.0).alias("living_area"),
        (qty * 120).alias("gross_area"),
        F.round(price * 0.4, 2).alias("assessed_land"),
        F.round(price * 0.6, 2).alias("assessed_bldg"),
        (qty * 60 + 200).alias("land_sf"),
        (1880.0 + sup % 160).alias("yr_built"),
        (1.0 + n % 4).alias("num_floors"),
        ((part % 50) * 100.0).alias("centroid_x"),
        (F.floor(part / 50) * 100.0).alias("centroid_y"),
        F.concat(F.lit("N"), (part % 6).cast("string")).alias("neighborhood_name"),
    )


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.parcel_state(accounts(spark, sf_dir))


_STATE_SQL = (
    _PANEL_SQL
    + """,
coded AS (SELECT *, trim(regexp_split_to_array(upper(trim(land_use_code)), '\\s*-\\s*')[1]) AS u FROM panel WHERE geo_pid IS NOT NULL),
marked AS (SELECT *, coalesce(u IN ('CD', 'CP', 'CC'), false) AS unit, coalesce(u IN ('CD', 'CP', 'CC'), false)::INTEGER * 2 - coalesce(u = 'CM', false)::INTEGER AS rnk FROM coded),
collapsed AS (
  SELECT geo_pid, fy, arg_min(struct_pack(u := u, r := res_units, p := parcel_id, x := centroid_x, y := centroid_y, f := num_floors, h := neighborhood_name), (rnk, parcel_id)) AS rep,
    sum(living_area) AS living_area, sum(gross_area) AS gross_area, sum(assessed_total) AS assessed_total, sum(assessed_land) AS assessed_land, sum(assessed_bldg) AS assessed_bldg, sum(land_sf) AS land_sf,
    max(yr_built) AS yr_built, count(*) FILTER (unit) AS n_unit_rows
  FROM marked GROUP BY geo_pid, fy
),
named AS (SELECT *, CASE WHEN rep.u IN ('CD', 'CP', 'CC') THEN 'CM' ELSE rep.u END AS lu, rep.r AS res_units, rep.p AS parcel_id, rep.x AS centroid_x, rep.y AS centroid_y, rep.f AS num_floors, rep.h AS neighborhood_name FROM collapsed),
counted AS (SELECT *, coalesce(CASE WHEN lu = 'RL' THEN 0.0 WHEN lu IN ('RC', 'A') THEN ceil(living_area / 850.0) WHEN lu = 'R1' THEN 1.0 WHEN lu = 'R2' THEN 2.0 WHEN lu = 'R3' THEN 3.0 WHEN lu = 'CM' THEN coalesce(res_units, n_unit_rows::DOUBLE) END,
  CASE WHEN res_units > 0 THEN res_units END, ceil(living_area / 850.0))::DOUBLE AS units FROM named),
state AS (SELECT *, coalesce(CASE lu WHEN 'R1' THEN '1 Unit' WHEN 'R2' THEN '2 Units' WHEN 'R3' THEN '3 Units' WHEN 'R4' THEN '4-6 Units' END, """
    + _BAND.format(u="units")
    + """) AS unit_category FROM counted)"""
)


@query(
    "WITH "
    + _STATE_SQL
    + """
SELECT geo_pid, fy, lu, res_units, parcel_id, round(living_area, 4) AS living_area, round(assessed_total, 4) AS assessed_total, yr_built, n_unit_rows, units, unit_category FROM state
"""
)
def parcel_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).select(
        "geo_pid", "fy", "lu", "res_units", "parcel_id", F.round("living_area", 4).alias("living_area"), F.round("assessed_total", 4).alias("assessed_total"), "yr_built", "n_unit_rows", "units", "unit_category"
    )


@query("""
WITH raw AS (SELECT o_orderkey, year(o_orderdate)::INTEGER AS fy, o_orderpriority, o_orderstatus, (o_orderkey % 900)::VARCHAR AS price FROM orders)
SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS parcel_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS land_use_code,
  CASE WHEN fy >= 1998 THEN o_orderstatus END AS land_use_desc, (price || '500')::DOUBLE AS assessed_total,
  CASE WHEN o_orderstatus = 'F' THEN 'F' WHEN o_orderstatus = 'P' THEN 'P' END AS overall_cond, fy FROM raw
""")
def harmonize_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").withColumn("fy", F.year("o_orderdate"))
    price = F.concat(F.lit("$"), (F.col("o_orderkey") % 900).cast("string"), F.lit(",500"))
    use = F.when(F.col("o_orderkey") % 11 == 0, F.lit("NA")).otherwise(F.col("o_orderpriority"))
    pid = F.col("o_orderkey").cast("string")
    old = raw.where("fy < 1998").select(pid.alias(" PID"), use.alias("LU "), price.alias("AV_TOTAL"), F.col("o_orderstatus").alias("R_OVRALL_CND"), "fy")
    new = raw.where("fy >= 1998").select(pid.alias("PID"), use.alias("LU"), F.col("o_orderstatus").alias("LU_DESC"), price.alias(" TOTAL_VALUE "), F.col("o_orderstatus").alias("OVERALL_COND"), "fy")
    years = [panel.harmonized(old, F.col("fy"), False), panel.harmonized(new, F.col("fy"), True)]
    return panel.stacked(years).select("parcel_id", "land_use_code", "land_use_desc", "assessed_total", "overall_cond", "fy")


@query("""
WITH shapes AS (SELECT lpad(p_partkey::VARCHAR, 10, '0') AS pid, y AS fy, p_retailprice AS cx FROM part, range(1995, 2002) t(y) WHERE p_partkey % 3 = 0 OR p_partkey % 1000 = 0),
a AS (SELECT lpad(l_partkey::VARCHAR, 10, '0') AS parcel_id, year(l_shipdate) AS fy FROM lineitem),
j AS (SELECT a.*, coalesce(s1.pid, s2.pid) AS geo_pid, CASE WHEN s1.pid IS NOT NULL THEN s1.cx ELSE s2.cx END AS cx FROM a LEFT JOIN shapes s1 ON s1.pid = a.parcel_id AND s1.fy = a.fy LEFT JOIN shapes s2 ON s2.pid = substr(a.parcel_id, 1, 7) || '000' AND s2.fy = a.fy)
SELECT geo_pid, fy::INTEGER AS fy, count(*) AS n, min(cx) AS cx FROM j GROUP BY ALL
""")
def key_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pid = F.lpad(F.col("p_partkey").cast("string"), 10, "0")
    shapes = table(spark, sf_dir, "part").where("p_partkey % 3 = 0 OR p_partkey % 1000 = 0").select(pid.alias("geo_pid"), F.col("p_retailprice").alias("centroid_x"), F.lit(0.0).alias("centroid_y"), F.explode(F.array(*map(F.lit, YEARS))).alias("fy"))
    rows = table(spark, sf_dir, "lineitem").select(F.lpad(F.col("l_partkey").cast("string"), 10, "0").alias("parcel_id"), F.year("l_shipdate").alias("fy"))
    return panel.with_geo_key(rows, shapes).groupBy("geo_pid", "fy").agg(F.count(F.lit(1)).alias("n"), F.min("centroid_x").alias("cx"))


@query("""
WITH p AS (SELECT l_partkey AS geo_pid, l_orderkey AS a, year(l_shipdate) AS fy, l_linenumber AS b, l_suppkey AS c, l_extendedprice AS d, CASE WHEN l_quantity < 10 THEN NULL ELSE l_quantity END AS x, l_discount AS y FROM lineitem),
f AS (SELECT geo_pid, arg_min(x, (a, fy, b, c, d)) AS centroid_x, arg_min(y, (a, fy, b, c, d)) AS centroid_y FROM p WHERE x IS NOT NULL GROUP BY geo_pid)
SELECT p.geo_pid, p.fy::INTEGER AS fy, count(*) AS n, any_value(centroid_x) AS centroid_x, any_value(centroid_y) AS centroid_y FROM p LEFT JOIN f USING (geo_pid) GROUP BY ALL
""")
def first_centroid_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("geo_pid"), F.col("l_orderkey").alias("parcel_id"), F.year("l_shipdate").alias("fy"), "l_linenumber", "l_suppkey", "l_extendedprice", F.when(F.col("l_quantity") >= 10, F.col("l_quantity")).alias("centroid_x"), F.col("l_discount").alias("centroid_y")
    )
    first = panel.first_points(rows, order=("parcel_id", "fy", "l_linenumber", "l_suppkey", "l_extendedprice"))
    back = enrich.spread_back(rows, first, ["geo_pid"], ["centroid_x", "centroid_y"])
    return back.groupBy("geo_pid", "fy", "centroid_x", "centroid_y").agg(F.count(F.lit(1)).alias("n"))


_CLIP_SQL = """
lo AS (SELECT fy, quantile_cont(assessed_total, 0.02) AS a, quantile_cont(price_per_sqft, 0.01) AS p FROM priced GROUP BY fy),
low AS (SELECT r.* REPLACE (CASE WHEN assessed_total IS NOT NULL THEN greatest(assessed_total, lo.a) END AS assessed_total, CASE WHEN price_per_sqft IS NOT NULL THEN greatest(price_per_sqft, lo.p) END AS price_per_sqft) FROM priced r JOIN lo USING (fy)),
hi AS (SELECT fy, quantile_cont(assessed_total, 0.98) AS a, quantile_cont(land_sf, 0.99) AS l, quantile_cont(gross_area, 0.95) AS g, quantile_cont(living_area, 0.95) AS v, quantile_cont(price_per_sqft, 0.99) AS p FROM low GROUP BY fy),
clipped AS (SELECT r.* REPLACE (CASE WHEN assessed_total IS NOT NULL THEN least(assessed_total, hi.a) END AS assessed_total, CASE WHEN land_sf IS NOT NULL THEN greatest(500.0, least(land_sf, hi.l)) END AS land_sf,
  CASE WHEN gross_area IS NOT NULL THEN greatest(500.0, least(gross_area, hi.g)) END AS gross_area, CASE WHEN living_area IS NOT NULL THEN greatest(500.0, least(living_area, hi.v)) END AS living_area,
  CASE WHEN price_per_sqft IS NOT NULL THEN least(price_per_sqft, hi.p) END AS price_per_sqft) FROM low r JOIN hi USING (fy))"""


@query(
    """
WITH priced AS (SELECT l_orderkey, year(l_shipdate)::INTEGER AS fy, l_extendedprice AS assessed_total, CASE WHEN l_quantity < 4 THEN NULL ELSE l_quantity * 100 END AS living_area, l_quantity * 120 AS gross_area, l_quantity * 60 + 200 AS land_sf, CASE WHEN l_quantity >= 4 THEN l_extendedprice / (l_quantity * 100) END AS price_per_sqft FROM lineitem),"""
    + _CLIP_SQL
    + """
SELECT l_orderkey, fy, round(assessed_total, 6) AS assessed_total, round(living_area, 6) AS living_area, round(gross_area, 6) AS gross_area, round(land_sf, 6) AS land_sf, round(price_per_sqft, 9) AS price_per_sqft FROM clipped
"""
)
def winsorize_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    qty = F.col("l_quantity")
    area = F.when(qty >= 4, qty * 100)
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.year("l_shipdate").alias("fy"), F.col("l_extendedprice").alias("assessed_total"), area.alias("living_area"), (qty * 120).alias("gross_area"), (qty * 60 + 200).alias("land_sf"), s.price_per_sqft(F.col("l_extendedprice"), area).alias("price_per_sqft")
    )
    df = prices.winsorized(df, prices.YEARLY_CLIPS)
    df = df.withColumns({c: s.clipped(F.col(c), low, high) for c, low, high in prices.FIXED_CLIPS if c in df.columns})
    return df.select("l_orderkey", "fy", *(F.round(c, 6).alias(c) for c in ("assessed_total", "living_area", "gross_area", "land_sf")), F.round("price_per_sqft", 9).alias("price_per_sqft"))


_PRICED_SQL = (
    _STATE_SQL
    + """,
priced AS (SELECT geo_pid, fy, parcel_id, centroid_x, centroid_y, neighborhood_name, coalesce(CASE WHEN units <= 0 THEN 'Land' ELSE """
    + _BAND.format(u="units")
    + """ END, 'Other') AS land_use_code, assessed_total, living_area, gross_area, land_sf, least(yr_built, 2030::DOUBLE) AS yr_built, greatest(num_floors, 1::DOUBLE) AS num_floors, units, CASE WHEN living_area > 0 THEN assessed_total / living_area END AS price_per_sqft
  FROM state WHERE lu IN ('R1', 'R2', 'R3', 'R4', 'A', 'CD', 'CP', 'CC', 'CM', 'RC', 'RL')),"""
    + _CLIP_SQL
    + """,
spots AS (SELECT centroid_x AS x, centroid_y AS y, fy, sum(price_per_sqft) AS s, count(*) AS n FROM clipped WHERE price_per_sqft IS NOT NULL GROUP BY ALL),
lag AS (SELECT c.geo_pid, c.fy, sum(s.s) / sum(s.n) AS prior_sales_avg, sum(s.n)::BIGINT AS prior_sales_count FROM clipped c JOIN spots s ON c.price_per_sqft IS NOT NULL AND s.fy < c.fy AND s.x BETWEEN c.centroid_x - 300 AND c.centroid_x + 300 AND s.y BETWEEN c.centroid_y - 300 AND c.centroid_y + 300
  AND (s.x - c.centroid_x) * (s.x - c.centroid_x) + (s.y - c.centroid_y) * (s.y - c.centroid_y) <= 90000 GROUP BY ALL),
input AS (SELECT c.*, prior_sales_avg, prior_sales_count FROM clipped c JOIN lag USING (geo_pid, fy) WHERE assessed_total IS NOT NULL AND living_area IS NOT NULL AND land_sf IS NOT NULL AND yr_built IS NOT NULL AND prior_sales_avg IS NOT NULL)"""
)


#: Prices are short decimals that often lie half way between two rounded ones, where the engines differ; this far from them none does.
_OFF_TIES = 2.7182818e-7


def _price_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.price_panel(_state(spark, sf_dir), years=YEARS)


@query(
    "WITH "
    + _PRICED_SQL
    + """
SELECT geo_pid, fy, land_use_code, round(price_per_sqft + 2.7182818e-7, 6) AS price_per_sqft, round(prior_sales_avg + 2.7182818e-7, 6) AS prior_sales_avg, prior_sales_count, yr_built, num_floors, """
    + ", ".join(f"(fy = {y})::INTEGER AS y_{y}" for y in YEARS[1:])
    + " FROM input"
)
def price_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _price_input(spark, sf_dir).select(
        "geo_pid", "fy", "land_use_code", F.round(F.col("price_per_sqft") + _OFF_TIES, 6).alias("price_per_sqft"), F.round(F.col("prior_sales_avg") + _OFF_TIES, 6).alias("prior_sales_avg"), "prior_sales_count", "yr_built", "num_floors", *(f"y_{y}" for y in YEARS[1:])
    )


# Spatial joins.

_POINTS_SQL = "pts AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS v, label::INTEGER AS fy FROM embeddings)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("v"), F.col("label").cast("int").alias("fy"))


@query(f"""
WITH {_POINTS_SQL}, holed AS (SELECT id, fy, CASE WHEN id % 11 <> 3 THEN x END AS x, CASE WHEN id % 13 <> 5 THEN y END AS y, CASE WHEN id % 7 <> 2 THEN v END AS v FROM pts),
valid AS (SELECT * FROM holed WHERE v IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL),
seen AS (SELECT a.id, count(*) AS n, avg(b.v) AS mean FROM valid a JOIN valid b ON b.fy < a.fy AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.02 * 0.02 GROUP BY a.id)
SELECT id, fy, coalesce(n, 0) AS n, round(mean, 6) AS mean FROM holed LEFT JOIN seen USING (id)
""")
def prior_radius_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points without a value or a coordinate are among them: they are no neighbours and see none."""
    at = lambda c, n, r: F.when(F.col("id") % n != r, F.col(c))
    holed = _points(spark, sf_dir).select("id", "fy", at("x", 11, 3).alias("x"), at("y", 13, 5).alias("y"), at("v", 7, 2).alias("v"))
    out = spatial.prior_within(holed, "v", 0.02, x="x", y="y", mean_as="mean", count_as="n")
    return out.select("id", "fy", "n", F.round("mean", 6).alias("mean"))


@query(f"""
WITH {_POINTS_SQL}
SELECT a.id, count(b.id) AS dev_activity_600m, round(coalesce(sum(b.v), 0.0), 6) AS dev_units_600m FROM pts a LEFT JOIN pts b ON b.fy >= 5 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.03 * 0.03 WHERE a.fy < 5 GROUP BY a.id
""")
def radius_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    out = spatial.events_within(p.where("fy < 5"), p.where("fy >= 5"), "v", 0.03, "x", "y", "x", "y")
    return out.select("id", "dev_activity_600m", F.round("dev_units_600m", 6).alias("dev_units_600m"))


_N, _SCALE, _ORIGIN = MASSACHUSETTS.cone
_ECC = MASSACHUSETTS.eccentricity
_CENTERS = [MASSACHUSETTS.point(lon, lat) for _, lat, lon in enrich.EMPLOYMENT_CENTERS]


@query(f"""
WITH {_POINTS_SQL}, ll AS (SELECT id, radians(-71.07 + x / 10) AS lon, radians(42.34 + y / 10) AS lat FROM pts),
t AS (SELECT id, lon, tan(pi() / 4 - lat / 2) / pow((1 - {_ECC!r}::DOUBLE * sin(lat)) / (1 + {_ECC!r}::DOUBLE * sin(lat)), {_ECC / 2!r}::DOUBLE) AS t FROM ll),
r AS (SELECT id, {MASSACHUSETTS.axis!r}::DOUBLE * {_SCALE!r}::DOUBLE * pow(t, {_N!r}::DOUBLE) AS r, {_N!r}::DOUBLE * (lon - radians(-71.5)) AS th FROM t),
xy AS (SELECT id, 200000.0::DOUBLE + r * sin(th) AS x, 750000.0::DOUBLE + {_ORIGIN!r}::DOUBLE - r * cos(th) AS y FROM r)
SELECT id, round(x, 3) AS x, round(y, 3) AS y, round(least({", ".join(f"sqrt((x - {a!r}::DOUBLE) * (x - {a!r}::DOUBLE) + (y - {b!r}::DOUBLE) * (y - {b!r}::DOUBLE))" for a, b in _CENTERS)}), 3) AS emp_dist_m FROM xy
""")
def nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = MASSACHUSETTS.columns(-71.07 + F.col("x") / 10, 42.34 + F.col("y") / 10)
    p = _points(spark, sf_dir).select(F.col("id").alias("geo_pid"), F.lit("a").alias("parcel_id"), "fy", x.alias("centroid_x"), y.alias("centroid_y"))
    out = enrich.with_employment_distance(p)
    return out.select(F.col("geo_pid").alias("id"), F.round("centroid_x", 3).alias("x"), F.round("centroid_y", 3).alias("y"), F.round("emp_dist_m", 3).alias("emp_dist_m"))


#: Concave, with a hole, in two parts; the second overlaps the first.
_AREAS = (
    (1, None, None, [[[[-0.3, -0.3], [0.3, -0.3], [0.3, 0.3], [0.0, 0.05], [-0.3, 0.3]], [[-0.1, -0.2], [0.1, -0.2], [0.1, -0.1], [-0.1, -0.1]]]]),
    (2, "Two", 7, [[[[-0.2, -0.1], [0.2, -0.1], [0.2, 0.2], [-0.2, 0.2]]]]),
    (3, "Three", 8, [[[[-0.4, -0.4], [0.0, -0.4], [0.0, 0.4], [-0.4, 0.4]]], [[[0.2, -0.4], [0.4, -0.4], [0.4, 0.0]]]]),
)


def _areas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_AREAS, f"ordinal int, name string, neighborhood_id int, geom {spatial.GEOMETRY_TYPE}")


def _edges_sql() -> str:
    rows = []
    for i, name, nid, shape in _AREAS:
        for part in shape:
            for ring in part:
                for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
                    rows.append(f"({i}, {'NULL' if name is None else repr(name)}, {'NULL' if nid is None else nid}, {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)")
    return f"edges(ordinal, name, nid, x1, y1, x2, y2) AS (VALUES {', '.join(rows)})"


_INSIDE_SQL = f"""{_POINTS_SQL}, {_edges_sql()},
inside AS (SELECT id, ordinal, any_value(name) AS name, any_value(nid) AS nid FROM pts JOIN edges ON (y1 > y) <> (y2 > y) AND x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x GROUP BY id, ordinal HAVING count(*) % 2 = 1)"""


@query(f"WITH {_INSIDE_SQL} SELECT id, ordinal::INTEGER AS ordinal FROM inside")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.pip_join(_points(spark, sf_dir), _areas(spark), "id", "ordinal")


@query(f"""
WITH {_INSIDE_SQL}, named AS (SELECT id, arg_min(name, ordinal) FILTER (name IS NOT NULL) AS neighborhood_name, (arg_min(nid, ordinal) FILTER (nid IS NOT NULL))::INTEGER AS neighborhood_id FROM inside GROUP BY id)
SELECT id, neighborhood_name, neighborhood_id FROM pts LEFT JOIN named USING (id)
""")
def neighborhood_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).select(F.col("id").alias("geo_pid"), F.lit("a").alias("parcel_id"), "fy", F.col("x").alias("centroid_x"), F.col("y").alias("centroid_y"))
    out = enrich.with_neighborhood(p, _areas(spark), crs=None)
    return out.select(F.col("geo_pid").alias("id"), "neighborhood_name", "neighborhood_id")


@query(f"""
WITH {_INSIDE_SQL}, z AS (SELECT id, arg_min(struct_pack(n := name, f := nid::DOUBLE), ordinal) AS r FROM inside GROUP BY id)
SELECT id, r.n AS zoning_use, r.f AS max_far FROM pts LEFT JOIN z USING (id)
""")
def zoning_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).select(F.col("id").alias("geo_pid"), F.lit("a").alias("parcel_id"), "fy", F.col("x").alias("centroid_x"), F.col("y").alias("centroid_y"))
    areas = _areas(spark).select("ordinal", "geom", F.col("name").alias("Zoning_Sub"), F.col("neighborhood_id").cast("string").alias("Max_FAR"), F.lit("35").alias("Max_Height"), F.lit("x").alias("Max_Number"))
    out = enrich.with_zoning(p, areas, crs=None)
    return out.select(F.col("geo_pid").alias("id"), "zoning_use", "max_far")


@query(f"""
WITH {_INSIDE_SQL}, inc AS (SELECT id, (arg_min(ordinal, ordinal) FILTER (ordinal >= 1)) AS o FROM inside GROUP BY id)
SELECT id, 2016 + fy AS fy, CASE WHEN o IS NULL THEN NULL ELSE (1000.0 * o + 2014 + fy) END::DOUBLE AS median_hh_income FROM pts LEFT JOIN inc USING (id)
""")
def income_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).select(F.col("id").alias("geo_pid"), F.lit("a").alias("parcel_id"), (F.col("fy") + 2016).alias("fy"), F.col("x").alias("centroid_x"), F.col("y").alias("centroid_y"))
    vintages = F.explode(F.sequence(F.lit(2014), F.lit(2023)))
    tracts = _areas(spark).select("ordinal", "geom", F.concat(F.lit("25025"), F.lpad(F.col("ordinal").cast("string"), 6, "0")).alias("GEOID"), vintages.alias("acs_year"))
    income = tracts.select("GEOID", "acs_year", (F.col("ordinal") * 1000.0 + F.col("acs_year")).alias("income"))
    return enrich.with_income(p, tracts, income, crs=None).select(F.col("geo_pid").alias("id"), "fy", "median_hh_income")


_RECT_SQL = """rect AS (SELECT p_partkey AS geo_pid, y AS fy, ((p_partkey % 25) * 10 + (p_partkey * 7 + y * 3) % 5)::DOUBLE AS x0, (((p_partkey - p_partkey % 25) / 25)::BIGINT * 10 + (p_partkey * 5 + y) % 4)::DOUBLE AS y0, (7 + (p_partkey + y) % 5)::DOUBLE AS w, (6 + (p_partkey * 3 + y) % 5)::DOUBLE AS h
  FROM part, range(2016, 2020) t(y))"""


def _part_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and years, dealt to all tasks: a table's only file may be one split, and outlines are many times its size."""
    years = F.explode(F.array(*map(F.lit, range(2016, 2020)))).alias("fy")
    return table(spark, sf_dir, "part").select("p_partkey", years).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey", "fy")


def _rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, y = F.col("p_partkey"), F.col("fy")
    base = _part_years(spark, sf_dir)
    x0, y0 = ((k % 25) * 10 + (k * 7 + y * 3) % 5).cast("double"), (F.floor(k / 25) * 10 + (k * 5 + y) % 4).cast("double")
    x1, y1 = x0 + (7 + (k + y) % 5), y0 + (6 + (k * 3 + y) % 5)
    ring = F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0))
    return base.select(k.alias("geo_pid"), "fy", F.array(F.array(ring)).cast(spatial.GEOMETRY_TYPE).alias("geom"))


@query(f"""
WITH {_RECT_SQL}, o AS (SELECT a.geo_pid, a.fy, b.geo_pid AS prev_geo_pid, greatest(0, least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0)) * greatest(0, least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0)) / (a.w * a.h) AS share
  FROM (SELECT *, unnest([-1, 0, 1]) AS d FROM rect) a JOIN rect b ON b.fy + 1 = a.fy AND b.geo_pid // 25 = a.geo_pid // 25 + d AND a.x0 <= b.x0 + b.w AND b.x0 <= a.x0 + a.w AND a.y0 <= b.y0 + b.h AND b.y0 <= a.y0 + a.h),
best AS (SELECT *, row_number() OVER (PARTITION BY geo_pid, fy ORDER BY round(share, 9) DESC, prev_geo_pid) AS rn FROM o)
SELECT geo_pid, fy::INTEGER AS fy, prev_geo_pid, round(share, 6) AS overlap_share FROM best WHERE rn = 1 AND share >= 0.5
""")
def rect_overlay_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all parts; in the SQL, rows of the layout that are two apart never meet."""
    out = choices.best_predecessors(_rectangles(spark, sf_dir), cell=10.0)
    return out.select("geo_pid", "fy", "prev_geo_pid", F.round("overlap_share", 6).alias("overlap_share"))


# Outlines with corners, holes and two parts: boxes added up and taken away, and then sheared, so that no edge is level or upright.

#: Of each kind, boxes as (x0, y0, x1, y1) and their sign, and the rings that they are: (part, ring, corners).
_KINDS = {
    0: ([(0, 0, 9, 3, 1), (0, 3, 3, 9, 1)], [(0, 0, [(0, 0), (9, 0), (9, 3), (3, 3), (3, 9), (0, 9)])]),
    1: ([(0, 0, 9, 9, 1), (2, 2, 6, 7, -1)], [(0, 0, [(0, 0), (9, 0), (9, 9), (0, 9)]), (0, 1, [(2, 2), (6, 2), (6, 7), (2, 7)])]),
    2: ([(0, 0, 4, 9, 1), (6, 1, 10, 6, 1)], [(0, 0, [(0, 0), (4, 0), (4, 9), (0, 9)]), (1, 0, [(6, 1), (10, 1), (10, 6), (6, 6)])]),
    3: ([(0, 0, 9, 9, 1), (3, 4, 6, 9, -1)], [(0, 0, [(0, 0), (9, 0), (9, 9), (6, 9), (6, 4), (3, 4), (3, 9), (0, 9)])]),
}
_SHEAR = (0.3, 0.2)  # x + 0.3 y, y + 0.2 x


def _outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, y = F.col("p_partkey"), F.col("fy")
    base = _part_years(spark, sf_dir)
    x0, y0 = ((k % 25) * 8 + (k * 7 + y * 3) % 5).cast("double"), (F.floor(k / 25) * 8 + (k * 5 + y) % 4).cast("double")
    corners = [[[list(map(list, corners)) for p, _, corners in rings if p == part] for part in sorted({r[0] for r in rings})] for _, rings in (_KINDS[n] for n in sorted(_KINDS))]
    # one nested constant; the same outlines written out corner by corner are too much code for the JVM to compile
    listed = F.from_json(F.lit(json.dumps(corners)), f"array<{spatial.GEOMETRY_TYPE}>")
    point = lambda p: F.array(x0 + p[0] + (y0 + p[1]) * _SHEAR[0], y0 + p[1] + (x0 + p[0]) * _SHEAR[1])
    geom = F.transform(F.get(listed, (k % len(_KINDS)).cast("int")), lambda part: F.transform(part, lambda ring: F.transform(ring, point)))
    return base.select(k.alias("geo_pid"), "fy", geom.cast(spatial.GEOMETRY_TYPE).alias("geom"))


_OUTLINE_SQL = f"""kinds(kind, dx0, dy0, dx1, dy1, sign) AS (VALUES {", ".join(f"({n}, {', '.join(map(str, box))})" for n, (boxes, _) in _KINDS.items() for box in boxes)}),
boxes AS (SELECT p_partkey AS geo_pid, y AS fy, p_partkey // 25 AS line, x0 + dx0 AS x0, y0 + dy0 AS y0, x0 + dx1 AS x1, y0 + dy1 AS y1, sign::DOUBLE AS sign
  FROM (SELECT p_partkey, y, (p_partkey % 25) * 8 + (p_partkey * 7 + y * 3) % 5 AS x0, (p_partkey // 25) * 8 + (p_partkey * 5 + y) % 4 AS y0 FROM part, range(2016, 2020) t(y)) JOIN kinds ON kind = p_partkey % 4),
own AS (SELECT geo_pid, fy, sum(sign * (x1 - x0) * (y1 - y0)) AS own FROM boxes GROUP BY ALL),
o AS (SELECT a.geo_pid, a.fy, b.geo_pid AS prev_geo_pid, sum(a.sign * b.sign * greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS common
  FROM (SELECT *, unnest([-2, -1, 0, 1, 2]) AS d FROM boxes) a JOIN boxes b ON b.fy + 1 = a.fy AND b.line = a.line + d GROUP BY ALL),
shares AS (SELECT geo_pid, fy, prev_geo_pid, common, common / own AS share FROM o JOIN own USING (geo_pid, fy) WHERE common > 0)"""


@query(f"WITH {_OUTLINE_SQL} SELECT geo_pid, fy::INTEGER AS fy, prev_geo_pid, round(common * {1 - _SHEAR[0] * _SHEAR[1]}, 5) AS overlap_area, round(share, 7) AS overlap_share FROM shares")
def polygon_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overlaps of slanted outlines with corners, holes and two parts, over all parts and years."""
    shapes = _outlines(spark, sf_dir)
    prior = shapes.select(F.col("geo_pid").alias("prev_geo_pid"), (F.col("fy") + 1).alias("next"), "geom")
    met = spatial.overlay(shapes, prior, 10.0, equal=[("fy", "next")]).where("overlap_area > 1e-6")
    return met.select("geo_pid", "fy", "prev_geo_pid", F.round("overlap_area", 5).alias("overlap_area"), F.round("overlap_share", 7).alias("overlap_share"))


@query(f"""WITH {_OUTLINE_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY geo_pid, fy ORDER BY round(share, 9) DESC, prev_geo_pid) AS rn FROM shares)
SELECT geo_pid, fy::INTEGER AS fy, prev_geo_pid, round(share, 6) AS overlap_share FROM best WHERE rn = 1 AND share >= 0.5""")
def polygon_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best predecessor of each of these outlines."""
    out = choices.best_predecessors(_outlines(spark, sf_dir), cell=10.0)
    return out.select("geo_pid", "fy", "prev_geo_pid", F.round("overlap_share", 6).alias("overlap_share"))


@query(f"WITH {_OUTLINE_SQL} SELECT geo_pid, fy::INTEGER AS fy, round(own * {1 - _SHEAR[0] * _SHEAR[1]}, 6) AS area, CASE WHEN geo_pid % 4 = 2 THEN 'MULTIPOLYGON' ELSE 'POLYGON' END AS kind FROM own")
def wkt_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines written as WKT and read again."""
    text = _outlines(spark, sf_dir).withColumn("text", files.wkt_text(F.col("geom")))
    return text.select("geo_pid", "fy", F.round(spatial.area(files.wkt_polygons(F.col("text"))), 6).alias("area"), F.substring_index("text", " ", 1).alias("kind"))


# The hull by walking around it: from a corner on to the point of the least turn.


@query(f"""
WITH RECURSIVE {_POINTS_SQL}, spots AS (SELECT DISTINCT x, y FROM pts WHERE x IS NOT NULL AND y IS NOT NULL),
walk(k, x, y, way, x0, y0) AS (
  SELECT 0, x, y, -pi() / 2, x, y FROM (SELECT x, y FROM spots ORDER BY x, y LIMIT 1)
  UNION ALL
  SELECT k + 1, n.x, n.y, n.way, x0, y0 FROM (
    SELECT k, x0, y0, arg_min(struct_pack(x := s.x, y := s.y, way := atan2(s.y - w.y, s.x - w.x)), struct_pack(turn := round(atan2(s.y - w.y, s.x - w.x) - way + CASE WHEN atan2(s.y - w.y, s.x - w.x) - way < -1e-9 THEN 2 * pi() ELSE 0 END, 12), far := -((s.x - w.x) * (s.x - w.x) + (s.y - w.y) * (s.y - w.y)))) AS n
    FROM walk w JOIN spots s ON s.x <> w.x OR s.y <> w.y WHERE (k = 0 OR w.x <> x0 OR w.y <> y0) AND k < 10000 GROUP BY k, x0, y0)
)
SELECT x, y FROM walk WHERE k > 0
""")
def walking_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of the hull of all points."""
    corners = spatial.convex_hull(_points(spark, sf_dir), "x", "y")
    return spark.createDataFrame([tuple(map(float, p)) for p in corners], "x double, y double")


@query(f"WITH {_RECT_SQL} SELECT geo_pid, fy::INTEGER AS fy, x0 + w / 2 AS px, y0 + h / 2 AS py FROM rect")
def representative_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.representative_points(_rectangles(spark, sf_dir)).select("geo_pid", "fy", "px", "py")


@query(f"""
WITH {_POINTS_SQL}, d AS (SELECT a.id, b.id AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM pts a JOIN pts b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other)::INTEGER AS rank FROM d)
SELECT id, other, rank, round(d, 9) AS distance FROM r WHERE rank <= 8
""")
def knn8(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    t = p.select(F.col("id").alias("other"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return spatial.knn_join(p, t, 8, None, "id", "other", exclude_self=True).select("id", "other", "rank", F.round("distance", 9).alias("distance"))


# Choices.


def _identity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    state = _state(spark, sf_dir)
    return state, state.select("geo_pid", "fy", F.col("geo_pid").alias("prev_geo_pid"), F.lit(1.0).alias("overlap_share"))


@query(
    "WITH "
    + _STATE_SQL
    + """
SELECT a.geo_pid, a.fy, a.units - b.units AS net_new_units, a.centroid_x, a.centroid_y FROM state a JOIN state b ON a.geo_pid = b.geo_pid AND b.fy + 1 = a.fy WHERE a.fy BETWEEN 1996 AND 1998 AND a.units > b.units
"""
)
def development_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choices.development_events(*_identity(spark, sf_dir), years=(1996, 1997, 1998))


@query(
    "WITH "
    + _STATE_SQL
    + """, c AS (SELECT a.geo_pid, a.fy, a.lu AS current_lu, b.lu AS prior_lu, a.unit_category AS now, b.unit_category AS was, b.assessed_total AS cost, coalesce(b.lu IN ('R1', 'R2', 'R3', 'R4', 'A', 'CD', 'CP', 'CC', 'CM', 'RC', 'RL'), false) AS inset
  FROM state a LEFT JOIN state b ON a.geo_pid = b.geo_pid AND b.fy + 1 = a.fy WHERE a.fy BETWEEN 1999 AND 2001)
SELECT geo_pid, fy, current_lu, prior_lu, round(cost, 4) AS acquisition_cost, inset AS in_choice_set, CASE WHEN inset AND coalesce(now, 'No Development') <> coalesce(was, 'No Development') THEN coalesce(now, 'No Development') ELSE 'No Development' END AS dev_outcome FROM c
"""
)
def dev_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = choices.choice_set(*_identity(spark, sf_dir), years=(1999, 2000, 2001))
    return out.select("geo_pid", "fy", "current_lu", "prior_lu", F.round("acquisition_cost", 4).alias("acquisition_cost"), "in_choice_set", "dev_outcome")


# What was chosen, of the residential parcels. At the maximum the score equations hold: fitted sums are observed sums.

_CHOICE_SQL = (
    "WITH "
    + _STATE_SQL
    + """, c AS (SELECT a.fy, ln(b.assessed_total) AS cost, ln(b.land_sf) AS land, b.lu, CASE WHEN coalesce(a.unit_category, 'No Development') <> coalesce(b.unit_category, 'No Development') THEN coalesce(a.unit_category, 'No Development') ELSE 'No Development' END AS outcome
  FROM state a JOIN state b ON a.geo_pid = b.geo_pid AND b.fy + 1 = a.fy WHERE a.fy BETWEEN 1994 AND 1998 AND b.assessed_total > 0 AND b.land_sf > 0 AND b.lu IN ('R1', 'R2', 'R3', 'R4', 'A', 'CD', 'CP', 'CC', 'CM', 'RC', 'RL'))"""
)
_CHOICE_TERMS = """unnest([struct_pack(term := 'const', v := 1.0), struct_pack(term := 'log_acquisition_cost', v := cost), struct_pack(term := 'log_land_sf', v := land)]) AS t"""


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = choices.choice_set(*_identity(spark, sf_dir), years=range(1994, 1999)).where("in_choice_set")
    return out.withColumn("year", F.col("fy").cast("string"))


@query(_CHOICE_SQL + f" SELECT outcome AS alternative, t.term AS term, round(sum(t.v), 3) AS fitted FROM (SELECT outcome, {_CHOICE_TERMS} FROM c) GROUP BY ALL")
def choice_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multinomial logit of what was developed: its fitted sums of each term by alternative."""
    d = logit.choice_design(_choices(spark, sf_dir), ["acquisition_cost", "land_sf"])
    return logit.totals(d, logit.fit_choice(d)).withColumn("fitted", F.round("fitted", 3))


@query(_CHOICE_SQL + f" SELECT outcome <> 'No Development' AS develops, t.term AS term, round(sum(t.v), 3) AS fitted FROM (SELECT outcome, {_CHOICE_TERMS} FROM c) GROUP BY ALL")
def choice_nested_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A developer first decides to build and then how densely: the fitted sums by nest, which the nested model keeps too."""
    d = logit.choice_design(_choices(spark, sf_dir), ["acquisition_cost", "land_sf"])
    sums = logit.totals(d, logit.fit_choice(d, {"develop": d.alternatives[1:]}))
    return sums.groupBy((F.col("alternative") != logit.BASE).alias("develops"), "term").agg(F.round(F.sum("fitted"), 3).alias("fitted"))


@query(
    _CHOICE_SQL
    + """, n AS (SELECT fy, outcome, count(*)::DOUBLE AS n FROM c GROUP BY ALL), o AS (SELECT k.fy, k.outcome, ln(k.n / b.n) AS odds, 1 / k.n + 1 / b.n AS v FROM n k JOIN n b ON k.fy = b.fy AND b.outcome = 'No Development' WHERE k.outcome <> 'No Development')
SELECT outcome AS alternative, 'const' AS term, round(odds, 6) AS coef, round(sqrt(v), 6) AS std_err FROM o WHERE fy = (SELECT min(fy) FROM c) UNION ALL SELECT o.outcome, 'year_' || o.fy, round(o.odds - f.odds, 6), round(sqrt(o.v + f.v), 6) FROM o JOIN o f ON f.outcome = o.outcome AND f.fy = (SELECT min(fy) FROM c) WHERE o.fy > f.fy
"""
)
def choice_logit_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saturated model, whose estimates are log odds of counts."""
    f = logit.fit_choice(logit.choice_design(_choices(spark, sf_dir), ["year"]))
    return spark.createDataFrame([(a, t, round(b, 6), round(e, 6)) for a, t, b, e, _, _ in f.coefficients], "alternative string, term string, coef double, std_err double")


@query("""
WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE substr(o_orderpriority, 1, 1) END AS prior_lu, year(o_orderdate)::INTEGER AS fy FROM orders),
prices AS (SELECT CASE WHEN p_size % 7 = 0 THEN NULL ELSE (p_size % 7)::VARCHAR END AS lu, 1995 + p_size % 5 AS fy, first(CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END ORDER BY p_partkey) AS price FROM part GROUP BY ALL)
SELECT o_orderkey, p.fy, prior_lu, price AS market_price_psf FROM p LEFT JOIN prices ON prior_lu IS NOT DISTINCT FROM lu AND p.fy = prices.fy
""")
def price_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.substring("o_orderpriority", 1, 1)).alias("prior_lu"), F.year("o_orderdate").alias("fy"))
    size = F.col("p_size")
    right = table(spark, sf_dir, "part").select(F.when(size % 7 != 0, (size % 7).cast("string")).alias("lu"), (1995 + size % 5).alias("fy"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")).alias("price_per_sqft"), F.col("p_partkey").alias("ordinal"))
    return choices.with_market_price(left, right)


@query("""
SELECT c_custkey, c_acctbal AS v FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey + CASE WHEN c_custkey % 20 = 0 THEN 1000000 ELSE 0 END, -1.0 FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 20 = 0
""")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    fresh = c.where("c_custkey % 10 = 0").select((F.col("c_custkey") + F.when(F.col("c_custkey") % 20 == 0, 1000000).otherwise(0)).alias("c_custkey"), F.lit(-1.0).alias("v"))
    return panel.upsert(c.select("c_custkey", F.col("c_acctbal").alias("v")), fresh, ["c_custkey"])


# Graph: a full grid, where the shortest path is the Manhattan distance.


@query("""
WITH side AS (SELECT ceil(sqrt(max(c_custkey) + 1))::BIGINT AS m FROM customer),
n AS (SELECT c_custkey AS id, c_custkey % m AS cx, c_custkey // m AS cy FROM customer, side),
src AS (SELECT 'food' AS category, cx, cy FROM n WHERE id % 211 = 5 UNION ALL SELECT 'park', cx, cy FROM n WHERE id % 307 = 9),
d AS (SELECT id, category, min(abs(n.cx - s.cx) + abs(n.cy - s.cy)) * 100.0 AS d FROM n, src s GROUP BY ALL),
w AS (SELECT id, max(CASE WHEN category = 'food' THEN greatest(0, 100 * (1 - d / 1600)) END) AS food, max(CASE WHEN category = 'park' THEN greatest(0, 100 * (1 - d / 1600)) END) AS park FROM d GROUP BY id)
SELECT id, food::DOUBLE AS food_score, park::DOUBLE AS park_score, round_even((food + park) / 2, 2)::DOUBLE AS walkability FROM w
""")
def walk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a grid of all customers, its side and its places growing with the table."""
    c = table(spark, sf_dir, "customer")
    last = c.agg(F.max("c_custkey")).first()[0] or 0
    m, k = math.isqrt(last) + 1, F.col("c_custkey")  # keys begin at 0
    at = c.select(F.col("c_custkey").alias("id"), (k % m).alias("cx"), F.floor(k / m).alias("cy"))
    nodes = at.select("id", (F.col("cx") * 100.0).alias("x"), (F.col("cy") * 100.0).alias("y"))
    step = F.array(F.when((F.col("cx") < m - 1) & (F.col("id") < last), F.col("id") + 1), F.when(F.col("id") + m <= last, F.col("id") + m))
    one_way = at.select(F.col("id").alias("src"), F.explode(F.array_compact(step)).alias("dst"))
    edges = one_way.union(one_way.select("dst", "src")).withColumn("length", F.lit(100.0))
    near = nodes.select("id", (F.col("x") + 1).alias("x"), (F.col("y") + 2).alias("y"))
    places = near.where("id % 211 = 5").select(F.lit("food").alias("category"), "x", "y").union(near.where("id % 307 = 9").select(F.lit("park"), "x", "y"))
    points = nodes.select("id", (F.col("x") + 7).alias("x"), (F.col("y") - 9).alias("y"))
    return graph.walk_scores(points, nodes, edges, places, "id", cell=100.0, categories=("food", "park"))


# Statistics.


@query(f"""
WITH {_POINTS_SQL}, d AS (SELECT a.id, b.id AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM pts a JOIN pts b ON a.id <> b.id),
e AS (SELECT id, other FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rn FROM d) WHERE rn <= 8),
z AS (SELECT id, v - (SELECT avg(v) FROM pts) AS z FROM pts)
SELECT round((SELECT sum(a.z * b.z) / 8 FROM e JOIN z a ON a.id = e.id JOIN z b ON b.id = e.other) / (SELECT sum(z * z) FROM z), 9) AS moran_i, (SELECT count(*) FROM z) AS moran_n_parcels
""")
def moran_i(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).select(F.col("id").alias("geo_pid"), F.col("v").alias("z"), "x", "y")
    out = stats.moran_statistic(p, stats.moran_edges(p, 8), 8)
    return out.select(F.round("moran_i", 9).alias("moran_i"), "moran_n_parcels")


@query(f"""
WITH {_POINTS_SQL}, a AS (SELECT id, CASE WHEN fy = 9 THEN '<none>' ELSE 'n' || fy END AS area, x, y FROM pts), r AS (SELECT area, (row_number() OVER (ORDER BY area) - 1) % 2 AS odd FROM (SELECT DISTINCT area FROM a)),
o AS (SELECT id, area, row_number() OVER (PARTITION BY area ORDER BY CASE WHEN odd = 0 THEN x ELSE y END, id) - 1 AS i, count(*) OVER (PARTITION BY area) AS n FROM a JOIN r USING (area))
SELECT id AS geo_pid, floor(i * 5 / n)::INTEGER AS fold FROM o
""")
def spatial_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    p = p.select(F.col("id").alias("geo_pid"), "fy", F.when(F.col("fy") != 9, F.concat(F.lit("n"), F.col("fy").cast("string"))).alias("neighborhood_name"), F.col("x").alias("centroid_x"), F.col("y").alias("centroid_y"))
    return stats.spatial_folds(p, 5)


@query("""
WITH e AS (SELECT o_orderkey, o_totalprice - 100000 AS e, lag(o_totalprice - 100000) OVER (ORDER BY o_orderkey) AS p FROM orders)
SELECT round(sum((e - p) * (e - p)) / sum(e * e), 9) AS durbin_watson FROM e
""")
def durbin_watson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") - 100000).alias("resid"))
    return stats.durbin_watson(rows, ["o_orderkey"]).select(F.round("durbin_watson", 9).alias("durbin_watson"))


def _simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("price_per_sqft"), F.col("l_quantity").alias("living_area"), F.col("l_tax").alias("walkability"))


@query("""
WITH d AS (SELECT ln(l_extendedprice) AS y, ln(l_quantity) AS x FROM lineitem)
SELECT 'const' AS term, round(regr_intercept(y, x), 8) AS coef, round(regr_r2(y, x), 8) AS r2, count(*) AS n FROM d UNION ALL SELECT 'log_living_area', round(regr_slope(y, x), 8), round(regr_r2(y, x), 8), count(*) FROM d
""")
def ols_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stats.fit(stats.design(_simple(spark, sf_dir), ["living_area"]))
    return spark.createDataFrame([(t, round(b, 8), round(f.stats["r2"], 8), int(f.stats["n"])) for t, b in zip(f.terms, f.beta.tolist())], "term string, coef double, r2 double, n long")


@query("""
WITH d AS (SELECT ln(l_quantity) AS a, l_tax AS b FROM lineitem) SELECT term, round(1 / (1 - corr(a, b) * corr(a, b)), 8) AS vif FROM d, (VALUES ('log_living_area'), ('walkability')) t(term) GROUP BY term
""")
def vif_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stats.fit(stats.design(_simple(spark, sf_dir), ["living_area", "walkability"]))
    return spark.createDataFrame([(t, round(v, 8)) for t, v in f.vif], "term string, vif double")


def _modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _price_input(spark, sf_dir).withColumn("emp_dist_m", F.col("centroid_x") + F.col("centroid_y") + 50.0)
    years = {f"y_{2017 + i}": (F.col("fy") == y).cast("int") for i, y in enumerate(YEARS[1:])}
    return out.withColumns(years)


#: What the year dummies and the constant leave undetermined: each row has one dummy.
_FREE = "CASE WHEN term = 'const' THEN 1.0 WHEN starts_with(term, 'y_') THEN -1.0 ELSE 0.0 END"
_FREE_WEIGHT = 1000


def _fits_sql(numbers: dict[str, str], fold: str = "-1", groups: str = "SELECT -1 AS g", before: str = "") -> str:
    """CTEs ``long`` (a row's nonzero terms) to ``beta`` (each group's fit on rows of other folds), by normal equations.

    With N spanning the null space of X, (X'X + w NN') b = X'y has the solution of least norm, and its
    inverse is the pseudoinverse of X'X plus NN' / (w |N|^4). A term that a training set lacks gets 0.
    """
    many = " ".join(f"UNION ALL SELECT geo_pid, fy, fold, '{name}', {value} FROM placed" for name, value in numbers.items())
    return (
        _PRICED_SQL
        + f""",
complete AS (SELECT *, centroid_x + centroid_y + 50 AS emp_dist_m, ln(price_per_sqft) AS y FROM input WHERE price_per_sqft > 0 AND prior_sales_avg > 0 AND living_area > 0 AND centroid_x + centroid_y + 50 > 0),
{before}
placed AS (SELECT *, {fold} AS fold FROM complete),
long(geo_pid, fy, fold, term, v) AS (SELECT geo_pid, fy, fold, 'const', 1.0::DOUBLE FROM placed {many}
  UNION ALL SELECT geo_pid, fy, fold, 'land_use_code_' || land_use_code, 1 FROM placed WHERE land_use_code > (SELECT min(land_use_code) FROM input)
  UNION ALL SELECT geo_pid, fy, fold, 'neighborhood_name_' || neighborhood_name, 1 FROM placed WHERE neighborhood_name > (SELECT min(neighborhood_name) FROM input)
  UNION ALL SELECT geo_pid, fy, fold, 'y_' || (fy - {YEARS[1]} + 2017), 1 FROM placed WHERE fy >= {YEARS[1]}),
terms AS (SELECT term, row_number() OVER (ORDER BY term) AS spot, {_FREE} AS free FROM long GROUP BY term HAVING term = 'const' OR min(v) < max(v) OR count(*) < (SELECT count(*) FROM complete)),
sides AS (SELECT geo_pid, fy, fold, spot, v FROM long JOIN terms USING (term)),
moments AS (SELECT a.fold, a.spot AS i, b.spot AS j, sum(a.v * b.v) AS s FROM sides a JOIN sides b USING (geo_pid, fy) GROUP BY ALL),
answers AS (SELECT s.fold, spot AS i, sum(v * y) AS s FROM sides s JOIN complete USING (geo_pid, fy) GROUP BY ALL),
groups AS ({groups}),
products AS (SELECT g, i, j, sum(s) AS s FROM groups JOIN moments ON fold <> g OR g = -1 GROUP BY ALL),
targets AS (SELECT g, i, sum(s) AS s FROM groups JOIN answers ON fold <> g OR g = -1 GROUP BY ALL),
lines AS (SELECT groups.g, a.spot AS i, list(coalesce(p.s, CASE WHEN a.spot = b.spot THEN 1.0 ELSE 0.0 END) + {_FREE_WEIGHT} * a.free * b.free ORDER BY b.spot) AS line, list(CASE WHEN a.spot = b.spot THEN 1.0 ELSE 0.0 END ORDER BY b.spot) AS unit
  FROM groups CROSS JOIN terms a CROSS JOIN terms b LEFT JOIN products p ON p.g = groups.g AND p.i = a.spot AND p.j = b.spot GROUP BY groups.g, a.spot),
steps(g, k, m) AS (
  SELECT g, 0, list(list_concat(line, [coalesce(s, 0.0)], unit) ORDER BY i) FROM lines LEFT JOIN targets USING (g, i) GROUP BY g
  UNION ALL
  SELECT g, k + 1, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = k + 1 THEN list_transform(m[k + 1], lambda x: x / m[k + 1][k + 1])
    ELSE list_transform(range(1, len(m[1]) + 1), lambda j: m[i][j] - m[i][k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END) FROM steps WHERE k < len(m)
),
beta AS (SELECT g, spot, term, m[spot][len(m) + 1] AS b, m[spot][len(m) + 1 + spot] - free * free / ({_FREE_WEIGHT} * (SELECT sum(free * free) * sum(free * free) FROM terms)) AS inverse FROM steps CROSS JOIN terms WHERE k = len(m)),
guesses AS (SELECT geo_pid, fy, s.fold, sum(v * b) AS guess FROM sides s JOIN beta ON beta.spot = s.spot AND (g = s.fold OR g = -1) GROUP BY ALL),
missed AS (SELECT c.geo_pid, c.fy, c.centroid_x AS x, c.centroid_y AS y0, g.fold, c.y, c.y - guess AS resid FROM complete c JOIN guesses g USING (geo_pid, fy))"""
    )


_NUMBERS = {"log_prior_sales_avg": "ln(prior_sales_avg)", "log_emp_dist_m": "ln(emp_dist_m)", "log_living_area": "ln(living_area)"}


# The t distribution by Simpson's rule, its quantile by Newton's method from the normal one's.
_T_TAIL = """(scale * {t} / 6000 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(i * {t} / 2000, 2) / rest, -(rest + 1) / 2))))"""


@query(
    "WITH RECURSIVE "
    + _fits_sql(_NUMBERS | {"yr_built": "yr_built"})
    + f""",
shape AS (SELECT (count(*) - (SELECT count(*) - 1 FROM terms))::DOUBLE AS rest, sum(resid * resid) AS ssr FROM missed),
law AS (SELECT rest, ssr, exp(lgamma((rest + 1) / 2) - lgamma(rest / 2)) / sqrt(rest * pi()) AS scale FROM shape),
roots(k, rest, scale, q) AS (SELECT 0, rest, scale, 1.959963985::DOUBLE FROM law UNION ALL SELECT k + 1, rest, scale, q - ({_T_TAIL.format(t="q")} - 0.475) / (scale * pow(1 + q * q / rest, -(rest + 1) / 2)) FROM roots WHERE k < 8),
scored AS (SELECT term, b, sqrt(ssr / law.rest * inverse) AS se, law.rest, law.scale, q FROM beta CROSS JOIN law CROSS JOIN roots WHERE k = 8),
tested AS (SELECT *, b / se AS t, least(abs(b / se), 40.0) AS size FROM scored)
SELECT term, round(b, 5) AS coef, round(se, 5) AS std_err, round(t, 3) AS t, abs(round(1 - 2 * {_T_TAIL.format(t="size")}, 6)) AS p_value, round(b - q * se, 5) AS ci_low, round(b + q * se, 5) AS ci_high FROM tested
"""
)
def ols_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank-deficient by design: constant and year dummies add up."""
    f = stats.fit(stats.design(_modelled(spark, sf_dir), stats.SPECS["building2"]))
    digits = (5, 5, 3, 6, 5, 5)
    rows = [(term, *(round(float(v), n) for v, n in zip(values, digits))) for term, *values in f.coefficients]
    return spark.createDataFrame(rows, "term string, coef double, std_err double, t double, p_value double, ci_low double, ci_high double")


def _float(v: object) -> object:
    return v if isinstance(v, str) or v is None else float(v)


@query()
def cv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial cross-validation of the building model; permutations have no SQL form, tested against numpy."""
    rows = stats.spatial_cv(_modelled(spark, sf_dir), stats.SPECS["building"], folds=5)
    return spark.createDataFrame([(r["fold"], int(r["n_train"]), int(r["n_test"]), *map(_float, (r["rmse"], r["mae"], r["r2"], r["moran_i"], r["moran_p"]))) for r in rows], "fold string, n_train long, n_test long, rmse double, mae double, r2 double, moran_i double, moran_p double")


_BANDS_SQL = """
stands AS (SELECT geo_pid, neighborhood_name AS area, any_value(centroid_x) AS x, any_value(centroid_y) AS y FROM complete GROUP BY ALL),
areas AS (SELECT area, (row_number() OVER (ORDER BY area) - 1) % 2 AS odd FROM (SELECT DISTINCT area FROM stands)),
banded AS (SELECT geo_pid, row_number() OVER (PARTITION BY area ORDER BY CASE WHEN odd = 0 THEN x ELSE y END, geo_pid) - 1 AS i, count(*) OVER (PARTITION BY area) AS n FROM stands JOIN areas USING (area)),"""


@query(
    "WITH RECURSIVE "
    + _fits_sql(_NUMBERS, "(SELECT floor(i * 5 / n) FROM banded WHERE banded.geo_pid = complete.geo_pid)::INTEGER", "SELECT range AS g FROM range(5)", _BANDS_SQL)
    + """,
shown AS (SELECT *, fold::VARCHAR AS part FROM missed UNION ALL SELECT *, 'pooled' FROM missed),
measured AS (SELECT part, count(*) AS n_test, sqrt(avg(resid * resid)) AS rmse, avg(abs(resid)) AS mae, 1 - sum(resid * resid) / (var_pop(y) * count(*)) AS r2 FROM shown GROUP BY part),
means AS (SELECT part, geo_pid, any_value(x) AS x, any_value(y0) AS y, avg(resid) AS z FROM shown GROUP BY ALL),
centred AS (SELECT *, z - avg(z) OVER (PARTITION BY part) AS c FROM means),
near AS (SELECT a.part, a.c * b.c AS product, row_number() OVER (PARTITION BY a.part, a.geo_pid ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.geo_pid) AS k FROM centred a JOIN centred b ON a.part = b.part AND a.geo_pid <> b.geo_pid),
crossed AS (SELECT part, sum(product) / 8 AS crossed FROM near WHERE k <= 8 GROUP BY part),
own AS (SELECT part, sum(c * c) AS own FROM centred GROUP BY part)
SELECT part AS fold, (SELECT count(*) FROM missed) - CASE WHEN part = 'pooled' THEN 0 ELSE n_test END AS n_train, n_test, round(rmse, 8) AS rmse, round(mae, 8) AS mae, round(r2, 7) AS r2, round(crossed / own, 7) AS moran_i FROM measured JOIN crossed USING (part) JOIN own USING (part)
"""
)
def cv_fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can give of ``cv_metrics``: all but the permutations' p, which are therefore not drawn."""
    rows = stats.spatial_cv(_modelled(spark, sf_dir), stats.SPECS["building"], folds=5, permutations=0)
    digits = {"rmse": 8, "mae": 8, "r2": 7, "moran_i": 7}
    return spark.createDataFrame([(r["fold"], int(r["n_train"]), int(r["n_test"]), *(round(float(r[c]), n) for c, n in digits.items())) for r in rows], "fold string, n_train long, n_test long, rmse double, mae double, r2 double, moran_i double")
