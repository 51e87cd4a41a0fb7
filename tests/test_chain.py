"""The preparation chain end to end on a small grid of parcels."""

import json

import __spark_entry__
import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.__main__ import main
from cadastra.operators import choices, panel, spatial, stats
from cadastra.plans import pipeline
from cadastra.sources import files


def grid(spark):
    rows, shapes = [], []
    for fy in range(2016, 2023):
        for i in range(36):
            x, y = (i % 6) * 20.0, (i // 6) * 20.0
            pid = f"{1000000 + i}000"
            use = "R3" if i % 7 == 0 and fy > 2018 else "R1"
            rows.append((pid, fy, use, 100_000.0 + 1000 * i + 500 * (fy - 2016), 1000.0 + 20 * i, 2000.0, "1950"))
            ring = [[x, y], [x + 20, y], [x + 20, y + 20], [x, y + 20], [x, y]]
            shapes.append((pid, fy, [[ring]], x + 10, y + 10))
    accounts = spark.createDataFrame(rows, "parcel_id string, fy int, land_use_code string, assessed_total double, living_area double, land_sf double, yr_built string")
    return accounts, spark.createDataFrame(shapes, "geo_pid string, fy int, geom array<array<array<array<double>>>>, centroid_x double, centroid_y double")


def test_chain(spark):
    accounts, shapes = grid(spark)
    out = pipeline.build_panel(accounts, shapes, crs=None)
    assert out.where("geo_pid is null or emp_dist_m is null").count() == 0
    state = panel.parcel_state(out)
    hedonic = pipeline.hedonic_input(state)
    assert hedonic.where("fy = 2016").count() == 0 and hedonic.count() == 36 * 6
    choices = pipeline.choice_input(state, shapes, cell=20.0)
    assert choices.count() == 36 * 2 and choices.where("prev_geo_pid <> geo_pid or overlap_share < 1 - 1e-9").count() == 0
    # six parcels grew from one unit to three in 2019; all lie within the radius
    assert choices.agg(F.min("dev_activity_600m"), F.max("dev_units_600m")).first() == (6, 12.0)


def test_written_outputs(spark, tmp_path):
    accounts, shapes = grid(spark)
    written = pipeline.prepare(accounts, shapes, str(tmp_path), crs=None, cell=20.0)
    assert written == {"panel": 36 * 7, "parcel_state": 36 * 7, "hedonic_input": 36 * 6, "devchoice_input": 36 * 2}
    rows = [(r.geo_pid, r.fy) for r in spark.read.parquet(f"{tmp_path}/parcel_state.parquet").coalesce(1).collect()]
    assert rows == sorted(rows)
    with pytest.raises(ValueError, match="rebuild"):
        files.load_or_build(spark, f"{tmp_path}/parcel_state.parquet", None, needed=["no_such"])
    with pytest.raises(ValueError, match="county"):
        files.county_tracts(spark.createDataFrame([("1", "017")], "GEOID string, COUNTYFP string"), "025")
    assert files.price_table(spark, f"{tmp_path}/nowhere.parquet") is None


def test_command_line(spark, tmp_path, capsys):
    for fy in (2021, 2022):
        (tmp_path / f"property-assessment-fy{fy}.csv").write_text("PID,LU,TOTAL_VALUE,LIVING_AREA,LAND_SF,YR_BUILT\n" + "".join(f"{i}000,R1,{100_000 + i},1000,2000,1950\n" for i in range(1, 9)))
        features = [{"type": "Feature", "properties": {"MAP_PAR_ID": f"{i}000"}, "geometry": {"type": "Polygon", "coordinates": [[[x, y] for x, y in ((i, 0), (i + 1, 0), (i + 1, 1), (i, 1), (i, 0))]]}} for i in range(1, 9)]
        (tmp_path / f"parcels-fy{fy}.geojson").write_text('{"type": "FeatureCollection", "features": [\n' + ",\n".join(map(json.dumps, features)) + "\n]}\n")
    main(["prepare", "--assessors", str(tmp_path), "--parcels", str(tmp_path), "--out", str(tmp_path / "out"), "--planar"], spark)
    assert "hedonic_input: 8 rows" in capsys.readouterr().out


def test_first_price_of_a_key_counts(spark):
    left = spark.createDataFrame([(1, "R1"), (2, None), (3, "A")], "id int, prior_lu string")
    table = spark.createDataFrame([("r1", 9.0, 2), ("R1", None, 1), (None, 4.0, 3), (None, 1.0, 4)], "lu string, price_per_sqft double, ordinal int")
    assert {r.id: r.market_price_psf for r in choices.with_market_price(left, table).collect()} == {1: None, 2: 4.0, 3: None}


def test_lag_of_rows_without_price_or_point(spark):
    rows = [(1, 2016, 0.0, 0.0, 10.0), (2, 2017, 1.0, 0.0, None), (3, 2017, None, 0.0, 5.0), (4, 2017, 0.0, 1.0, 7.0)]
    out = spatial.prior_within(spark.createDataFrame(rows, "id int, fy int, centroid_x double, centroid_y double, v double"), "v", 300.0)
    assert {r.id: (r.prior_sales_avg, r.prior_sales_count) for r in out.collect()} == {1: (None, 0), 2: (None, 0), 3: (None, 0), 4: (10.0, 1)}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
