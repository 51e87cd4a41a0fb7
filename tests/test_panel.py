"""Panel operators: oracle queries on the small tables, edge rows, and properties against brute force."""

import inspect
import json
import math
import struct

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadastra.functions import geometry as g
from cadastra.functions import scalars as s
from cadastra.functions.crs import MASSACHUSETTS
from cadastra.operators import graph, panel, prices, spatial, stats
from cadastra.plans import queries as q
from cadastra.sources import files

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(rows):
    clean = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v)
    return sorted(tuple(map(clean, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_queries_give_the_rows_of_their_sql(spark, sf, duck, name):
    if name == "walk_score":  # its grid needs 400 customers
        sf = "/root/testdata/sf0.01"
        duck = duckdb.connect()
        duck.execute(f"create view customer as select * from read_parquet('{sf}/customer.parquet')")
    df = q.QUERIES[name](spark, sf)
    got = duck.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    want = got.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert plain(df.select(*names).collect()) == plain(want)


def values(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("v"))
    return [r.v for r in rows.orderBy("i").collect()]


@pytest.mark.parametrize(("name", "source", "key", "each"), [("rect_overlay_predecessor", "part", "geo_pid", None), ("representative_point", "part", "geo_pid", 4), ("walk_score", "customer", "id", 1)])
def test_whole_tables_are_read(spark, name, source, key, each):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view {source} as select * from read_parquet('{sf}/{source}.parquet')")
    rows = q.QUERIES[name](spark, sf)
    want = con.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = rows.select(*names).collect()
    assert plain(got) == plain(want.fetchall())
    n = con.execute(f"select count(*) from {source}").fetchone()[0]
    assert max(r[key] for r in got) > 600 and (each is None or len(got) == each * n)


def test_scalars_on_edge_rows(spark):
    assert values(spark, [None, "12-3", "123456789012", "x"], s.normalize_pid) == ["0000000000", "0000000123", "123456789012", "0000000000"]
    assert values(spark, ["$1,234", "", "nan", "None", "10d", "1e3", " 5 ", ".5", None], s.clean_numeric) == [1234.0, None, None, None, None, 1000.0, 5.0, 0.5, None]
    assert values(spark, ["r1", "CM - CONDO MAIN", None, " a "], s.normalize_land_use) == ["R1", "CM", None, "A"]
    assert values(spark, ["A", "A - Average", "AVG - Default", "EX - Excellent", "ZZ", None], s.normalize_condition) == ["A", "A", "A", "E", None, None]
    assert values(spark, ["20198", "19999", "99999", "1950", "x"], s.clean_year) == [2019.0, 1999.0, 99999.0, 1950.0, None]
    assert values(spark, ["0", "1", "2.5", "6", "21", None], lambda c: s.categorize_units(c.cast("double"))) == ["No Development", "1 Unit", "21+ Units", "4-6 Units", "21+ Units", None]
    assert values(spark, ["0", "800", "9999", None], lambda c: s.decay_score(c.cast("double"), 1600.0)) == [100.0, 50.0, 0.0, None]
    assert values(spark, ["1", None], lambda c: s.clipped(c.cast("double"), 500.0)) == [500.0, None]


@pytest.mark.parametrize(
    ("rows", "units", "category"),
    [
        ([("R1", None, 1000.0)], 1.0, "1 Unit"),
        ([("R4", None, 1700.0)], 2.0, "4-6 Units"),
        ([("R4", 5.0, 1700.0)], 5.0, "4-6 Units"),
        ([("CM", None, None), ("CD", None, 900.0), ("CD", None, 900.0), ("CD", None, 900.0)], 3.0, "3 Units"),
        ([("CD", None, 1.0), ("CD", None, 1.0)], 2.0, "2 Units"),
        ([("CM", None, None)], 0.0, "No Development"),
        ([("A", None, 8501.0)], 11.0, "7-20 Units"),
        ([("A", 12.0, None)], 12.0, "7-20 Units"),
        ([("RL", None, 5000.0)], 0.0, "No Development"),
        ([("E", 3.5, None)], 3.5, "21+ Units"),
    ],
)
def test_state_cases(spark, rows, units, category):
    df = spark.createDataFrame([("p", 2020, f"a{i}", *r) for i, r in enumerate(rows)], "geo_pid string, fy int, parcel_id string, land_use_code string, res_units double, living_area double")
    r = panel.parcel_state(df).collect()
    assert len(r) == 1 and (r[0].units, r[0].unit_category) == (units, category) and r[0].gross_area is None


def test_upper_quantile_is_of_the_clipped_column(spark):
    x = np.random.default_rng(0).lognormal(3, 1, 200)
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(x)], "fy int, v double")
    got = sorted(tuple(r) for r in prices.winsorized(df, [("v", 0.1, 0.9)]).collect())
    want = []
    for fy in (0, 1):
        part = x[fy::2]
        part = np.maximum(part, np.quantile(part, 0.1))
        want += [(fy, v) for v in np.minimum(part, np.quantile(part, 0.9))]
    assert np.allclose(got, sorted(want))


@pytest.mark.parametrize("accuracy, groups", [(10_000, 10_000), (100, 10_000), (100, 0)])
def test_quantiles_are_exact_beyond_the_sketch(spark, monkeypatch, accuracy, groups):
    monkeypatch.setattr(prices, "RANK_ACCURACY", accuracy)
    monkeypatch.setattr(prices, "BROADCAST_GROUPS", groups)
    rng = np.random.default_rng(1)
    smooth, tied, few = rng.lognormal(3, 1, 3000), np.where(rng.random(3000) < 0.4, 7.0, rng.integers(0, 50, 3000)), rng.normal(size=55)
    rows = [(1, float(v), float(t)) for v, t in zip(smooth, tied)] + [(2, float(v), None) for v in few] + [(3, None, None), (None, 1.0, 1.0)]
    wanted = [("v", 0.9), ("w", 0.02)]
    got = {r["_by"]: r for r in prices.quantiles(spark.createDataFrame(rows, "fy int, v double, w double"), wanted, "fy").collect()}
    assert np.allclose([got[1]["_q_v"], got[1]["_q_w"], got[2]["_q_v"]], [np.quantile(smooth, 0.9), np.quantile(tied, 0.02), np.quantile(few, 0.9)])
    assert got[2]["_q_w"] is None and set(got) <= {1, 2, 3} and (3 not in got or got[3]["_q_v"] is None)
    sparse = [(1, float(i), float(i) if i % 60 == 0 else None) for i in range(3300)]
    assert prices.quantiles(spark.createDataFrame(sparse, "fy int, v double, w double"), [("w", 0.9)], "fy").first()["_q_w"] == np.quantile(np.arange(0, 3300, 60), 0.9)
    for q in (0.0, 0.4, 0.5, 1.0):
        top = {r["_by"]: r["_q_v"] for r in prices.quantiles(spark.createDataFrame(rows, "fy int, v double, w double"), [("v", q)], "fy").collect()}
        assert np.allclose([top[1], top[2]], [np.quantile(smooth, q), np.quantile(few, q)])


def test_geometry():
    frame = [[[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]]]
    assert g.area(frame) == 12 and not g.contains(frame, 2, 2) and g.contains(frame, 0.5, 0.5)
    assert g.contains(frame, *g.representative_point(frame))
    assert g.from_wkt(g.to_wkt(frame)) == frame and g.from_wkt(" ") is None
    assert MASSACHUSETTS.point(-71.5, 41.0) == pytest.approx((200_000, 750_000))


@pytest.mark.parametrize("crowd", [spatial.CROWD, 1])
def test_knn_is_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(spatial, "CROWD", crowd)
    rng = np.random.default_rng(2)
    xy = np.vstack([rng.random((60, 2)), rng.random((20, 2)) * 0.01, rng.random((30, 2)) * 1e-5 + 0.3, [[0.75, 0.75]] * 12, [[50.0, 50.0]]])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xy)], "id int, x double, y double")
    t = df.select(F.col("id").alias("tid"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    got = {(r.id, r.tid) for r in spatial.knn_join(df, t, 4, exclude_self=True).collect()}
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    assert got == {(i, int(j)) for i in range(len(xy)) for j in sorted(range(len(xy)), key=lambda j: (d[i, j], j))[:4]}


def test_the_first_cell_follows_the_fullest(spark):
    places = [(float(i), 0.0) for i in range(20)] + [(3 + i / 1024, 0.0) for i in range(16)]
    there = spark.createDataFrame(places, "_tx double, _ty double")
    assert [spatial._first_cell(there, 32.0, most) for most in (36, 18, 5)] == [32.0, 2.0, 1 / 256]


def test_ols_is_the_pseudoinverse_on_a_singular_design(spark):
    rng = np.random.default_rng(7)
    n = 400
    year = rng.integers(2017, 2020, n)
    area = rng.lognormal(7, 0.4, n)
    price = np.exp(1 + 0.3 * np.log(area) + 0.1 * (year - 2017) + 0.1 * rng.standard_normal(n))
    rows = [(f"p{i}", int(y), float(a), float(v), *(int(y == d) for d in (2017, 2018, 2019))) for i, (y, a, v) in enumerate(zip(year, area, price))]
    df = spark.createDataFrame(rows, "geo_pid string, fy int, living_area double, price_per_sqft double, y_2017 int, y_2018 int, y_2019 int")
    f = stats.fit(stats.design(df, ["living_area"]))
    x = np.column_stack([np.ones(n), np.log(area), *((year == d).astype(float) for d in (2017, 2018, 2019))])
    assert f.terms == ["const", "log_living_area", "y_2017", "y_2018", "y_2019"] and f.stats["k"] == 3
    beta = np.linalg.pinv(x) @ np.log(price)
    assert np.allclose(f.beta, beta)
    left = np.log(price) - x @ beta
    assert f.stats["r2"] == pytest.approx(1 - (left @ left) / ((np.log(price) - np.log(price).mean()) ** 2).sum())
    e = stats.durbin_watson(stats.residuals(stats.design(df, ["living_area"]), f.beta)).first()[0]
    order = np.argsort([f"p{i}" for i in range(n)])
    assert e == pytest.approx((np.diff(left[order]) ** 2).sum() / (left @ left))


def test_tails():
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert stats.f_upper(3.0, 2, 20) == pytest.approx(1.3**-10)
    assert stats.t_quantile(0.975, 30) == pytest.approx(2.0422725, abs=1e-6)


def test_cv_metrics_permute_as_often_as_the_reference(spark, sf, monkeypatch):
    used, signature = [], inspect.signature(stats.spatial_cv)

    def spied(*a, **b):
        bound = signature.bind(*a, **b)
        bound.apply_defaults()
        used.append(bound.arguments["permutations"])
        return [{"fold": "pooled", "n_train": 1, "n_test": 1, "rmse": 0.0, "mae": 0.0, "r2": 0.0, "moran_i": 0.0, "moran_p": 1.0}]

    monkeypatch.setattr(stats, "spatial_cv", spied)
    q.QUERIES["cv_metrics"](spark, sf)
    assert used == [499]


def test_folds_hold_each_parcel_once(spark):
    df = spark.createDataFrame([(f"p{i}", fy, f"n{i % 3}", float(i), float(-i)) for i in range(24) for fy in (1, 2)], "geo_pid string, fy int, neighborhood_name string, centroid_x double, centroid_y double")
    rows = stats.spatial_folds(df, 5).collect()
    assert len(rows) == 24 and [sum(r.fold == f and int(r.geo_pid[1:]) % 3 == 0 for r in rows) for f in range(5)] == [2, 2, 1, 2, 1]


def test_files(spark, tmp_path):
    (tmp_path / "property-assessment-fy2016.csv").write_text(' PID ,LU,AV_TOTAL,R_OVRALL_CND\n1-2,R1,"$1,234",A\n,NA,nan,ZZ\n')
    (tmp_path / "property-assessment-fy2021.csv").write_text("PID,LU,LU_DESC,TOTAL_VALUE,OVERALL_COND\n7,CM - MAIN,x,5,EX - Excellent\n")
    rows = files.assessor_panel(spark, str(tmp_path)).orderBy("fy", "parcel_id").collect()
    assert [(r.parcel_id, r.fy, r.land_use_code, r.assessed_total, r.overall_cond, r.y_2021) for r in rows] == [
        ("0000000000", 2016, None, None, None, 0), ("0000000012", 2016, "R1", 1234.0, "A", 0), ("0000000007", 2021, "CM - MAIN", 5.0, "E", 1),
    ]
    with pytest.raises(FileNotFoundError):
        files.assessor_panel(spark, str(tmp_path), years=[1999])
    square = [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]]
    feature = lambda kind, c: {"type": "Feature", "properties": {"PID_LONG": "1-2"}, "geometry": {"type": kind, "coordinates": c}}
    both = [feature("Polygon", square), feature("MultiPolygon", [square, square])]
    (tmp_path / "lines.json").write_text('{"type":"FeatureCollection","features":[\n' + ",\n".join(map(json.dumps, both)) + "\n]}\n")
    for lines in (True, False):
        got = files.geojson(spark, str(tmp_path / "lines.json"), ["PID_LONG"], lines).orderBy("ordinal").collect()
        assert [(r.PID_LONG, r.geom) for r in got] == [("1-2", [square]), ("1-2", [square, square])]
    shape = files.parcel_shapes(spark, str(tmp_path / "lines.json"), 2016).collect()
    assert [(r.geo_pid, r.centroid_x, r.centroid_y) for r in shape] == [("0000000012", 1.0, 1.0)]
    (tmp_path / "acs.json").write_text('[["B19013_001E","state","county","tract"],["85000","25","25","000100"],["-666666666","25","025","000200"],["x","25","025","000300"]]')
    got = files.census_income(spark, str(tmp_path / "acs.json"), 2014).orderBy("GEOID").collect()
    assert [(r.GEOID, r.income) for r in got] == [("25025000100", 85000.0), ("25025000200", -666666666.0), ("25025000300", None)]
    (tmp_path / "bad.json").write_text('{"error": "no"}')
    with pytest.raises(ValueError):
        files.census_income(spark, str(tmp_path / "bad.json"), 2014)


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
    record = struct.pack("<i4d2ii", 5, 0, 0, 2, 2, 1, 5, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "z.shp").write_bytes(bytes(100) + struct.pack(">ii", 1, len(record) // 2) + record)
    field = b"Zoning_Sub\0C" + bytes(4) + bytes([8]) + bytes(15)
    (tmp_path / "z.dbf").write_bytes(struct.pack("<4BIHH", 3, 0, 0, 0, 1, 65, 9) + bytes(20) + field + b"\r" + b" H-1     ")
    spark.dataSource.register(files.ShapefileSource)
    r = spark.read.format("shapefile").option("path", str(tmp_path / "z.shp")).load().collect()
    assert [(x.Zoning_Sub, g.area(x.geom)) for x in r] == [("H-1", 4.0)]


def test_entry_without_the_training_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "cadastra", tmp_path / "cadastra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), [k for k in e.queries() if k.startswith('op1_') or k == 'pipeline'])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout
    assert out.split()[1] == "[]" and int(out.split()[0]) > 25
