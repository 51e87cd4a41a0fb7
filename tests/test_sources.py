"""Landed files: WKT, shapefiles, tagged features, versions, counts and reports; the extent of a walking network."""

import json
import math
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.__main__ import main
from cadastra.functions import geometry as g
from cadastra.operators import graph, panel, spatial, stats
from cadastra.plans import pipeline
from cadastra.sources import files

FRAME = [[[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]], [[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 1.0]]]]
TWO = [*FRAME, [[[9.5, -1e-7], [1.25e8, 0.0], [11.0, 2.0], [9.5, -1e-7]]]]


def test_wkt_in_columns(spark, tmp_path):
    shapes = [(1, FRAME), (2, TWO), (3, []), (4, None)]
    df = spark.createDataFrame(shapes, f"id int, geom {spatial.GEOMETRY_TYPE}")
    text = df.withColumn("text", files.wkt_text(F.col("geom")))
    assert {r.id: g.from_wkt(r.text) for r in text.collect()} == dict(shapes)
    again = text.select("id", files.wkt_polygons(F.col("text")).alias("geom"))
    assert {r.id: r.geom for r in again.collect()} == dict(shapes)
    assert "Python" not in again._jdf.queryExecution().executedPlan().toString()
    odd = {1: " polygon((+1 .5,2 1 7 , 3. 1e1,1 0.5),(0 0,1 1,0 1,0 0))", 2: "MultiPolygon Z (((0 0 1, 1 0 1, 1 1 1)) , ((5 5,6 5,6 6),(5 5,5 6,6 6)))", 3: "  ", 4: "MULTIPOLYGON EMPTY"}
    got = {r.id: r.g for r in spark.createDataFrame([*odd.items()], "id int, t string").select("id", files.wkt_polygons(F.col("t")).alias("g")).collect()}
    assert got == {1: [[[[1, 0.5], [2, 1], [3, 10], [1, 0.5]], [[0, 0], [1, 1], [0, 1], [0, 0]]]], 2: [[[[0, 0], [1, 0], [1, 1]]], [[[5, 5], [6, 5], [6, 6]], [[5, 5], [5, 6], [6, 6]]]], 3: None, 4: []}
    spots = spark.createDataFrame([("POINT (1 -2.5)",), ("point z(3 4 5)",), ("POINT EMPTY",), (None,), ("",)], "t string").select(files.wkt_point(F.col("t")).alias("p"))
    assert [r.p and tuple(r.p) for r in spots.collect()] == [(1.0, -2.5), (3.0, 4.0), None, None, None]
    files.write_wkt_csv(df.withColumn("note", F.lit('a "b", c')), str(tmp_path / "w"))
    landed = files.read_wkt_csv(spark, str(tmp_path / "w"))
    assert {int(r.id): (r.note, r.geom) for r in landed.collect()} == {i: ('a "b", c', s) for i, s in shapes}
    with pytest.raises(ValueError, match="no column"):
        files.read_wkt_csv(spark, str(tmp_path / "w"), "wkt")


def write_shapes(folder, name, rows, index=True):
    """rows: (county, id, outline or None); the three files of a shapefile."""
    shp, shx = bytearray(100), bytearray(100)
    for i, (_, _, ring) in enumerate(rows):
        record = struct.pack("<i", 0) if ring is None else struct.pack("<i4d2ii", 5, 0, 0, 2, 2, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
        shx += struct.pack(">ii", len(shp) // 2, len(record) // 2)
        shp += struct.pack(">ii", i + 1, len(record) // 2) + record
    field = lambda n, size: n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([size]) + bytes(15)
    dbf = struct.pack("<4BIHH", 3, 0, 0, 0, len(rows), 97, 10) + bytes(20) + field("COUNTYFP", 3) + field("GEOID", 6) + b"\r"
    dbf += b"".join(b" " + c.encode().ljust(3) + i.encode().ljust(6) for c, i, _ in rows)
    for end, data in ((".shp", shp), (".dbf", dbf), *([(".shx", shx)] if index else [])):
        (folder / f"{name}{end}").write_bytes(bytes(data))


def test_zipped_and_split_shapefiles(spark, tmp_path):
    square = lambda x: [(x, 0.0), (x, 2.0), (x + 2, 2.0), (x + 2, 0.0), (x, 0.0)]
    rows = [("025" if i % 3 else "017", f"t{i}", None if i == 4 else square(float(i))) for i in range(11)]
    write_shapes(tmp_path, "tracts", rows)
    with zipfile.ZipFile(tmp_path / "tracts.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for end in (".shp", ".dbf", ".shx"):
            z.write(tmp_path / f"tracts{end}", f"tl_2020/x{end.upper()}")
    write_shapes(tmp_path, "bare", rows, index=False)
    want = [(c, i, 0.0 if s is None else 4.0, n) for n, (c, i, s) in enumerate(rows)]
    for name in ("tracts.shp", "tracts.zip", "bare.shp"):
        df = files.shapefile(spark, str(tmp_path / name), records="4")
        assert df.rdd.getNumPartitions() == 3
        assert [(r.COUNTYFP, r.GEOID, g.area(r.geom or []), r.ordinal) for r in df.orderBy("ordinal").collect()] == want
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        tracts = files.county_tracts(files.shapefile(spark, str(tmp_path / "tracts.zip"), records="4"), "025")
        assert [r.GEOID for r in tracts.orderBy("ordinal").collect()] == [i for c, i, _ in rows if c == "025"]
        assert tracts.where("geom IS NOT NULL AND ordinal > 3").count() == 4
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    write_shapes(tmp_path, "none", [])
    assert files.shapefile(spark, str(tmp_path / "none.shp")).count() == 0
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    with pytest.raises(Exception, match="has no .dbf"):
        files.shapefile(spark, str(tmp_path / "empty.zip")).count()


def test_a_table_is_rewritten_while_it_is_read(spark, tmp_path):
    table = files.Versions(spark, str(tmp_path / "panel"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.write(spark.range(5).selectExpr("id", "id AS v"), ["v"])
    opened = table.read()
    step = lambda df: df.drop("z").withColumn("z", F.col("id") * 10)
    once = sorted(map(tuple, table.rewrite(step).select("id", "z").collect()))
    twice = sorted(map(tuple, table.rewrite(step).select("id", "z").collect()))
    assert once == twice == [(i, 10 * i) for i in range(5)] and sorted(table.read().columns) == ["id", "v", "z"]
    assert opened.columns == ["id", "v"] and opened.count() == 5  # a reader keeps what it opened
    before = table.current()

    def dies(df):
        return df.withColumn("z", F.when(F.col("id") < 3, F.col("z")).otherwise(F.raise_error(F.lit("lost"))))

    with pytest.raises(Exception, match="lost"):
        table.rewrite(dies)
    assert table.current() == before and table.read().agg(F.sum("z")).first()[0] == 100
    assert table.prune() >= 2 and table.read().count() == 5


def feature(kind, coordinates, **tags):
    return json.dumps({"type": "Feature", "properties": tags, "geometry": coordinates and {"type": kind, "coordinates": coordinates}})


def test_features_become_amenities(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    lines = [
        feature("Point", [1, 2], shop="convenience"), feature("Polygon", square, amenity="cafe", shop="supermarket"), feature("MultiPolygon", [square], leisure="park"), feature("LineString", [[0, 0], [5, 1], [6, 6]], public_transport="anything"),
        feature("MultiPoint", [[7, 8], [0, 0]], highway="bus_stop"), feature("Point", [3, 3], highway="residential"), feature("Point", None, amenity="cafe"), feature("Point", [4, 4], amenity="school", name="ä"), feature("MultiLineString", [[[1, 1], [2, 2]]], railway="station"),
    ]
    (tmp_path / "features.geojson").write_text('{"type": "FeatureCollection", "features": [\n' + ",\n".join(lines) + "\n]}\n")
    spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0)], "id long, x double, y double").write.parquet(str(tmp_path / "nodes.parquet"))
    spark.createDataFrame([(1, 2, 7.0)], "src long, dst long, length double").write.parquet(str(tmp_path / "edges.parquet"))
    nodes, edges, places = files.walking_network(spark, str(tmp_path))
    got = sorted(map(tuple, places.collect()))
    assert got == sorted([("grocery", 1, 2), ("grocery", 1, 1), ("food", 1, 1), ("park", 1, 1), ("transit", 5, 1), ("transit", 7, 8), ("education", 4, 4), ("transit", 2, 2)])
    assert (nodes.count(), edges.count()) == (2, 1)
    (tmp_path / "features.geojson").write_text(feature("Point", [3, 3], highway="residential"))
    with pytest.raises(ValueError, match="no feature"):
        files.walking_network(spark, str(tmp_path))
    places.sparkSession.createDataFrame([("park", 1.0, 1.0)], "category string, x double, y double").write.parquet(str(tmp_path / "amenities.parquet"))
    assert files.walking_network(spark, str(tmp_path))[2].count() == 1


def brute_corners(points):
    """Corners by their property: some line through the point has all others strictly on one side."""
    out = set()
    for p in set(points):
        angles = sorted(math.atan2(q[1] - p[1], q[0] - p[0]) for q in set(points) if q != p)
        gaps = [b - a for a, b in zip(angles, [*angles[1:], angles[0] + 2 * math.pi])] if angles else [2 * math.pi]
        if max(gaps) > math.pi + 1e-9:
            out.add(p)
    return out


@pytest.mark.parametrize("parts", [1, 9])
def test_hull_and_what_is_near(spark, parts):
    rng = np.random.default_rng(3)
    points = [tuple(map(float, p)) for p in rng.integers(0, 12, (150, 2))]
    df = spark.createDataFrame([*points, (None, 1.0), (2.0, float("nan"))], "x double, y double").repartition(parts)
    hull = spatial.convex_hull(df, "x", "y", fan=2)
    assert set(map(tuple, hull.tolist())) == brute_corners(points) and len(hull) == len(brute_corners(points))
    assert g.signed_area(hull) > 0
    asked = [tuple(map(float, p)) for p in rng.uniform(-4, 16, (300, 2))] + points
    got = [r.near for r in spark.createDataFrame(asked, "x double, y double").select(spatial.near_hull(hull, F.col("x"), F.col("y"), 1.5).alias("near")).collect()]

    def away(p):
        if g.contains([[hull.tolist()]], *p):
            return 0.0
        gaps = []
        for a, b in zip(hull, np.roll(hull, -1, axis=0)):
            t = np.clip(np.dot(p - a, b - a) / np.dot(b - a, b - a), 0, 1)
            gaps.append(math.dist(p, a + t * (b - a)))
        return min(gaps)

    assert got == [away(np.array(p)) <= 1.5 for p in asked]
    for few in ([], [(1.0, 2.0)], [(1.0, 2.0), (3.0, 4.0), (2.0, 3.0)]):
        hull = spatial.convex_hull(spark.createDataFrame(few, "x double, y double"), "x", "y")
        near = spark.createDataFrame([(1.0, 2.5)], "x double, y double").select(spatial.near_hull(hull, F.col("x"), F.col("y"), 1.0)).first()[0]
        assert len(hull) == min(len(few), 2) and near == bool(few)


def test_a_network_is_cut_to_the_parcels(spark):
    points = spark.createDataFrame([(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)], "x double, y double")
    nodes = spark.createDataFrame([(1, 1.0, 1.0), (2, 12.0, 0.0), (3, 90.0, 0.0)], "id long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (3, 1, 5.0)], "src long, dst long, length double")
    places = spark.createDataFrame([("food", 3.0, 3.0), ("food", 50.0, 50.0)], "category string, x double, y double")
    a, b, c = graph.around(points, nodes, edges, places, 5.0)
    assert [r.id for r in a.orderBy("id").collect()] == [1, 2] and [(r.src, r.dst) for r in b.collect()] == [(1, 2)] and c.count() == 1
    with pytest.raises(ValueError, match="no node"):
        graph.around(points.limit(0), nodes, edges, places)


def priced(spark, n=160):
    rng = np.random.default_rng(2)
    rows = [(f"p{i}", f"a{i}", 2017 + i % 3, float(rng.lognormal(6, 0.3)), "R1" if i % 3 else "CD", float(rng.lognormal(5, 0.2)), float(rng.uniform(100, 900)), float(rng.lognormal(7, 0.4)), 1900.0 + i % 50, f"N{i % 4}", float(i % 13), float(i // 13)) for i in range(n)]
    df = spark.createDataFrame(rows, "geo_pid string, parcel_id string, fy int, price_per_sqft double, land_use_code string, prior_sales_avg double, emp_dist_m double, living_area double, yr_built double, neighborhood_name string, centroid_x double, centroid_y double")
    return panel.with_year_dummies(df, range(2016, 2026))


def test_models_by_the_command_line(spark, tmp_path, capsys):
    priced(spark).write.parquet(str(tmp_path / "hedonic.parquet"))
    main(["model", "--input", str(tmp_path / "hedonic.parquet"), "--out", str(tmp_path / "out"), "--specs", "building", "--folds", "2", "--sample", "150"], spark)
    said = capsys.readouterr().out
    assert "== building: n 150" in said and "fold pooled" in said and "inflation" in said
    read = lambda name: spark.read.option("header", True).csv(f"{tmp_path}/out/hedonic_{name}")
    compared = read("comparison").collect()
    assert [r.spec for r in compared] == ["building"] and float(compared[0].n) == 150
    fit = stats.fit_spec(panel.sampled(priced(spark), 150, "parcel_id", 0), stats.SPECS["building"])
    kept = {r.term: float(r.coef) for r in read("coefficients_building").collect()}
    assert kept == pytest.approx(dict(zip(fit.terms, fit.beta.tolist())))
    assert {r.fold for r in read("spatial_cv_building").collect()} == {"0", "1", "pooled"} and read("vif_building").count() == len(fit.vif)


def test_steps_run_again_give_the_same_panel(spark, tmp_path, capsys):
    rows = [(f"{i:010d}", f"{i:010d}", 2020 + i % 2, float(i % 6) * 10, float(i // 6) * 10) for i in range(24)] + [("x", None, 2020, None, None)]
    spark.createDataFrame(rows, "parcel_id string, geo_pid string, fy int, centroid_x double, centroid_y double").write.parquet(str(tmp_path / "start"))
    spark.createDataFrame([(i, float(i) * 10, 0.0) for i in range(6)], "id long, x double, y double").write.parquet(str(tmp_path / "nodes.parquet"))
    spark.createDataFrame([(a, b, 10.0) for i in range(5) for a, b in ((i, i + 1), (i + 1, i))], "src long, dst long, length double").write.parquet(str(tmp_path / "edges.parquet"))
    (tmp_path / "features.geojson").write_text(feature("Point", [0, 0], leisure="park") + "\n" + feature("Point", [50, 0], shop="grocery"))
    args = ["enrich", "--panel", str(tmp_path / "panel"), "--start", str(tmp_path / "start"), "--walking", str(tmp_path), "--planar", "--steps", "employment", "walkability"]
    main(args, spark)
    table = files.Versions(spark, str(tmp_path / "panel"))
    show = lambda: sorted(map(str, table.read().select("parcel_id", "fy", "emp_dist_m", "walkability").collect()))
    once, columns = show(), table.read().columns
    main(args, spark)
    assert show() == once and sorted(table.read().columns) == sorted(columns) and len(once) == 25
    assert "walkability: 25 rows" in capsys.readouterr().out
    assert {r.parcel_id: r.walkability for r in table.read().collect()}["0000000000"] == 98.44  # of 100 and of 100 (1 - 50 / 1600)
    with pytest.raises(ValueError, match="no step"):
        pipeline.enriched(table.read(), "nothing")


def test_samples_are_drawn_by_the_seed(spark):
    df = spark.range(500).selectExpr("CAST(id AS STRING) AS parcel_id")
    one, two, other = (sorted(r[0] for r in panel.sampled(df.repartition(n), 50, "parcel_id", seed).collect()) for n, seed in ((2, 0), (7, 0), (2, 1)))
    assert one == two != other and len(one) == len(other) == 50


def test_choices_by_the_command_line(spark, tmp_path, capsys):
    rng = np.random.default_rng(8)
    kinds = ["No Development", "1 Unit", "2 Units"]
    rows = [(f"p{i}", 2022, kinds[int(rng.integers(0, 3))], bool(i % 9), float(rng.lognormal(12, 0.4)), float(rng.lognormal(7, 0.3)), float(i % 4)) for i in range(300)]
    spark.createDataFrame(rows, "geo_pid string, fy int, dev_outcome string, in_choice_set boolean, acquisition_cost double, land_sf double, dev_activity_600m double").write.parquet(str(tmp_path / "choices.parquet"))
    main(["choices", "--input", str(tmp_path / "choices.parquet"), "--out", str(tmp_path / "out")], spark)
    said = capsys.readouterr().out
    assert "multinomial: n 266" in said and "nested: n 266" in said
    read = spark.read.option("header", True).csv(f"{tmp_path}/out/choice_coefficients_nested").collect()
    assert {(r.alternative, r.term) for r in read} >= {("develop", "dissimilarity"), ("1 Unit", "log1p_dev_activity_600m")}


def test_counts_are_taken_while_writing(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i % 40}", 2016 + i % 5, None if i % 4 else 1.0) for i in range(200)], "geo_pid string, fy int, walkability double")
    for write in (files.write_sorted, files.write_years):
        found = write(rows, str(tmp_path / write.__name__), matched=("walkability", "not_there"))
        assert found == {"rows": 200, "keys": 40, "first_fy": 2016, "last_fy": 2020, "with_walkability": 50}
    accounts = spark.createDataFrame([("1000000000", 2021, "R1", 1e5, 900.0, 2000.0, "1950")], "parcel_id string, fy int, land_use_code string, assessed_total double, living_area double, land_sf double, yr_built string")
    shapes = spark.createDataFrame([("1000000000", 2021, [[[[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]]]], 4.5, 4.5)], f"geo_pid string, fy int, geom {spatial.GEOMETRY_TYPE}, centroid_x double, centroid_y double")
    pipeline.prepare(accounts, shapes, str(tmp_path / "run"), crs=None, cell=20.0)
    counts = {(r["table"], r["count"]): r["value"] and int(r["value"]) for r in spark.read.option("header", True).csv(f"{tmp_path}/run/run_counts").collect()}
    assert counts["panel", "rows"] == counts["panel", "with_centroid_x"] == counts["parcel_state", "keys"] == 1 and counts["hedonic_input", "rows"] == 0


def test_paths_must_exist(tmp_path):
    assert files.require_existing_path(tmp_path) == tmp_path.resolve()
    with pytest.raises(FileNotFoundError):
        files.require_existing_path(tmp_path / "nothing")
