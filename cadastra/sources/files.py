"""Assessor CSVs, GeoJSON and shapefile polygons, landed census JSON, tables and caches."""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from cadastra.functions import geometry
from cadastra.functions import scalars as s
from cadastra.functions.geometry import GEOMETRY_TYPE
from cadastra.operators import panel

# The parcel-id property of a year's shapes.
SHAPE_ID = {**{fy: "PID_LONG" for fy in range(2016, 2020)}, **{fy: "MAP_PAR_ID" for fy in range(2020, 2026)}}


def require_existing_path(path: str | Path) -> Path:
    """A local path, resolved; FileNotFoundError if it isn't there."""
    found = Path(path).expanduser().resolve()
    if not found.exists():
        raise FileNotFoundError(found)
    return found


def assessor_year(spark: SparkSession, path: str, fy: int, res_units: str | None = None) -> DataFrame:
    """One year's CSV, all text, under the unified names of its generation."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return panel.harmonized(raw, fy, fy >= panel.FIRST_NEW_YEAR, res_units)


def assessor_files(spark: SparkSession, folder: str, years: Sequence[int] | None = None, prefix: str = "property-assessment-fy") -> dict[int, str]:
    """Year to path of the CSVs in ``folder``, the year being the last four digits of the name; none is an error."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*.csv").load(folder).select("path")
    found = {int(y): p for p, y in listed.select("path", F.regexp_extract("path", r"(\d{4})\.csv$", 1)).collect() if y}  # a row for each year
    chosen = {y: found[y] for y in sorted(found) if years is None or y in set(years)}
    if not chosen:
        raise FileNotFoundError(f"no {prefix}*.csv in {folder} for the years asked for")
    return chosen


def assessor_panel(spark: SparkSession, folder: str, years: Sequence[int] | None = None, res_units: str | None = None) -> DataFrame:
    """All years under one another, money and areas as numbers, with year dummies."""
    files = assessor_files(spark, folder, years)
    stacked = panel.stacked([assessor_year(spark, p, y, res_units) for y, p in files.items()])
    return panel.with_year_dummies(stacked, panel.PANEL_YEARS)


def geojson(spark: SparkSession, path: str, properties: Sequence[str], feature_lines: bool = True) -> DataFrame:
    """``properties`` as text, geom and ordinal of each feature; Polygon and MultiPolygon become one type.

    ``feature_lines``: a feature to a line, as large exports are written, so the file splits; otherwise
    files are read whole, one task each. Properties a feature lacks are null. Ordinals follow the lines.
    """
    if feature_lines:
        lines = spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id())
        text = F.regexp_replace(F.trim("value"), r",$", "")
        rows = lines.select("ordinal", F.try_parse_json(text).alias("f")).where(F.try_variant_get("f", "$.geometry.type", "string").isNotNull())
    else:
        whole = spark.read.text(path, wholetext=True)
        listed = F.try_variant_get(F.try_parse_json("value"), "$.features", "array<variant>")
        rows = whole.select(F.posexplode(listed).alias("ordinal", "f")).withColumn("ordinal", F.col("ordinal").cast("long"))
    kind = F.try_variant_get("f", "$.geometry.type", "string")
    many = F.try_variant_get("f", "$.geometry.coordinates", GEOMETRY_TYPE)
    one = F.try_variant_get("f", "$.geometry.coordinates", "array<array<array<double>>>")
    geom = F.when(kind == "MultiPolygon", many).when(kind == "Polygon", F.array(one))
    values = [F.try_variant_get("f", f"$.properties.{p}", "string").alias(p) for p in properties]
    return rows.select(*values, geom.alias("geom"), "ordinal")


def parcel_shapes(spark: SparkSession, path: str, fy: int, crs=None) -> DataFrame:  # noqa: ANN001
    """geo_pid, fy, geom and the representative point as centroid_x, centroid_y; of repeated ids the first."""
    from cadastra.operators.spatial import representative_points

    name = SHAPE_ID[fy]
    raw = geojson(spark, path, [name])
    shapes = raw.select(s.normalize_pid(F.col(name)).alias("geo_pid"), F.lit(fy).alias("fy"), "geom", "ordinal")
    out = representative_points(panel.keep_first(shapes, ["geo_pid"], ["ordinal"]).drop("ordinal"))
    x, y = (F.col("px"), F.col("py")) if crs is None else crs.columns(F.col("px"), F.col("py"))
    return out.select("geo_pid", "fy", "geom", x.alias("centroid_x"), y.alias("centroid_y"))


def census_income(spark: SparkSession, path: str, acs_year: int) -> DataFrame:
    """GEOID, acs_year, income from a landed array of arrays whose first row names the columns.

    A payload that isn't such an array, or has no data row, is an error.
    """
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.from_json("value", "array<array<string>>").alias("a"))
    head = rows.select(F.col("a")[0], F.size("a")).first()
    if head is None or head[0] is None or head[1] < 2:
        raise ValueError(f"{path} holds no census table")
    at = {c: i for i, c in enumerate(head[0])}
    value = next(c for c in head[0] if c not in ("NAME", "state", "county", "tract"))
    data = rows.select(F.explode(F.slice("a", 2, F.size("a") - 1)).alias("r"))
    geoid = F.concat(s.zero_filled(F.col("r")[at["state"]], 2), s.zero_filled(F.col("r")[at["county"]], 3), F.col("r")[at["tract"]])
    return data.select(geoid.alias("GEOID"), F.lit(acs_year).alias("acs_year"), s.number(F.col("r")[at[value]]).alias("income"))


def price_table(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Prices by use: Parquet by its suffix, else CSV, with the ordinal of each row; no path, or nothing there, no table."""
    from pyspark.errors import AnalysisException

    if path is None:
        return None
    try:
        raw = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return raw.withColumn("ordinal", F.monotonically_increasing_id())


def county_tracts(tracts: DataFrame, county: str) -> DataFrame:
    """The tracts of a county by COUNTYFP; without that column or GEOID, or without rows, an error."""
    if not {"COUNTYFP", "GEOID"} <= set(tracts.columns):
        raise ValueError("tracts need COUNTYFP and GEOID")
    out = tracts.where(F.col("COUNTYFP") == county)
    if out.isEmpty():
        raise ValueError(f"no tracts of county {county}")
    return out


def tagged_features(spark: SparkSession, path: str, crs=None) -> DataFrame:  # noqa: ANN001
    """x, y and the tags (a map) of the features of a GeoJSON, a feature to a line: points as they are, others by a point of theirs.

    A polygon gives its representative point, a line its middle corner, a collection of points its first.
    Features without a geometry go. ``crs`` takes longitudes and latitudes to its plane.
    """
    from cadastra.operators.spatial import representative_points

    text = F.regexp_replace(F.trim("value"), r",$", "")
    rows = spark.read.text(path).select(F.try_parse_json(text).alias("f")).where(F.try_variant_get("f", "$.geometry.type", "string").isNotNull())
    kind = F.try_variant_get("f", "$.geometry.type", "string")
    of = lambda depth: F.try_variant_get("f", "$.geometry.coordinates", "array<" * depth + "double" + ">" * depth)
    middle = lambda points: F.get(points, F.floor(F.size(points) / 2).cast("int"))
    spot = F.when(kind == "Point", of(1)).when(kind == "MultiPoint", F.get(of(2), 0)).when(kind == "LineString", middle(of(2))).when(kind == "MultiLineString", middle(F.get(of(3), 0)))
    geom = F.when(kind == "MultiPolygon", of(4)).when(kind == "Polygon", F.array(of(3)))
    tags = F.from_json(F.try_variant_get("f", "$.properties", "variant").cast("string"), "map<string,string>")
    found = representative_points(rows.select(tags.alias("tags"), spot.alias("spot"), geom.alias("geom")))
    x, y = F.coalesce(F.get("spot", 0), "px"), F.coalesce(F.get("spot", 1), "py")
    placed = found.select("tags", x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return placed if crs is None else placed.select("tags", *(c.alias(n) for c, n in zip(crs.columns(F.col("x"), F.col("y")), ("x", "y"))))


def walking_network(spark: SparkSession, folder: str, crs=None) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: ANN001
    """Landed nodes (id, x, y), edges (src, dst, length) and amenities (category, x, y), Parquet files of these names.

    Instead of amenities.parquet there may be features.geojson, whose features are put into categories by
    their tags; its coordinates are those of ``crs``'s longitudes and latitudes.
    """
    from pyspark.errors import AnalysisException

    from cadastra.operators import enrich, graph

    root = folder.rstrip("/")
    nodes, edges = (spark.read.parquet(f"{root}/{name}.parquet").select(*columns) for name, columns in {"nodes": ("id", "x", "y"), "edges": ("src", "dst", "length")}.items())
    try:
        places = spark.read.parquet(f"{root}/amenities.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        places = enrich.amenities(tagged_features(spark, f"{root}/features.geojson", crs), graph.AMENITY_TAGS)
    return nodes, edges, places.select("category", "x", "y")


def counted(df: DataFrame, name: str, key: str = "geo_pid", matched: Sequence[str] = ()) -> tuple[DataFrame, Observation]:
    """``df`` with counts that are taken while it is written: rows, distinct keys (approximate, to 1 %), years and rows with a value of each of ``matched``."""
    seen = Observation(name)
    counts = [F.count(F.lit(1)).alias("rows")]
    if key in df.columns:
        counts.append(F.approx_count_distinct(key, 0.01).alias("keys"))
    if "fy" in df.columns:
        counts += [F.min("fy").alias("first_fy"), F.max("fy").alias("last_fy")]
    return df.observe(seen, *counts, *(F.count(c).alias(f"with_{c}") for c in matched if c in df.columns)), seen


def write_sorted(df: DataFrame, path: str, keys: Sequence[str] = ("geo_pid", "fy"), matched: Sequence[str] = ()) -> dict[str, object]:
    """``df`` as Parquet, sorted by ``keys`` over all its files; the counts of what was written."""
    # counted after the exchange: the sampling of its bounds would count rows twice
    out, seen = counted(df.repartitionByRange(*keys).sortWithinPartitions(*keys), path.rsplit("/", 1)[-1], matched=matched)
    out.write.mode("overwrite").parquet(path)
    return seen.get


def write_years(df: DataFrame, path: str, matched: Sequence[str] = ()) -> dict[str, object]:
    """A folder for each fiscal year, so that a read of one year opens no other; the counts of what was written."""
    out, seen = counted(df, path.rsplit("/", 1)[-1], matched=matched)
    out.write.mode("overwrite").partitionBy("fy").parquet(path)
    return seen.get


def load_or_build(spark: SparkSession, path: str, build, rebuild: bool = False, needed: Sequence[str] = (), keys: Sequence[str] = ("geo_pid", "fy"), counts: dict | None = None) -> DataFrame:  # noqa: ANN001
    """The table at ``path`` if there is one and it isn't to be rebuilt; else ``build()``, written there sorted by ``keys``.

    A kept table without the ``needed`` columns was built for another purpose: that is an error, not a rebuild.
    ``counts`` gets those of a table that was built.
    """
    from pyspark.errors import AnalysisException

    if not rebuild:
        try:
            kept = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            if missing := [c for c in needed if c not in kept.columns]:
                raise ValueError(f"{path} lacks {missing}; rebuild it")
            return kept
    built = write_sorted(build(), path, keys)
    if counts is not None:
        counts.update(built)
    return spark.read.parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A small table as one CSV with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


class ShapefileSource(DataSource):
    """``spark.read.format("shapefile").option("path", "x.shp" or "x.zip")``: attributes as text, geom, ordinal.

    Polygon records only. A file is read in ranges of ``records`` (an option, 5,000 by default) found in its
    .shx index, a task each; of an archive each task opens the members itself. With the option ``filters``
    (``shapefile`` sets it where Spark pushes filters to Python sources) equalities of attributes are tested
    before a shape is decoded. Files are read from a
    path that the executors see.
    """

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def _fields(self) -> list[tuple[str, int]]:
        with opened_member(self.options["path"], ".dbf") as f:
            return dbf_fields(f.read(65_536))

    def schema(self) -> str:
        return ", ".join(f"`{n}` string" for n, _ in self._fields()) + f", geom {GEOMETRY_TYPE}, ordinal long"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        kind = _FilteringReader if self.options.get("filters") == "true" else _ShapefileReader
        return kind(self.options["path"], int(self.options.get("records", "5000")))


def shapefile(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The shapes of a .shp or of an archive that holds one; see ``ShapefileSource``."""
    spark.dataSource.register(ShapefileSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("shapefile").options(path=path, filters=pushed, **options).load()


@contextmanager
def opened_member(path: str, end: str) -> Iterator[BinaryIO]:
    """The file of a shapefile with this ending: beside ``path``, or in the archive ``path``."""
    if not path.lower().endswith(".zip"):
        with open(path[:-4] + end, "rb") as f:
            yield f
        return
    with zipfile.ZipFile(path) as archive:
        found = [n for n in archive.namelist() if n.lower().endswith(end)]
        if not found:
            raise FileNotFoundError(f"{path} has no {end}")
        with archive.open(sorted(found)[0]) as f:
            yield f


def dbf_fields(head: bytes) -> list[tuple[str, int]]:
    """(name, width) of the attributes."""
    out, at = [], 32
    while head[at] != 0x0D:
        out.append((head[at : at + 11].split(b"\0")[0].decode("latin-1"), head[at + 16]))
        at += 32
    return out


@dataclass
class _Records(InputPartition):
    first: int
    last: int


class _ShapefileReader(DataSourceReader):
    def __init__(self, path: str, records: int) -> None:
        self.path, self.records, self.wanted = path, max(1, records), {}

    def partitions(self) -> list[InputPartition]:
        with opened_member(self.path, ".dbf") as f:
            count = struct.unpack_from("<I", f.read(12), 4)[0]
        return [_Records(i, min(i + self.records, count)) for i in range(0, count, self.records)] or [_Records(0, 0)]

    def _index(self, partition: _Records) -> bytes:
        """(place, size) of the records, in words; without an index file from the records' own heads."""
        try:
            with opened_member(self.path, ".shx") as f:
                f.seek(100 + 8 * partition.first)
                return f.read(8 * (partition.last - partition.first))
        except FileNotFoundError:
            out, at = [], 100
            with opened_member(self.path, ".shp") as f:
                for i in range(partition.last):
                    f.seek(at + 4)
                    size = struct.unpack(">i", f.read(4))[0]
                    out += [struct.pack(">ii", at // 2, size)] if i >= partition.first else []
                    at += 8 + 2 * size
            return b"".join(out)

    def read(self, partition: _Records) -> Iterator[tuple]:
        if partition.first == partition.last:
            return
        index = self._index(partition)
        with opened_member(self.path, ".dbf") as f:
            head = f.read(65_536)
            fields = dbf_fields(head)
            _, start, width = struct.unpack_from("<IHH", head, 4)
            f.seek(start + partition.first * width)
            rows = f.read(width * (partition.last - partition.first))
        with opened_member(self.path, ".shp") as shp:
            for i in range(partition.last - partition.first):
                where, values = i * width + 1, []
                for _, n in fields:
                    values.append(rows[where : where + n].decode("utf-8", "replace").strip() or None)
                    where += n
                if any(values[k] != self.wanted[name] for k, (name, _) in enumerate(fields) if name in self.wanted):
                    continue
                at, size = (2 * v for v in struct.unpack_from(">ii", index, 8 * i))
                shp.seek(at + 8)
                yield (*values, shape_record(shp.read(size)), partition.first + i)


class _FilteringReader(_ShapefileReader):
    def pushFilters(self, filters: list) -> Iterator:  # noqa: ANN001, N802
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, str):
                self.wanted[f.attribute[0]] = f.value
            yield f  # tested again by Spark, as a filter on geom or ordinal is


def shape_record(record: bytes) -> list | None:
    """Parts of a polygon record: clockwise rings are shells, the others holes of the shell before them."""
    kind = struct.unpack_from("<i", record)[0]
    if kind not in (5, 15, 25):
        return None
    rings, points = struct.unpack_from("<ii", record, 36)
    starts = [*struct.unpack_from(f"<{rings}i", record, 44), points]
    flat = struct.unpack_from(f"<{2 * points}d", record, 44 + 4 * rings)
    parts: list[list] = []
    for a, b in zip(starts, starts[1:]):
        ring = [[flat[2 * i], flat[2 * i + 1]] for i in range(a, b)]
        if geometry.signed_area(geometry.ring_array(ring)) <= 0 or not parts:
            parts.append([ring])
        else:
            parts[-1].append(ring)
    return parts


def wkt_polygons(c: Column) -> Column:
    """POLYGON and MULTIPOLYGON text as polygons; null and blank text is null, EMPTY has no parts.

    Numbers beyond x and y are left out; what isn't a number where one should be is an error.
    """
    inner = F.regexp_extract(c, r"(?s)\((.*)\)", 1)
    parts = F.when(F.rlike(c, F.lit(r"(?i)^\s*MULTI")), F.split(inner, r"\)\s*\)\s*,\s*\(\s*\(")).otherwise(F.array(inner))
    point = lambda text: F.transform(F.slice(F.split(F.trim(text), r"\s+"), 1, 2), lambda v: v.cast("double"))
    ring = lambda text: F.transform(F.split(F.regexp_replace(text, r"[()]", " "), ","), point)
    shape = F.transform(parts, lambda part: F.transform(F.split(part, r"\)\s*,\s*\("), ring))
    return F.when(c.isNull() | (F.trim(c) == ""), None).when(~F.contains(c, F.lit("(")), F.array().cast(GEOMETRY_TYPE)).otherwise(shape)


def wkt_point(c: Column) -> Column:
    """POINT text as a struct of x and y; null, blank and empty text is null."""
    values = F.split(F.trim(F.regexp_extract(c, r"(?is)^\s*POINT[^(]*\((.*)\)", 1)), r"\s+")
    return F.when(F.size(values) > 1, F.struct(F.get(values, 0).cast("double").alias("x"), F.get(values, 1).cast("double").alias("y")))


def wkt_text(geom: Column) -> Column:
    """Polygons as WKT: POLYGON for one part, MULTIPOLYGON for more, null for null."""
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string"))), ", "), F.lit(")"))
    parts = F.transform(geom, lambda part: F.concat(F.lit("("), F.array_join(F.transform(part, ring), ", "), F.lit(")")))
    several = F.concat(F.lit("MULTIPOLYGON ("), F.array_join(parts, ", "), F.lit(")"))
    return F.when(F.size(geom) == 0, F.lit("POLYGON EMPTY")).when(F.size(geom) == 1, F.concat(F.lit("POLYGON "), F.get(parts, 0))).when(geom.isNotNull(), several)


def read_wkt_csv(spark: SparkSession, path: str, column: str = "geometry") -> DataFrame:
    """A landed CSV whose ``column`` holds WKT: the other columns as text, and geom."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    if column not in raw.columns:
        raise ValueError(f"{path} has no column {column}")
    return raw.withColumn("geom", wkt_polygons(F.col(column))).drop(column)


def write_wkt_csv(df: DataFrame, path: str, geom: str = "geom", column: str = "geometry") -> None:
    """``df`` as CSV with its polygons as WKT under ``column``."""
    df.withColumn(column, wkt_text(F.col(geom))).drop(geom).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


class Versions:
    """A Parquet table that is rewritten while it is read: each write is a new folder, and a small file names the current one.

    The name is swapped by one rename, so a reader sees the old table or the new one and keeps what it has
    opened; a run that dies before the rename leaves the old table current.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):  # noqa: ANN202
        return self._at("CURRENT").getFileSystem(self._conf)

    def current(self) -> str | None:
        """The folder of the current version; None before the first."""
        if not self._files().exists(self._at("CURRENT")):
            return None
        return f"{self.path}/{self.spark.read.text(f'{self.path}/CURRENT').first()[0]}"

    def read(self) -> DataFrame:
        folder = self.current()
        if folder is None:
            raise FileNotFoundError(f"no version of {self.path}")
        return self.spark.read.parquet(folder)

    def write(self, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """``df``, which may read this table, as the new version."""
        name = f"v-{self._jvm.java.util.UUID.randomUUID().toString()}"
        df.write.partitionBy(*by).parquet(f"{self.path}/{name}")
        draft = self._at(f"{name}.name")
        stream = self._files().create(draft, True)
        stream.write(bytearray(name.encode()))
        stream.close()
        option = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = option
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self._conf).makeQualified(draft).toUri(), self._conf).rename(draft, self._at("CURRENT"), options)
        return self.read()

    def rewrite(self, step, by: Sequence[str] = ()) -> DataFrame:  # noqa: ANN001
        """``step`` of the current version as the new one."""
        return self.write(step(self.read()), by)

    def prune(self) -> int:
        """Deletes all but the current version, when no reader has an older one open; how many went."""
        keep, gone = (self.current() or "").rsplit("/", 1)[-1], 0
        for status in self._files().listStatus(self._at("")) if keep else ():
            name = status.getPath().getName()
            if name.startswith("v-") and name != keep:
                gone += bool(self._files().delete(status.getPath(), True))
        return gone
