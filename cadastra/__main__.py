"""``python -m cadastra prepare|enrich|model|choices``: the preparation from landed files, and the models on its outputs."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from cadastra.functions.crs import MASSACHUSETTS
from cadastra.operators import panel, stats
from cadastra.plans import pipeline
from cadastra.sources import files


def add_layers(p: argparse.ArgumentParser) -> None:
    p.add_argument("--neighborhoods", help="GeoJSON")
    p.add_argument("--zoning", help="shapefile")
    p.add_argument("--tracts", help="folder of tracts-YYYY.zip or .shp, by vintage")
    p.add_argument("--income", help="folder of income-YYYY.json, by vintage")
    p.add_argument("--county", default="025", help="of the tracts")
    p.add_argument("--walking", help="folder of nodes, edges, and amenities or features.geojson")
    p.add_argument("--vintages", type=int, nargs="*", default=[], help="of tracts and income")
    p.add_argument("--planar", action="store_true", help="coordinates are in metres already")
    for flag, text in (("--skip-income", "no tracts and income"), ("--skip-walkability", "no walking scores")):
        p.add_argument(flag, action="store_true", help=text)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="cadastra", description=__doc__)
    steps = parser.add_subparsers(dest="step", required=True)
    p = steps.add_parser("prepare", help="panel, state and the two model inputs")
    p.add_argument("--assessors", required=True, help="folder of property-assessment-fyYYYY.csv")
    p.add_argument("--parcels", required=True, help="folder of parcels-fyYYYY.geojson")
    p.add_argument("--prices", help="market prices by use, Parquet or CSV")
    p.add_argument("--out", required=True)
    p.add_argument("--years", type=int, nargs="*", help="fiscal years, all by default")
    for flag, text in (("--skip-prep", "only the panel"), ("--rebuild-state", "not the state that is there")):
        p.add_argument(flag, action="store_true", help=text)
    add_layers(p)
    e = steps.add_parser("enrich", help="steps of the panel again, each as a new version of the table")
    e.add_argument("--panel", required=True, help="folder of the panel's versions")
    e.add_argument("--start", help="Parquet panel to begin with, if there is no version yet")
    e.add_argument("--steps", nargs="+", choices=pipeline.STEPS, required=True)
    add_layers(e)
    m = steps.add_parser("model", help="coefficients, statistics, inflation factors and cross-validation")
    m.add_argument("--input", required=True, help="hedonic_input.parquet")
    m.add_argument("--out", required=True)
    m.add_argument("--specs", nargs="*", choices=sorted(stats.SPECS), default=sorted(stats.SPECS))
    m.add_argument("--folds", type=int, default=5)
    m.add_argument("--seed", type=int, default=0)
    m.add_argument("--sample", type=int, help="rows, for a quick look")
    c = steps.add_parser("choices", help="multinomial and nested logit of what was developed")
    c.add_argument("--input", required=True, help="devchoice_input.parquet")
    c.add_argument("--out", required=True)
    c.add_argument("--variables", nargs="*", default=["acquisition_cost", "land_sf", "dev_activity_600m"])
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("cadastra").config("spark.sql.python.filterPushdown.enabled", "true").getOrCreate()
    if args.step == "model":
        rows = spark.read.parquet(args.input)
        if args.sample:
            rows = panel.sampled(rows, args.sample, "parcel_id", args.seed)
        pipeline.model_reports(spark, rows, args.out, {name: stats.SPECS[name] for name in args.specs}, args.folds, args.seed, print)
        return
    if args.step == "choices":
        for name, found in pipeline.choice_reports(spark, spark.read.parquet(args.input), args.out, args.variables).items():
            print(f"{name}: " + ", ".join(f"{k} {v:,.4f}" for k, v in found.items()))
        return
    layers = layers_of(spark, args)
    if args.step == "enrich":
        table = files.Versions(spark, args.panel)
        if table.current() is None:
            table.write(spark.read.parquet(args.start), ["fy"])
        for step in args.steps:
            rows = table.rewrite(lambda df: pipeline.enriched(df, step, **layers), ["fy"])  # noqa: B023
            print(f"{step}: {rows.count():,} rows in {table.current()}")
        return
    years = sorted(files.assessor_files(spark, args.assessors, args.years))
    shapes = pipeline.together([files.parcel_shapes(spark, f"{args.parcels}/parcels-fy{y}.geojson", y, layers["crs"]) for y in years])
    written = pipeline.prepare(files.assessor_panel(spark, args.assessors, args.years), shapes, args.out, files.price_table(spark, args.prices), args.skip_prep, args.rebuild_state, **layers)
    for name, n in sorted(written.items()):
        print(f"{name}: {n:,} rows")


def layers_of(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The tables of the layers that the arguments name."""
    layers: dict = {"crs": None if args.planar else MASSACHUSETTS}
    if args.neighborhoods:
        layers["neighborhoods"] = files.geojson(spark, args.neighborhoods, ["name", "neighborhood_id"], feature_lines=False)
    if args.zoning:
        layers["zoning"] = files.shapefile(spark, args.zoning)
    if args.tracts and args.income and not args.skip_income:
        end = lambda y: next((e for e in (".zip", ".shp") if os.path.exists(f"{args.tracts}/tracts-{y}{e}")), ".shp")
        shape = lambda y: files.county_tracts(files.shapefile(spark, f"{args.tracts}/tracts-{y}{end(y)}"), args.county)
        layers["tracts"] = pipeline.together([pipeline.of_vintage(shape(y), y) for y in args.vintages])
        layers["income"] = pipeline.together([files.census_income(spark, f"{args.income}/income-{y}.json", y) for y in args.vintages])
    if args.walking and not args.skip_walkability:
        layers["walking"] = files.walking_network(spark, args.walking, layers["crs"])
    return layers


if __name__ == "__main__":
    main()
