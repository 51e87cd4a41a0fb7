"""The whole preparation as one chain of lazy tables, and the models on it.

Steps take and return DataFrames; ``prepare`` writes the panel, the state and the two model inputs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions.crs import MASSACHUSETTS, Conic
from cadastra.operators import choices, enrich, graph, logit, panel, prices, stats
from cadastra.sources import files


STEPS = ("neighborhood", "income", "employment", "zoning", "walkability")


def enriched(rows: DataFrame, step: str, neighborhoods: DataFrame | None = None, tracts: DataFrame | None = None, income: DataFrame | None = None, zoning: DataFrame | None = None, walking: tuple[DataFrame, DataFrame, DataFrame] | None = None, crs: Conic | None = MASSACHUSETTS) -> DataFrame:
    """``rows`` with the columns of one of ``STEPS``, which replace those of an earlier run; without the step's inputs as they are."""
    if step not in STEPS:
        raise ValueError(f"no step {step}")
    if step == "neighborhood" and neighborhoods is not None:
        return enrich.with_neighborhood(rows, neighborhoods, crs=crs)
    if step == "income" and tracts is not None and income is not None:
        return enrich.with_income(rows, tracts, income, crs=crs)
    if step == "employment":
        return enrich.with_employment_distance(rows)
    if step == "zoning" and zoning is not None:
        return enrich.with_zoning(rows, zoning, crs=crs)
    if step == "walkability" and walking is not None:
        points = panel.first_points(rows).withColumnsRenamed({"centroid_x": "x", "centroid_y": "y"})
        scores = graph.walk_scores(points, *graph.around(points, *walking))
        return enrich.spread_back(rows, scores, ["geo_pid"], ["walkability"])
    return rows


def build_panel(accounts: DataFrame, shapes: DataFrame, **layers) -> DataFrame:  # noqa: ANN003
    """Accounts with their parcels and every enrichment whose inputs are given (as to ``enriched``); the others' columns are absent."""
    return reduce(lambda out, step: enriched(out, step, **layers), STEPS, panel.with_geo_key(accounts, shapes.drop("geom")))


def together(tables: Sequence[DataFrame]) -> DataFrame:
    """Yearly tables under one another, by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def of_vintage(tracts: DataFrame, acs_year: int) -> DataFrame:
    return tracts.withColumn("acs_year", F.lit(acs_year))


def hedonic_input(state: DataFrame, years: Sequence[int] = prices.DUMMY_YEARS) -> DataFrame:
    return prices.price_panel(state, years=years)


def choice_input(state: DataFrame, shapes: DataFrame, price_table: DataFrame | None = None, cell: float = 100.0) -> DataFrame:
    """Choices of the last years with activity of the years before and market prices, from one overlay of all years."""
    before = choices.best_predecessors(shapes, cell)
    events = choices.development_events(state, before)
    return choices.with_market_price(choices.with_activity(choices.choice_set(state, before), events), price_table)


MATCHED = ("geo_pid", "centroid_x", "neighborhood_name", "median_hh_income", "zoning_use", "walkability", "prior_sales_avg", "market_price_psf", "in_choice_set")


def prepare(accounts: DataFrame, shapes: DataFrame, out: str, price_table: DataFrame | None = None, skip_prep: bool = False, rebuild_state: bool = False, cell: float = 100.0, **layers) -> dict[str, int]:  # noqa: ANN003
    """Writes panel.parquet by year, parcel_geometry.parquet, and unless ``skip_prep`` parcel_state.parquet,
    hedonic_input.parquet and devchoice_input.parquet under ``out``; the rows of each.

    ``layers`` are those of ``build_panel``. A state that is there is used as it is, unless ``rebuild_state``.
    Rows, parcels, years and matches are counted while the tables are written and stand in run_counts.
    """
    spark, root = accounts.sparkSession, out.rstrip("/")
    counts = {"panel": files.write_years(build_panel(accounts, shapes, **layers), f"{root}/panel.parquet", MATCHED)}
    counts["parcel_geometry"] = files.write_years(shapes, f"{root}/parcel_geometry.parquet", MATCHED)
    if not skip_prep:
        rows, geometry = (spark.read.parquet(f"{root}/{name}.parquet") for name in counts)
        needed = [c for c in prices.ATTRIBUTES if c in rows.columns and c != "land_use_code"]
        built: dict[str, object] = {}
        state = files.load_or_build(spark, f"{root}/parcel_state.parquet", lambda: panel.parcel_state(rows), rebuild_state, needed, counts=built)
        counts["parcel_state"] = built or {"rows": state.count()}  # of a kept table, from its footers
        for name, made in (("hedonic_input", hedonic_input(state)), ("devchoice_input", choice_input(state, geometry, price_table, cell))):
            counts[name] = files.write_sorted(made, f"{root}/{name}.parquet", matched=MATCHED)
    lines = [(table, what, None if v is None else int(v)) for table, found in counts.items() for what, v in found.items()]
    files.write_report(spark.createDataFrame(lines, "table string, count string, value long"), f"{root}/run_counts")
    return {table: int(found["rows"]) for table, found in counts.items() if table != "parcel_geometry"}


def choice_reports(spark: SparkSession, df: DataFrame, out: str, variables: Sequence[str], nested: bool = True) -> dict[str, dict[str, float]]:
    """Coefficients and statistics of the multinomial and, unless there is a single way to develop, the nested choice model."""
    d = logit.choice_design(df.where("in_choice_set"), variables)
    done = {}
    for name, nests in (("multinomial", None), ("nested", {"develop": d.alternatives[1:]})):
        if nests and (not nested or len(d.alternatives) < 3):
            continue
        f = logit.fit_choice(d, nests)
        done[name] = f.stats
        files.write_report(spark.createDataFrame([(name, *row) for row in f.coefficients], "model string, alternative string, term string, coef double, std_err double, z double, p_value double"), f"{out}/choice_coefficients_{name}")
        files.write_report(spark.createDataFrame([(name, k, float(v)) for k, v in f.stats.items()], "model string, statistic string, value double"), f"{out}/choice_fit_stats_{name}")
    return done


def report_lines(name: str, f: stats.Fit, folds: Sequence[Mapping[str, object]] = ()) -> list[str]:
    """What a reader of the console wants of a fit: its statistics, estimates, largest inflation factors and folds."""
    show = lambda v: v if isinstance(v, str) else "-" if v is None else f"{v:,.4f}" if isinstance(v, float) else f"{v:,}"
    lines = [f"== {name}: " + ", ".join(f"{k} {show(float(f.stats[k]) if k not in ('n', 'k') else int(f.stats[k]))}" for k in ("n", "k", "r2", "r2_adj", "aic", "rmse", "moran_i", "moran_p") if k in f.stats)]
    lines += [f"  {term:<40} {coef:>12.5f} {se:>12.5f} {p:>8.4f}" for term, coef, se, _, p, *_ in f.coefficients if term not in stats.DUMMIES]
    lines += [f"  inflation {term}: {show(float(v))}" for term, v in f.vif[:10]]
    return lines + [f"  fold {r['fold']}: " + ", ".join(f"{k} {show(r[k])}" for k in ("n_test", "rmse", "mae", "r2", "moran_p")) for r in folds]


COMPARED = ("n", "k", "r2", "r2_adj", "aic", "bic", "rmse", "mae", "durbin_watson", "moran_i", "moran_p")


def model_reports(spark: SparkSession, df: DataFrame, out: str, specs: Mapping[str, Sequence[str]] = stats.SPECS, folds: int = 5, seed: int = 0, say=lambda line: None) -> None:  # noqa: ANN001
    """Coefficients, statistics, inflation factors and cross-validation of each specification, written and told to ``say`` as each is done; then their comparison, the least AIC first."""
    compared = []
    for name, variables in specs.items():
        f = stats.fit_spec(df, variables)
        table = lambda rows, schema: spark.createDataFrame([(name, *(v if v is None or isinstance(v, (str, int)) else float(v) for v in r)) for r in rows], "spec string, " + schema)  # noqa: E731, B023
        files.write_report(table(f.coefficients, "term string, coef double, std_err double, t double, p_value double, ci_low double, ci_high double"), f"{out}/hedonic_coefficients_{name}")
        files.write_report(table([(k, float(v)) for k, v in f.stats.items()], "statistic string, value double"), f"{out}/hedonic_fit_stats_{name}")
        files.write_report(table(f.vif, "term string, vif double"), f"{out}/hedonic_vif_{name}")
        cv = stats.spatial_cv(df, variables, folds, seed) if folds > 1 else []
        if cv:
            rows = [(r["fold"], int(r["n_train"]), int(r["n_test"]), *(None if r[c] is None else float(r[c]) for c in ("rmse", "mae", "r2", "moran_i", "moran_p"))) for r in cv]
            files.write_report(table(rows, "fold string, n_train long, n_test long, rmse double, mae double, r2 double, moran_i double, moran_p double"), f"{out}/hedonic_spatial_cv_{name}")
        for line in report_lines(name, f, cv):
            say(line)
        compared.append((name, *(float(f.stats[c]) for c in COMPARED)))
    files.write_report(spark.createDataFrame(compared, "spec string, " + ", ".join(f"{c} double" for c in COMPARED)).orderBy("aic"), f"{out}/hedonic_comparison")
