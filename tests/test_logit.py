"""Choice models against likelihoods and fits written down independently."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.operators import logit

ALTERNATIVES = ["No Development", "1 Unit", "2 Units", "7-20 Units"]
NESTS = {"small": ["1 Unit", "2 Units"], "absent": ["elsewhere"]}


def brute_likelihood(theta, x, z, y, scale_free):
    """Sum of log chances, alternatives 1 and 2 in one nest; row by row and alternative by alternative."""
    t, a = x.shape[1], z.shape[2]
    beta = np.vstack([np.zeros(t), theta[: 3 * t].reshape(3, t)])
    gamma = theta[3 * t : 3 * t + a]
    lam = theta[3 * t + a] if scale_free else 1.0
    total = 0.0
    for xi, zi, yi in zip(x, z, y):
        v = [math.fsum(xi * b) + math.fsum(zj * gamma) for b, zj in zip(beta, zi)]
        inner = math.exp(v[1] / lam) + math.exp(v[2] / lam)
        whole = math.exp(v[0]) + inner**lam + math.exp(v[3])
        chance = math.exp(v[yi]) / whole if yi in (0, 3) else math.exp(v[yi] / lam) / inner * inner**lam / whole
        total += math.log(chance)
    return total


def slopes(f, theta, step=1e-5):
    return np.array([(f(theta + e) - f(theta - e)) / (2 * step) for e in np.eye(len(theta)) * step])


def drawn(n, seed, lam=0.5):
    """Rows whose choices follow a nested model."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([np.ones(n), rng.normal(size=n)])
    z = rng.normal(size=(n, 4, 1))
    beta = np.array([[0, 0], [0.3, 0.8], [0.1, -0.5], [-0.4, 0.6]])
    v = x @ beta.T + z[:, :, 0] * 0.7
    nest = np.array([0, 1, 1, 2])
    _, inside, nests, _ = logit.shares(v, nest, np.array([1, lam, 1]))
    p = inside * nests[:, nest]
    y = (rng.uniform(size=n)[:, None] > p.cumsum(axis=1)).sum(axis=1)
    return x, z, np.minimum(y, 3)


def as_rows(spark, x, z, y):
    rows = [(i, 2020, float(math.exp(a[1])), *(float(c) for c in b[:, 0]), ALTERNATIVES[k], "one") for i, (a, b, k) in enumerate(zip(x, z, y))]
    return spark.createDataFrame(rows, "geo_pid long, fy int, land_sf double, z0 double, z1 double, z2 double, z3 double, dev_outcome string, single string")


def of_rows(spark, x, z, y):
    order = sorted(ALTERNATIVES[1:])
    assert order == ALTERNATIVES[1:]
    return logit.choice_design(as_rows(spark, x, z, y), ["land_sf", "single"], attributes={"revenue": {a: f"z{i}" for i, a in enumerate(ALTERNATIVES)}})


@pytest.mark.parametrize("lam", [1.0, 0.4, 1.7])
def test_curvature_is_that_of_the_likelihood(lam):
    rng = np.random.default_rng(7)
    v, y, nest, scale = rng.normal(size=(6, 5)) * 2, rng.integers(0, 5, 6), np.array([0, 1, 1, 2, 2]), np.array([1.0, lam, 0.8])

    def value(v, scale):
        return logit.curvature(v, y, nest, scale)[0].sum()

    _, g, h, gl, hl, mixed = logit.curvature(v, y, nest, scale)
    e = 1e-5
    for k in range(5):
        move = np.zeros((6, 5))
        move[:, k] = e
        assert np.allclose((logit.curvature(v + move, y, nest, scale)[0] - logit.curvature(v - move, y, nest, scale)[0]) / (2 * e), g[:, k], atol=1e-7)
        assert np.allclose((logit.curvature(v + move, y, nest, scale)[1] - logit.curvature(v - move, y, nest, scale)[1]) / (2 * e), h[:, :, k], atol=1e-7)
        assert np.allclose((logit.curvature(v + move, y, nest, scale)[3] - logit.curvature(v - move, y, nest, scale)[3]) / (2 * e), mixed[:, k], atol=1e-7)
    for k in range(3):
        move = np.eye(3)[k] * e
        assert abs((value(v, scale + move) - value(v, scale - move)) / (2 * e) - gl[:, k].sum()) < 1e-6
        assert np.allclose((logit.curvature(v, y, nest, scale + move)[3] - logit.curvature(v, y, nest, scale - move)[3]) / (2 * e), hl[:, :, k], atol=1e-6)


@pytest.mark.parametrize("nests", [None, NESTS])
def test_fit_is_the_maximum_of_the_likelihood(spark, nests):
    x, z, y = drawn(1500, 1)
    d = of_rows(spark, x, z, y)
    assert d.terms == ["const", "log_land_sf"] and d.alternatives == ALTERNATIVES and d.attributes == ["revenue"]
    f = logit.fit_choice(d, nests)
    value = lambda t: brute_likelihood(t, x, z, y, nests is not None)
    assert f.stats["converged"] and abs(value(f.theta) - f.stats["log_likelihood"]) < 1e-6
    assert np.abs(slopes(value, f.theta)).max() < 1e-3
    bend = np.array([slopes(lambda t: slopes(value, t, 1e-4)[i], f.theta, 1e-4) for i in (0, len(f.theta) - 1)])
    errors = np.array([c[3] for c in f.coefficients])
    # rows 0 and last of the Hessian times the covariance must be rows of the unit matrix
    variance = np.linalg.inv(-logit.partial_sums(d.data, lambda pdf: f.layout.sums(f.theta, *logit._arrays(pdf, f.layout), pdf["y"].to_numpy()), 1 + len(f.theta) * (1 + len(f.theta)))[1 + len(f.theta) :].reshape(len(f.theta), -1))
    assert np.allclose(-bend @ variance, np.eye(len(f.theta))[[0, -1]], atol=1e-2) and np.allclose(errors, np.sqrt(np.diag(variance)), rtol=1e-6)
    names = [(a, t) for a, t, *_ in f.coefficients]
    assert names[:2] == [("1 Unit", "const"), ("1 Unit", "log_land_sf")] and ("", "revenue") in names and (("small", "dissimilarity") in names) == (nests is not None)
    if nests:
        lam = f.coefficients[-1]
        assert abs(lam[2] - 0.5) < 3 * lam[3] and f.stats["log_likelihood"] > logit.fit_choice(d).stats["log_likelihood"]


def test_sums_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).select(F.col("id").cast("double").alias("v")).repartition(70)
    out = logit.partial_sums(rows, lambda pdf: np.array([pdf["v"].sum(), len(pdf)]), 2, fan=4)
    assert out.tolist() == [499500.0, 1000.0]


def test_rows_and_terms_that_stay_out(spark):
    rows = [(1, "No Development", 10.0, "a"), (2, "1 Unit", 12.0, None), (3, "1 Unit", 9.0, "b"), (4, "No Development", 14.0, "a"), (5, None, 9.0, "a"), (6, "1 Unit", None, "a"), (7, "2 Units", -1.0, "a"), (8, "No Development", 8.0, "b"), (9, "1 Unit", 30.0, "a"), (10, "No Development", 9.0, None)]
    df = spark.createDataFrame(rows, "geo_pid long, dev_outcome string, land_sf double, zone string")
    d = logit.choice_design(df, ["land_sf", "zone"])
    assert d.alternatives == ["No Development", "1 Unit", "2 Units"] and sorted(r.geo_pid for r in d.data.collect()) == [1, 2, 3, 4, 8, 9, 10]
    assert d.terms == ["const", "log_land_sf", "zone_b", "zone_<NA>"]
    f = logit.fit_choice(d)
    # nobody of the complete rows chose two units: its chance goes to nothing
    assert logit.predicted(d, f).agg(F.max(F.col("p")[2])).first()[0] < 1e-3
    with pytest.raises(KeyError):
        logit.choice_design(df, ["nothing"])
    with pytest.raises(ValueError):
        logit.choice_design(df.where("dev_outcome <> 'No Development'"), ["land_sf"])
    with pytest.raises(ValueError):
        logit.fit_choice(logit.choice_design(df.withColumn("land_sf", F.lit(-1.0)), ["land_sf"]))
    with pytest.raises(ValueError):
        logit.fit_choice(d, {"a": ["1 Unit"], "b": ["1 Unit"]})


def test_fitted_sums_are_observed_sums(spark):
    x, z, y = drawn(400, 2)
    d = of_rows(spark, x, z, y)
    got = {(r.alternative, r.term): r.fitted for r in logit.totals(d, logit.fit_choice(d)).collect()}
    for j, a in enumerate(ALTERNATIVES):
        for t, term in enumerate(d.terms):
            assert abs(got[a, term] - x[y == j, t].sum()) < 1e-6


def test_a_dissimilarity_may_end_at_its_bound(spark):
    # one alternative of the nest is better for all, so that the nest's choices are as of one without chance
    x, z, y = drawn(300, 3)
    z = np.zeros_like(z)
    y = np.where(y == 2, 1, y)
    y[:2] = 2
    d = of_rows(spark, x, z, y)
    f = logit.fit_choice(d, NESTS)
    got = {}
    for r in logit.totals(d, f).collect():
        key = (r.alternative if r.alternative in ("No Development", "7-20 Units") else "small", r.term)
        got[key] = got.get(key, 0) + r.fitted
    for j, a in ((0, "No Development"), (3, "7-20 Units")):
        for t, term in enumerate(d.terms):
            assert abs(got[a, term] - x[y == j, t].sum()) < 1e-3
    assert f.coefficients[-1][2] >= logit.SMALLEST and f.stats["log_likelihood"] >= logit.fit_choice(d).stats["log_likelihood"] - 1e-9
