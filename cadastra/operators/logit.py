"""Developer-choice models: multinomial and nested logit by Newton's method on Spark's partial sums.

An alternative's utility is a row's terms times the alternative's own coefficients, plus attributes of
the alternative with coefficients that all share. In a nest the utilities are divided by the nest's
dissimilarity, its inclusive value is the log sum of what results, and nests compete by inclusive values
times dissimilarity. With every dissimilarity at 1 the model is the multinomial logit.

Each Newton step is one pass: tasks add up log likelihood, gradient and Hessian of their rows in numpy,
one row a partition, and those rows are summed in groups, level by level, so that the driver gets a
bounded number of arrays however many partitions there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions import scalars as s
from cadastra.session import durable

from .stats import LEVEL_VARIABLES, degenerate_free, levels

OUTCOME, BASE = "dev_outcome", "No Development"
LOG_VARIABLES = {"acquisition_cost", "land_sf", "living_area", "gross_area", "assessed_total", "market_price_psf", "median_hh_income", "emp_dist_m", "units"}
COUNTS = {"dev_activity_600m", "dev_units_600m"}  # zeros are usual: log(1 + x)
FAN = 32  # partial sums that one task, and at last the driver, adds up
SMALLEST = 0.05  # dissimilarity


@dataclass
class ChoiceDesign:
    """``data``: complete rows with ``x`` (terms), ``z`` (attributes by alternative), ``y`` (number of the choice) and what is carried."""

    data: DataFrame
    terms: list[str]
    alternatives: list[str]  # the first is the base
    attributes: list[str] = field(default_factory=list)


def choice_design(
    df: DataFrame, variables: Sequence[str], outcome: str = OUTCOME, base: str = BASE, attributes: Mapping[str, Mapping[str, str]] | None = None, carry: Sequence[str] = ("geo_pid", "fy"),
) -> ChoiceDesign:
    """Rows of choices with const, logs, levels and one-hot categories without their first level.

    ``attributes`` give for a name each alternative's column; an alternative without one has 0. Numbers in
    ``LOG_VARIABLES`` enter as logs and must be positive, those in ``COUNTS`` as log(1 + x), other numbers as
    they are. A missing category is a level of its own; rows with another missing term, attribute or choice
    go. Constant columns and repeats of earlier ones are dropped. Alternatives are those chosen at all.
    """
    columns: dict[str, Column] = {"const": F.lit(1.0)}
    for v in variables:
        if v not in df.columns:
            raise KeyError(v)
        numeric = df.schema[v].dataType.typeName() != "string"
        value = F.col(v).cast("double")
        if v in LOG_VARIABLES:
            columns[f"log_{v}"] = s.log_positive(value)
        elif v in COUNTS:
            columns[f"log1p_{v}"] = F.log1p(value)
        elif numeric or v in LEVEL_VARIABLES:
            columns[v] = value
        else:
            known, missing = levels(df, v)
            for name in [*known, *([None] if missing else [])][1:]:
                hit = F.col(v).isNull() if name is None else F.coalesce(F.col(v) == name, F.lit(False))
                columns[f"{v}_{'<NA>' if name is None else name}"] = hit.cast("double")
    chosen = sorted(r[0] for r in df.where(F.col(outcome).isNotNull()).select(outcome).distinct().collect())  # few
    if base not in chosen:
        raise ValueError(f"no row has the base {base!r}")
    alternatives = [base, *(a for a in chosen if a != base)]
    attributes = attributes or {}
    z = F.array(*(F.array(*(F.col(of[a]).cast("double") if a in of else F.lit(0.0) for of in attributes.values())) for a in alternatives)) if attributes else F.array().cast("array<array<double>>")
    kept = [c for c in carry if c in df.columns]
    y = F.array_position(F.array(*map(F.lit, alternatives)), F.col(outcome)).cast("int") - 1
    rows = df.select(*kept, y.alias("y"), F.array(*columns.values()).alias("_terms"), z.alias("z"))
    bad = lambda v: v.isNull() | F.isnan(v)
    rows = durable(rows.where(F.col("y").isNotNull() & ~F.exists("_terms", bad) & ~F.exists(F.flatten("z"), bad)))
    names = [f"_t{i}" for i in range(len(columns))]
    keep = {"_t0", *degenerate_free(rows.select(*(F.col("_terms")[i].alias(n) for i, n in enumerate(names))), names[1:])}
    at = [i for i, n in enumerate(names) if n in keep]
    data = rows.select(*kept, "y", F.array(*(F.col("_terms")[i] for i in at)).alias("x"), "z")
    return ChoiceDesign(data, [t for i, t in enumerate(columns) if i in at], alternatives, list(attributes))


def _log_sums(v: np.ndarray, groups: np.ndarray, count: int) -> np.ndarray:
    out = np.full((len(v), count), -np.inf)
    for m in range(count):
        part = v[:, groups == m]
        top = part.max(axis=1)
        out[:, m] = top + np.log(np.exp(part - top[:, None]).sum(axis=1))
    return out


def shares(v: np.ndarray, nest: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inclusive values, shares in the nest, shares of nests, log of the sum over nests) of utilities ``v``."""
    inclusive = _log_sums(v / scale[nest], nest, len(scale))
    inside = np.exp(v / scale[nest] - inclusive[:, nest])
    worth = scale * inclusive
    total = _log_sums(worth, np.zeros(len(scale), int), 1)
    return inclusive, inside, np.exp(worth - total), total[:, 0]


def curvature(v: np.ndarray, y: np.ndarray, nest: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each row's log likelihood and its derivatives: by utilities (first, second), by dissimilarities (first, second), mixed."""
    n, j, m = len(v), len(nest), len(scale)
    inclusive, q, big, total = shares(v, nest, scale)
    p = q * big[:, nest]
    own = nest[y]
    lam = scale[own][:, None]
    took = np.zeros((n, j))
    took[np.arange(n), y] = 1
    mine = np.zeros((n, m))
    mine[np.arange(n), own] = 1
    with_me = mine[:, nest]
    vy = v[np.arange(n), y][:, None]
    value = (vy / lam)[:, 0] - inclusive[np.arange(n), own] + scale[own] * inclusive[np.arange(n), own] - total
    g = took / lam + (1 - 1 / lam) * q * with_me - p
    together = (nest[:, None] == nest[None]).astype(float)
    dq = (np.eye(j)[None] - q[:, None, :] * together) / scale[nest][None, :, None]  # of log q_j by v_k
    h = ((1 - 1 / lam) * with_me * q)[:, :, None] * dq - p[:, :, None] * (dq + q[:, None, :] * together - p[:, None, :])
    of = (nest[:, None] == np.arange(m)[None]).astype(float)
    mean = (q * v) @ of
    gap = v - mean[:, nest]
    spread = (q * gap * gap) @ of
    slope = inclusive - mean / scale
    gl = mine * ((mean - vy) / scale**2 + slope) - big * slope
    pull = big * slope
    hl = pull[:, :, None] * pull[:, None, :]
    at = np.arange(m)
    hl[:, at, at] = mine * (2 * (vy - mean) / scale**3 - spread / scale**4 + spread / scale**3) - big * (1 - big) * slope**2 - big * spread / scale**3
    lean = q * gap / scale[nest]  # share times distance from the nest's mean
    inner = with_me * (-(took - q - lean) / scale[nest] ** 2 - lean / scale[nest]) + big[:, nest] * lean / scale[nest] - (big * slope)[:, nest] * q
    mixed = inner[:, :, None] * of[None] + pull[:, None, :] * p[:, :, None]
    return value, g, h, gl, hl, mixed


class Layout:
    """Where each parameter stands: terms of each alternative but the base, attributes, free dissimilarities."""

    def __init__(self, d: ChoiceDesign, nests: Mapping[str, Sequence[str]] | None):
        listed = {name: list(members) for name, members in (nests or {}).items()}
        known = [a for members in listed.values() for a in members]
        if len(set(known)) < len(known):
            raise ValueError("an alternative stands in two nests")
        listed = {name: [a for a in members if a in d.alternatives] for name, members in listed.items()}
        listed |= {a: [a] for a in d.alternatives if a not in known}
        self.nests = {name: members for name, members in listed.items() if members}
        self.nest = np.array([next(i for i, m in enumerate(self.nests.values()) if a in m) for a in d.alternatives])
        self.free = [i for i, m in enumerate(self.nests.values()) if len(m) > 1] if nests else []
        self.j, self.t, self.a = len(d.alternatives), len(d.terms), len(d.attributes)
        self.size = (self.j - 1) * self.t + self.a + len(self.free)

    def parts(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(alternatives x terms, attributes, dissimilarities)."""
        k = (self.j - 1) * self.t
        scale = np.ones(len(self.nests))
        scale[self.free] = theta[k + self.a :]
        return np.vstack([np.zeros((1, self.t)), theta[:k].reshape(self.j - 1, self.t)]), theta[k : k + self.a], scale

    def utilities(self, theta: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        beta, gamma, _ = self.parts(theta)
        return x @ beta.T + (z @ gamma if self.a else 0.0)

    def sums(self, theta: np.ndarray, x: np.ndarray, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        """[log likelihood, gradient, Hessian row by row] of the rows."""
        value, g, h, gl, hl, mixed = curvature(self.utilities(theta, x, z), y, self.nest, self.parts(theta)[2])
        k, t, a = (self.j - 1) * self.t, self.t, self.a
        grad, hess = np.zeros(self.size), np.zeros((self.size, self.size))
        free = self.free
        lam = slice(k + a, None)
        for j in range(1, self.j):
            rows = slice((j - 1) * t, j * t)
            grad[rows] = x.T @ g[:, j]
            for i in range(1, j + 1):
                block = x.T @ (h[:, j, i, None] * x)
                hess[rows, (i - 1) * t : i * t] = block
                hess[(i - 1) * t : i * t, rows] = block.T
            if a:
                hess[rows, k : k + a] = x.T @ np.einsum("nk,nka->na", h[:, j], z)
            hess[rows, lam] = x.T @ mixed[:, j, free]
        if a:
            grad[k : k + a] = np.einsum("nj,nja->a", g, z)
            hess[k : k + a, k : k + a] = np.einsum("nja,njk,nkb->ab", z, h, z, optimize=True)
            hess[k : k + a, lam] = np.einsum("nja,njm->am", z, mixed[:, :, free])
            hess[k : k + a, :k] = hess[:k, k : k + a].T
        grad[lam] = gl[:, free].sum(axis=0)
        hess[lam, lam] = hl[:, free][:, :, free].sum(axis=0)
        hess[lam, : k + a] = hess[: k + a, lam].T
        return np.concatenate([[value.sum()], grad, hess.ravel()])


def _arrays(pdf: pd.DataFrame, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack(pdf["x"].to_list()).astype(np.float64)
    z = np.stack([np.stack(r) for r in pdf["z"]]).astype(np.float64) if layout.a else np.zeros((len(pdf), 0, 0))
    return x, z


def partial_sums(rows: DataFrame, make, width: int, fan: int = FAN) -> np.ndarray:
    """The sum of ``make(pdf)``, an array of ``width``, over all batches of ``rows``, without more than ``fan`` arrays in one place."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total, seen = np.zeros(width), False
        for pdf in batches:
            if len(pdf):
                total, seen = total + make(pdf), True
        if seen:
            yield pd.DataFrame({"at": [TaskContext.get().partitionId()], "v": [total]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [int(pdf["at"].iloc[0]) // fan], "v": [np.stack(pdf["v"].to_list()).sum(axis=0)]})

    parts, left = rows.mapInPandas(add, "at long, v array<double>"), rows.rdd.getNumPartitions()
    while left > fan:
        parts, left = parts.groupBy(F.floor(F.col("at") / fan)).applyInPandas(join, "at long, v array<double>"), -(-left // fan)
    # the same sum in whatever order rows arrive
    return sum((np.array(r.v) for r in sorted(parts.collect(), key=lambda r: r.at)), np.zeros(width))


@dataclass
class ChoiceFit:
    """``coefficients``: (alternative, term, estimate, standard error, z, p); a nest's dissimilarity is tested against 1."""

    layout: Layout
    theta: np.ndarray
    coefficients: list[tuple]
    stats: dict[str, float]


def fit_choice(d: ChoiceDesign, nests: Mapping[str, Sequence[str]] | None = None, rounds: int = 60, tolerance: float = 1e-14, start: np.ndarray | None = None) -> ChoiceFit:
    """Maximum likelihood of the choices; with ``nests`` (name to alternatives), a nested logit.

    Alternatives in no nest are nests of their own; a nest of one has dissimilarity 1. Steps that don't
    raise the likelihood are halved, directions of the wrong curvature turned. A dissimilarity that falls to
    ``SMALLEST`` stays there, without a standard error. A nested fit starts from the multinomial one. What isn't identified gets the estimate of least
    change from the start and no standard error. ``converged`` in the stats is 0 after ``rounds`` passes.
    """
    layout = Layout(d, nests)
    rows = d.data.select("x", "z", "y")
    theta = np.zeros(layout.size)
    if start is not None:
        theta[:] = start
    elif layout.free:
        theta[: layout.size - len(layout.free)] = fit_choice(d, None, rounds, tolerance).theta
        theta[layout.size - len(layout.free) :] = 1.0
    n = rows.count()
    if not n:
        raise ValueError("no complete row")
    p = layout.size

    def at(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        shared = rows.sparkSession.sparkContext.broadcast((layout, theta))

        def make(pdf: pd.DataFrame) -> np.ndarray:
            known, now = shared.value
            return known.sums(now, *_arrays(pdf, known), pdf["y"].to_numpy())

        out = partial_sums(rows, make, 1 + p + p * p)
        return float(out[0]), out[1 : 1 + p], out[1 + p :].reshape(p, p)

    passes, converged = 1, False
    value, grad, hess = at(theta)
    scales = np.arange(p) >= p - len(layout.free)
    while passes < rounds:
        # a dissimilarity at its bound that would go on stays there
        moves = ~(scales & (theta <= SMALLEST) & (grad <= 0))
        bend, axes = np.linalg.eigh(-hess[np.ix_(moves, moves)])
        size = np.abs(bend)
        used = size > 1e-11 * size.max() if len(size) and size.max() > 0 else np.zeros(len(size), bool)
        move = np.zeros(p)
        move[moves] = axes[:, used] @ ((axes[:, used].T @ grad[moves]) / size[used])
        falls = scales & (move < 0)
        step = min([1.0, *((theta - SMALLEST)[falls] / -move[falls])])
        goes = lambda: np.where(scales, np.maximum(theta + step * move, SMALLEST), theta + step * move)  # noqa: B023, E731
        if grad @ move / 2 < tolerance * max(1.0, abs(value)):
            theta, converged = goes(), True
            break
        while passes < rounds and step >= 1e-8:
            tried = at(goes())
            passes += 1
            if np.isfinite(tried[0]) and tried[0] >= value - 1e-13 * abs(value):
                theta, (value, grad, hess) = goes(), tried
                break
            step /= 2
        if step < 1e-8:
            break
    held = scales & (theta <= SMALLEST)
    hess[held], hess[:, held] = 0, 0
    variance = np.linalg.pinv(-hess, rcond=1e-11, hermitian=True)
    null = np.abs(variance @ -hess - np.eye(p)).max(axis=1) > 1e-6
    errors = np.where(null, np.nan, np.sqrt(np.maximum(np.diag(variance), 0)))
    named = [(a, t) for a in d.alternatives[1:] for t in d.terms] + [("", a) for a in d.attributes] + [(list(layout.nests)[i], "dissimilarity") for i in layout.free]
    coefficients = []
    for (alternative, term), estimate, error in zip(named, theta, errors):
        z = (estimate - (term == "dissimilarity")) / error if error > 0 else math.nan
        coefficients.append((alternative, term, float(estimate), float(error), float(z), math.erfc(abs(z) / math.sqrt(2)) if not math.isnan(z) else math.nan))
    counts = dict(rows.groupBy("y").count().collect())
    constants = sum(c * math.log(c / n) for c in counts.values())
    free = p - int(null.sum())
    stats = {"n": n, "parameters": free, "log_likelihood": value, "log_likelihood_constants": constants, "log_likelihood_equal": -n * math.log(layout.j), "mcfadden_r2": 1 - value / constants if constants else math.nan, "aic": 2 * free - 2 * value, "bic": math.log(n) * free - 2 * value, "passes": passes, "converged": int(converged)}
    return ChoiceFit(layout, theta, coefficients, stats)


def predicted(d: ChoiceDesign, fit: ChoiceFit) -> DataFrame:
    """The design's rows with ``p``, the chance of each alternative in the design's order."""
    shared = d.data.sparkSession.sparkContext.broadcast((fit.layout, fit.theta))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.data.schema), "p array<double>"])

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layout, theta = shared.value
        for pdf in batches:
            if len(pdf):
                _, inside, nests, _ = shares(layout.utilities(theta, *_arrays(pdf, layout)), layout.nest, layout.parts(theta)[2])
                yield pdf.assign(p=list(inside * nests[:, layout.nest]))

    return d.data.mapInPandas(make, schema)


def totals(d: ChoiceDesign, fit: ChoiceFit) -> DataFrame:
    """(alternative, term, fitted): terms summed with the chances as weights; at the multinomial maximum the sums over those who chose."""
    rows = predicted(d, fit).select("x", F.posexplode("p").alias("j", "p"))
    terms = rows.select("j", "p", F.posexplode("x").alias("t", "x")).groupBy("j", "t").agg(F.sum(F.col("x") * F.col("p")).alias("fitted"))
    name = lambda values, at: F.element_at(F.array(*map(F.lit, values)), F.col(at) + 1)
    return terms.select(name(d.alternatives, "j").alias("alternative"), name(d.terms, "t").alias("term"), "fitted")
