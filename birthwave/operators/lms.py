"""Weighted three-parameter LMS (Box-Cox Cole-Green) regression by stratum and replicate.

All strata and replicates are fitted together. A scoring pass is one
aggregation of the rows to score and information sums per (stratum,
replicate); rows never leave Spark and replicates are never stored. Between
passes only a staged table of coefficients per key is carried, so the driver
holds nothing but the number of keys still running.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.design import natural_spline, spline_knots
from ..functions.scalar import lms_value, normal_cdf_positive_sql
from .intervals import point_and_interval
from .reshape import linear_predictor, long_design, parameters_wide
from .resample import poisson_draws, replicate_block
from .staging import join_summary, stage

PARAMS = ("mu", "sigma", "nu")
_NU_FLOOR = 1e-4
# Pairs of parameters whose second derivatives are summed.
_BLOCKS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
_STATE = (
    "no bigint, boot int, coef array<double>, trial array<double>, grad array<double>, curve array<double>, "
    "radius double, size double, promised double, slope double, loglik double, floor double, cycles int, status string"
)
# A fit whose scale falls below this share of the stratum's own at some row goes through single points: its likelihood has no bound.
_COLLAPSED = 1e-3
# Rows times replicates that one part of the rows stands for, at least.
_PART_WORK = 50_000_000
# Centile values that are expanded together.
_CUBE = 2_000_000


def _key() -> Column:
    """Stratum number and replicate in one integer, for one-column joins and grouping."""
    return F.expr("no * 1048576L + boot").alias("key")


def with_spline(df: DataFrame, x: str, df_terms: int, by: list[str], prefix: str = "ns") -> tuple[DataFrame, list[str]]:
    """Rows with the natural-spline columns of their own stratum, and the column names."""
    knots = spline_knots(df, x, df_terms, by).select(*by, "knots")
    rows = join_summary(df, knots, by)
    names = [f"{prefix}{i + 1}" for i in range(df_terms)]
    rows = rows.withColumns(dict(zip(names, natural_spline(x, "knots", df_terms))))
    return rows.drop("knots"), names


def score_columns(rows: DataFrame, y: str, terms: list[str], mu_link: str = "identity") -> DataFrame:
    """Log-likelihood, scores and observed information of each row at coefficients c0, c1, ...

    The density is truncated to positive values of y; h is its hazard at the
    cut and vanishes beyond t = 6. A trial point without a density (a median
    that is not positive, a scale out of range) gives NaN and so is refused.
    Expressions are SQL text because a pass is planned anew each time.
    """
    p = len(terms) + 1
    design = ["", *[f" * {t}" for t in terms]]
    eta = [" + ".join(f"c{b * p + i}{design[i]}" for i in range(p)) for b in range(3)]
    log_mu = mu_link == "log"
    cdf = normal_cdf_positive_sql("t")
    # First and second derivatives by m become those by its linear predictor.
    chain = "m" if log_mu else "1D"
    bend = " + m * lm" if log_mu else ""
    nan = "double('NaN')"
    steps = [
        {"em": eta[0], "es": eta[1], "ev": eta[2]},
        {
            "m": f"if(abs(em) < 200, exp(em), {nan})" if log_mu else f"if(em > 1e-100, em, {nan})",
            "s": f"if(abs(es) < 200, exp(es), {nan})",
            "v": f"if(abs(ev) >= {_NU_FLOOR}D, ev, if(ev < 0, -{_NU_FLOOR}D, {_NU_FLOOR}D))",
        },
        {"lg": f"ln({y}) - ln(m)", "t": "1D / (s * abs(v))"},
        {"u": "exp(v * lg)", "cdf": f"if(t > 6, 1D, {cdf})"},
        {"z": "(u - 1D) / (v * s)", "h": f"if(t > 6, 0D, {(2 * np.pi) ** -0.5!r}D * exp(-0.5D * t * t) / cdf)"},
        {"q": "(u * lg / s - z) / v", "r": "1D - t * (t + h)", "lm": "(z * u / s - v) / m"},
        {
            "ll": f"{float(-0.5 * np.log(2 * np.pi))!r}D + (v - 1D) * ln({y}) - v * ln(m) - ln(s) - 0.5D * z * z - ln(cdf)",
            "g0": f"lm * {chain}",
            "g1": "z * z - 1D + h * t",
            "g2": "lg - z * q + h * t / v",
            "i00": f"-((v - u * u / (s * s) - z * u * (1D + v) / s) / (m * m) * {chain} * {chain}{bend})",
            "i01": f"2D * z * u / (m * s) * {chain}",
            "i02": f"(1D - u * (q + z * lg) / s) / m * {chain}",
            "i11": "2D * z * z + h * t * r",
            "i12": "h * t * r / v - 2D * z * q",
            "i22": "q * q + z * (u * lg * lg / s - 2D * q) / v + h * t * (1D + r) / (v * v)",
        },
    ]
    for step in steps:
        rows = rows.selectExpr("*", *[f"{e} AS {n}" for n, e in step.items()])
    return rows


def score_sums(scored: DataFrame, by: list[str], weight: str, terms: list[str], least: bool = False) -> DataFrame:
    """One aggregation: log-likelihood, gradient and information sums per key, on request with the least log scale."""
    design = ["", *[f" * {t}" for t in terms]]
    p = len(design)
    columns = ["ll", "g0", "g1", "g2", *[f"i{b}{c}" for b, c in _BLOCKS]]
    rows = scored.selectExpr(*by, *terms, "es AS _es", f"{weight} AS _kw", *[f"({weight}) * {c} AS {c}" for c in columns])
    sums = ["count(1) AS n", "sum(_kw) AS sum_w", "sum(ll) AS loglik"]
    if least:
        sums.append("min(_es) AS low_es")
    for b in range(3):
        sums += [f"sum(g{b}{design[i]}) AS g{b}_{i}" for i in range(p)]
    for b, c in _BLOCKS:
        sums += [
            f"sum(i{b}{c}{design[i]}{design[j]}) AS i{b}{c}_{i}_{j}" for i in range(p) for j in range(i, p)
        ]
    return rows.groupBy(*by).agg(*[F.expr(e) for e in sums])


def _gradient_and_information(row, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Score and observed information; the design is the same in all blocks."""
    g = np.array([getattr(row, f"g{b}_{i}") for b in range(3) for i in range(p)])
    info = np.zeros((3 * p, 3 * p))
    for b, c in _BLOCKS:
        for i in range(p):
            for j in range(i, p):
                value = getattr(row, f"i{b}{c}_{i}_{j}")
                for u, v in ((i, j), (j, i)):
                    info[b * p + u, c * p + v] = info[c * p + v, b * p + u] = value
    return g, info


def trust_step(curve: np.ndarray, g: np.ndarray, radius: float) -> tuple[np.ndarray, float, float]:
    """Best step of the quadratic model within a radius, its promised gain and its length.

    Lengths are in units of the curvature's diagonal. The eigenvalues give the
    exact step also where the model is not concave.
    """
    scale = np.sqrt(np.abs(np.diag(curve)))
    scale = np.where(scale > 0, scale, 1.0)
    values, vectors = np.linalg.eigh(curve / np.outer(scale, scale))
    slope = vectors.T @ (g / scale)
    if values[0] > 1e-10 * max(1.0, values[-1]) and np.linalg.norm(slope / values) <= radius:
        d = slope / values
    else:
        low = max(0.0, -values[0])
        high = low + np.linalg.norm(slope) / radius + 1e-12
        for _ in range(100):
            shift = (low + high) / 2
            divisor = values + shift
            short = (divisor > 0).all() and np.linalg.norm(slope / divisor) <= radius
            low, high = (low, shift) if short else (shift, high)
        d = slope / (values + high)
        missing = radius**2 - d @ d
        if values[0] <= 0 and missing > 1e-6 * radius**2:  # along the direction of least curvature
            d[0] += np.copysign(np.sqrt(missing), slope[0])
    return vectors @ d / scale, float(slope @ d - 0.5 * d @ (values * d)), float(np.linalg.norm(d))


def _advance(p: int, tol: float, max_passes: int):
    """Next state per key from the sums at its trial point, by a trust region.

    The ratio of the gain to what the quadratic model promised decides whether
    the trial is accepted and how far the model is trusted next. A key has
    converged when a whole step promises less than half of ``tol``; that step is
    still taken. It is given up where it cannot converge: with no more rows than
    coefficients, or once its scale has collapsed at some row.
    """

    def one(row) -> tuple:
        coef, old, cycles = np.asarray(row.coef), row.loglik, row.cycles + 1
        trial, grad, curve = (np.asarray(v) for v in (row.trial, row.grad, row.curve))
        radius, size, promised, slope = row.radius, row.size, row.promised, row.slope

        def state(status):
            return row.no, row.boot, coef, trial, grad, curve, radius, size, promised, slope, old, row.floor, cycles, status

        if row.n is None or np.isnan(row.n):
            return state("empty")
        if row.n <= 3 * p:
            return state("few rows")
        new, first = row.new_loglik, np.isnan(old)
        g, info = _gradient_and_information(row, p)
        known = bool(np.isfinite(new) and np.isfinite(g).all() and np.isfinite(info).all())
        if first:
            if not known:
                return state("stalled")
            accepted, radius = True, 2 * np.sqrt(max(row.sum_w, 1e-12))
        else:
            gain = new - old if known else -np.inf
            accepted = gain > 1e-4 * promised
            if gain < 0.25 * promised:
                # Shorten to the top of the parabola through both ends.
                top = 0.5 * slope / (slope - gain) if known else 0.25
                radius = size * float(np.clip(top, 0.1, 0.5))
            elif gain > 0.75 * promised and size > 0.8 * radius:
                radius = 2 * radius
        if accepted:
            coef, old, grad, curve = trial, new, g, info.ravel()
            if row.low_es < row.floor:
                return state("collapsed")
        step, promised, size = trust_step(curve.reshape(3 * p, 3 * p), grad, radius)
        slope, trial = float(grad @ step), coef + step
        if promised < 0.5 * tol and size < radius:
            coef, old = trial, old + promised
            return state("converged")
        if radius < 1e-7:
            return state("stalled")
        return state("unfinished" if cycles >= max_passes else "run")

    names = [field.split()[0] for field in _STATE.split(", ")]

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(row) for row in pdf.itertuples(index=False)], columns=names)

    return advance


def _iterate(
    base: DataFrame, state: DataFrame, terms: list[str], mu_link: str, tol: float, max_passes: int, replicated: bool, seed: int
) -> DataFrame:
    """Scoring passes until no key runs; finished keys leave the aggregation.

    Replicates are drawn anew in each pass, and only in the strata and blocks
    that still have a running key.
    """
    p = len(terms) + 1
    advance = _advance(p, tol, max_passes)
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    finished = []
    while True:
        running = state.where(F.col("status") == "run")
        finished.append(state.where(F.col("status") != "run"))
        if running.isEmpty():
            break
        # The state is a written table, so its true size decides whether a join broadcasts it.
        point = running.select(_key(), *[F.col("trial")[i].alias(f"c{i}") for i in range(3 * p)])
        if replicated:
            blocks = F.collect_set(replicate_block(F.col("boot"))).alias("_blocks")
            rows = base.join(running.groupBy("no").agg(blocks), "no")
            rows = poisson_draws(rows, ["sid"], "_row", F.col("_blocks"), seed).drop("_blocks")
        else:
            rows = base.withColumns({"boot": F.lit(0), "k": F.lit(1)})
        rows = rows.withColumn("key", _key()).join(point, "key")
        sums = score_sums(score_columns(rows, "_y", terms, mu_link), ["key"], "k * _w", terms, least=True)
        sums = sums.withColumnRenamed("loglik", "new_loglik")
        joined = running.withColumn("key", _key()).join(sums, "key", "left")
        # The solves are spread explicitly: their rows are too few bytes for adaptive execution to do so.
        state = stage(joined.repartition(parts).mapInPandas(advance, _STATE), "lms-state")
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def fit_lms(
    df: DataFrame,
    y: str,
    terms: list[str],
    w: str,
    by: list[str],
    row_id: str,
    reps: int = 0,
    seed: int = 1,
    mu_link: str = "identity",
    tol: float = 1e-3,
    max_passes: int = 100,
) -> DataFrame:
    """Coefficients per stratum, replicate, parameter and term.

    Replicate 0 is the sample itself; the others are Poisson bootstraps that
    start from its solution and so need few passes. ``tol`` is in units of the
    deviance. Keys that did not converge, or not within ``max_passes`` (a bound
    that should not bind), stay in the result with ``converged`` false and null
    coefficients.
    """
    p = len(terms) + 1
    base = df.select(
        *by, F.xxhash64(*by).alias("sid"), F.col(row_id).alias("_row"), F.col(y).cast("double").alias("_y"),
        F.col(w).cast("double").alias("_w"), *[F.col(t).cast("double").alias(t) for t in terms],
    )
    strata = base.groupBy("sid", *by).agg(
        F.avg("_y").alias("_mean"), (F.stddev_pop("_y") / F.avg("_y")).alias("_cv"), F.count(F.lit(1)).alias("_rows")
    )
    # Strata are few: they are numbered in one task.
    strata = stage(strata.withColumn("no", F.row_number().over(Window.orderBy("sid")).cast("bigint")), "lms-strata")
    if strata.groupBy("sid").count().where("count > 1").take(1):
        raise RuntimeError("two strata share a hash; rename one of them")
    base = join_summary(base.drop(*by), strata.select("sid", "no"), ["sid"], "inner")
    # Replicates multiply the work per row, so the number of parts is not left to their size.
    # Parts hold few strata each, so a pass emits few partial sums per task, and
    # a stratum with most rows is split over many parts.
    work = (strata.agg(F.sum("_rows")).first()[0] or 0) * (reps + 1)
    parts = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), work // _PART_WORK)
    base = base.repartitionByRange(parts, "no", "_row").persist(StorageLevel.MEMORY_AND_DISK)
    centre = F.log("_mean") if mu_link == "log" else F.col("_mean")
    zeros = [F.lit(0.0)] * (p - 1)
    start = F.array(
        centre, *zeros, F.log(F.greatest(F.coalesce("_cv", F.lit(0.0)), F.lit(0.01))), *zeros, F.lit(-0.5), *zeros
    )

    def fresh(keys: DataFrame, coef: Column) -> DataFrame:
        none = F.array().cast("array<double>")
        return keys.select(
            "no", "boot", coef.alias("coef"), coef.alias("trial"), none.alias("grad"), none.alias("curve"),
            *[F.lit(0.0).alias(n) for n in ("radius", "size", "promised", "slope")],
            F.lit(float("nan")).alias("loglik"), "floor", F.lit(0).alias("cycles"), F.lit("run").alias("status"),
        )

    floor = F.log(F.greatest(F.coalesce("_cv", F.lit(0.0)), F.lit(1e-12)) * _COLLAPSED)
    state = fresh(strata.withColumns({"boot": F.lit(0), "floor": floor}), start)
    state = _iterate(base, state, terms, mu_link, tol, max_passes, False, seed)
    if reps:
        again = state.drop("boot").withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(reps))))
        again = stage(fresh(again, F.col("coef")), "lms-state")
        state = state.unionByName(_iterate(base, again, terms, mu_link, tol, max_passes, True, seed))
    base.unpersist()
    names = ["(Intercept)", *terms]
    beta = F.when(F.col("status") == "converged", F.col("coef"))
    cells = [
        F.struct(F.lit(PARAMS[b]).alias("param"), F.lit(t).alias("term"), beta[b * p + i].alias("beta"))
        for b in range(3) for i, t in enumerate(names)
    ]
    out = state.join(strata.select("no", *by), "no").withColumn("_c", F.explode(F.array(*cells)))
    return out.select(
        *by, "boot", "_c.param", "_c.term", "_c.beta",
        (F.col("status") == "converged").alias("converged"), "cycles", "loglik",
    )


def lms_parameters(coef: DataFrame, grid: DataFrame, by: list[str], x: str, columns: dict[str, str]) -> DataFrame:
    """mu, sigma and nu per stratum, replicate and grid value; sigma on its natural scale.

    ``grid`` has one row per stratum and value of x with the term columns.
    """
    design = long_design(grid, [*by, x], columns)
    values = linear_predictor(coef, design, [*by, "term"], [*by, "boot", x, "param"])
    return parameters_wide(values, [*by, "boot", x])


def centile_table(percents) -> Column:
    """Percentages with their normal scores, as a literal array."""
    score = NormalDist().inv_cdf
    return F.array(*[F.struct(F.lit(p).alias("centile"), F.lit(score(p / 100)).alias("z")) for p in percents])


def expand_centiles(params: DataFrame, percents=range(1, 100), log_mu: bool = False) -> DataFrame:
    """One row per centile with its value; scores come from a literal table."""
    rows = params.withColumn("_c", F.explode(centile_table(percents)))
    value = lms_value("mu", "sigma", "nu", "_c.z", log_mu)
    return rows.withColumns({"centile": F.col("_c.centile"), "value": value}).drop("_c")


def lms_centiles(params: DataFrame, by: list[str], percents=range(1, 100), log_mu: bool = False) -> DataFrame:
    """Centile curves with percentile intervals over replicates, and how many replicates have a value.

    The replicates of a curve point travel together as arrays, so the shuffle
    carries parameters and not their many centile values; points are expanded
    together as a cube of points, replicates and centiles.
    """
    again = F.col("boot") > 0
    arrays = [F.collect_list(F.when(again, F.struct("mu", "sigma", "nu"))).alias("_r")]
    point = [F.max(F.when(~again, F.col(p))).alias(f"_{p}") for p in PARAMS]
    packed = params.groupBy(*by).agg(*arrays, *point)
    packed = packed.select(*by, *[f"_{p}" for p in PARAMS], *[F.col("_r")[p].alias(f"_{p}s") for p in PARAMS])
    scores = np.array([NormalDist().inv_cdf(p / 100) for p in percents])
    numbers = np.array(list(percents), dtype="int32")
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in params.select(*by).schema)

    def values(mu, sigma, nu) -> np.ndarray:
        """Parameters with a last axis of centiles; NaN where a negative base has no value."""
        mu, sigma, nu = (v[..., None] for v in (mu, sigma, nu))
        near = np.abs(nu) < 1e-8
        base = 1 + nu * sigma * scores
        power = np.where(base > 0, base, np.nan) ** (1 / np.where(near, 1.0, nu))
        return (np.exp(mu) if log_mu else mu) * np.where(near, np.exp(sigma * scores), power)

    def quantile(v: np.ndarray, n: np.ndarray, prob: float) -> np.ndarray:
        """Interpolated quantile over the first ``n`` of the sorted second axis."""
        at = np.maximum(n - 1, 0) * prob
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, np.maximum(n - 1, 0))
        first, second = (np.take_along_axis(v, i[:, None], axis=1)[:, 0] for i in (low, high))
        return first + (at - low) * (second - first)

    def cube(lists) -> np.ndarray:
        out = np.full((len(lists), max(1, *map(len, lists))), np.nan)
        for i, v in enumerate(lists):
            out[i, : len(v)] = v
        return out

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            reps = max(1, int(whole["_mus"].map(len).max()))
            size = max(1, _CUBE // (reps * len(numbers)))
            for start in range(0, len(whole), size):
                pdf = whole.iloc[start : start + size]
                beta = values(*[pdf[f"_{p}"].to_numpy(float) for p in PARAMS])
                v = np.sort(values(*[cube(pdf[f"_{p}s"].tolist()) for p in PARAMS]), axis=1)
                n = (~np.isnan(v)).sum(axis=1)
                low, high = quantile(v, n, 0.025), quantile(v, n, 0.975)
                drawn = np.repeat(pdf["_mus"].map(len).to_numpy(), len(numbers))
                fixed = {b: np.repeat(pdf[b].to_numpy(), len(numbers)) for b in by}
                made = {"beta": beta, "lci": low, "uci": high, "n_used": n}
                out = fixed | {"centile": np.tile(numbers, len(pdf))} | {k: a.ravel() for k, a in made.items()}
                yield pd.DataFrame(out | {"n_failed": drawn - n.ravel()})

    return packed.mapInPandas(expand, f"{keys}, centile int, beta double, lci double, uci double, n_used bigint, n_failed bigint")


def parameter_intervals(params: DataFrame, by: list[str]) -> DataFrame:
    long = params.unpivot([*by, "boot"], ["mu", "sigma", "nu"], "parameter", "value")
    return point_and_interval(long, [*by, "parameter"], "value")


def centile_contrast(params: DataFrame, by: list[str], pairs=((25, 75), (10, 90))) -> DataFrame:
    """Difference of two centiles within each replicate, then its interval."""
    z = NormalDist().inv_cdf
    table = [
        F.struct(
            F.lit(f"{hi}th vs {lo}th").alias("comp"), F.lit(z(lo / 100)).alias("lo"), F.lit(z(hi / 100)).alias("hi")
        )
        for lo, hi in pairs
    ]
    rows = params.withColumn("_c", F.explode(F.array(*table)))
    gap = lms_value("mu", "sigma", "nu", "_c.hi") - lms_value("mu", "sigma", "nu", "_c.lo")
    rows = rows.withColumns({"comp": F.col("_c.comp"), "value": gap})
    return point_and_interval(rows, [*by, "comp"], "value")
