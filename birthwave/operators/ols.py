"""Ordinary least squares from grouped counts and sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.design import natural_spline, spline_knots
from ..functions.scalar import t_quantile
from .staging import stage

# Normal equations of at most so many levels are solved as one matrix, larger ones by conjugate gradients.
DENSE = 256
# Relative residual at which a conjugate-gradient solution is taken.
CG_TOL = 1e-11


def factor_effects(df: DataFrame, y: str, factor: str) -> DataFrame:
    """Contrasts of an outcome against the first level of one factor, with 95% intervals.

    One aggregation gives count, mean and sum of squares per level; the rest
    works on the levels.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(factor).isNotNull())
    levels = rows.groupBy(F.col(factor).alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("ss"),
    )
    first = F.min_by(F.struct("n", "m"), "level")
    pooled = levels.agg(
        first.alias("base"), F.min("level").alias("base_level"),
        F.sum("ss").alias("ss"), (F.sum("n") - F.count(F.lit(1))).alias("dof"),
    )
    # One row on the right: it travels as a constant column, not as a join.
    one = levels.withColumn("p", pooled.select(F.struct("*")).scalar())
    s2 = F.col("p.ss") / F.nullif(F.col("p.dof"), F.lit(0))
    se = F.sqrt(s2 * (F.lit(1.0) / F.col("n") + F.lit(1.0) / F.col("p.base.n")))
    out = one.where(F.col("level") != F.col("p.base_level")).select(
        "level", "n", (F.col("m") - F.col("p.base.m")).alias("estimate"), se.alias("se"),
        t_quantile("p.dof").alias("_t"),
    )
    return out.select(
        "level", "n", "estimate", "se",
        (F.col("estimate") - F.col("_t") * F.col("se")).alias("conf_low"),
        (F.col("estimate") + F.col("_t") * F.col("se")).alias("conf_high"),
    )


def _cells(df: DataFrame, y: str, keys: dict[str, str]) -> DataFrame:
    """Count, sum and sum of squares of y per combination of keys, without rows that lack any of them."""
    rows = df.where(F.col(y).isNotNull())
    for c in keys.values():
        rows = rows.where(F.col(c).isNotNull())
    v = F.col(y).cast("double")
    return rows.groupBy(*[F.col(c).alias(k) for k, c in keys.items()]).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(v).alias("sy"), F.sum(v * v).alias("syy")
    )


def _linked(cells: DataFrame) -> DataFrame:
    """``j, part`` of the kept levels: the least level that shares eliminated levels with it, however far."""
    now = cells.groupBy("j").agg(F.min("j").alias("part"))
    before = None
    while True:
        now = stage(now, "ols-parts")
        changed = now.agg(F.count_distinct("part"), F.sum(F.xxhash64("j", "part").cast("decimal(38,0)"))).first()
        if changed == before:
            return now
        before = changed
        least = cells.select("i", "j").join(now, "j").groupBy("i").agg(F.min("part").alias("part"))
        now = cells.select("i", "j").join(least, "i").groupBy("j").agg(F.min("part").alias("part"))


def _dense_solution(cells: DataFrame, kept: DataFrame) -> DataFrame:
    """``j, nj, v, part, b, row`` of the kept levels: effect, and row of the inverse as ``k, g``, from the formed equations.

    The least level of each part (levels that meet in the equations, however far)
    is its reference. The equations are bounded by the square of ``DENSE`` and
    travel as one row.
    """
    kind = kept.schema["j"].dataType.simpleString()
    other = cells.select("i", F.col("j").alias("k"), F.col("n").alias("m"))
    pairs = cells.select("i", "j", "n", "ni").join(other, "i").groupBy("j", "k").agg(F.sum(F.col("n") * F.col("m") / F.col("ni")).alias("s"))
    one = pairs.agg(F.collect_list(F.struct("j", "k", "s")).alias("s"))
    one = one.withColumn("levels", kept.agg(F.sort_array(F.collect_list(F.struct("j", "nj", "v")))).scalar())

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level = batch.schema.field("levels").type.value_type.field("j").type
            for row in batch.to_pylist():
                names, nj, v = ([r[c] for r in row["levels"]] for c in ("j", "nj", "v"))
                place = {name: n for n, name in enumerate(names)}
                s = np.diag(np.array(nj, float))
                met = np.eye(len(names), dtype=bool)
                for r in row["s"]:
                    s[place[r["j"]], place[r["k"]]] -= r["s"]
                    met[place[r["j"]], place[r["k"]]] = True
                part = np.arange(len(names))
                while True:
                    least = np.array([part[m].min() for m in met], dtype=int)
                    if (least == part).all():
                        break
                    part = least
                free = np.flatnonzero(part != np.arange(len(names)))
                g = np.zeros_like(s)
                # Levels of different parts do not meet, so one inverse serves all.
                g[np.ix_(free, free)] = np.linalg.inv(s[np.ix_(free, free)])
                lines = [[{"k": names[k], "g": g[j, k]} for k in np.flatnonzero(g[j])] for j in range(len(names))]
                line = pa.list_(pa.struct([("k", level), ("g", pa.float64())]))
                made = {
                    "j": pa.array(names, level), "nj": pa.array(nj, pa.float64()), "v": pa.array(v, pa.float64()),
                    "part": pa.array([names[n] for n in part], level), "b": pa.array(g @ np.array(v, float)), "row": pa.array(lines, line),
                }
                yield pa.RecordBatch.from_pydict(made)

    return one.mapInArrow(solve, f"j {kind}, nj double, v double, part {kind}, b double, row array<struct<k:{kind},g:double>>")


def _gradient_solutions(cells: DataFrame, totals: DataFrame, right: DataFrame, limit: int) -> DataFrame:
    """Solutions ``rhs, j, x`` of the reduced equations for right sides ``rhs, j, value``, by conjugate gradients.

    The equations are never formed: a product goes from the kept levels to the
    eliminated ones and back, as two joins with the cells. All right sides move
    together; vectors are written tables. ``totals`` has the rows ``nj`` of each
    kept level, which are also the preconditioner.
    """
    start = totals.select("j", "nj")
    vectors = stage(right.join(start, "j").select("rhs", "j", "nj", F.lit(0.0).alias("x"), F.col("value").alias("r"), (F.col("value") / F.col("nj")).alias("p")), "ols-vectors")
    sizes = vectors.groupBy("rhs").agg(F.sum(F.col("r") * F.col("r") / F.col("nj")).alias("rz"))
    sizes = stage(sizes.withColumn("first", F.col("rz")), "ols-sizes")
    links = cells.select("i", "j", "n", "ni")
    for _ in range(limit):
        going = sizes.where(F.col("rz") > CG_TOL**2 * F.col("first"))
        if going.isEmpty():
            break
        p = vectors.join(going.select("rhs"), "rhs", "left_semi")
        down = p.select("rhs", "j", "p").join(links, "j").groupBy("rhs", "i").agg((F.sum(F.col("n") * F.col("p")) / F.first("ni")).alias("t"))
        back = down.join(links, "i").groupBy("rhs", "j").agg(F.sum(F.col("n") * F.col("t")).alias("u"))
        moved = stage(p.join(back, ["rhs", "j"], "left").withColumn("q", F.col("nj") * F.col("p") - F.coalesce("u", F.lit(0.0))), "ols-products")
        length = moved.groupBy("rhs").agg(F.sum(F.col("p") * F.col("q")).alias("pq")).join(going, "rhs")
        length = length.select("rhs", "rz", "first", F.coalesce(F.col("rz") / F.nullif(F.col("pq"), F.lit(0.0)), F.lit(0.0)).alias("alpha"))
        new = moved.join(length, "rhs").withColumns({"x": F.col("x") + F.col("alpha") * F.col("p"), "r": F.col("r") - F.col("alpha") * F.col("q")})
        new = stage(new.select("rhs", "j", "nj", "x", "r", "p", "rz", "first"), "ols-moved")
        after = new.groupBy("rhs").agg(F.sum(F.col("r") * F.col("r") / F.col("nj")).alias("after"), F.first("rz").alias("before"), F.first("first").alias("first"))
        turned = new.join(after.select("rhs", (F.col("after") / F.col("before")).alias("beta")), "rhs")
        turned = turned.select("rhs", "j", "nj", "x", "r", (F.col("r") / F.col("nj") + F.col("beta") * F.col("p")).alias("p"))
        done = sizes.where(~(F.col("rz") > CG_TOL**2 * F.col("first")))
        vectors = stage(turned.unionByName(vectors.join(done.select("rhs"), "rhs", "left_semi")), "ols-vectors")
        sizes = stage(after.select("rhs", F.col("after").alias("rz"), "first").unionByName(done), "ols-sizes")
    else:
        raise RuntimeError(f"the equations did not settle within {limit} products")
    return vectors.select("rhs", "j", "x")


def two_factor_effects(df: DataFrame, y: str, first: str, second: str, dense: int = DENSE) -> DataFrame:
    """Contrasts of an outcome on two factors jointly, against the first level of each, with 95% intervals.

    Rows shrink to one cell per pair of levels. The factor with more levels is
    eliminated: its effects follow from those of the other, whose equations need
    only sums per pair of its levels. Up to ``dense`` kept levels these equations
    are one matrix; beyond, they are solved by conjugate gradients over the cells
    and never formed, for the effects and for the unit vectors behind the
    standard errors alike.

    Levels may be of any type that has an order; factors of different types are
    compared as text in the result. Levels that no chain of cells links with the
    first level of their factor cannot be contrasted with it and get null.
    """
    cells = _cells(df, y, {"a": first, "b": second})
    integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    cells = stage(cells.select(*[F.col(c).cast("bigint" if isinstance(cells.schema[c].dataType, integral) else cells.schema[c].dataType).alias(c) for c in ("a", "b")], "n", "sy", "syy"), "ols-cells")
    levels = cells.agg(F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b")).first()
    many, few = ("a", "b") if levels["a"] >= levels["b"] else ("b", "a")
    cells = cells.select(F.col(many).alias("i"), F.col(few).alias("j"), "n", "sy", "syy")
    gone = cells.groupBy("i").agg(F.sum("n").alias("ni"), F.sum("sy").alias("yi"))
    cells = cells.join(gone, "i")
    kept = cells.groupBy("j").agg(F.sum("n").alias("nj"), F.sum(F.col("sy") - F.col("n") * F.col("yi") / F.col("ni")).alias("v"))
    if levels[few] <= dense:
        kept = stage(_dense_solution(cells, kept), "ols-kept")
        inverse = kept.select("j", F.inline("row"))
    else:
        kept, inverse = _iterated_solution(stage(cells, "ols-cells"), kept, 2 * levels[few] + 50)
    return _contrasts(cells, gone, kept, inverse, *((first, second) if many == "a" else (second, first)))


def _iterated_solution(cells: DataFrame, kept: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """``j, nj, v, part, b`` and the inverse ``j, k, g`` without forming the equations."""
    parts = _linked(cells)
    kept = stage(kept.join(parts, "j"), "ols-kept")
    # A row of the inverse solves for its level's unit vector against the reference of its part.
    apart = parts.where("j <> part").select(F.col("j").alias("rhs"), "part")
    unit = F.when(F.col("j") == F.col("rhs"), 1.0).when(F.col("j") == F.col("part"), -1.0).otherwise(0.0)
    units = apart.join(parts, "part").select("rhs", "j", unit.alias("value"))
    solved = _gradient_solutions(cells, kept, units, limit)
    zero = solved.join(parts, "j").where("j = part").select("rhs", F.col("x").alias("zero"))
    inverse = stage(solved.join(zero, "rhs").select(F.col("rhs").alias("j"), F.col("j").alias("k"), (F.col("x") - F.col("zero")).alias("g")), "ols-inverse")
    effect = inverse.join(kept.select(F.col("j").alias("k"), "v"), "k").groupBy("j").agg(F.sum(F.col("g") * F.col("v")).alias("b"))
    return stage(kept.join(effect, "j", "left").fillna(0.0, subset=["b"]), "ols-effects"), inverse


def _contrasts(cells: DataFrame, gone: DataFrame, kept: DataFrame, inverse: DataFrame, many: str, few: str) -> DataFrame:
    """Contrasts of both factors from the kept effects ``j, nj, v, part, b`` and the inverse ``j, k, g``."""
    own = gone.agg(F.sum(F.col("yi") * F.col("yi") / F.col("ni")).alias("ss"), F.count(F.lit(1)).alias("levels"))
    model = kept.agg(F.sum(F.col("b") * F.col("v")).alias("ss"), (F.count(F.lit(1)) - F.count_distinct("part")).alias("levels"))
    fit = cells.agg(F.sum("syy").alias("syy"), F.sum("n").alias("n"))
    fit = fit.withColumns({"own": own.select(F.struct("*")).scalar(), "model": model.select(F.struct("*")).scalar()})
    dof = F.col("n") - F.col("own.levels") - F.col("model.levels")
    left = F.greatest(F.col("syy") - F.col("own.ss") - F.col("model.ss"), F.lit(0.0))
    fit = fit.select(dof.alias("dof"), (left / F.when(dof > 0, dof)).alias("s2"))

    # The first kept level is the reference of its part: its effect and its row of the inverse are zero.
    diagonal = inverse.where("j = k").select("j", F.col("g").alias("var"))
    base = kept.agg(F.min("j").alias("j"), F.min("part").alias("part"))
    near = kept.join(diagonal, "j", "left").fillna(0.0, subset=["var"]).withColumn("base", base.select(F.struct("*")).scalar())
    linked = F.col("part") == F.col("base.part")
    near = near.where(F.col("j") != F.col("base.j")).select(
        F.lit(few).alias("factor"), F.col("j").alias("level"), F.when(linked, F.col("b")).alias("estimate"), F.when(linked, F.col("var")).alias("var")
    )

    # Eliminated levels: their mean less that of the kept effects under their own mix of kept levels.
    mix = cells.select("i", "j", (F.col("n") / F.col("ni")).alias("p"))
    base_mix = mix.where(F.col("i") == mix.agg(F.min("i")).scalar()).select(F.col("j").alias("k"), F.col("p").alias("p0"))
    toward = inverse.join(base_mix, "k").groupBy("j").agg(F.sum(F.col("g") * F.col("p0")).alias("h"))
    sums = mix.join(kept.select("j", "part", "b"), "j").join(toward, "j", "left").groupBy("i").agg(
        F.sum(F.col("p") * F.col("b")).alias("m"), F.sum(F.col("p") * F.coalesce("h", F.lit(0.0))).alias("u"), F.first("part").alias("part")
    )
    pairs = mix.join(mix.select("i", F.col("j").alias("k"), F.col("p").alias("q")), "i").join(inverse, ["j", "k"])
    spread = pairs.groupBy("i").agg(F.sum(F.col("p") * F.col("q") * F.col("g")).alias("w"))
    far = gone.join(sums, "i").join(spread, "i", "left").fillna(0.0, subset=["w"])
    far = stage(far.withColumn("e", F.col("yi") / F.col("ni") - F.col("m")), "ols-far")
    far = far.withColumn("base", far.agg(F.min_by(F.struct("i", "e", "u", "ni", "part"), "i")).scalar())
    linked = F.col("part") == F.col("base.part")
    var = F.lit(1.0) / F.col("ni") + F.lit(1.0) / F.col("base.ni") + F.col("w") - 2 * F.col("u") + F.col("base.u")
    far = far.where(F.col("i") != F.col("base.i")).select(
        F.lit(many).alias("factor"), F.col("i").alias("level"), F.when(linked, F.col("e") - F.col("base.e")).alias("estimate"),
        F.when(linked, F.greatest(var, F.lit(0.0))).alias("var"),
    )
    if near.schema["level"].dataType != far.schema["level"].dataType:
        near, far = (d.withColumn("level", F.col("level").cast("string")) for d in (near, far))
    rows = near.unionByName(far).withColumn("fit", fit.select(F.struct("*")).scalar())
    rows = rows.withColumn("se", F.sqrt(F.col("var") * F.col("fit.s2")))
    t = t_quantile("fit.dof")
    return rows.select(
        "factor", "level", "estimate", "se",
        (F.col("estimate") - t * F.col("se")).alias("conf_low"),
        (F.col("estimate") + t * F.col("se")).alias("conf_high"),
    )


def _solve(gram: np.ndarray, xty: np.ndarray, yty: float, n: float):
    """Coefficients, covariance and residual degrees of freedom; aliased terms drop out as NaN."""
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    g = gram / np.outer(scale, scale)
    keep: list[int] = []
    for j in range(len(g)):
        if g[j, j] <= 0:
            continue
        if keep:
            sub, col = g[np.ix_(keep, keep)], g[keep, j]
            if g[j, j] - col @ np.linalg.solve(sub, col) < 1e-10:
                continue
        keep.append(j)
    inv = np.linalg.inv(g[np.ix_(keep, keep)])
    b = inv @ (xty / scale)[keep]
    dof = n - len(keep)
    s2 = max(yty - b @ (xty / scale)[keep], 0.0) / dof if dof > 0 else np.nan
    beta, cov = np.full(len(gram), np.nan), np.full(gram.shape, np.nan)
    beta[keep] = b / scale[keep]
    cov[np.ix_(keep, keep)] = s2 * inv / np.outer(scale[keep], scale[keep])
    return beta, cov, dof


def gram_fit(rows: DataFrame, terms: list[str], n: str = "n", sy: str = "sy", syy: str = "syy") -> DataFrame:
    """One row ``beta, cov, dof`` of a regression on the term columns of cells, from weighted moments.

    Only the moments (a row as wide as the square of the terms) reach the solver.
    """
    p = len(terms)
    at = [(i, j) for i in range(p) for j in range(i, p)]
    moments = rows.agg(
        F.array(*[F.sum(F.col(n) * F.col(terms[i]) * F.col(terms[j])) for i, j in at]).alias("gram"),
        F.array(*[F.sum(F.col(sy) * F.col(t)) for t in terms]).alias("xty"),
        F.sum(syy).alias("yty"), F.sum(n).alias("n"),
    ).where("n > 0")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                gram = np.zeros((p, p))
                for (i, j), v in zip(at, row.gram):
                    gram[i, j] = gram[j, i] = v
                beta, cov, dof = _solve(gram, np.asarray(row.xty, float), row.yty, row.n)
                beta, cov = np.nan_to_num(beta), np.where(np.isnan(cov) & (dof > 0), 0.0, cov)
                yield pd.DataFrame({"beta": [beta], "cov": [cov.ravel()], "dof": [float(dof)]})

    return moments.mapInPandas(fit, "beta array<double>, cov array<double>, dof double")


def spline_mean(df: DataFrame, y: str, x: str, df_terms: int = 3) -> DataFrame:
    """Mean of y as a natural spline of x, predicted with 95% interval at every value of x.

    Rows shrink to one cell per value of x; the cells stay where they are and
    only the moments of the basis are gathered.
    """
    cells = _cells(df, y, {x: x}).withColumn(x, F.col(x).cast("double"))
    knots = spline_knots(cells, x, df_terms, [])
    terms = [f"_b{i}" for i in range(df_terms + 1)]
    basis = [F.lit(1.0), *natural_spline(x, "_k", df_terms)]
    cells = cells.withColumn("_k", knots.select("knots").scalar()).withColumns(dict(zip(terms, basis)))
    cells = stage(cells.select(x, "n", "sy", "syy", *terms), "ols-cells")
    rows = cells.withColumn("_f", stage(gram_fit(cells, terms), "ols-fit").select(F.struct("*")).scalar())
    p = len(terms)
    predicted = sum((F.col(t) * F.col("_f.beta")[i] for i, t in enumerate(terms)), F.lit(0.0))
    var = sum((F.col(terms[i]) * F.col(terms[j]) * F.col("_f.cov")[i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))
    rows = rows.select(x, predicted.alias("predicted"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("se"), t_quantile("_f.dof").alias("_t"))
    return rows.select(
        x, "predicted", "se",
        (F.col("predicted") - F.col("_t") * F.col("se")).alias("conf_low"),
        (F.col("predicted") + F.col("_t") * F.col("se")).alias("conf_high"),
    )
