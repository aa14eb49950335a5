"""Projections and filters: formulas over tables, feature bases, scaling, outliers, validity."""

from __future__ import annotations

import math

from itertools import combinations_with_replacement, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ast
from ..functions.compile import to_column
from ..functions.parse import parse
from .quantile import largest_group, median, percentiles, written

INF = float("inf")


def is_finite(c: Column) -> Column:
    """True for finite values; null is not finite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(INF)), F.lit(False))


def evaluate(df: DataFrame, **formulas: str) -> DataFrame:
    """Adds a column for each formula over the table's columns."""
    return df.withColumns({k: to_column(parse(v)) for k, v in formulas.items()})


def finite_rows(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose named columns are all finite."""
    for c in cols:
        df = df.filter(is_finite(F.col(c).cast("double")))
    return df


def finite_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Those of ``cols`` that hold finite values below 1e100 alone, by one aggregate."""
    if not cols:
        return []
    row = df.agg(*[F.min(is_finite(F.col(c)) & (F.abs(F.col(c)) < 1e100)).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def to_doubles(df: DataFrame) -> DataFrame:
    """Every column as double: trimmed names, NaN for what isn't a number; columns that are never numbers go."""
    df = df.toDF(*[c.strip() for c in df.columns])
    cast = {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in df.columns}
    counts = df.agg(*[F.count(v).alias(c) for c, v in cast.items()]).first()
    keep = [c for c in df.columns if counts[c]]
    return df.select(*[F.coalesce(cast[c], F.lit(float("nan"))).alias(c) for c in keep])


def monomials(cols: list[str], degree: int, negative: bool = False) -> dict[str, str]:
    """Name -> formula of the monomials up to a degree; with negative exponents, by the sum of their sizes."""
    out = {"1": "1"}
    if negative:
        for exps in product(range(-degree, degree + 1), repeat=len(cols)):
            if 0 < sum(map(abs, exps)) <= degree:
                terms = [c if e == 1 else f"{c}^{e}" if e > 0 else f"{c}^({e})" for c, e in zip(cols, exps, strict=True) if e]
                out["*".join(terms)] = "*".join(terms)
        return out
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(cols, d):
            terms = [c if (n := combo.count(c)) == 1 else f"{c}^{n}" for c in dict.fromkeys(combo)]
            out["*".join(terms)] = "*".join(terms)
    return out


def sindy_library(cols: list[str], degree: int = 2, trig: bool = False, exponential: bool = False) -> dict[str, str]:
    out = monomials(cols, degree)
    for c in cols:
        if trig:
            out |= {f"sin({c})": f"sin({c})", f"cos({c})": f"cos({c})"}
        if exponential:
            out[f"exp({c})"] = f"exp(min(max({c}, -20), 20))"
    return out


def build_features(df: DataFrame, formulas: dict[str, str], keep: list[str]) -> DataFrame:
    """One wide select of ``keep`` and the features."""
    return df.select(*keep, *[to_column(parse(f)).alias(name) for name, f in formulas.items()])


def standardise(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """z-scores by population deviation, within ``keys``; a column without spread is only centred."""
    stats = [f(c).alias(f"__{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    both = df.join(df.groupBy(*keys).agg(*stats), keys) if keys else df.crossJoin(F.broadcast(df.agg(*stats)))
    z = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0) for c in cols}
    return both.select(*[z[c].alias(c) if c in z else F.col(c) for c in df.columns])


def minmax(df: DataFrame, col: str) -> DataFrame:
    """Adds <col>_scaled in [0, 1]; a constant column gives 0."""
    bounds = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    return df.crossJoin(F.broadcast(bounds)).withColumn(f"{col}_scaled", F.when(span > 0, (F.col(col) - F.col("__lo")) / span).otherwise(0.0)).drop("__lo", "__hi")


def scale_by_median(df: DataFrame, col: str, ratio: float = 1000.0) -> tuple[DataFrame, float]:
    """Divides by the median size if the greatest is over ``ratio`` times that; and the divisor."""
    a = F.abs(F.col(col))
    m, x = median(df, a), df.agg(F.max(a)).first()[0]
    by = float(m) if m and x / m > ratio else 1.0
    return df.withColumn(col, F.col(col) / by), by


def target_transforms(df: DataFrame, col: str) -> dict[str, DataFrame]:
    """direct, log and inverse targets, each where over half of the rows are valid."""
    y = F.col(col)
    row = df.agg(F.count("*").alias("n"), F.count_if(y > 1e-10).alias("log"), F.count_if(F.abs(y) > 1e-10).alias("inverse")).first()
    out = {"direct": df}
    if 2 * row.log > row.n:
        out["log"] = df.filter(y > 1e-10).withColumn(col, F.ln(y))
    if 2 * row.inverse > row.n:
        out["inverse"] = df.filter(F.abs(y) > 1e-10).withColumn(col, 1 / y)
    return out


def outliers(df: DataFrame, col: str, method: str = "mad", keys: list[str] | None = None, threshold: float | None = None) -> DataFrame:
    """Adds is_outlier, within ``keys``: mad (3.5 deviations), iqr (1.5 ranges) or zscore (3 deviations)."""
    keys = keys or []
    v = F.col(col)
    joined = lambda a, b: a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))
    grouped = lambda d: d.groupBy(*keys) if keys else d.groupBy()
    if method == "iqr":
        k = 1.5 if threshold is None else threshold
        both = joined(df, percentiles(df, v, [0.25, 0.75], keys))
        lo, hi = F.col("__q")[0], F.col("__q")[1]
        return both.withColumn("is_outlier", (v < lo - k * (hi - lo)) | (v > hi + k * (hi - lo))).drop("__q")
    if method == "zscore":
        k = 3.0 if threshold is None else threshold
        both = joined(df, grouped(df).agg(F.avg(v).alias("__m"), F.stddev_pop(v).alias("__s")))
        return both.withColumn("is_outlier", F.coalesce(F.abs(v - F.col("__m")) > k * F.col("__s"), F.lit(False))).drop("__m", "__s")
    k = 3.5 if threshold is None else threshold
    # the middles are a row a group: written once, so that neither they nor the deviations are made again for what follows
    most = largest_group(df, v, keys)
    middle = written(percentiles(df, v, [0.5], keys, largest=most).select(*keys, F.col("__q")[0].alias("__m")))
    dev = joined(df, middle).withColumn("__d", F.abs(v - F.col("__m")))
    spread = written(percentiles(dev, F.col("__d"), [0.5], keys, largest=most).select(*keys, F.col("__q")[0].alias("__mad")))
    return joined(dev, spread).withColumn("is_outlier", F.coalesce(F.col("__d") > k * F.col("__mad") / 0.6745, F.lit(False))).drop("__m", "__d", "__mad")


def banned(formulas: list[str], ban: list[str], polynomial: bool = False) -> list[str]:
    """Formulas without the banned words; with ``polynomial``, without any function call or fractional power."""
    out = [f for f in formulas if not any(b in f for b in ban)]
    if not polynomial:
        return out
    plain = {"add", "sub", "mul", "neg", "pow"}
    return [f for f in out if all(n.fn in plain and (n.fn != "pow" or isinstance(n.args[1], ast.Num) and n.args[1].value == int(n.args[1].value) >= 0) for n in ast.walk(parse(f)) if isinstance(n, ast.Call))]


def detected_poles(df: DataFrame, v: str, y: str, most: int = 5) -> list[float]:
    """Values of a variable at which y isn't finite on any row (unfiltered rows show them); none if there are more than ``most``."""
    cy = F.col(y).cast("double")
    finite = F.coalesce(cy.isNotNull() & ~F.isnan(cy) & (F.abs(cy) < float("inf")), F.lit(False))
    rows = df.groupBy(F.col(v).cast("double").alias("v")).agg(F.max(finite).alias("some")).filter(~F.col("some") & F.col("v").isNotNull() & ~F.isnan("v")).select("v").orderBy("v").limit(most + 1).collect()
    return [r.v for r in rows] if len(rows) <= most else []


def detected_frequency(df: DataFrame, v: str, y: str, bins: int = 4096) -> float | None:
    """2 pi over the mean period of the sign changes of y less its mean, over means in bins of the variable."""
    own = df.select(F.col(v).cast("double").alias("v"), F.col(y).cast("double").alias("y"))
    s = own.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("y").alias("m")).first()
    if s.lo is None or s.hi <= s.lo:
        return None
    place = F.least(F.floor((F.col("v") - s.lo) / (s.hi - s.lo) * bins), F.lit(bins - 1))
    # at most a row for each bin
    rows = sorted((r.v, r.y - s.m) for r in own.groupBy(place.alias("b")).agg(F.avg("v").alias("v"), F.avg("y").alias("y")).collect() if r.v is not None)
    cuts = [a + (b - a) * f / (f - g) for (a, f), (b, g) in zip(rows[:-1], rows[1:], strict=True) if f * g < 0]
    periods = (len(cuts) - 1) // 2
    return round(2 * math.pi * periods / (cuts[2 * periods] - cuts[0]), 2) if periods else None


def detected_power(df: DataFrame, v: str, y: str) -> float | None:
    """The exponent of a power law that explains log |y| by log |x| almost wholly."""
    lx, ly = (F.when(F.abs(F.col(c)) > 0, F.ln(F.abs(F.col(c)))) for c in (v, y))
    row = df.agg(F.regr_slope(ly, lx).alias("p"), F.regr_r2(ly, lx).alias("r2")).first()
    return round(float(row.p), 4) if row.p is not None and row.r2 is not None and row.r2 > 0.999 else None


def admissible_features(df: DataFrame, variables: list[str], stage: int = 1, y: str | None = None, poles: dict[str, list[float]] | None = None) -> dict[str, str]:
    """The candidate library by name: stage 1 algebraic, stage 2 with transcendental functions.

    One aggregate of extremes and zero counts decides which candidates are defined on all rows. With a target ``y``,
    exponents and (for one variable) a frequency found in it add their terms; so do ``poles`` by variable.
    """
    stats = df.agg(*[f.alias(f"{n}_{v}") for v in variables for n, f in (("lo", F.min(v)), ("hi", F.max(v)), ("zero", F.count_if(F.col(v) == 0)))]).first()
    lo, hi, zero = ({v: stats[f"{k}_{v}"] for v in variables} for k in ("lo", "hi", "zero"))
    out = {"1": "1"}
    put = lambda *fs: out.update({f: f for f in fs})
    for v in variables:
        put(v, f"{v}^2", f"{v}^3", f"{v}^4", f"{v}^5", f"{v}^10")
        for c in (340, 30, 100, 3e8, round(hi[v] + 1, 6), round(lo[v] - 1, 6)):
            if not lo[v] <= c <= hi[v]:
                put(f"1/({c:g}-{v})")
        if not zero[v]:
            put(f"1/{v}", f"1/{v}^2")
            power = detected_power(df, v, y) if y else None
            if power is not None and power < -1:
                put(f"1/{v}^{-power:g}")
        for p in (poles or {}).get(v, []):
            put(*[f"{top}/({v}-({p:.10g}))^{n}" for top in ("1", v) for n in (1, 2)])
        if lo[v] >= 0:
            put(f"sqrt({v})")
    for i, a in enumerate(variables):
        for b in variables[i + 1 :]:
            put(f"{a}*{b}", f"{a}^2*{b}", f"{a}*{b}^2")
            if lo[a] >= 0 and lo[b] >= 0:
                put(f"sqrt({a}*{b})")
        for b in variables:
            if a != b:
                put(f"{a}*sqrt({a}^2+{b}^2)")
                if not zero[b]:
                    put(f"{a}/{b}", f"{a}/{b}^2")
    if len(variables) >= 3:
        for i, a in enumerate(variables):
            for j, b in enumerate(variables[i + 1 :], i + 1):
                for c in variables[j + 1 :]:
                    put(f"{a}*{b}*{c}")
                for c in variables:
                    if c not in (a, b) and not zero[c]:
                        put(f"{a}*{b}/{c}", f"{a}*{b}/{c}^2", f"{a}*{b}/{c}^4")
                    for d in variables:
                        if len({a, b, c, d}) == 4 and not zero[d] and b < c:
                            put(f"{a}*{b}*{c}/{d}", f"{a}*{b}*{c}/{d}^4")
    if stage < 2:
        return out
    for v in variables:
        put(f"sin({v})", f"cos({v})", f"sin(2*{v})", f"cos(2*{v})", f"sin(pi*{v})", f"cos(pi*{v})", f"tanh({v})", f"sigmoid({v})", f"softplus({v})", f"{v}*sin({v})", f"sqrt({v}^2+1)", f"atan({v})", f"abs({v})", f"sign({v})", f"relu({v})", f"floor({v})", f"ceil({v})", f"erf({v})", f"exp(-{v}^2)", f"{v}*exp(-{v}^2)")
        if -50 <= lo[v] and hi[v] <= 50:
            put(f"exp({v})", f"exp(-{v})", f"2^{v}", f"10^{v}", f"sinh({v})", f"cosh({v})", f"{v}*exp({v})", f"{v}^2*exp({v})", f"{v}*exp(-{v})", f"{v}^2*exp(-{v})")
        if lo[v] > 0:
            put(f"log({v})", f"log10({v})", f"{v}*log({v})", f"exp(-log({v})^2)", f"lambertw({v})", f"exp(lambertw(log({v})))" if lo[v] >= 0.7 else f"log({v})", f"exp(-1/{v})", f"exp(-10/{v})", f"exp(-100/{v})")
            if hi[v] <= 20:
                put(f"{v}^{v}", f"gamma({v})")
            if hi[v] <= 100:
                put(f"{v}^3/(exp({v})-1)", f"{v}^5/(exp({v})-1)")
        if not zero[v]:
            put(f"sin({v})/{v}")
        k = detected_frequency(df, v, y) if y and len(variables) == 1 else None
        if k:
            put(f"sin({k:g}*{v})", f"cos({k:g}*{v})")
        if -1 < lo[v] and hi[v] < 1:
            put(f"1/sqrt(1-{v}^2)", f"sqrt(1-{v}^2)", f"asin({v})", f"acos({v})", f"tan({v})")
    for i, a in enumerate(variables):
        for b in variables:
            if a != b:
                put(f"exp(-{a})*cos({b})", f"exp(-{a})*sin({b})", f"{a}*sin({b})", f"{a}*cos({b})", f"{a}*exp(-{b})", f"sin({a})*cos({b})")
                if a < b:
                    put(f"sin({a})*sin({b})", f"cos({a})*cos({b})", f"exp(-{a})*exp(-{b})")
                if hi[a] <= 50:
                    put(f"exp({a})*sin({b})", f"exp({a})*cos({b})")
        put(f"exp(-{a})*cos(2*{a})", f"exp(-{a})*sin(2*{a})", f"exp(-{a})*cos({a})", f"exp(-{a})*sin({a})")
    return out
