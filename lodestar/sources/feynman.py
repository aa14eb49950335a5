"""Equations of physics with ranges, a seeded sampler, and a benchmark of discovery on them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ast
from ..functions.cas import equivalent
from ..functions.compile import to_column, to_sql
from ..functions.parse import parse

# fixed values: the published benchmark of equations of the Feynman lectures, by volume, chapter and number.
# A name that is a function or constant here has an underscore at its end.
EQUATIONS = {
    "I.6.2a": "exp(-theta^2/2)/sqrt(2*pi)",
    "I.6.2b": "exp(-(theta-theta1)^2/(2*sigma^2))/(sqrt(2*pi)*sigma)",
    "I.9.18": "G*m1*m2/((x2-x1)^2+(y2-y1)^2+(z2-z1)^2)",
    "I.10.7": "m_0/sqrt(1-v^2/c^2)",
    "I.11.19": "x1*y1+x2*y2+x3*y3",
    "I.12.1": "m*u^2/2",
    "I.12.2": "q1*q2/(4*pi*epsilon*r^2)",
    "I.12.4": "q1/(4*pi*epsilon*r^2)",
    "I.12.5": "q2*Ef",
    "I.12.11": "q*(Ef+B*v*sin(theta))",
    "I.13.4": "0.5*m*(v^2+u^2+w^2)",
    "I.13.12": "G*m1*m2*(1/r2-1/r1)",
    "I.14.3": "m*g*z",
    "I.14.4": "0.5*k*x^2",
    "I.15.3t": "(t-u*x/c^2)/sqrt(1-u^2/c^2)",
    "I.15.3x": "(x-u*t)/sqrt(1-u^2/c^2)",
    "I.16.6": "(u+v)/(1+u*v/c^2)",
    "I.18.4": "(m1*r1+m2*r2)/(m1+m2)",
    "I.24.6": "0.25*m*(omega^2+omega_0^2)*x^2",
    "I.25.13": "q/C",
    "I.26.2": "asin(n*sin(theta2))",
    "I.27.6": "1/(1/d1+n/d2)",
    "I.29.4": "omega_0/(1-v/c)",
    "I.29.16": "sqrt(x1^2+x2^2-2*x1*x2*cos(theta1-theta2))",
    "I.30.3": "Int*sin(n*theta/2)^2/(n*theta/2)^2",
    "I.32.5": "q^2*a^2/(6*pi*epsilon*c^3)",
    "I.34.8": "q*v*B/p",
    "I.37.4": "I1+I2+2*sqrt(I1*I2)*cos(delta)",
    "I.38.12": "4*pi*epsilon*(h/(2*pi))^2/(m*q^2)",
    "I.39.1": "3/2*p*V",
    "I.39.11": "1/(gamma_-1)*p*V",
    "I.39.22": "n*kb*T/V",
    "I.40.1": "n_0*exp(-m*g*x/(kb*T))",
    "I.41.16": "h*omega^3/(pi^2*c^2*(exp(h*omega/(kb*T))-1))",
    "I.43.16": "m*v+m*w*r/3",
    "I.43.31": "m*g*(kb*T)/(6*pi*eta*r)",
    "I.43.43": "kb*T*v/(6*pi*eta*r)",
    "I.44.4": "n*kb*T*log(V2/V1)",
    "I.47.23": "sqrt(gamma_*p/rho)",
    "I.48.2": "m*c^2/sqrt(1-v^2/c^2)",
    "I.50.26": "x1*(cos(omega*t)+alpha*cos(omega*t)^2)",
    "II.2.42": "kappa*(T2-T1)*A/d",
    "II.3.24": "Pwr/(4*pi*r^2)",
    "II.4.23": "q/(4*pi*epsilon*r)",
    "II.6.11": "C*V^2/2",
    "II.6.15a": "epsilon*Ef^2/2",
    "II.8.31": "epsilon*Ef^2/2",
    "II.11.3": "q*Ef/(m*(omega_0^2-omega^2))",
    "II.11.17": "n_0*(1+p*d*Ef/(kb*T))",
    "II.11.20": "n_rho*p^2*Ef/(3*kb*T)",
    "II.21.32": "q/(4*pi*epsilon*r*(1-v/c))",
    "II.24.17": "sqrt(omega^2/c^2-pi^2/d^2)",
    "II.27.16": "epsilon*c*Ef^2",
    "II.27.18": "epsilon*Ef^2",
    "II.34.2a": "q*v/(2*pi*r)",
    "II.34.2": "q*v*r/2",
    "II.34.11": "g_*q*B/(2*m)",
    "II.34.29a": "q*h/(4*pi*m)",
    "II.34.29b": "g_*mom*B/h",
    "II.35.18": "n_0/(exp(mom*B/(kb*T))+exp(-mom*B/(kb*T)))",
    "II.35.21": "n*mom*tanh(mom*B/(kb*T))",
    "II.36.38": "mom*H/(kb*T)+(mom*alpha)/(epsilon*c^2*kb*T)*M",
    "II.37.1": "mom*(1+chi)*B",
    "II.38.3": "Y*A*x/d",
    "II.38.14": "Y/(2*(1+sigma))",
    "III.4.32": "1/(exp((h*omega)/(kb*T))-1)",
    "III.4.33": "h*omega/(exp(h*omega/(kb*T))-1)",
    "III.7.38": "2*mom*B/h",
    "III.8.54": "sin(E_*d/h)^2",
    "III.9.52": "p*d*Ef*sin(theta)/h",
    "III.10.19": "mom*sqrt(Bx^2+By^2+Bz^2)",
    "III.12.43": "n*h",
    "III.13.18": "2*E_*d^2*k/h",
    "III.14.14": "I_0*(exp(q*V/(kb*T))-1)",
    "III.15.12": "2*U*(1-cos(k*d))",
    "III.15.14": "h^2/(2*E_*d^2)",
    "III.15.27": "2*pi*alpha/(n*d)",
    "III.17.37": "beta*(1+alpha*cos(theta))",
    "III.19.51": "-m*q^4/(2*(4*pi*epsilon)^2*h^2)*(1/n^2)",
    "III.21.20": "-rho*c*d*cos(theta)/r",
}
_PI = math.pi
# fixed values: the ranges that a symbol has where an equation names no other (a constant's ends are equal)
COMMON = {
    "G": (6.67e-11, 6.67e-11), "c": (3e8, 3e8), "epsilon": (8.85e-12, 8.85e-12), "kb": (1.38e-23, 1.38e-23), "h": (1.05e-34, 1.05e-34), "g": (9.8, 9.8), "mom": (9.27e-24, 9.27e-24),
    "x": (0.1, 10), "m": (0.1, 10), "u": (0.1, 10), "w": (0.1, 10), "omega": (0.1, 10), "x1": (0.1, 10), "x2": (0.1, 10), "d1": (0.1, 10), "d2": (0.1, 10), "U": (0.1, 10), "beta": (0.1, 10),
    "m1": (1, 100), "m2": (1, 100), "I1": (1, 100), "I2": (1, 100), "Int": (1, 100), "q": (1e-19, 1e-18), "q1": (1e-9, 1e-6), "q2": (1e-9, 1e-6), "r": (0.01, 1), "d": (1e-10, 1e-9), "B": (0.01, 1),
    "Ef": (1e3, 1e6), "E_": (1e-21, 1e-18), "p": (1e-30, 1e-29), "V": (1e-3, 1), "T": (200, 400), "t": (0, 10), "theta": (0, _PI), "delta": (0, 2 * _PI), "alpha": (1, 10), "gamma_": (1.1, 1.7), "g_": (1, 3),
    "n_0": (1e19, 1e21), "n_rho": (1e19, 1e21), "Y": (1e9, 1e11), "C": (1e-12, 1e-6), "eta": (1e-4, 1e-2), "m_0": (1, 10), "n": (1, 10),
}
# fixed values: the ranges that differ from those, by equation
OWN = {
    "I.6.2a": {"theta": (-3, 3)},
    "I.6.2b": {"sigma": (0.5, 2), "theta": (-3, 3), "theta1": (-1, 1)},
    "I.9.18": {"x1": (0, 5), "x2": (5, 10), "y1": (0, 5), "y2": (5, 10), "z1": (0, 5), "z2": (5, 10)},
    "I.10.7": {"v": (1e4, 2e8)},
    "I.11.19": {"x1": (-5, 5), "y1": (-5, 5), "x2": (-5, 5), "y2": (-5, 5), "x3": (-5, 5), "y3": (-5, 5)},
    "I.12.11": {"q": (1e-9, 1e-6), "v": (1, 1e6)},
    "I.13.4": {"v": (0.1, 10)},
    "I.13.12": {"m1": (1e3, 1e6), "m2": (1e3, 1e6), "r1": (1e6, 1e7), "r2": (1e7, 1e8)},
    "I.14.3": {"m": (0.1, 100), "z": (0.1, 100)},
    "I.14.4": {"k": (0.1, 100)},
    "I.15.3t": {"x": (0, 1e9), "u": (1e4, 1e8)},
    "I.15.3x": {"x": (0, 1e9), "u": (1e4, 1e8)},
    "I.16.6": {"u": (1e4, 1e8), "v": (1e4, 1e8)},
    "I.18.4": {"r1": (0, 10), "r2": (0, 10)},
    "I.24.6": {"omega_0": (0.1, 10)},
    "I.25.13": {"q": (1e-9, 1e-3)},
    "I.26.2": {"n": (1, 2), "theta2": (0.1, 1)},
    "I.27.6": {"n": (1, 2)},
    "I.29.4": {"omega_0": (1e6, 1e9), "v": (1, 1e7)},
    "I.29.16": {"theta1": (0, 2 * _PI), "theta2": (0, 2 * _PI)},
    "I.30.3": {"theta": (0.1, 3)},
    "I.32.5": {"a": (1e10, 1e15)},
    "I.34.8": {"v": (1e5, 1e8), "p": (1e-25, 1e-20)},
    "I.38.12": {"h": (6.626e-34, 6.626e-34), "m": (9.1e-31, 9.1e-31), "q": (1.6e-19, 1.6e-19)},
    "I.39.1": {"p": (1e3, 1e6)},
    "I.39.11": {"p": (1e3, 1e6)},
    "I.39.22": {"n": (1, 100), "T": (200, 500)},
    "I.40.1": {"n_0": (1e19, 1e20), "m": (1e-26, 1e-25), "x": (0, 1e4), "T": (200, 350)},
    "I.41.16": {"h": (1.05e-34, 1.05e-34), "omega": (1e12, 1e15), "T": (1000, 6000)},
    "I.43.16": {"v": (0.1, 10), "r": (0.1, 10)},
    "I.43.31": {"m": (1e-26, 1e-20), "r": (1e-9, 1e-6)},
    "I.43.43": {"v": (1e-3, 1), "r": (1e-9, 1e-6)},
    "I.44.4": {"n": (1, 100), "T": (200, 500), "V1": (1e-3, 0.5), "V2": (0.5, 1)},
    "I.47.23": {"p": (1e3, 1e6), "rho": (0.1, 10)},
    "I.48.2": {"m": (1e-30, 1e-25), "v": (1e5, 2.9e8)},
    "I.50.26": {"alpha": (0.1, 1)},
    "II.2.42": {"kappa": (0.1, 400), "T1": (200, 300), "T2": (300, 400), "A": (1e-4, 1), "d": (0.01, 1)},
    "II.3.24": {"Pwr": (1, 1e6), "r": (0.1, 100)},
    "II.4.23": {"q": (1e-9, 1e-6)},
    "II.6.11": {"V": (1, 1e3)},
    "II.6.15a": {"Ef": (1e3, 1e7)},
    "II.8.31": {"epsilon": (8.85e-12, 1e-10), "Ef": (1e3, 1e7)},
    "II.11.3": {"m": (1e-30, 1e-25), "omega_0": (1e12, 1e15), "omega": (1e11, 9e14)},
    "II.21.32": {"v": (1e5, 1e8)},
    "II.24.17": {"omega": (1e10, 1e12), "d": (0.01, 0.1)},
    "II.27.16": {"Ef": (1, 1e6)},
    "II.27.18": {"Ef": (1, 1e6)},
    "II.34.2a": {"v": (1e3, 1e7), "r": (1e-10, 1e-8)},
    "II.34.2": {"v": (1e3, 1e7), "r": (1e-10, 1e-8)},
    "II.34.11": {"m": (1e-30, 1e-25)},
    "II.34.29a": {"q": (1.6e-19, 1.6e-19), "h": (6.626e-34, 6.626e-34), "m": (9.1e-31, 9.1e-31)},
    "II.35.18": {"T": (1, 100)},
    "II.35.21": {"n": (1e19, 1e21), "T": (1, 100)},
    "II.36.38": {"H": (1, 1e5), "T": (100, 1000), "M": (1e3, 1e6)},
    "II.37.1": {"chi": (-1, 10)},
    "II.38.3": {"A": (1e-6, 1e-2), "x": (1e-4, 1e-2), "d": (0.1, 10)},
    "II.38.14": {"sigma": (0.1, 0.5)},
    "III.4.32": {"omega": (1e12, 1e15), "T": (1, 1000)},
    "III.4.33": {"omega": (1e12, 1e15), "T": (1, 1000)},
    "III.7.38": {"mom": (9.27e-24, 1.4e-26), "B": (0.1, 10)},
    "III.9.52": {"Ef": (1e5, 1e8)},
    "III.10.19": {"Bx": (-1, 1), "By": (-1, 1), "Bz": (-1, 1)},
    "III.13.18": {"k": (1e9, 1e11)},
    "III.14.14": {"I_0": (1e-12, 1e-9), "q": (1.6e-19, 1.6e-19), "V": (-0.5, 1), "T": (250, 400)},
    "III.15.12": {"k": (0, _PI)},
    "III.15.27": {"n": (1, 5)},
    "III.17.37": {"alpha": (-1, 1)},
    "III.19.51": {"m": (9.1e-31, 9.1e-31), "q": (1.6e-19, 1.6e-19)},
    "III.21.20": {"rho": (1e19, 1e21), "c": (1e-10, 1e-9), "r": (1e-10, 1e-8)},
}


def ranges(name: str) -> dict[str, tuple[float, float]]:
    """Each variable's range in an equation."""
    own = OWN.get(name, {})
    return {v: tuple(map(float, own.get(v) or COMMON[v])) for v in ast.symbols(parse(EQUATIONS[name]))}


def varied(name: str) -> bool:
    """No variable is held constant: such equations are in the benchmark by default."""
    return all(lo != hi for lo, hi in ranges(name).values())


def equation_table(spark: SparkSession) -> DataFrame:
    rows = [(k, f, list(r := ranges(k)), [v[0] for v in r.values()], [v[1] for v in r.values()]) for k, f in EQUATIONS.items()]
    return spark.createDataFrame(rows, "name string, formula string, variables array<string>, lo array<double>, hi array<double>")


def sample(spark: SparkSession, name: str, n: int = 100, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Uniform draws in the ranges and y, with Gaussian noise of ``noise`` deviations of y."""
    f = EQUATIONS[name]
    cols = [(F.rand(seed * 1009 + k) * (hi - lo) + lo).alias(v) for k, (v, (lo, hi)) in enumerate(ranges(name).items())]
    own = spark.range(n).select("id", *cols).withColumn("y", to_column(parse(f)))
    if noise:
        sd = own.agg(F.stddev_pop("y").alias("s")).first().s or 0.0
        own = own.withColumn("y", F.col("y") + F.randn(seed + 77) * noise * sd)
    return own


def grid(keys: DataFrame) -> DataFrame:
    """name, id and y: every equation at a point of a lattice for each whole ``id`` (no random numbers), in one select."""
    cells = []
    for name, f in EQUATIONS.items():
        at = {v: f"({lo!r}D + CAST(id * {k + 3} % 17 AS DOUBLE) * {(hi - lo) / 17!r}D)" for k, (v, (lo, hi)) in enumerate(ranges(name).items())}
        cells += [f"'{name}'", f"CAST({to_sql(parse(f), 'spark', at)} AS DOUBLE)"]
    return keys.selectExpr("id", f"stack({len(EQUATIONS)}, {', '.join(cells)}) AS (name, y)")


def points_of(keys: DataFrame, name: str) -> DataFrame:
    """id, the equation's variables and y, each variable spread over its range by a hash of the id."""
    cols = [(F.lit(lo) + F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000_003)) * ((hi - lo) / 1_000_003)).alias(v) for k, (v, (lo, hi)) in enumerate(ranges(name).items())]
    return keys.select("id", *cols).withColumn("y", to_column(parse(EQUATIONS[name])))


def run_on(keys: DataFrame, names: list[str]) -> DataFrame:
    """name, formula, exact, r2 and n: discovery on the points of even ids, scored on those of odd ones."""
    from ..operators.discover import find, score

    spark, rows = keys.sparkSession, []
    n = keys.count()
    for name in names:
        own = points_of(keys, name)
        found = find(own.filter("id % 2 = 0"), list(ranges(name)), "y")
        mse, r2 = score(own.filter("id % 2 = 1"), {"f": found.formula}, "y")["f"]
        rows.append((name, found.formula, bool(mse < 1e-9), float(r2), n))
    return spark.createDataFrame(rows, "name string, formula string, exact boolean, r2 double, n long")


def run(spark: SparkSession, names: list[str], n: int = 100, noise: float = 0.0) -> DataFrame:
    """Discovery on training draws, scored on clean test draws: exact or R2 over 0.999 succeeds."""
    from ..operators.discover import find, score

    rows = []
    for k, name in enumerate(names):
        variables = list(ranges(name))
        found = find(sample(spark, name, n, noise, k).drop("id"), variables, "y")
        try:
            exact = equivalent(parse(found.formula), parse(EQUATIONS[name]))
        except (ValueError, KeyError):
            exact = False
        _, r2 = score(sample(spark, name, n, 0.0, k + 500), {"f": found.formula}, "y")["f"]
        rows.append((name, "find", float(noise), found.formula, bool(exact), float(r2) if not math.isnan(r2) else 0.0))
    return spark.createDataFrame(rows, "name string, method string, noise double, formula string, exact boolean, r2 double")
