"""Tables from files, literals and session variables; results to files."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compile import evaluate
from ..functions.parse import parse, split_top_level
from ..operators.project import to_doubles


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column as double (NaN for what isn't a number)."""
    return to_doubles(spark.read.csv(path, header=True))


def read(spark: SparkSession, path: str) -> DataFrame:
    """By extension: csv (with or without a header), parquet, json, orc, xlsx, xls or pkl; all columns double."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        first = spark.read.text(path).limit(1).collect()
        cells = first[0][0].split(",") if first else []
        headed = any(not _is_number(c) for c in cells)
        df = spark.read.csv(path, header=headed)
        return to_doubles(df if headed else df.toDF(*[f"col{k}" for k in range(len(df.columns))]))
    if kind in ("parquet", "json", "orc"):
        return to_doubles(getattr(spark.read, kind)(path))
    if kind in ("xlsx", "xls"):
        import pandas as pd

        # one sheet of a workbook: it fits the driver by format
        return to_doubles(spark.createDataFrame(pd.read_excel(path).astype(str)))
    if kind in ("pkl", "pickle"):
        raise ValueError("pickles run code when read; convert the file to parquet")
    raise ValueError(f"no reader for .{kind}")


def _is_number(x: str) -> bool:
    try:
        float(x)
    except ValueError:
        return False
    return True


def inline_arrays(spark: SparkSession, text: str) -> DataFrame:
    """x=[1, 2], y=[3, 4] as a table; cells may be formulas."""
    cols = {m[1]: [float(evaluate(parse(c))) for c in split_top_level(m[2])] for m in re.finditer(r"(\w+)\s*=\s*\[([^\]]*)\]", text)}
    if not cols or len({len(v) for v in cols.values()}) != 1:
        raise ValueError("the arrays must have one length")
    return spark.createDataFrame(list(zip(*cols.values(), strict=True)), ", ".join(f"`{k}` double" for k in cols))


def session_table(spark: SparkSession, variables: dict[str, list[float]], names: list[str]) -> DataFrame:
    """Numeric session variables of one length, by name."""
    cols = [np.asarray(variables[n], float) for n in names]
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(*cols, strict=True)], ", ".join(f"`{n}` double" for n in names))


def split_target(columns: list[str], inputs: list[str] | None = None, target: str | None = None) -> tuple[list[str], str]:
    """Inputs and output: the stated target, else y, else z, else the first column that is no input."""
    target = target or next((c for c in ("y", "z") if c in columns and c not in (inputs or [])), None) or next(c for c in columns if c not in (inputs or []))
    return inputs or [c for c in columns if c != target], target


def sample_curve(spark: SparkSession, formula: str, lo: float = -10.0, hi: float = 10.0, n: int = 100) -> DataFrame:
    """x and y of a formula on an even grid."""
    from ..functions.compile import to_column

    x = F.lit(lo) + F.col("id") * ((hi - lo) / max(n - 1, 1))
    return spark.range(n).select(x.alias("x")).withColumn("y", to_column(parse(formula)))


def ascii_plot(df: DataFrame, width: int = 60, height: int = 20) -> str:
    """A character plot of a curve's x and y (a bounded sample: at most 10,000 rows are read)."""
    rows = [(r.x, r.y) for r in df.select("x", "y").limit(10_000).collect() if r.y is not None and np.isfinite(r.y)]
    if not rows:
        return ""
    xs, ys = np.array(rows).T
    col = ((xs - xs.min()) / ((np.ptp(xs)) or 1) * (width - 1)).round().astype(int)
    line = ((ys.max() - ys) / ((np.ptp(ys)) or 1) * (height - 1)).round().astype(int)
    grid = [[" "] * width for _ in range(height)]
    for c, r in zip(col, line, strict=True):
        grid[r][c] = "*"
    return "\n".join("".join(r).rstrip() for r in grid)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
