"""Command line: one statement per call or line, with the engine's commands."""

from __future__ import annotations

import argparse
import json
import re
import sys
import time

from . import api
from .functions.parse import FormulaError, split_top_level
from .functions.registry import points


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lodestar").getOrCreate()


def _find(text: str) -> dict:
    """f(1) = 1, f(2) = 4, find f(x)."""
    from .operators.discover import find, from_points

    m = re.search(r"find\s+(\w+)\s*\(([^)]*)\)", text)
    if not m:
        raise FormulaError("SYNTAX_ERROR", "say find f(x)")
    variables = [v.strip() for v in m[2].split(",")]
    own = points(text, m[1])
    found = find(from_points(_spark(), own, variables), variables, "y")
    api.session.define(f"{m[1]}({', '.join(variables)}) = {found.formula}")
    return {"formula": found.formula, "mse": found.mse, "r2": found.r2, "sure": found.sure}


#: Short forms of evolve and the flags that they stand for.
SHORTCUTS = {"alt": "--hybrid --transform", "all": "--hybrid --transform --boost 3", "b": "--boost 3", "h": "--hybrid", "v": "--verbose", "ode": "--discover-ode"}


def _evolve(text: str) -> dict:
    """evolve f(x, y) from file.csv [--boost N] [--seed formula] [--ban a,b] [--polynomial] [--hybrid] [--transform] [--discover-ode] [--verbose] [--hp].

    --hybrid breeds from the formula that discovery finds; --polynomial allows no function calls; --hp also gives the best
    formula's error in 50 digits. ``--file path`` stands for ``from path``.
    """
    from .operators.genetic import Config, precise_mse, search, search_transformed
    from .operators.project import banned
    from .sources.readers import read, split_target

    m = re.match(r"\w+\s+(\w+)\s*\(([^)]*)\)(?:.*?(?:from|--file)\s+(\S+))", text)
    if not m:
        raise FormulaError("SYNTAX_ERROR", "say evolve f(x) from a file")
    flag = lambda name: re.search(rf"--{name}(?:\s|$)", text) is not None
    if flag("discover-ode"):
        return _ode(f"find ode {m[3]}")
    boost = int(b[1]) if (b := re.search(r"--boost\s+(\d+)", text)) else 1
    seeds = re.findall(r"--seed\s+(\S+)", text)
    ban = b[1].split(",") if (b := re.search(r"--ban\s+(\S+)", text)) else []
    df = read(_spark(), m[3])
    inputs, target = split_target(df.columns, [v.strip() for v in m[2].split(",")])
    if flag("hybrid"):
        from .operators.discover import find

        seeds.append(find(df, inputs, target).formula)
    base = Config()
    polynomial = flag("polynomial")
    config = Config(
        population=100 * boost, islands=2, generations=30 * boost, seconds=15.0 * boost, seeds=tuple(banned(seeds, ban, polynomial)),
        unary=() if polynomial else tuple(u for u in base.unary if u not in ban), binary=tuple(b for b in (("add", "sub", "mul") if polynomial else base.binary) if b not in ban),
    )
    if flag("transform"):
        name, formula, mse = search_transformed(df, inputs, target, config)
        return {"formula": formula, "mse": mse, "transform": name}
    found = search(df, inputs, target, config)
    best = found.best
    api.session.define(f"{m[1]}({', '.join(inputs)}) = {best[0]}")
    out = {"formula": best[0], "mse": best[1], "complexity": best[2]}
    if flag("verbose"):
        out |= {"front": found.front, "generations": found.generations}
    if flag("hp") or flag("high-precision"):
        out["mse_50_digits"] = str(precise_mse(df, best[0], inputs, target))
    return out


def _ode(text: str) -> dict:
    from pyspark.sql import functions as F

    from .operators.dynamics import sindy, time_column
    from .sources.readers import read

    df = read(_spark(), text.split()[-1]).withColumn("__k", F.lit(1)).withColumn("__id", F.monotonically_increasing_id())
    t = time_column(df)
    return {"equations": sindy(df, t, [c for c in df.columns if c not in (t, "__k", "__id")], ["__k"], "__id").equations()}


def _dimensionless(text: str) -> dict:
    """find dimensionless F=N, rho=kg/m^3, v=m/s, L=m."""
    from .operators.units import Dimension, pi_groups

    pairs = [p.split("=") for p in split_top_level(text.split("dimensionless", 1)[1])]
    if not pairs or any(len(p) != 2 for p in pairs):
        raise FormulaError("SYNTAX_ERROR", "say find dimensionless name=unit, ...")
    groups = pi_groups({k.strip(): Dimension.of(v.strip()) for k, v in pairs})
    return {"groups": ["*".join(f"{k}^({v})" for k, v in g.items()) for g in groups]}


def _causal(text: str) -> dict:
    """discover causal from file.csv [--alpha 0.05]."""
    from .operators.causal import pc
    from .sources.readers import read

    df = read(_spark(), re.split(r"\s+from\s+", text)[-1].split()[0])
    alpha = float(b[1]) if (b := re.search(r"--alpha\s+(\S+)", text)) else 0.05
    graph = pc(df, df.columns, alpha)
    return {"directed": sorted(graph.directed), "undirected": sorted(graph.undirected)}


def _benchmark(text: str) -> dict:
    """benchmark [names]: discovery on equations of physics."""
    from .sources.feynman import EQUATIONS, run as benchmark, varied

    names = text.split()[1:] or [k for k in EQUATIONS if varied(k)][:10]
    rows = benchmark(_spark(), names).collect()
    return {"succeeded": sum(bool(r.exact or r.r2 > 0.999) for r in rows), "of": len(rows), "rows": [r.asDict() for r in rows]}


def _health() -> dict:
    """The parser, the algebra, the solver and Spark, each by one question."""
    checks = {"evaluate": lambda: api.evaluate("2 + 2").result == "4", "diff": lambda: api.evaluate("diff(x^2, x)").result == "2*x", "solve": lambda: api.equation("x + 1 = 0").approx == [-1.0], "spark": lambda: _spark().range(3).count() == 3}
    out = {}
    for name, ask in checks.items():
        try:
            out[name] = bool(ask())
        except Exception as e:  # a report names what fails, whatever it is
            out[name] = f"{type(e).__name__}: {e}"
    return {"ok": all(v is True for v in out.values()), **out}


_timing = False


def run(text: str) -> dict:
    """The result of one statement; with timing on, also the seconds it took."""
    start = time.perf_counter()
    out = _run(text)
    return out | {"seconds": round(time.perf_counter() - start, 6)} if _timing else out


def _run(text: str) -> dict:
    global _timing
    text = text.strip()
    word = text.split()[0] if text.split() else ""
    if text.startswith("find ode"):
        return _ode(text)
    if text.startswith("find dimensionless"):
        return _dimensionless(text)
    if text.startswith("discover causal"):
        return _causal(text)
    if word == "benchmark":
        return _benchmark(text)
    if word == "health":
        return _health()
    if word == "timing":
        _timing = text.split()[-1] != "off"
        return {"timing": _timing}
    if word in SHORTCUTS and re.match(rf"{word}\s+\w+\s*\([^)]*\).*(?:from|--file)\s", text):
        return _evolve(f"{text} {SHORTCUTS[word]}")
    if re.search(r"\bfind\s+\w+\s*\(", text):
        return _find(text)
    if word == "evolve":
        return _evolve(text)
    if word == "plot":
        from .sources.readers import ascii_plot, sample_curve

        return {"plot": ascii_plot(sample_curve(_spark(), text[5:]))}
    if word == "export":
        return {"python": api.session.export(text.split()[1])}
    if word in ("savefunctions", "loadfunctions"):
        path = text.split()[1] if len(text.split()) > 1 else "functions.json"
        return {"bad": api.session.load(path)} if word == "loadfunctions" else {"saved": api.session.save(path) or path}
    if word == "showfunctions":
        return {"functions": {k: f"({', '.join(p)}) = {b}" for k, (p, b) in api.session.functions.items()}}
    if word in ("savecache", "loadcache", "replacecache"):
        path = text.split()[1] if len(text.split()) > 1 else "cache.json"
        return {"saved": api.cache.save(path) or path} if word == "savecache" else {"read": api.cache.load(path, word == "replacecache")}
    if word in ("showcache", "cachehits"):
        return {"entries": len(api.cache.held), "hits": api.cache.hits, "misses": api.cache.misses}
    if word == "clearcache":
        api.cache.clear()
        return {"ok": True}
    if word == "clearfunctions":
        api.session.clear()
        return {"ok": True}
    if re.search(r"[<>]", text) and "=" not in re.sub(r"[<>]=", "", text):
        return vars(api.inequality(text))
    if re.fullmatch(r"\w+\s*\(\s*[A-Za-z_]\w*(\s*,\s*[A-Za-z_]\w*)*\s*\)\s*=[^=].*", text):
        return {"defined": api.session.define(text)}
    parts = split_top_level(text)
    if len(parts) > 1 and all(re.search(r"(?<![<>!=])=(?!=)", p) for p in parts):
        return vars(api.system(text))
    if re.search(r"(?<![<>!=])=(?!=)", text):
        return vars(api.equation(text))
    return api.evaluate(text).to_dict()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestar", description=__doc__)
    p.add_argument("-e", "--expression", action="append", default=[])
    p.add_argument("--format", choices=("json", "text"), default="text")
    args = p.parse_args(argv)
    status = 0
    for line in args.expression or sys.stdin:
        if not line.strip():
            continue
        try:
            out = run(line)
        except (FormulaError, ValueError) as e:
            out, status = {"ok": False, "error": str(e), "error_code": getattr(e, "code", "ERROR")}, 1
        print(json.dumps(out, default=str) if args.format == "json" else "\n".join(f"{k}: {v}" for k, v in out.items() if v not in (None, [], "")))
    return status


if __name__ == "__main__":
    sys.exit(main())
