"""Periods of y over x that stand gaps, uneven steps, noise and outliers.

1. Rows are averaged in bins as wide as the mean step of x. Blocks of bins, of bounded length, are clipped to their own
   middle range, so that no outlier outweighs a period, and give partial Fourier sums; their powers are added up over all
   blocks. Longer periods come from the blocks' own means, level by level.
2. Peaks are sharpened by phases: sums over windows turn against each other by what the frequency is off, first from
   one window to the next, then over lags of 2, 4, 8, ... windows, each of which narrows it further.
3. Rows are folded by each candidate: the period with the least middle spread of y within bins of phase wins.

No series is in one task, whatever its length; the driver sees a spectrum of ``BINS`` / 2 powers a level.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantile import shared_folder

#: Bins of a block, and bins of a level that make one of the next.
BINS, COARSER = 1 << 16, 1 << 10
#: Periods that a peak must have in a block; bins of phase; peaks that are sharpened; how far a peak stands out of the median power.
CYCLES, PHASES, PEAKS, CLEAR = 4, 64, 6, 12.0


@dataclass(frozen=True)
class Period:
    length: float
    #: Share of the middle spread of y that is left within bins of phase.
    spread: float


@dataclass(frozen=True)
class Sampling:
    n: int
    lo: float
    hi: float
    step: float
    whole: bool


def sampling(df: DataFrame, x: str) -> Sampling | None:
    """Range and mean step of x, and whether it is whole; None where there are too few values."""
    c = F.col(x).cast("double")
    row = df.agg(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.approx_count_distinct(c, 0.02).alias("d"), F.count_if(c != F.floor(c)).alias("broken")).first()
    if row.n < 8 or row.hi <= row.lo:
        return None
    step = (row.hi - row.lo) / max(1, row.d - 1)
    return Sampling(row.n, row.lo, row.hi, max(1.0, float(round(step))) if not row.broken else step, not row.broken)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, places of its bins, their values) of rows that come sorted by block."""
    held_i, held_v, block = [], [], None
    for batch in batches:
        b, i, v = (np.asarray(batch.column(k)) for k in range(3))
        cut = np.nonzero(np.r_[True, b[1:] != b[:-1]])[0] if len(b) else []
        for lo, hi in zip(cut, [*cut[1:], len(b)], strict=True):
            if block is not None and b[lo] != block:
                yield block, np.concatenate(held_i), np.concatenate(held_v)
                held_i, held_v = [], []
            block = int(b[lo])
            held_i.append(i[lo:hi])
            held_v.append(v[lo:hi])
    if held_i:
        yield block, np.concatenate(held_i), np.concatenate(held_v)


def _clipped(i: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Values less their line through the middle, cut to three times their middle range."""
    third = max(1, len(v) // 3)
    order = np.argsort(i, kind="stable")
    head, tail = order[:third], order[-third:]
    gap = np.median(i[tail]) - np.median(i[head])
    slope = (np.median(v[tail]) - np.median(v[head])) / gap if gap > 0 else 0.0
    r = v - slope * i
    low, mid, high = np.percentile(r, [25, 50, 75])
    r = r - mid
    most = 3 * max(high - mid, mid - low)
    return np.clip(r, -most, most) if most > 0 else np.sign(r)


def _levels(df: DataFrame, x: str, y: str, s: Sampling) -> Iterator[tuple[DataFrame, float]]:
    """Tables of bins (i, v), ever coarser ones, and their bins' width; each is written to the shared folder."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/period-{uuid.uuid4().hex}"
    place = F.floor((F.col(x).cast("double") - s.lo) / s.step).cast("long")
    bins = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(place.alias("i")).agg(F.avg(F.col(y).cast("double")).alias("v"))
    width, size, level = s.step, (s.hi - s.lo) / s.step, 0
    while True:
        bins.write.parquet(f"{folder}/{level}")
        bins = spark.read.parquet(f"{folder}/{level}")
        yield bins, width
        if size <= BINS:
            return
        # what is averaged out are periods that the level before has seen
        bins = bins.groupBy(F.floor(F.col("i") / COARSER).cast("long").alias("i")).agg(F.avg("v").alias("v"))
        width, size, level = width * COARSER, size / COARSER, level + 1


def powers(bins: DataFrame, size: int) -> np.ndarray:
    """The power of each frequency k / size of the blocks of ``size`` bins, each block's sums to 1, averaged over blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, blocks = np.zeros(size // 2 + 1), 0
        for block, i, v in _blocks(batches):
            if len(v) < 8:
                continue
            at = i - block * size
            dense = np.zeros(size)
            dense[at] = _clipped(at, v)
            power = np.abs(np.fft.rfft(dense)) ** 2
            if power.sum() > 0:
                total += power / power.sum()
                blocks += 1
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), blocks))], ["k", "p", "blocks"])

    rows = bins.select(F.floor(F.col("i") / size).cast("long").alias("b"), "i", "v").repartition("b").sortWithinPartitions("b", "i")
    out = np.zeros(size // 2 + 1)
    for r in rows.mapInArrow(run, "k long, p double, blocks long").groupBy("k").agg(F.sum("p").alias("p"), F.sum("blocks").alias("n")).collect():
        out[r.k] = r.p / r.n
    return out


def _peaks(power: np.ndarray, size: int, count: int = PEAKS) -> list[float]:
    """Frequencies (cycles a bin) of the clearest local maxima, the strongest first, between their neighbours by their powers."""
    k = np.arange(CYCLES, len(power) - 1)
    own = power[k]
    tops = k[(own >= power[k - 1]) & (own >= power[k + 1]) & (own > CLEAR * np.median(power[CYCLES:]))]
    best = tops[np.argsort(-power[tops], kind="stable")][:count]
    return [float((np.arange(b - 1, b + 2) * power[b - 1 : b + 2]).sum() / power[b - 1 : b + 2].sum()) / size for b in best]


def sharpened(bins: DataFrame, frequencies: list[float], size: int, length: float) -> list[float]:
    """Frequencies by the phases of windows: by those of one and the next, then of 2, 4, 8, ... apart."""
    # a window holds some periods of the lowest frequency, and the spectrum's error turns it by less than half
    widths = [max(size // 16, math.ceil(CYCLES / f)) for f in frequencies]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, i, v in _blocks(batches):
            r = _clipped((i - block * size).astype(float), v) if len(v) >= 8 else np.zeros(len(v))
            for j, (f, w) in enumerate(zip(frequencies, widths, strict=True)):
                window = i // w
                first = int(window.min())
                turn = np.exp(-2j * np.pi * np.mod(f * i.astype(float), 1.0)) * r
                re, im = (np.bincount(window - first, part) for part in (turn.real, turn.imag))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(re), j)), pa.array(np.arange(len(re)) + first), pa.array(re), pa.array(im)], ["j", "w", "re", "im"])

    rows = bins.select(F.floor(F.col("i") / size).cast("long").alias("b"), "i", "v").repartition("b").sortWithinPartitions("b", "i")
    sums = rows.mapInArrow(run, "j long, w long, re double, im double").groupBy("j", "w").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    lags = range(max(1, int(math.log2(max(2.0, length / min(widths))))))
    later = sums.select("j", F.explode(F.array(*[F.lit(1 << k).cast("long") for k in lags])).alias("lag"), F.col("w").alias("w2"), F.col("re").alias("re2"), F.col("im").alias("im2")).withColumn("w", F.col("w2") - F.col("lag"))
    a, b, c, d = (F.col(k) for k in ("re", "im", "re2", "im2"))
    turns = sums.join(later, ["j", "w"]).groupBy("j", "lag").agg(F.sum(a * c + b * d).alias("re"), F.sum(a * d - b * c).alias("im")).collect()
    out = list(frequencies)
    for j, w in enumerate(widths):
        off = 0.0
        for r in sorted((r for r in turns if r.j == j), key=lambda r: r.lag):
            seen = math.atan2(r.im, r.re) / (2 * math.pi)
            turned = off * r.lag * w
            off = (turned + (seen - turned + 0.5) % 1.0 - 0.5) / (r.lag * w)
        out[j] += off
    return out


def fourier_sums(df: DataFrame, x: str, y: str, lengths: list[float], keys: list[str] | None = None) -> DataFrame:
    """keys, length, n, re and im: sums of (y - its mean) e^(-2 pi i x / length) for each length, in one pass."""
    keys = list(keys or [])
    own = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    each = own.select(*keys, "__x", "__y", F.explode(F.array(*[F.lit(float(p)) for p in lengths])).alias("length"))
    turn = 2 * math.pi * phase(F.col("__x"), 0.0, F.col("length"))
    sums = each.groupBy(*keys, "length").agg(F.count("*").alias("n"), F.avg("__y").alias("m"), F.sum(F.col("__y") * F.cos(turn)).alias("yc"), F.sum(F.col("__y") * F.sin(turn)).alias("ys"), F.sum(F.cos(turn)).alias("c"), F.sum(F.sin(turn)).alias("s"))
    return sums.select(*keys, "length", "n", (F.col("yc") - F.col("m") * F.col("c")).alias("re"), (F.col("m") * F.col("s") - F.col("ys")).alias("im"))


def phase(x: Column, start: float, length: float | Column) -> Column:
    """Place in the period, from 0 to 1."""
    t = (x - F.lit(start)) / (length if isinstance(length, Column) else F.lit(length))
    return t - F.floor(t)


def folded(df: DataFrame, x: str, y: str, lengths: list[float], start: float = 0.0, phases: int = PHASES) -> DataFrame:
    """k (the length's number), bin of phase, n, the middle of y and its quartiles, and the mean phase: one pass for all lengths."""
    c = F.col(x).cast("double")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), phase(c, start, p).alias("at")) for k, p in enumerate(lengths)]))
    rows = df.select(F.col(y).cast("double").alias("y"), each.alias("f")).select("y", "f.k", "f.at")
    quartiles = F.percentile_approx("y", [0.25, 0.5, 0.75], 200).alias("q")
    return rows.groupBy("k", F.least(F.floor(F.col("at") * phases), F.lit(phases - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("at").alias("at"), quartiles)


def periods(df: DataFrame, x: str, y: str, clear: float = 0.5) -> list[Period]:
    """Periods of y over x, the best first: those that leave at most ``clear`` of y's middle spread within bins of phase.

    Whole x has whole periods where they do as well. Rows without x or y don't take part.
    """
    own = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = sampling(own, x)
    if s is None:
        return []
    lengths: list[float] = []
    for bins, width in _levels(own, x, y, s):
        size = min(BINS, 1 << max(4, math.ceil(math.log2((s.hi - s.lo) / width + 2))))
        found = _peaks(powers(bins, size), size)
        if found:
            lengths += [width / f for f in sharpened(bins, found, size, (s.hi - s.lo) / width) if f > 0]
    # a spectrum doesn't tell periods that come once or twice: lengths around those are tried
    lengths += [(s.hi - s.lo) / k for k in (1.3, 1.5, 1.75, 2, 2.3, 2.6, 3, 3.5)]
    longest = (s.hi - s.lo) / 1.2
    whole = own.agg(F.percentile_approx(F.col(y).cast("double"), [0.25, 0.75], 1000).alias("q")).first().q
    middle = whole[1] - whole[0]
    start = 0.0 if s.whole else s.lo
    # a bin of a key or two is even whatever the period
    phases = int(min(PHASES, max(4, (s.hi - s.lo) / s.step / 8)))

    def spreads(tried: list[float]) -> dict[float, float]:
        tried = list(dict.fromkeys(p for p in tried if 2 * s.step <= p <= longest))
        if not tried:
            return {}
        rows = folded(own, x, y, tried, start, phases).groupBy("k").agg((F.sum((F.col("q")[2] - F.col("q")[0]) * F.col("n")) / F.sum("n")).alias("s")).collect()
        return {tried[r.k]: r.s / middle for r in rows}

    if not middle > 0:
        return []
    # a peak may be the first harmonic
    seen = spreads([q for p in lengths for q in (p, 2 * p)])
    best = sorted(seen, key=lambda p: (round(seen[p], 1), p))[:4]
    if s.whole:
        # whole periods near what was measured, as far as a spectrum of this length can be off
        tried = []
        for p in best:
            slack = max(0.5, p * p / (s.hi - s.lo) / 4)
            near = range(math.floor(p - slack), math.ceil(p + slack) + 1)
            tried += [float(r) for r in sorted(near, key=lambda r, p=p: abs(r - p))[:5]]
        seen |= spreads(tried)
    out = [Period(p, v) for p, v in seen.items() if v <= clear]
    # a multiple folds as well, in wider bins: the shortest of nearly equal ones is the period
    return sorted(out, key=lambda p: (round(p.spread, 2), s.whole and p.length % 1 != 0, p.length))


def _line(df: DataFrame, x: str, y: str, length: float) -> tuple[float, float, list] | None:
    """a and b of y = a + b mod(x, length) by the middles of bins of phase, and the bins."""
    bins = sorted(folded(df, x, y, [length]).collect(), key=lambda r: r.bin)
    if len(bins) < 3:
        return None
    at, mid = np.array([r["at"] for r in bins]) * length, np.array([r.q[1] for r in bins])
    i, j = np.triu_indices(len(at), 1)
    b = float(np.median((mid[j] - mid[i]) / (at[j] - at[i])))
    return float(np.median(mid - b * at)), b, bins


def cycle_length(df: DataFrame, x: str, y: str, length: float, rounds: int = 5) -> float:
    """A sawtooth's length, from one that is near: x - y / b is the same all over a cycle and a length more in the next.

    The middles of the cycles give the length, which gives a better b.
    """
    c, v = F.col(x).cast("double"), F.col(y).cast("double")
    for _ in range(rounds):
        line = _line(df, x, y, length)
        if not line or not line[1]:
            return length
        u = c - v / F.lit(line[1])
        base = df.agg(F.percentile_approx(u - F.lit(length) * F.floor(c / F.lit(length)), 0.5, 1000).alias("m")).first().m
        if base is None:
            return length
        cycles = df.groupBy(F.round((u - F.lit(base)) / F.lit(length)).alias("k")).agg(F.percentile_approx(u, 0.5, 1000).alias("u"), F.count("*").alias("n"))
        # what few rows are in is no cycle but outliers
        most = cycles.agg(F.percentile_approx("n", 0.5, 100).alias("n")).first().n
        new = cycles.filter(F.col("n") > 0.2 * most).agg(F.regr_slope("u", "k").alias("p")).first().p
        if new is None or not 0.5 * length < new < 2 * length:
            return length
        near = round(new)
        if near and abs(new - near) < 1e-3 and abs(new - length) < 1:
            return float(near)
        if abs(new - length) <= 1e-9 * length:
            return new
        length = new
    return length


def sawtooth(df: DataFrame, x: str, y: str, length: float, least: float = 0.9) -> tuple[float, float, float] | None:
    """(a, b, share of rows on it) of y = a + b mod(x, length), by the middles of bins of phase, then by the rows near it.

    None where fewer than ``least`` of the rows are on one.
    """
    c, v = F.col(x).cast("double"), F.col(y).cast("double")
    line = _line(df, x, y, length)
    if not line:
        return None
    a, b, bins = line
    mid = np.array([r.q[1] for r in bins])
    place = c - F.lit(length) * F.floor(c / F.lit(length))
    scale = max(1e-12, float(np.abs(mid).max()), abs(b) * length)
    width = max(abs(b) * length / PHASES, float(np.median([r.q[2] - r.q[0] for r in bins])))
    share = 0.0
    # ever narrower bands around the line: what is far from it has no part in the next
    for tolerance in (width, width / 100, 1e-9 * scale):
        near = F.abs(v - F.lit(a) - F.lit(b) * place) <= max(tolerance, 1e-9 * scale)
        row = df.agg(F.count("*").alias("n"), F.count_if(near).alias("k"), F.regr_slope(F.when(near, v), F.when(near, place)).alias("b"), F.regr_intercept(F.when(near, v), F.when(near, place)).alias("a")).first()
        share = row.k / row.n
        if share < least or row.b is None:
            return None
        a, b = row.a, row.b
    return a, b, share
