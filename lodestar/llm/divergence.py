"""How far the sources of a language differ in their words: joint count histograms (operator 11).

A language keeps the terms that at least ``least_docs`` of its documents hold. A source's share
of a term, smoothed and scaled to whole numbers, depends on the term's count alone, so for a
pair of sources the terms with equal counts (a, b) are alike: the pair's histogram says how many
kept terms have each combination, and the divergence is evaluated once for a combination, times
that number. Only combinations where both count something are tallied from the terms; the cells
with a zero follow from each source's own histogram and the number of kept terms:

    (a, 0): terms with a in the first, less those tallied with any b      (0, b) likewise
    (0, 0): all kept terms, less those of either source, plus those of both

Tasks count the words of their documents by source before anything is shuffled, in tables of
bounded size. A term's row then holds a count for each source that has it, so it is as long as
the language has sources, whose pairs are the result. Tallies of pairs are summed where they are
made, and meet as sums.

All sums are whole numbers: with p and q at most 10**9 + 1, one f is at most 10**18, and all f of
a pair together at most (10**9 + V)**2 for V kept terms, which 64 bits hold for V up to 2 * 10**9.

Null text, lang and source count as empty, a row is a document (rows that repeat count each), an
empty table gives no rows, and columns besides text, lang and source aren't looked at. Ties go to
the item first in UTF-8 order. A language without kept terms has pairs of value 0 and no terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Terms that a task counts before it hands them on.
MOST_TERMS = 400_000
#: Bytes of one text that are split at once.
STRETCH = 4_000_000
SCALE = 1_000_000_000
#: What each byte of UTF-8 becomes: letters stay (A-Z lower-cased), bytes of other alphabets too, the rest parts terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def stretches(text: bytes, fold: bytes, most: int = STRETCH) -> Iterator[list[bytes]]:
    """The terms of a text in lists of bounded size; a cut never parts a term."""
    text = text.translate(fold)
    at = 0
    while len(text) - at > most:
        cut = text.find(b" ", at + most)
        if cut < 0:
            break
        yield text[at:cut].split()
        at = cut + 1
    yield text[at:].split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, occurrences and documents: sums over a task's rows, handed on when the tables are full."""
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    held: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            docs = held[lang, source]
            terms = list(own)
            columns = [pa.array([lang], pa.string()).take(pa.array([0] * len(terms), pa.int32())), pa.array([source], pa.string()).take(pa.array([0] * len(terms), pa.int32()))]
            columns += [pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            if terms:
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        counts.clear()
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own, docs, whole = counts[lang, source], held[lang, source], set()
            before = len(own)
            for terms in stretches(text.as_buffer().to_pybytes(), FOLD):
                own.update(terms)
                whole.update(terms)
            docs.update(whole)
            size += len(own) - before
            if size > MOST_TERMS:
                yield from flush()
                size = 0
    yield from flush()


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), in decimals so that no count is too large."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", wide, total.cast("decimal(20,0)")).cast("long") + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """lang, term, its occurrences in the language, and (source, n) of each source that has it, by source."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], text.alias("text"))
    partial = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    cells = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells"))
    return terms.filter(F.col("docs") >= least_docs).select("lang", "term", "total", "cells")


def pair_histograms(kept: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, s, t (s before t), a, b and m: how many kept terms occur a times in s and b times in t, zeros included.

    ``groups``: lang and source. ``sizes``: lang and v, the number of kept terms.
    """
    one = kept.select("lang", "cells", F.posexplode("cells").alias("at", "x"))
    both = one.select("lang", F.col("x.source").alias("s"), F.col("x.n").alias("a"), F.explode(F.expr("slice(cells, at + 2, size(cells))")).alias("y"))
    joint = both.groupBy("lang", "s", F.col("y.source").alias("t"), "a", F.col("y.n").alias("b")).agg(F.count("*").alias("m"))
    zero = F.lit(0).cast("long")
    cell = lambda a, b, m: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), m.cast("long").alias("m"))
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    joint = joint.select("lang", "s", "t", F.explode(F.array(cell(a, b, m), cell(a, zero, -m), cell(zero, b, -m), cell(zero, zero, m))).alias("c"))

    own = kept.select("lang", F.explode("cells").alias("x")).groupBy("lang", F.col("x.source").alias("source"), F.col("x.n").alias("n")).agg(F.count("*").alias("m"))
    second = groups.select("lang", F.col("source").alias("t"))
    pairs = groups.select("lang", F.col("source").alias("s")).join(second, "lang").filter("s < t")
    first = pairs.join(own.withColumnRenamed("source", "s"), ["lang", "s"])
    first = first.select("lang", "s", "t", F.explode(F.array(cell(F.col("n"), zero, m), cell(zero, zero, -m))).alias("c"))
    other = pairs.join(own.withColumnRenamed("source", "t"), ["lang", "t"])
    other = other.select("lang", "s", "t", F.explode(F.array(cell(zero, F.col("n"), m), cell(zero, zero, -m))).alias("c"))
    base = pairs.join(sizes, "lang").select("lang", "s", "t", cell(zero, zero, F.col("v")).alias("c"))
    tally = joint.unionByName(first).unionByName(other).unionByName(base)
    return tally.groupBy("lang", "s", "t", F.col("c.a").alias("a"), F.col("c.b").alias("b")).agg(F.sum("c.m").alias("m")).filter("m > 0")


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: other sources by divergence ("pair"), and each source's ``top`` telling terms ("term")."""
    kept = materialise(kept_terms(docs, least_docs), "kept-terms")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    in_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    in_group = kept.select("lang", F.explode("cells").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n_group"))
    # one row for each group: what its shares are divided by
    sums = groups.join(in_lang, "lang", "left").join(in_group, ["lang", "source"], "left")
    sums = materialise(sums.select("lang", "source", F.coalesce("v", F.lit(0).cast("long")).alias("v"), "n_lang", F.coalesce("n_group", F.lit(0).cast("long")).alias("n_group")), "group-sums")

    of = lambda end: sums.select("lang", F.col("source").alias(end), (F.col("n_group") + F.col("v")).alias(f"{end}_sum"))
    cells = pair_histograms(kept, sums.select("lang", "source"), sums.select("lang", "v").distinct()).join(of("s"), ["lang", "s"]).join(of("t"), ["lang", "t"])
    cells = cells.select("lang", "s", "t", "m", _share(F.col("a"), F.col("s_sum")).alias("p"), _share(F.col("b"), F.col("t_sum")).alias("q"))
    p, q, m = F.col("p"), F.col("q"), F.col("m")
    summed = cells.groupBy("lang", "s", "t").agg(F.sum(m * _gap(p, q)).alias("there"), F.sum(m * _gap(q, p)).alias("back"))
    way = lambda source, item, value: F.struct(F.col(source).alias("source"), F.col(item).alias("item"), F.col(value).alias("value"))
    found = summed.select("lang", F.explode(F.array(way("s", "t", "there"), way("t", "s", "back"))).alias("x")).select("lang", "x.*")
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.join(other, "lang").filter(F.col("source") != F.col("item")).join(found, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    terms = kept.select("lang", "term", "total", F.explode("cells").alias("x")).select("lang", "term", "total", "x.source", "x.n").join(sums, ["lang", "source"])
    terms = terms.select("lang", "source", "term", _share(F.col("n"), F.col("n_group") + F.col("v")).alias("p"), _share(F.col("total"), F.col("n_lang") + F.col("v")).alias("q")).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(p, q).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
