"""Near-duplicate join by n-gram Jaccard similarity with Bayesian pruning (operator 5).

A document is its set of word 5-grams. Documents with equal sets form a class. MinHash bands
find the classes that may be alike: b bands of r values miss a pair at the threshold t with
probability (1 - t^r)^b, under 1e-7 at the defaults. Classes that share bands, directly or by
others, form a cluster; a cluster is compared in tiles of bounded size, each pair of tiles once
and as a whole, so that no group's pairs become rows. A cluster of more tiles than bands is
compared by its buckets instead, each in tiles, and a pair counts in its first common band; so
a class is sent once for each band and tile of its bucket, however large clusters become.

Within a pair of tiles, signatures are compared step by step. After m equal values of k, with a
uniform prior on the similarity, P(similarity >= t | m, k) = P(Binomial(k + 1, t) <= m); a pair
is dropped once that falls below the tolerance, and what remains is verified exactly. A tile
reports each class's number of links and a spanning forest of them.

Null text and text without words takes no part: own class, no links. Text of fewer words than a
shingle is one shingle of all its words. Rows with a null doc_id take no part. Rows that repeat
are copies of one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Blocks, Outbox, U, byte_names, even_keys, gather, materialise, mix, shuffle_parts, slices, utf8
from .recompress import words_of

BANDS, ROWS = 32, 4
#: Classes of a tile.
TILE = 256
#: Rows of one key that a join takes as they come; at most ``MOST_HOT`` keys have more, and those are broadcast.
COMMON, MOST_HOT = 2000, 20_000
#: Posterior probability below which a pair is dropped.
TOLERANCE = 1e-9
_rng = np.random.default_rng(90210)
_MUL = (_rng.integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
BUCKETS = {"key": "var", "node": "var"}


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the documents' distinct word n-grams, sorted in each document, and offsets."""
    starts, ends, bounds = words_of(data, off)
    names, _ = byte_names(data, starts, ends)
    count = np.diff(bounds)
    grams = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    first = np.repeat(bounds[:-1], grams) + np.arange(int(grams.sum())) - np.repeat(np.cumsum(grams) - grams, grams)
    last = np.minimum(first + n, np.repeat(bounds[1:], grams))
    h = Blocks(names).of(first, last)
    at = np.r_[0, np.cumsum(grams)]
    sets = [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return (np.concatenate(sets) if sets else h), np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)


def signatures(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """MinHash values (u32), a row for each document; those without shingles get the greatest value."""
    n = len(off) - 1
    out = np.full((n, BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    some = np.nonzero(np.diff(off))[0]
    if len(some):
        x = (mix(h) >> U(32)).astype(np.uint32)
        for k in range(BANDS * ROWS):
            out[some, k] = np.minimum.reduceat(x * _MUL[k] + _ADD[k], off[:-1][some])
    return out


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            for a, b in slices(off):
                h, at = shingles(data[off[a] : off[b]], off[a : b + 1] - off[a], n)
                total = lambda salt: np.diff(np.r_[U(0), np.cumsum(mix(h ^ U(salt)), dtype=np.uint64)][at]).view(np.int64)  # noqa: B023,E731
                sig = signatures(h, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(total(0x51), pa.int64()), pa.array(total(0xA3), pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array([row.tobytes() for row in sig], pa.binary())], ["doc_id", "tag", "node", "check", "n", "sig"])

    return run


def _bands(keys: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outbox(keys, BUCKETS)
        for batch in batches:
            if not len(batch):
                continue
            node = batch.column(0).to_numpy().view(np.uint64)
            key = band_keys(batch.column(1).to_pylist()).reshape(-1)
            yield from out.add((key >> U(48)) % U(len(keys)), key=key, node=np.repeat(node, BANDS))
        yield from out.flush()

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a bucket with the bucket's least one."""
    got = gather(batches, BUCKETS)
    if got is None:
        return
    node = got["node"].view(np.int64)
    order = np.lexsort((node, got["key"]))
    key, node = got["key"][order], node[order]
    new = np.r_[True, key[1:] != key[:-1]]
    least = node[np.nonzero(new)[0]][np.cumsum(new) - 1]
    pairs = np.unique(np.stack([node, least], 1)[node != least], axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows with keyed (unique keys; column n: how many rows have the key), n dropped.

    Keys of over max(COMMON, total / MOST_HOT) of the ``total`` rows, MOST_HOT at most, are broadcast; the others meet by a shuffle,
    as all do where no key has as many.
    """
    most = max(COMMON, total // MOST_HOT)
    if (keyed.agg(F.max("n")).first()[0] or 0) <= most:
        return rows.join(keyed.drop("n"), key)
    hot, rest = keyed.filter(F.col("n") > most).drop("n"), keyed.filter(F.col("n") <= most).drop("n")
    marked = F.broadcast(hot.withColumn("is_hot", F.lit(True)))
    tagged = rows.join(marked, key, "left")
    own = tagged.filter("is_hot is not null").drop("is_hot")
    return own.unionByName(tagged.filter("is_hot is null").select(*rows.columns).join(rest, key).select(*own.columns))


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b): root is the least node that can be reached.

    Alternating stars: neighbours hang on to the least of each node's neighbourhood, first the
    larger ones, then the smaller; each round's edges are written, which cuts lineage. Rounds go
    on until nothing changes; a graph that isn't done after ``most_rounds`` is an error.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before, n = None, edges.count()
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both.filter("b > a"), least, "a", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, low, "a", n)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = materialise(small, "edges", instead_of=edges)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == (state.n, state.h):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before, n = (state.n, state.h), state.n
    raise RuntimeError(f"components aren't settled after {most_rounds} rounds")


def least_matches(threshold: float, tolerance: float, steps: list[int]) -> list[int]:
    """For each number k of compared values the least number of equal ones that keeps a pair."""
    out = []
    for k in steps:
        total, m = 0.0, 0
        while m <= k:
            total += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def similar_pairs(sig: np.ndarray, sets: list[np.ndarray], mine: np.ndarray, theirs: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Pairs (i of mine, j of theirs) at or over the threshold; within one tile each pair once."""
    same = mine is theirs
    steps = list(range(16, BANDS * ROWS + 1, 16))
    need = least_matches(threshold, tolerance, steps)
    i_all, j_all = [], []
    a_sig, b_sig = sig[mine], sig[theirs]
    for a in range(0, len(mine), 128):
        equal = np.zeros((min(128, len(mine) - a), len(theirs)), np.int16)
        for k in range(16):
            equal += a_sig[a : a + 128, k][:, None] == b_sig[:, k][None, :]
        i, j = np.nonzero(equal >= need[0])
        m = equal[i, j]
        i = i + a
        if same:
            i, j, m = i[i < j], j[i < j], m[i < j]
        for s in range(1, len(steps)):
            m = m + (a_sig[i, steps[s - 1] : steps[s]] == b_sig[j, steps[s - 1] : steps[s]]).sum(axis=1)
            keep = m >= need[s]
            i, j, m = i[keep], j[keep], m[keep]
        i_all.append(mine[i])
        j_all.append(theirs[j])
    i, j = np.concatenate(i_all), np.concatenate(j_all)
    if not len(i):
        return np.zeros((0, 2), np.int64)
    size = np.array([len(s) for s in sets])
    t = Fraction(str(threshold))
    used = np.unique(np.r_[i, j])
    if len(i) <= 8 * len(used):
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)])
    else:
        # many pairs of few sets: products of incidence rows, a stretch of the vocabulary at once
        words, col = np.unique(np.concatenate([sets[x] for x in used]), return_inverse=True)
        row = np.repeat(np.arange(len(used)), size[used])
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        total = np.zeros((len(used), len(used)), np.float32)
        for c in range(0, len(words), 4096):
            lo, hi = np.searchsorted(col, (c, c + 4096))
            part = np.zeros((len(used), min(4096, len(words) - c)), np.float32)
            part[row[lo:hi], col[lo:hi] - c] = 1
            total += part @ part.T
        at = np.searchsorted(used, i), np.searchsorted(used, j)
        both = total[at].astype(np.int64)
    ok = both * t.denominator >= (size[i] + size[j] - both) * t.numerator
    return np.stack([i[ok], j[ok]], 1)


def first_common(sig: np.ndarray, pairs: np.ndarray, band: int) -> np.ndarray:
    """Of pairs that share a band: those that share no earlier one."""
    a, b = (sig[pairs[:, k], : band * ROWS].reshape(len(pairs), band, ROWS) for k in (0, 1))
    return pairs[~(a == b).all(axis=2).any(axis=1)]


def _compared(band: int, ti: int, tj: int, members: dict[int, tuple[int, bytes, bytes]], threshold: float, tolerance: float) -> tuple[np.ndarray, ...] | None:
    """Nodes with links in a pair of tiles, their numbers of links, and each one's root in the tiles' spanning forest."""
    nodes = np.array(sorted(members), np.int64)
    if len(nodes) < 2:
        return None
    rows = [members[x] for x in nodes.tolist()]
    tile = np.array([r[0] for r in rows])
    sig = np.frombuffer(b"".join(r[1] for r in rows), np.uint32).reshape(len(rows), -1)
    sets = [np.frombuffer(r[2], np.uint64) for r in rows]
    mine = np.nonzero(tile == ti)[0]
    theirs = mine if ti == tj else np.nonzero(tile == tj)[0]
    if not len(mine) or not len(theirs):
        return None
    pairs = similar_pairs(sig, sets, mine, theirs, threshold, tolerance)
    if band > 0 and len(pairs):
        pairs = first_common(sig, pairs, band)
    if not len(pairs):
        return None
    links = np.bincount(pairs.reshape(-1), minlength=len(nodes))
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = np.nonzero(links)[0]
    return nodes[some], links[some], nodes[root[some]]


def _verify(threshold: float, tolerance: float):
    """Rows come sorted by group, so that a task holds one pair of tiles at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            got = _compared(*group[1:], members, threshold, tolerance) if group else None
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64), pa.int64()) for x in got], ["node", "links", "root"])

        for batch in batches:
            for cluster, band, ti, tj, tile, node, sig, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (cluster, band, ti, tj):
                    yield from done()
                    group, members = (cluster, band, ti, tj), {}
                members[node] = (tile, sig, own)
        yield from done()

    return run


def _tiles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(0))
            node, sig, places = (c.to_pylist() for c in batch.columns[1:])
            for a, b in slices(off):
                h, at = shingles(data[off[a] : off[b]], off[a : b + 1] - off[a], n)
                rows: list[tuple] = []
                for k in range(a, b):
                    own = h[at[k - a] : at[k - a + 1]].tobytes()
                    rows += [(p["cluster"], p["band"], min(p["tile"], j), max(p["tile"], j), p["tile"], node[k], sig[k], own) for p in places[k] for j in range(p["tiles"])]
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["cluster", "band", "ti", "tj", "tile", "node", "sig", "own"])

    return run


def band_keys(sig: list[bytes]) -> np.ndarray:
    """The hash of each band of signatures: a row for each signature."""
    values = np.frombuffer(b"".join(sig), np.uint32).reshape(len(sig), BANDS, ROWS)
    key = np.zeros((len(sig), BANDS), np.uint64)
    for k in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + values[:, :, k] + U(1))
    return mix(key + np.arange(BANDS, dtype=np.uint64))


def _own_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, band, cluster): each band's hash of each node."""
    for batch in batches:
        if len(batch):
            key = band_keys(batch.column(1).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(batch))), pa.array(key.reshape(-1))], ["node", "band", "cluster"])


def places(classes: DataFrame, clusters: DataFrame, tile: int) -> DataFrame:
    """(node, places): the groups that a node is compared in, as array of (cluster, band, tile, tiles); band is -1 for a whole cluster."""
    sizes = clusters.groupBy("root").agg(F.count("*").alias("size")).withColumn("n", F.col("size"))
    total = clusters.count()
    sized = join_hot(clusters, sizes, "root", total)
    place = lambda band: F.struct("cluster", band.cast("int").alias("band"), F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"), F.col("tiles").cast("int").alias("tiles"))
    tiled = sized.select("node", F.col("root").alias("cluster"), F.ceil(F.col("size") / tile).alias("tiles"))
    whole = tiled.filter(F.col("tiles") <= BANDS).select("node", F.array(place(F.lit(-1))).alias("places"))
    if not sizes.filter(F.col("size") > tile * BANDS).limit(1).count():
        return whole
    large = tiled.filter(F.col("tiles") > BANDS).select("node")
    bands = materialise(classes.join(large, "node").select("node", "sig").mapInArrow(_own_bands, "node long, band int, cluster long"), "bands")
    counts = bands.groupBy("band", "cluster").agg(F.count("*").alias("size")).filter("size > 1")
    keys = counts.select(F.xxhash64("band", "cluster").alias("key"), "size", F.col("size").alias("n")).dropDuplicates(["key"])
    shared = join_hot(bands.withColumn("key", F.xxhash64("band", "cluster")), keys, "key", BANDS * total)
    tiled = shared.withColumn("tiles", F.ceil(F.col("size") / tile))
    return whole.unionByName(tiled.groupBy("node").agg(F.collect_list(place(F.col("band"))).alias("places")))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 5, tolerance: float = TOLERANCE, tile: int = TILE) -> DataFrame:
    """doc_id, class_id (least doc_id of equal sets), n_links (other classes at or over the threshold)
    and group_id (least class_id that links lead to)."""
    n = shuffle_parts(docs.sparkSession)
    keys = even_keys(n)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))
    described = materialise(rows.mapInArrow(_describe(words), "doc_id long, tag long, node long, check long, n long, sig binary"), "described")
    sets = described.filter("n > 0 and doc_id is not null")
    # the copies' signatures are equal; so is the text of a class's representative
    classes = materialise(sets.groupBy("node", "check").agg(F.min(F.struct("doc_id", "tag")).alias("first"), F.first("sig").alias("sig")).select("node", "check", "first.*", "sig"), "classes")
    buckets = classes.select("node", "sig").mapInArrow(_bands(keys), Outbox.schema(BUCKETS)).repartition(n, "part")
    clusters = components(buckets.mapInArrow(_stars, "a long, b long"))
    asked = classes.join(places(classes, clusters, tile), "node").select("doc_id", "tag", "node", "sig", "places")
    tiles = rows.join(asked, ["doc_id", "tag"]).select("text", "node", "sig", "places").mapInArrow(_tiles(words), "cluster long, band int, ti int, tj int, tile int, node long, sig binary, own binary")
    dealt = tiles.repartition(n, "cluster", "band", "ti", "tj").sortWithinPartitions("cluster", "band", "ti", "tj")
    found = materialise(dealt.mapInArrow(_verify(threshold, tolerance), "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = materialise(classes.select("node", "check", F.col("doc_id").alias("class_id")).join(links, "node").join(groups, "node"), "linked")
    least = linked.groupBy("root").agg(F.min("class_id").alias("group_id"), F.count("*").alias("n"))
    named = join_hot(linked, least, "root", linked.count()).select("node", "check", "class_id", "n_links", "group_id")
    alone = classes.select("node", "check", F.col("doc_id").alias("class_id")).join(named.select("node", "check"), ["node", "check"], "left_anti")
    named = named.unionByName(alone.select("node", "check", "class_id", F.lit(0).cast("long").alias("n_links"), F.col("class_id").alias("group_id")))
    lone = F.when(F.col("class_id").isNull(), F.col("doc_id"))
    return described.select("doc_id", "node", "check", "n").join(named, ["node", "check"], "left").select(
        "doc_id",
        F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("class_id", lone)).alias("class_id"),
        F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("group_id", lone)).alias("group_id"),
    )
