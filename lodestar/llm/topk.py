"""Exact top-k search by inner product with dual cover trees (operator 4).

Queries and data are both indexed in cover trees. A pair of nodes is bounded by

    <q, p>  <=  <cq, cp> + rq |cp| + rp |cq| + rq rp

with the centres c and the covering radii r, and is dropped, with all below it, if that is
under the worst k-th score of the query node's queries so far. The most promising pairs go
first, the node of the larger radius is opened, and leaves are scored in integers.

The data's vectors go to the nearest of up to ``PIVOTS`` pivots, a bounded sample by a hash of their ids, and lie by pivot, so that a
tree holds what is near: it takes up to ``TREE`` rows of one pivot. The data's trees are built once and travel packed; so do
the queries'. Queries are a stated set: each group of ``group`` trees of queries meets each group of trees of the data in
one task, which takes the data's trees by their bound, the most promising first, so that the k-th scores rise early and the
rest falls to them whole. Nothing passes through the driver but the two numbers of rows and the pivots. The k best of each
pair of groups then meet by query.

Where vectors point everywhere in many dimensions no ball of them is small, no bound falls below a k-th score, and what is
left is products of leaves; where they cluster, most are never taken (README has figures).

Vectors that are null or hold a null or non-finite component, and rows without an id, take no
part. Vectors of unequal length meet only their like. A row isn't its own candidate, nor are
rows of the same id; of query rows that repeat an id, the least vector is the query. Ties go to
the smaller id. Scores are exact integers of any size; a score that a long can't hold is ranked
as it is and reported as the nearest long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Rows of a leaf; rows of a tree; trees that a task takes from either side.
LEAF, TREE, GROUP = 64, 4096, 16
#: Rows of a leaf of queries: a ball of few is small, and drops what a larger one can't.
ASKED_LEAF = 4
#: Pivots at most.
PIVOTS = 256
#: Components up to which distances are floats.
FAR = 1e100
_LONG = 2**63 - 1
_MOST = int(1e308)
TREES = "dim int, lane int, ids binary, vectors binary, nodes binary, centres binary, radii binary"


class CoverTree:
    """Rows of a node's subtree lie together: node i holds rows lo[i] to hi[i], a centre, the row at its middle,
    a covering radius (no row of it is farther from the centre), and its children first[i] to first[i] + count[i].

    Nesting: a node's centre is its first child's. Covering: each row is within its child's radius of the child's centre.
    Separation: centres of one node's children are more than half its radius apart. Radii fall to half their parent's or less.
    A node of up to ``leaf`` rows is a leaf, as is one that only more balls of half its radius cover than half its rows: vectors
    that point everywhere in many dimensions have no smaller balls, and go as one block of products.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        if float(np.abs(x).max(initial=0.0)) > FAR:
            # squares of these aren't floats: one leaf, never pruned
            leaf, x = len(x), np.full(x.shape, np.inf)
        lo, hi, first, count, centres, radii = [0], [len(x)], [0], [0], [0], [0.0]
        if len(x):
            centres[0] = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1))) if len(x) > leaf else 0
        node = 0
        while node < len(lo) and len(x) and np.isfinite(x[0, 0]):
            rows = self.order[lo[node] : hi[node]].copy()
            own, at = x[rows], int(np.nonzero(rows == centres[node])[0][0])
            gap = np.sqrt(((own - own[at]) ** 2).sum(axis=1))
            radii[node] = float(gap.max())
            if len(rows) > leaf and radii[node] > 0:
                kids = self._net(own, at, gap, radii[node] / 2)
            else:
                kids = None
            if kids:
                net, who = kids
                order = np.argsort(who, kind="stable")
                self.order[lo[node] : hi[node]] = rows[order]
                sizes = np.bincount(who, minlength=len(net))
                ends = lo[node] + np.cumsum(sizes)
                first[node], count[node] = len(lo), len(net)
                lo += (ends - sizes).tolist()
                hi += ends.tolist()
                centres += rows[net].tolist()
                for col in (first, count):
                    col += [0] * len(net)
                radii += [0.0] * len(net)
            node += 1
        self.lo, self.hi, self.first, self.count = (np.array(c, np.int64) for c in (lo, hi, first, count))
        self.centre, self.radius = np.array(x[np.array(centres, np.int64)], np.float64) if len(x) else np.zeros((1, x.shape[1])), np.array(radii)

    @staticmethod
    def _net(own: np.ndarray, at: int, gap: np.ndarray, radius: float) -> tuple[list[int], np.ndarray] | None:
        """Centres, each the farthest row from those before, until all rows are within the radius; and each row's nearest. None if that takes over half the rows."""
        net, who, best = [at], np.zeros(len(own), np.int64), gap.copy()
        while True:
            at = int(best.argmax())
            if best[at] <= radius:
                return net, who
            if 2 * (len(net) + 1) > len(own):
                return None
            far = np.sqrt(((own - own[at]) ** 2).sum(axis=1))
            nearer = far < best
            best[nearer], who[nearer] = far[nearer], len(net)
            best[at], who[at] = 0.0, len(net)
            net.append(at)

    def pack(self) -> tuple[bytes, bytes, bytes]:
        return np.stack([self.lo, self.hi, self.first, self.count]).tobytes(), self.centre.tobytes(), self.radius.tobytes()

    @classmethod
    def unpack(cls, nodes: bytes, centres: bytes, radii: bytes) -> CoverTree:
        """A tree whose rows are in its order already."""
        own = cls.__new__(cls)
        own.lo, own.hi, own.first, own.count = np.frombuffer(nodes, np.int64).reshape(4, -1)
        own.radius = np.frombuffer(radii, np.float64)
        own.centre = np.frombuffer(centres, np.float64).reshape(len(own.radius), -1)
        own.order = np.arange(int(own.hi[0]))
        return own


def whole(x: np.ndarray) -> np.ndarray:
    """Integers of floats that hold whole numbers: floats while exact, int64, or Python's beyond that."""
    top = float(np.abs(x).max(initial=0.0))
    if top < 2.0**53:
        return x
    return x.astype(np.int64) if top < 2.0**62 else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, int64 where they fit and Python integers where they may not."""
    top = lambda x: float(max((abs(v) for v in x.flat), default=0)) if x.dtype == object else float(np.abs(x.astype(np.float64)).max(initial=0.0))
    most = top(q) * top(p) * max(1, q.shape[1])
    if most < 2.0**53 and q.dtype != object and p.dtype != object:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62 and q.dtype != object and p.dtype != object:
        return q.astype(np.int64) @ p.astype(np.int64).T
    exact = lambda x: x if x.dtype == object else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return exact(q) @ exact(p).T


class Best:
    """The k best of each query so far: exact scores, ids, and the k-th score as a float (-inf while there are fewer)."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score: list[list[int]] = [[] for _ in range(n)]
        self.id: list[list[int]] = [[] for _ in range(n)]
        self.worst = np.full(n, -np.inf)

    def add(self, rows: np.ndarray, score: np.ndarray, own_ids: np.ndarray, ids: np.ndarray) -> None:
        rough = np.clip(score, -_MOST, _MOST).astype(np.float64) if score.dtype == object else score.astype(np.float64)
        able = (own_ids[:, None] != ids[None, :]) & (rough >= self.worst[rows][:, None])
        for j in np.nonzero(able.any(axis=1))[0]:
            r, at = int(rows[j]), np.nonzero(able[j])[0]
            if len(at) > 4 * self.k and score.dtype != object:
                # those that tie with the k-th all stay
                at = at[score[j, at] >= np.partition(score[j, at], len(at) - self.k)[len(at) - self.k]]
            both = sorted(zip([-s for s in self.score[r]] + [-int(s) for s in score[j, at]], self.id[r] + ids[at].tolist(), strict=True))[: self.k]
            self.score[r], self.id[r] = [-s for s, _ in both], [i for _, i in both]
            if len(both) == self.k:
                # a float that isn't above the exact score
                self.worst[r] = np.nextafter(float(max(-_MOST, min(_MOST, self.score[r][-1]))), -np.inf)


def search(queries: CoverTree, query_ids: np.ndarray, q: np.ndarray, data: CoverTree, data_ids: np.ndarray, p: np.ndarray, best: Best, base: int = 0) -> int:
    """Merges the best of the data into ``best``, where the queries' rows start at ``base``; returns how many products were taken.

    Rows of q and p are in the order of their trees.
    """
    nq, np_ = np.sqrt((queries.centre**2).sum(axis=1)), np.sqrt((data.centre**2).sum(axis=1))

    def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dot = np.einsum("ij,ij->i", queries.centre[a], data.centre[b])
        top = dot + queries.radius[a] * np_[b] + data.radius[b] * nq[a] + queries.radius[a] * data.radius[b]
        # more than the rounding of sums of this size
        top += 1e-9 * (1 + (nq[a] + queries.radius[a]) * (np_[b] + data.radius[b]))
        return np.where(np.isnan(top), np.inf, top)

    taken = 0
    heap = [(-float(bounds(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]), 0, 0)] if len(q) and len(p) else []
    while heap:
        top, a, b = heapq.heappop(heap)
        lo, hi = int(queries.lo[a]), int(queries.hi[a])
        if -top < best.worst[base + lo : base + hi].min():
            continue
        open_a, open_b = queries.count[a] > 0, data.count[b] > 0
        if not open_a and not open_b:
            at = slice(int(data.lo[b]), int(data.hi[b]))
            best.add(np.arange(base + lo, base + hi), products(q[lo:hi], p[at]), query_ids[lo:hi], data_ids[at])
            taken += (hi - lo) * (at.stop - at.start)
            continue
        if open_a and (not open_b or queries.radius[a] >= data.radius[b]):
            kids = np.arange(queries.first[a], queries.first[a] + queries.count[a])
            pairs = kids, np.full(len(kids), b)
            if not open_b and hi - lo <= LEAF:
                # a few queries and a leaf: at once, unless most of them can do without it
                able = bounds(*pairs) >= [best.worst[base + x : base + y].min() for x, y in zip(queries.lo[kids].tolist(), queries.hi[kids].tolist(), strict=True)]
                if 2 * int((queries.hi - queries.lo)[kids[able]].sum()) > hi - lo:
                    at = slice(int(data.lo[b]), int(data.hi[b]))
                    best.add(np.arange(base + lo, base + hi), products(q[lo:hi], p[at]), query_ids[lo:hi], data_ids[at])
                    taken += (hi - lo) * (at.stop - at.start)
                    continue
                pairs = kids[able], np.full(int(able.sum()), b)
        else:
            kids = np.arange(data.first[b], data.first[b] + data.count[b])
            pairs = np.full(len(kids), a), kids
        for t, x, y in zip((-bounds(*pairs)).tolist(), pairs[0].tolist(), pairs[1].tolist(), strict=True):
            heapq.heappush(heap, (t, x, y))
    return taken


def _trees(scale: int, lanes: int, leaf: int = LEAF):
    """Rows of packed trees over a task's vectors, which come sorted by length and pivot; trees go round the lanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        lane = TaskContext.get().partitionId()

        def tree(dim: int) -> pa.RecordBatch:
            nonlocal lane
            ids, x = (np.concatenate([part[k] for part in held[dim]]) for k in (0, 1))
            held[dim] = []
            own = CoverTree(x, leaf)
            lane += 1
            row = (dim, lane % lanes, ids[own.order].tobytes(), x[own.order].tobytes(), *own.pack())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), *[pa.binary()] * 5), strict=True)], ["dim", "lane", "ids", "vectors", "nodes", "centres", "radii"])

        cell = None
        for batch in batches:
            sizes = batch.column(2).to_numpy(zero_copy_only=False)
            cells = batch.column(3).to_numpy(zero_copy_only=False)
            cut = np.nonzero(np.r_[True, (sizes[1:] != sizes[:-1]) | (cells[1:] != cells[:-1])])[0] if len(sizes) else []
            for lo, hi in zip(cut, [*cut[1:], len(sizes)], strict=True):
                dim = int(sizes[lo])
                if cell is not None and cell != (dim, int(cells[lo])) and held.get(cell[0]):
                    yield tree(cell[0])
                cell = dim, int(cells[lo])
                some = batch.slice(lo, hi - lo)
                ids = some.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                x = np.floor(scale * some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dim)
                for a in range(0, len(ids), TREE):
                    room = TREE - sum(len(i) for i, _ in held.get(dim, []))
                    part = ids[a : a + TREE], x[a : a + TREE]
                    held.setdefault(dim, []).append((part[0][:room], part[1][:room]))
                    if len(part[0]) >= room:
                        yield tree(dim)
                        if len(part[0]) > room:
                            held[dim].append((part[0][room:], part[1][room:]))
        for dim in held:
            if sum(len(i) for i, _ in held[dim]):
                yield tree(dim)

    return run


def root_bound(queries: CoverTree, data: CoverTree) -> float:
    """No product of a query and a row is greater, but for rounding."""
    q, p = queries.centre[0], data.centre[0]
    return float(q @ p + queries.radius[0] * np.sqrt(p @ p) + data.radius[0] * np.sqrt(q @ q) + queries.radius[0] * data.radius[0])


def _opened(dim: int, row: dict) -> tuple[CoverTree, np.ndarray, np.ndarray]:
    return CoverTree.unpack(row["nodes"], row["centres"], row["radii"]), np.frombuffer(row["ids"], np.int64), whole(np.frombuffer(row["vectors"], np.float64).reshape(-1, dim))


def _search(k: int):
    """Rows come sorted by group, the queries' trees first; a task holds the trees of one pair of groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, held = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if asked:
                best = Best(sum(len(own) for _, own, _ in asked), k)
                starts = np.cumsum([0, *[len(own) for _, own, _ in asked]])
                # the pairs of trees by the bounds of their roots
                pairs = sorted(((-root_bound(own, tree), j, t) for j, (own, _, _) in enumerate(asked) for t, (tree, _, _) in enumerate(held)), key=lambda r: r[:3])
                for _, j, t in pairs:
                    search(*asked[j], *held[t], best, int(starts[j]))
                ids = np.concatenate([own for _, own, _ in asked])
                out = [(int(i), j, s) for i, js, ss in zip(ids.tolist(), best.id, best.score, strict=True) for j, s in zip(js, ss, strict=True)]
                if out:
                    q, p, s = zip(*out, strict=True)
                    exact = [format(abs(v), "d").zfill(1) for v in s]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q, pa.int64()), pa.array(p, pa.int64()), pa.array([max(-_LONG - 1, min(_LONG, v)) for v in s], pa.int64()), pa.array([v > _LONG or v < -_LONG - 1 for v in s], pa.bool_()), pa.array([("-" if v < 0 else "") + x for v, x in zip(s, exact, strict=True)], pa.string())],
                        ["query_id", "vec_id", "score", "beyond", "exact"],
                    )

        for batch in batches:
            for row in batch.to_pylist():
                if group != (row["dim"], row["asked"], row["lane"]):
                    yield from done()
                    group, asked, held = (row["dim"], row["asked"], row["lane"]), [], []
                (asked if row["is_query"] else held).append(_opened(row["dim"], row))
        yield from done()

    return run


def _usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    ok = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding"), F.size(v).alias("dim"))


def _pivots(data: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Up to ``count`` vectors of each length, by a hash of their ids: a bounded sample that only deals rows out."""
    if count < 2:
        return {}
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id"))
    rows = data.withColumn("place", place).filter(F.col("place") <= count).collect()
    return {dim: np.array([r.embedding for r in rows if r.dim == dim]) for dim in {r.dim for r in rows}}


def _by_pivot(df: DataFrame, pivots: dict[int, np.ndarray], salts: int) -> DataFrame:
    """Rows with cell, the nearest pivot, sorted by it; a pivot that is near to many rows is dealt to several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy(zero_copy_only=False)
            cell = np.zeros(len(sizes), np.int32)
            for dim in np.unique(sizes).tolist():
                if dim in pivots:
                    at = np.nonzero(sizes == dim)[0]
                    x = batch.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    with np.errstate(all="ignore"):
                        far = (pivots[dim] ** 2).sum(axis=1)[None, :] - 2 * x @ pivots[dim].T
                    cell[at] = np.where(np.isnan(far), np.inf, far).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell)], ["vec_id", "embedding", "dim", "cell"])

    near = df.select("vec_id", "embedding", "dim").mapInArrow(run, "vec_id long, embedding array<double>, dim int, cell int")
    return near.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, salts)))).repartition("dim", "cell", "salt").sortWithinPartitions("dim", "cell").drop("salt")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, group: int = GROUP, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k greatest inner products over floor(scale * x)."""
    data = _usable(vectors, id_col, vector)
    asked = _usable(queries, id_col, vector).groupBy("vec_id").agg(F.min(F.struct("embedding", "dim")).alias("v")).select("vec_id", "v.embedding", "v.dim")
    n, n_asked = data.count(), asked.count()
    lanes, groups = (max(1, -(-size // (TREE * group))) for size in (n, n_asked))
    pivots = _pivots(data, min(PIVOTS, n // TREE))
    packed = materialise(_by_pivot(data, pivots, -(-n // (TREE * group))).mapInArrow(_trees(scale, lanes), TREES), "trees")
    own = _by_pivot(asked, {}, -(-n_asked // TREE)).mapInArrow(_trees(scale, groups, ASKED_LEAF), TREES)
    # every group of queries meets every lane of the data: a stated set against all rows, in blocks
    each = lambda df, mine, theirs, n, flag: df.withColumnRenamed("lane", mine).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("is_query", F.lit(flag))
    both = each(packed, "lane", "asked", groups, False).unionByName(each(own, "asked", "lane", lanes, True))
    dealt = both.repartition("dim", "asked", "lane").sortWithinPartitions("dim", "asked", "lane", F.desc("is_query"))
    best = dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long, beyond boolean, exact string")
    # scores beyond a long are ranked by sign, length and digits
    sign = F.when(F.col("exact").startswith("-"), -1).otherwise(1)
    wide = F.when(F.col("beyond"), sign * F.length("exact")).otherwise(0)
    digits = F.when(F.col("beyond"), F.when(sign > 0, F.col("exact")).otherwise(F.translate("exact", "0123456789", "9876543210")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(wide), F.desc("score"), F.desc(digits), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
