"""Cover trees that split, made through Spark, and what the search leaves out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import topk


def products_taken(vectors, queries, k=5, tree=4096):
    """(products taken, all products, best) of the search over trees that Spark has built and packed."""
    data, asked = topk._usable(vectors, "vec_id", "embedding"), topk._usable(queries, "vec_id", "embedding")
    pivots = topk._pivots(data, min(topk.PIVOTS, data.count() // tree))
    made = [sorted(topk._by_pivot(df, by, 1).mapInArrow(topk._trees(256, 1, leaf), topk.TREES).collect(), key=lambda r: r.ids) for df, by, leaf in ((data, pivots, topk.LEAF), (asked, {}, topk.ASKED_LEAF))]
    own, sought = ([topk._opened(r.dim, r.asDict()) for r in rows] for rows in made)
    best = topk.Best(sum(len(ids) for _, ids, _ in sought), k)
    starts = np.cumsum([0, *[len(ids) for _, ids, _ in sought]])
    pairs = sorted((-topk.root_bound(q[0], p[0]), j, t) for j, q in enumerate(sought) for t, p in enumerate(own))
    taken = sum(topk.search(*sought[j], *own[t], best, int(starts[j])) for _, j, t in pairs)
    ids = np.concatenate([ids for _, ids, _ in sought])
    return taken, len(ids) * sum(len(p[1]) for p in own), {int(i): list(zip(best.id[r], best.score[r], strict=True)) for r, i in enumerate(ids)}


def test_clustered_vectors_leave_most_products_out(spark):
    rng = np.random.default_rng(2)
    n, dim = 20_000, 32
    middles = rng.normal(size=(200, dim))
    x = middles[rng.integers(0, 200, n)] + rng.normal(size=(n, dim)) * 0.02
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    asked = df.filter(F.col("vec_id") % 50 == 0)
    taken, whole, best = products_taken(df, asked)
    assert taken < 0.1 * whole
    y = np.floor(256 * np.float32(x).astype(float)).astype(np.int64)
    for q in range(0, n, 1000):
        scores = y @ y[q]
        scores[q] = -(2**62)
        assert best[q] == [(int(i), int(scores[i])) for i in np.lexsort((np.arange(n), -scores))[:5]]
    rows = {}
    for r in topk.top_k(df, asked).collect():
        rows.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: [(i, s) for _, i, s in sorted(v)] for q, v in rows.items()} == best


@pytest.mark.parametrize("shape", ["equal", "line", "clusters", "far apart"])
def test_nodes_split_where_smaller_balls_cover_them(shape):
    rng = np.random.default_rng(3)
    x = {"equal": np.ones((500, 4)), "line": np.outer(np.arange(500.0), np.ones(4)), "clusters": np.repeat(rng.normal(size=(10, 8)) * 4000, 50, axis=0) + rng.normal(size=(500, 8)) * 40, "far apart": rng.normal(size=(500, 64)) * 256}[shape]
    tree = topk.CoverTree(np.floor(x), leaf=8)
    assert sorted(tree.order.tolist()) == list(range(500))
    for n in np.nonzero(tree.count)[0]:
        kids = np.arange(tree.first[n], tree.first[n] + tree.count[n])
        assert tree.radius[kids].max() <= tree.radius[n] / 2 + 1e-9
    assert {"equal": 1, "far apart": 1}.get(shape, 11) <= len(tree.lo) <= {"equal": 1, "far apart": 1}.get(shape, 500)
