"""Ranked lexical search: MaxScore in each shard of an inverted index (operator 12).

``build_index`` writes the index: each task cuts its documents into shards, and a shard has a row
for each of its terms, with the documents that hold it, how often, and the term's frontier: the
(occurrences, document length) that no other of its postings beats in both. The greatest score
that a term can give in the shard lies on the frontier whatever the corpus's mean length, so the
bounds are exact, though they are made before that is known.

``search`` joins the queries' terms to the postings and lets each shard answer each block of
queries. A query's terms are ordered by their bounds. While the bounds of the first ones together
stay below the score to beat, a document can't qualify by them alone: they are non-essential, and
candidates come from the other terms' postings, window by window. Non-essential postings are
probed from the greatest bound down, only for candidates that can still reach the score to beat,
which rises as the best documents are found. Shards' best meet by query.

The score sums w * ((10**9 * tf) div (1000 * tf + 12 * m)) over the query's terms, repeats
included: w = floor(1000 * ln((2 N + 2) / (2 df + 1))), m = 75 + (25 n N) div L, N documents with
terms, L their terms, n one document's, all whole numbers but the logarithm.

Terms are runs of ASCII digits and letters and of all other characters than ASCII, A-Z
lower-cased. Null text has none, and an item or a document without any is in no result. A row is a
document: rows that repeat are each ranked. Rows of one item_id and text are one query; those of
one item_id and other text are ranked each by itself (``copy`` tells them apart). Equal scores go
by doc_id, without doc_id last. Only doc_id (item_id) and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .divergence import stretches

#: What each byte of UTF-8 becomes: digits and letters stay (A-Z lower-cased), bytes of other alphabets too, the rest parts terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents and postings of a shard, queries of a block, documents of a window.
SHARD_DOCS, SHARD_POSTINGS, BLOCK, WINDOW = 8192, 1_000_000, 512, 1024
INDEX = "shard long, term string, at array<int>, tf array<int>, top_tf array<int>, top_n array<int>, doc_id array<long>"


def term_counts(text: bytes) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for terms in stretches(text, FOLD):
        for t in terms:
            out[t] = out.get(t, 0) + 1
    return out


def frontier(term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which postings no other of the same term beats by more occurrences in a shorter document (one of equal ones)."""
    order = np.lexsort((n, -tf, term))
    # the least length so far in a term: terms lie apart by more than any length, so a running minimum starts anew with each
    apart = n[order] - term[order].astype(np.int64) * (int(n.max()) + 1)
    least = np.minimum.accumulate(apart)
    own = term[order]
    best = np.r_[True, (own[1:] != own[:-1]) | (apart[1:] < least[:-1])]
    return np.sort(order[best])


class Shard:
    """Documents gathered in a task, up to the size of a shard."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: dict[bytes, int] = {}
        self.term: list[int] = []
        self.tf: list[int] = []
        self.held: list[int] = []

    def add(self, doc_id: int | None, counts: dict[bytes, int]) -> None:
        self.ids.append(doc_id)
        self.lengths.append(sum(counts.values()))
        known = self.terms
        self.term += [known.setdefault(t, len(known)) for t in counts]
        self.tf += counts.values()
        self.held.append(len(counts))

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """The documents' row (no term: doc_id, and lengths as tf), then a row for each term."""
        lengths = np.array(self.lengths, np.int64)
        term, tf, at = np.array(self.term, np.int32), np.array(self.tf, np.int64), np.repeat(np.arange(len(self.ids)), self.held)
        order = np.argsort(term, kind="stable")
        term, tf, at = term[order], tf[order], at[order]
        top = frontier(term, tf, lengths[at])
        size = len(self.terms)
        lists = lambda values, cut: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, pa.int32()))
        cut, top_cut = np.searchsorted(term, np.arange(size + 1)), np.searchsorted(term[top], np.arange(size + 1))
        none = lambda n, kind: pa.nulls(n, pa.list_(kind))
        names = ["shard", "term", "at", "tf", "top_tf", "top_n", "doc_id"]
        head = [pa.array([number], pa.int64()), pa.array([None], pa.string()), none(1, pa.int32()), pa.array([self.lengths], pa.list_(pa.int32())), none(1, pa.int32()), none(1, pa.int32()), pa.array([self.ids], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(head, names)
        terms = pa.array(list(self.terms), pa.binary()).cast(pa.string())
        whole = [pa.array(np.full(size, number)), terms, lists(at, cut), lists(tf, cut), lists(tf[top], top_cut), lists(lengths[at[top]], top_cut), none(size, pa.int64())]
        batch = pa.RecordBatch.from_arrays(whole, names)
        for lo in range(0, size, 4096):
            yield batch.slice(lo, 4096)


def build_index(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The written index of ``docs``: a row for each shard and term, and one for each shard's documents (no term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = (TaskContext.get().partitionId() << 32 | k for k in count())
        shard = Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if counts := term_counts(text.as_buffer().to_pybytes()):
                    shard.add(doc_id, counts)
                if len(shard.ids) >= shard_docs or len(shard.term) >= shard_postings:
                    yield from shard.rows(next(numbers))
                    shard = Shard()
        if shard.ids:
            yield from shard.rows(next(numbers))

    text = F.encode(F.col("text").cast("string"), "UTF-8")
    return materialise(docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, INDEX), "lexical-index")


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, copy, term and reps of each query: one for each item_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, copy, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                counts = term_counts(text.as_buffer().to_pybytes())
                n = len(counts)
                yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array([copy] * n, pa.int32()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["item_id", "copy", "term", "reps"])

    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull()).distinct()
    own = own.select("item_id", F.row_number().over(Window.partitionBy("item_id").orderBy("text")).alias("copy"), F.encode("text", "UTF-8").alias("text"))
    return own.mapInArrow(run, "item_id long, copy int, term string, reps long")


class Postings:
    """A term's postings in a shard: documents in ascending order, and what each scores."""

    def __init__(self, at: np.ndarray, tf: np.ndarray, w: int, top_tf: np.ndarray, top_m: np.ndarray, edges: np.ndarray):
        self.at, self.tf, self.w = at, tf, w
        self.cut = np.searchsorted(at, edges)
        self.bound = w * int(impact(top_tf, top_m).max(initial=0))
        self.scores: np.ndarray | None = None

    def all(self, m: np.ndarray) -> np.ndarray:
        if self.scores is None:
            self.scores = self.w * impact(self.tf, m[self.at])
        return self.scores

    def probe(self, docs: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Scores of the documents (ascending), 0 where they lack the term."""
        place = np.minimum(np.searchsorted(self.at, docs), len(self.at) - 1)
        hit = self.at[place] == docs
        out = np.zeros(len(docs), np.int64)
        out[hit] = self.w * impact(self.tf[place[hit]], m[docs[hit]])
        return out


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def max_score(lists: list[Postings], reps: np.ndarray, m: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, k: int, windows: list[tuple[int, int]], stats: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best of a shard for a query, by score, then id; ``stats`` counts postings scored and held."""
    bounds = np.array([p.bound for p in lists], np.int64) * reps
    order = np.argsort(bounds, kind="stable")
    lists, reps = [lists[i] for i in order], reps[order]
    below = np.cumsum(bounds[order])
    best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = 1
    for w, (lo, hi) in enumerate(windows):
        # the first essential term: those before it give less than the least score even together
        first = int(np.searchsorted(below, least))
        if first == len(lists):
            break
        acc, seen = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, bool)
        for p, r in zip(lists[first:], reps[first:].tolist(), strict=True):
            a, b = p.cut[w], p.cut[w + 1]
            if a < b:
                spots = p.at[a:b] - lo
                acc[spots] += r * p.all(m)[a:b]
                seen[spots] = True
                if stats is not None:
                    stats["scored"] += int(b - a)
        docs = np.nonzero(seen)[0]
        own = acc[docs]
        docs += lo
        for t in range(first - 1, -1, -1):
            can = own + below[t] >= least
            docs, own = docs[can], own[can]
            if not len(docs):
                break
            own = own + int(reps[t]) * lists[t].probe(docs, m)
            if stats is not None:
                stats["scored"] += len(docs)
        can = own >= least
        if not can.any():
            continue
        best, scores = np.r_[best, docs[can]], np.r_[scores, own[can]]
        top = np.lexsort((ids[best], unnamed[best], -scores))[:k]
        best, scores = best[top], scores[top]
        if len(best) == k:
            least = max(1, int(scores[-1]))
    if stats is not None:
        stats["held"] += sum(len(p.at) for p in lists)
    return best, scores


def _arrays(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """A list column's values as arrays, without a Python object for each number."""
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        off, values = np.asarray(chunk.offsets), np.asarray(chunk.values).astype(kind, copy=False)
        out += [values[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    return out


def search(index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, copy, rank, doc_id and score of each query's k best documents with a score above 0."""
    spark = index.sparkSession
    queries = materialise(query_terms(items), "lexical-queries")
    totals = index.filter("term is null").agg(F.coalesce(F.sum(F.size("doc_id")), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = int(totals["docs"]), max(1, int(totals["terms"]))
    n_blocks = -(-queries.select("item_id", "copy").distinct().count() // BLOCK) or 1
    # a term's weight, and the queries of each block that ask for it
    asked = queries.withColumn("block", F.pmod(F.xxhash64("item_id", "copy"), F.lit(n_blocks)).cast("int"))
    held = index.join(queries.select("term").distinct(), "term").groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")))
    blocks = asked.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("item_id", "copy", "reps"))).alias("by"))
    wanted = materialise(blocks.join(held.select("term", weight.alias("w")), "term"), "lexical-terms")

    postings = index.filter("term is not null").drop("doc_id").join(wanted, "term").select("shard", "block", "at", "tf", "top_tf", "top_n", "w", "by", F.lit(None).cast("array<long>").alias("doc_id"))
    none = F.lit(None)
    heads = index.filter("term is null").select("shard", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), none.cast("array<int>").alias("at"), "tf", none.cast("array<int>").alias("top_tf"), none.cast("array<int>").alias("top_n"), none.cast("long").alias("w"), none.cast("array<struct<item_id:long,copy:int,reps:long>>").alias("by"), "doc_id")

    def answer(rows: pa.Table) -> pa.Table:
        is_head = np.asarray(rows.column("at").is_null())
        head, rows = rows.filter(pa.array(is_head)), rows.filter(pa.array(~is_head))
        ids = head.column("doc_id").combine_chunks().flatten()
        unnamed, ids = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
        size = {int(n): 75 + 25 * int(n) * n_docs // n_terms for n in np.unique(_arrays(head.column("tf"), np.int64)[0]).tolist()}
        lengths = np.array(sorted(size), np.int64)
        long = np.array([size[n] for n in lengths.tolist()], np.int64)
        m_of = lambda n: long[np.searchsorted(lengths, n)]
        m = m_of(_arrays(head.column("tf"), np.int64)[0])
        windows = [(lo, min(lo + WINDOW, len(m))) for lo in range(0, len(m), WINDOW)]
        edges = np.array([lo for lo, _ in windows] + [len(m)])
        columns = [_arrays(rows.column(c), np.int64) for c in ("at", "tf", "top_tf", "top_n")]
        lists = [Postings(at, tf, w, top, m_of(n), edges) for at, tf, top, n, w in zip(*columns, rows.column("w").to_pylist(), strict=True)]
        by_query: dict[tuple, list[tuple[int, int]]] = {}
        for t, by in enumerate(rows.column("by").to_pylist()):
            for q in by:
                by_query.setdefault((q["item_id"], q["copy"]), []).append((t, q["reps"]))
        out: tuple[list, ...] = ([], [], [], [])
        for (item, copy), terms in by_query.items():
            own, scores = max_score([lists[t] for t, _ in terms], np.array([r for _, r in terms], np.int64), m, ids, unnamed, k, windows)
            out[0].extend([item] * len(own))
            out[1].extend([copy] * len(own))
            out[2].append([None if unnamed[d] else int(ids[d]) for d in own])
            out[3].append(scores.tolist())
        flat = lambda x: list(chain.from_iterable(x))
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(flat(out[2]), pa.int64()), pa.array(flat(out[3]), pa.int64())], names=["item_id", "copy", "doc_id", "score"])

    found = postings.unionByName(heads).groupBy("shard", "block").applyInArrow(answer, "item_id long, copy int, doc_id long, score long")
    order = Window.partitionBy("item_id", "copy").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "copy", "rank", "doc_id", "score")
