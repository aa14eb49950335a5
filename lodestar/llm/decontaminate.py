"""Benchmark decontamination by rare n-gram seeds and local alignment (operator 3).

The documents that hold each word n-gram of the test items are counted first, exactly. Then an
n-gram found in a document seeds a candidate: a rare one alone, one that more than ``everyday``
of the documents hold only together with another of the item's near it, or alone where the item
is short (up to 4 n words). The seeds join the documents' passages to the items. A score can't
exceed the words that item and passage share, which drops passages around everyday phrases
before they are written and loses nothing. The others are aligned with the item by
Smith-Waterman over words, and the score, as a share of the item's own, tells copies and edited
copies from chance.

Test items go out in blocks of ``block`` rows, which bounds what a task and the driver hold;
each block is two passes over the documents. Passages travel alone, never with their documents.

Words are runs without ASCII white space or punctuation; ASCII and Latin-1 letters are folded.
Items of fewer words than an n-gram, null texts and rows with a null id take no part. Rows that
repeat count once; of passages with the best score the last one is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Blocks, U, byte_names, materialise, ranges, slices, utf8

MATCH, MISMATCH, GAP = 2, -1, -1
#: Documents that may hold an n-gram that is rare in any corpus.
LONE = 64
#: Padded words of passages that are aligned in one go.
CELLS = 2_000_000
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[:128] = [not chr(c).isalnum() for c in range(128)]


def folded_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and the documents' offsets in words."""
    raw = _FOLD[data]
    if len(data) > 1:
        latin = np.nonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))[0] + 1
        raw[latin] += 0x20
    ink = ~_BREAK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    starts = np.nonzero(ink & (np.r_[True, ~ink[:-1]] | edge[:-1]))[0] if len(raw) else np.zeros(0, np.int64)
    ends = np.nonzero(ink & (np.r_[~ink[1:], True] | edge[1:]))[0] + 1 if len(raw) else starts
    return byte_names(raw, starts, ends)[0], np.searchsorted(starts, off)


class Items:
    """A block of test items: their words, as numbers of a vocabulary, and a table of their n-grams."""

    def __init__(self, ids: list[int], texts: list[str], n: int):
        data, off = utf8(pa.array(texts, pa.string()))
        self.n, self.ids = n, np.array(ids, np.int64)
        words, self.off = folded_words(data, off)
        self.vocabulary, number = np.unique(words, return_inverse=True)
        self.words = number.astype(np.int64)
        count = np.maximum(np.diff(self.off) - n + 1, 0)
        at = ranges(self.off[:-1], count)
        gram = Blocks(words).of(at, at + n)
        self.grams, which = np.unique(gram, return_inverse=True)
        order = np.argsort(which, kind="stable")
        # occurrences of gram g: first[g] to first[g + 1]
        self.first = np.searchsorted(which[order], np.arange(len(self.grams) + 1))
        self.item = np.repeat(np.arange(len(ids)), count)[order]
        self.place = (at - np.repeat(self.off[:-1], count))[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.grams >> U(44)] = True
        self.rare = np.ones(len(self.grams), bool)
        # how often each item has each of its words
        owner = np.repeat(np.arange(len(ids)), np.diff(self.off))
        self.own, self.times = np.unique(owner * (len(self.vocabulary) + 1) + self.words, return_counts=True)

    def length(self, item: np.ndarray) -> np.ndarray:
        return self.off[item + 1] - self.off[item]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words in the vocabulary; those that aren't in it get its size."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), max(0, len(self.vocabulary) - 1))
        return np.where(self.vocabulary[at] == words, at, len(self.vocabulary))

    def shared(self, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The most words that an alignment of each item with numbers[lo:hi] can match."""
        out = np.zeros(len(item), np.int64)
        cut = np.r_[0, np.cumsum(hi - lo)]
        a = 0
        while a < len(item):
            b = max(a + 1, int(np.searchsorted(cut, cut[a] + CELLS, side="right")) - 1)
            which = np.repeat(np.arange(a, b), (hi - lo)[a:b])
            word = numbers[ranges(lo[a:b], (hi - lo)[a:b])]
            some = word < len(self.vocabulary)
            which, word = which[some], word[some]
            key = item[which] * (len(self.vocabulary) + 1) + word
            at = np.minimum(np.searchsorted(self.own, key), len(self.own) - 1)
            ok = self.own[at] == key
            pair, n = np.unique((which[ok] - a) * len(self.own) + at[ok], return_counts=True)
            out[a:b] = np.bincount(pair // len(self.own), np.minimum(n, self.times[pair % len(self.own)]), b - a)
            a = b
        return out

    def hits(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``words`` of n-grams of the table, and which."""
        h = Blocks(words).every(self.n)
        at = np.nonzero(self.bits[h >> U(44)])[0]
        at = at[at + self.n <= bounds[np.searchsorted(bounds, at, side="right")]] if len(at) else at
        g = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        ok = self.grams[g] == h[at]
        return at[ok], g[ok]


def _counted(items: Items):
    """Rows (gram, n): how many of a task's documents hold each n-gram of the items; gram -1 counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.grams) + 1, np.int64)
        for batch in batches:
            data, off = utf8(batch.column(1))
            total[-1] += len(off) - 1
            for a, b in slices(off):
                words, bounds = folded_words(data[off[a] : off[b]], off[a : b + 1] - off[a])
                at, gram = items.hits(words, bounds)
                doc = np.searchsorted(bounds, at, side="right") - 1
                pairs = np.unique(doc * len(items.grams) + gram)
                total[:-1] += np.bincount(pairs % len(items.grams), minlength=len(items.grams))
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.where(some == len(items.grams), -1, some)), pa.array(total[some])], ["gram", "n"])

    return run


def _candidates(items: Items, least: float):
    """Rows (doc_id, item, start, words): the passage around an item's n-grams in a document, where it can reach the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices(off):
                words, bounds = folded_words(data[off[a] : off[b]], off[a : b + 1] - off[a])
                at, gram = items.hits(words, bounds)
                if not len(at):
                    continue
                times = items.first[gram + 1] - items.first[gram]
                occ = ranges(items.first[gram], times)
                rare = np.repeat(items.rare[gram], times)
                at = np.repeat(at, times)
                item, begin = items.item[occ], at - items.place[occ]
                doc = np.searchsorted(bounds, at, side="right") - 1
                order = np.lexsort((begin, item, doc))
                doc, item, begin, rare, at = (x[order] for x in (doc, item, begin, rare, at))
                long = items.length(item)
                new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > long[1:])]
                head = np.nonzero(new)[0]
                end = np.r_[head[1:], len(new)]
                # more than one place in the document, a rare seed, or a short item
                several = np.minimum.reduceat(at, head) < np.maximum.reduceat(at, head)
                ok = several | np.logical_or.reduceat(rare, head) | (long[head] <= 4 * items.n)
                head, end = head[ok], end[ok]
                slack = long[head] // 2 + 4
                lo = np.maximum(begin[head] - slack, bounds[doc[head]])
                hi = np.minimum(begin[end - 1] + long[head] + slack, bounds[doc[head] + 1])
                numbers = items.numbers(words)
                ok = items.shared(item[head], lo, hi, numbers) >= least * long[head]
                head, lo, hi = head[ok], lo[ok], hi[ok]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[a + doc[head]], pa.int64()),
                        pa.array(item[head], pa.int64()),
                        pa.array(lo - bounds[doc[head]], pa.int64()),
                        pa.array([numbers[x:y].astype("<u4").tobytes() for x, y in zip(lo, hi, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "item", "start", "words"],
                )

    return run


def align(item: np.ndarray, passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman with linear gaps: each passage's best score, and the word after its end."""
    width = max(map(len, passages))
    padded = np.zeros((len(passages), width), np.int64) - 1
    for k, p in enumerate(passages):
        padded[k, : len(p)] = p
    slope = np.arange(width + 1) * GAP
    row = np.zeros((len(passages), width + 1), np.int32)
    best, end = np.zeros(len(passages), np.int32), np.zeros(len(passages), np.int64)
    for word in item:
        new = np.zeros_like(row)
        np.maximum(row[:, :-1] + np.where(padded == word, MATCH, MISMATCH), row[:, 1:] + GAP, out=new[:, 1:], casting="unsafe")
        np.maximum(new, 0, out=new)
        row = (np.maximum.accumulate(new - slope, axis=1) + slope).astype(np.int32)
        at = row.argmax(axis=1)
        value = row[np.arange(len(row)), at]
        better = value > best
        best[better], end[better] = value[better], at[better]
    return best, end


def _groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Passages of like length, up to 256 and ``CELLS`` padded words at a time."""
    order = np.argsort(lengths, kind="stable")[::-1]
    at = 0
    while at < len(order):
        n = max(1, min(256, CELLS // max(1, int(lengths[order[at]]))))
        yield order[at : at + n]
        at += n


def _aligned(items: Items, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item = batch.column(1).to_numpy()
            words = batch.column(3)
            starts = batch.column(2).to_numpy()
            rows, scores, ends = [], [], []
            order = np.argsort(item, kind="stable")
            cut = np.nonzero(np.r_[True, np.diff(item[order]) != 0])[0] if len(item) else []
            for mine in np.split(order, cut[1:]) if len(item) else []:
                k = item[mine[0]]
                own = items.words[items.off[k] : items.off[k + 1]]
                texts = [np.frombuffer(words[int(j)].as_py(), "<u4").astype(np.int64) for j in mine]
                for some in _groups(np.array([len(t) for t in texts], np.int64)):
                    best, end = align(own, [texts[j] for j in some])
                    score = best / (MATCH * len(own))
                    ok = score >= least
                    rows.append(mine[some][ok])
                    scores.append(score[ok])
                    ends.append(end[ok])
            if rows:
                at = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(items.ids[item[at]]), pa.array(np.concatenate(scores)), pa.array(starts[at]), pa.array(starts[at] + np.concatenate(ends))], ["doc_id", "item_id", "score", "start", "end"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.5, everyday: float = 0.001, block: int = 16_384) -> DataFrame:
    """doc_id, item_id, score (of 1), start and end (words of the best passage): documents that hold items."""
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    found: DataFrame | None = None
    held: list = []

    def send() -> None:
        nonlocal found
        items = Items([r.item_id for r in held], [r.text for r in held], n)
        if not len(items.grams):
            return
        # at most a row for each n-gram of the block
        counts = {r.gram: int(r.n) for r in rows.mapInArrow(_counted(items), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        most = max(LONE, everyday * counts.pop(-1, 0))
        items.rare[[g for g, k in counts.items() if k > most]] = False
        hits = materialise(rows.mapInArrow(_candidates(items, least), "doc_id long, item long, start long, words binary"), "hits")
        part = hits.mapInArrow(_aligned(items, least), "doc_id long, item_id long, score double, start long, end long")
        found = part if found is None else found.unionByName(part)

    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == block:
            send()
            held = []
    if held:
        send()
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, start long, end long")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "start", "end")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")
