"""Repeated passages of words, found by recompression (operator 7).

Recompression rewrites a text in rounds: runs of one symbol become a symbol, then the alphabet
is split in two by a hash of the names, and each pair of a left and a right symbol becomes a
symbol. A name is a function of the names inside alone, so it is global: tasks agree on it
without exchange, and equal substrings get equal interior symbols wherever they stand. With
each symbol goes its extent, the words that settle how it was parsed; a window that holds the
extent holds the symbol in every document.

Every window of words is led by a symbol whose extent it holds, of the highest round that has
such a symbol, and of those the least-named one. Leaders that occur more than once are shared;
the windows that they lead are compared whole, and all but the first of equal ones are repeats.
Windows that hold no whole extent lead themselves. Windows that one task holds are compared by
their words, and those of different tasks by 128 bits of a keyed hash of their words; names of
fewer bits only choose what is looked at. Texts of any length go in stretches of a bounded
number of words.

Null text has no words. Rows with a null doc_id take no part and keep all words. Rows that
repeat a doc_id with other text don't count as earlier than each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEYS, REPLY, Blocks, Outbox, U, answered, bucket_of, byte_classes, byte_names, even_keys, gather, keyed, merge_spans, mix, ranges, reply, shuffle_parts, slices, utf8, window_classes

LEADERS = {"name": "var", "doc": "doc", "tag": "var", "pos": "var", "done": "var"}
WINDOWS = {"name": "var", "more": "var", "doc": "doc", "tag": "var", "pos": "var", "done": "var"}
#: Words whose windows are led in one go.
STRETCH = 200_000
SENT = U((1 << 40) - 1)
NONE = ~U(0)
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the n + 1 offsets of the documents in words."""
    ink = ~_space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off[:-1]] = True
    before = np.r_[False, ink[:-1]] if len(data) else ink
    starts = np.nonzero(ink & (~before | edge[:-1]))[0]
    after = np.r_[ink[1:], False] if len(data) else ink
    edge[len(data)] = True
    ends = np.nonzero(ink & (~after | edge[1:]))[0] + 1
    return starts, ends, np.searchsorted(starts, off)


def recompress(names: np.ndarray, bounds: np.ndarray, rounds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each round of runs and pairs its symbols: names, and extents [lo, hi) in words, both ascending.

    ``bounds`` are documents' offsets in words; symbols don't cross them, and what stands at one
    has an extent beyond it (its neighbour isn't in any window).
    """
    n, out = len(names), []
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    lo, hi = np.arange(n), np.arange(1, n + 1)
    for level in range(rounds):
        # runs; a run's end is known by the symbol next to it
        same = np.r_[False, (names[1:] == names[:-1]) & (doc[1:] == doc[:-1])]
        head = np.nonzero(~same)[0]
        if not len(head):
            break
        times = np.diff(np.r_[head, len(names)])
        tail = head + times - 1
        lo_before = np.where(np.r_[True, doc[head][1:] != doc[head][:-1]], bounds[doc[head]] - 1, lo[np.maximum(head - 1, 0)])
        hi_after = np.where(np.r_[doc[head][1:] != doc[head][:-1], True], bounds[doc[head] + 1] + 1, hi[np.minimum(tail + 1, len(hi) - 1)])
        names = np.where(times > 1, mix(names[head] + times.astype(np.uint64) * KEYS[9]), names[head])
        doc, lo, hi = doc[head], lo_before, hi_after
        # pairs
        left = (mix(names + U(level + 1)) & U(1)) == 0
        follow = np.r_[(doc[1:] == doc[:-1]), False]
        pair = left & follow & np.r_[~left[1:], False]
        second = np.r_[False, pair[:-1]]
        lo_before = np.where(np.r_[True, doc[1:] != doc[:-1]], bounds[doc] - 1, lo[np.maximum(np.arange(len(lo)) - 1, 0)])
        hi_after = np.where(follow, hi[np.minimum(np.arange(len(hi)) + 1, len(hi) - 1)], bounds[doc + 1] + 1)
        new = np.where(pair, mix(mix(names * KEYS[10]) + np.r_[names[1:], U(0)] * KEYS[11] + U(level)), names)
        lo = np.where(left, lo, lo_before)
        hi = np.where(pair | left, hi_after, hi)
        names, lo, hi, doc = new[~second], lo[~second], hi[~second], doc[~second]
        out.append((names, lo, hi))
    return out


def leaders(names: np.ndarray, bounds: np.ndarray, width: int, rounds: int) -> tuple[np.ndarray, np.ndarray, Blocks]:
    """For each word the leader of the window that starts there (NONE: no window does), and where
    in the text its leftmost one in the window stands."""
    blocks = Blocks(names)
    n = len(names)
    best, where = np.full(n, NONE), np.arange(n)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    open_ = np.nonzero(np.arange(n) + width <= bounds[1:][doc])[0]
    for sym, lo, hi in reversed(recompress(names, bounds, rounds)):
        ok = (hi - lo <= width) & (lo >= 0) & (hi <= n)
        sym, lo, hi = sym[ok], lo[ok], hi[ok]
        if not len(sym) or not len(open_):
            continue
        name = mix(blocks.of(lo, hi) ^ sym) >> U(1)
        # a window holds the symbols first to last - 1
        first, last = np.searchsorted(lo, open_), np.searchsorted(hi, open_ + width, side="right")
        held = last > first
        at, first, size = open_[held], first[held], (last - first)[held]
        # least[k][i]: the leftmost least one of the 2 ** k symbols from i on
        least = [np.arange(len(name))]
        while 2 << len(least) - 1 <= int(size.max(initial=0)):
            half = 1 << len(least) - 1
            a, b = least[-1][:-half], least[-1][half:]
            least.append(np.where(name[a] <= name[b], a, b))
        pick = np.zeros(len(at), np.int64)
        for k, level in enumerate(least):
            own = np.nonzero(size >> k == 1)[0]
            a, b = level[first[own]], level[first[own] + size[own] - (1 << k)]
            pick[own] = np.where(name[a] <= name[b], a, b)
        best[at], where[at] = name[pick], lo[pick] + n
        open_ = open_[~held]
    best[open_] = blocks.of(open_, open_ + width) >> U(1)
    return best, where, blocks


def firsts(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which are the first of their name, and which names come again."""
    _, at, which, count = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
    first = np.zeros(len(name), bool)
    first[at] = True
    return first, count[which] > 1


class Stretch:
    """Words of some documents, or of a part of one, whose windows are led in one go."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, row: int, before: int, width: int, rounds: int):
        #: The first document's row, and its words that precede the stretch.
        self.row, self.before = row, before
        base = int(starts[0]) if len(starts) else 0
        self.data, self.starts, self.ends, self.bounds = data[base : int(ends[-1])] if len(ends) else data[:0], starts - base, ends - base, bounds
        self.names, self.more = byte_names(self.data, self.starts, self.ends, second=True)
        self.best, where, self.blocks = leaders(self.names, bounds, width, rounds)
        head = np.ones(len(self.best), bool)
        head[1:] = (self.best[1:] != self.best[:-1]) | (where[1:] != where[:-1])
        head[bounds[:-1][bounds[:-1] < len(self.best)]] = True
        #: Where a leader's windows begin.
        self.heads = np.nonzero(head & (self.best != NONE))[0]

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and positions, in words of the documents, of words of the stretch."""
        own = np.searchsorted(self.bounds, at, side="right") - 1
        return self.row + own, at - self.bounds[own] + np.where(own == 0, self.before, 0)


def stretches(data: np.ndarray, off: np.ndarray, width: int, rounds: int) -> Iterator[Stretch]:
    for a, b in slices(off):
        own = data[off[a] : off[b]]
        starts, ends, bounds = words_of(own, off[a : b + 1] - off[a])
        if b - a > 1 or len(starts) <= STRETCH:
            yield Stretch(own, starts, ends, bounds, a, 0, width, rounds)
            continue
        # a long text: each window lies whole in one stretch, and its leader is of what the window holds alone
        for c in range(0, len(starts), STRETCH):
            hi = min(len(starts), c + STRETCH + width - 1)
            yield Stretch(own, starts[c:hi], ends[c:hi], np.array([0, hi - c]), a, c, width, rounds)


def _leaders(width: int, rounds: int, keys: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outbox(keys, LEADERS)
        for batch in batches:
            data, off = utf8(batch.column(1))
            docs, tags = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2))
            for s in stretches(data, off, width, rounds):
                row, pos = s.place(s.heads)
                name = mix(s.best[s.heads])
                # of equal leaders of a stretch the first goes on; the others are shared already, as it is then
                first, again = firsts(name)
                part = np.where(first, ((name >> U(44)) % U(len(keys))).astype(np.int64), bucket_of(docs[row], len(keys)))
                yield from out.add(part, name=(name & SENT) * first.astype(np.uint64), doc=docs[row], tag=tags[row], pos=pos, done=np.where(first, again.astype(np.int64), 2))
        yield from out.flush()

    return run


def _shared(keys: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gather(batches, LEADERS)
        if got is None:
            return
        rest = np.nonzero(got["done"] < 2)[0]
        name = got["name"][rest]
        order = np.argsort(name, kind="stable")
        same = name[order][1:] == name[order][:-1]
        hit = np.r_[rest[order[np.r_[same, False] | np.r_[False, same]]], np.nonzero(got["done"])[0]]
        hit = np.unique(hit)
        yield from reply(keys, got["doc"][hit], got["tag"][hit], got["pos"][hit])

    return run


def least_of_class(which: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row the smallest doc of its class."""
    out = np.full(int(which.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(out, which, doc)
    return out[which]


def _windows(width: int, rounds: int, keys: list[int]):
    def work(batch: pa.RecordBatch, numbers: list[np.ndarray]) -> list[pa.RecordBatch]:
        out, made = Outbox(keys, WINDOWS), []
        asked_rows = np.nonzero([len(x) for x in numbers])[0]
        batch = batch.take(pa.array(asked_rows))
        numbers = [np.unique(numbers[k]) for k in asked_rows]
        data, off = utf8(batch.column(1))
        docs, tags = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2))
        for s in stretches(data, off, width, rounds):
            count = np.diff(np.r_[s.heads, len(s.best)])
            row, pos = s.place(s.heads)
            mine = np.zeros(len(pos), bool)
            cut = np.r_[np.nonzero(np.r_[True, row[1:] != row[:-1]])[0] if len(row) else [], len(row)].astype(np.int64)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                mine[a:b] = np.isin(pos[a:b], numbers[row[a]], assume_unique=True)
            win = ranges(s.heads[mine], count[mine])
            win = win[s.best[win] != NONE]
            row, pos = s.place(win)
            name, doc = s.blocks.of(win, win + width), docs[row]
            # a smaller document beside it has the window, word by word: settled here, and dealt by document
            ids = byte_classes(s.data, s.starts, s.ends, s.names)
            done = doc > least_of_class(window_classes(ids, win, width, name), doc)
            more = Blocks(s.more).of(win, win + width)
            part = np.where(done, bucket_of(doc, len(keys)), ((name >> U(40)) % U(len(keys))).astype(np.int64))
            live = (~done).astype(np.uint64)
            made += out.add(part, name=name * live, more=more * live, doc=doc, tag=tags[row], pos=pos, done=done)
        return made + list(out.flush())

    return work


def _repeats(keys: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gather(batches, WINDOWS)
        if got is None:
            return
        done = got.pop("done").astype(bool)
        yield from reply(keys, got["doc"][done], got["tag"][done], got["pos"][done])
        got = {k: v[~done] for k, v in got.items()}
        if not len(got["doc"]):
            return
        order = np.lexsort((got["pos"], got["tag"], got["doc"], got["more"], got["name"]))
        name, more, doc, tag, pos = (got[k][order] for k in ("name", "more", "doc", "tag", "pos"))
        del got, order
        new = np.r_[True, (name[1:] != name[:-1]) | (more[1:] != more[:-1])]
        own = new | np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]
        first_doc = doc[np.nonzero(new)[0]][np.cumsum(new) - 1]
        first_pos = pos[np.nonzero(own)[0]][np.cumsum(own) - 1]
        hit = (doc > first_doc) | (pos > first_pos)
        yield from reply(keys, doc[hit], tag[hit], pos[hit])

    return run


def _cut(width: int):
    def work(batch: pa.RecordBatch, numbers: list[np.ndarray]) -> list[pa.RecordBatch]:
        total, removed, sha, kept = [], [], [], []
        for text, got in zip(batch.column(1), numbers, strict=True):
            words = text.as_py().encode().split()
            total.append(len(words))
            if len(got):
                at = np.unique(got)
                lo, hi = merge_spans(at, at + width)
                keep = np.ones(len(words), bool)
                keep[ranges(lo, hi - lo)] = False
                words = list(compress(words, keep.tolist()))
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words))
            sha.append(hashlib.sha256(kept[-1]).hexdigest())
        return [pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array([x.decode() for x in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])]

    return work


def dedup_passages(docs: DataFrame, width: int = 20, rounds: int = 3) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept, the text of the words that remain."""
    n = shuffle_parts(docs.sparkSession)
    keys = even_keys(n)
    rows = keyed(docs, keys)
    ids = rows.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", "tag")
    leading = ids.mapInArrow(_leaders(width, rounds, keys), Outbox.schema(LEADERS))
    shared = leading.repartition(n, "part").mapInArrow(_shared(keys), Outbox.schema(REPLY))
    windows = answered(rows, shared, _windows(width, rounds, keys), Outbox.schema(WINDOWS))
    repeats = windows.repartition(n, "part").mapInArrow(_repeats(keys), Outbox.schema(REPLY))
    return answered(rows, repeats, _cut(width), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
