"""Exact substring dedup over bytes with suffix arrays (operator 2).

A window is ``length`` consecutive bytes of one document; it goes if the same bytes also start
in a document with a smaller doc_id. Every window holds a seed: the q-gram whose hash is least
in it. So documents that share a window share a seed with equal bytes around it.

1. Every document deals out its seeds with a hash of the context (all windows that hold the
   seed). Equal contexts of one seed form a class, which its smallest document stands for;
   in every other document the class's windows are repeats as they are equal byte for byte.
2. Classes of one seed that differ somewhere may still share windows. Their contexts, once a
   class, go into texts whose suffix arrays are built by ``gsaca.suffix_arrays``; windows with
   equal bytes are neighbours there, and the smallest document of such a run has it first.

A context that many documents have is settled slice by slice where it is read, so that what meets
in a seed's task is a row for each slice and distinct context. Contexts that one task holds are
compared byte by byte, and those of different tasks by ``CTX`` bits of a keyed hash of their bytes.
Texts of any length go in stretches of a bounded number of bytes.

Null text is empty. Rows with a null doc_id take no part and keep all bytes. Rows that repeat a
doc_id don't count as smaller than each other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEYS, REPLY, SLICE_BYTES, Outbox, U, answered, bucket_of, byte_classes, byte_names, equal_bytes, even_keys, gather, keyed, loads, merge_spans, minimizers, mix, ranges, reply, shuffle_parts, slices, utf8
from .gsaca import suffix_arrays

SEED = 16
#: Bits of a seed that are sent (a task's partition holds more; seeds that agree in them are looked at together), and of a context.
SENT, CTX = 32, 88
SEEDS = {"seed": "var", "ctx": "var", "more": "var", "doc": "doc", "tag": "var", "pos": "var", "done": "var"}
#: Kinds of replies, in the low two bits: the windows around the seed go; ask about them; the window goes.
WHOLE, ASK, WINDOW = 0, 1, 2
EDGES = {"seed": "var", "doc": "doc", "tag": "var", "pos": "var", "left": "var", "right": "var", "bytes": "raw"}


def least_of_class(which: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row the smallest doc of its class."""
    out = np.full(int(which.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(out, which, doc)
    return out[which]


def gram_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of q-grams from their first and last eight bytes."""
    return mix(mix(a * KEYS[12]) + b * KEYS[13])


def stretches(data: np.ndarray, off: np.ndarray, margin: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int, int]]:
    """(row, base, bytes, offsets, from, to): some documents, or a part of a long one from its byte ``base`` on, and which places count."""
    for a, b in slices(off):
        n = int(off[b] - off[a])
        if b - a > 1 or n <= 2 * SLICE_BYTES:
            yield a, 0, data[off[a] : off[b]], off[a : b + 1] - off[a], 0, n
            continue
        for c in range(0, n, SLICE_BYTES):
            lo, hi = max(0, c - margin), min(n, c + SLICE_BYTES + margin)
            yield a, lo, data[off[a] + lo : off[a] + hi], np.array([0, hi - lo]), c - lo, min(n, c + SLICE_BYTES) - lo


def _seeds(length: int, keys: list[int]):
    side = length - SEED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outbox(keys, SEEDS)
        for batch in batches:
            data, off = utf8(batch.column(1))
            docs, tags = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, base, text, o, least, most in stretches(data, off, length):
                if o[-1] < length:
                    continue
                eight = loads(text)
                h = gram_names(eight[: len(text) - SEED + 1], eight[SEED - 8 : len(text) - 7])
                bad = ranges(np.maximum(o[1:] - SEED + 1, o[:-1]), np.minimum(SEED - 1, np.diff(o)))
                h[bad[bad < len(h)]] = ~U(0)
                at = minimizers(h, side + 1)
                at = at[(h[at] != ~U(0)) & (at >= least) & (at < most)]
                row = np.searchsorted(o, at, side="right") - 1
                ok = o[row + 1] - o[row] >= length
                at, row = at[ok], row[ok]
                lo, hi = np.maximum(at - side, o[row]), np.minimum(at + length, o[row + 1])
                ctx, more = byte_names(text, lo, hi, second=True)
                seed, doc = h[at], docs[a + row]
                # where in the context the seed stands is part of it
                ctx, more = mix(ctx + (at - lo).astype(np.uint64)), mix(more ^ (at - lo).astype(np.uint64))
                # a smaller document beside it has the context: settled here, and dealt by document
                which = byte_classes(text, lo, hi, ctx)
                done = doc > least_of_class(which * (side + 1) + (at - lo), doc) if len(at) else np.zeros(0, bool)
                part = np.where(done, bucket_of(doc, len(keys)), ((seed >> U(44)) % U(len(keys))).astype(np.int64))
                live = (~done).astype(np.uint64)
                yield from out.add(part, seed=(seed & U((1 << SENT) - 1)) * live, ctx=ctx * live, more=(more >> U(128 - CTX)) * live, doc=doc, tag=tags[a + row], pos=at - o[row] + base, done=done)
        yield from out.flush()

    return run


def _classes(keys: list[int]):
    """Replies WHOLE where the class has a smaller document, and ASK where a document stands for its class and its seed has others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gather(batches, SEEDS)
        if got is None:
            return
        done = got.pop("done").astype(bool)
        yield from reply(keys, got["doc"][done], got["tag"][done], got["pos"][done].astype(np.int64) * 4 + WHOLE)
        got = {k: v[~done] for k, v in got.items()}
        if not len(got["doc"]):
            return
        order = np.lexsort((got["doc"], got["more"], got["ctx"], got["seed"]))
        seed, ctx, more, doc, tag, pos = (got[k][order] for k in got)
        del got
        new_seed = np.r_[True, seed[1:] != seed[:-1]]
        new = new_seed | np.r_[True, (ctx[1:] != ctx[:-1]) | (more[1:] != more[:-1])]
        heads = np.nonzero(new)[0]
        least = doc[heads][np.cumsum(new) - 1]
        of_seed = np.cumsum(new_seed)[heads] - 1
        starts = np.nonzero(new_seed[heads])[0]
        differ = np.minimum.reduceat(doc[heads], starts) < np.maximum.reduceat(doc[heads], starts)
        edge = differ[of_seed][np.cumsum(new) - 1] & (doc == least)
        some = np.nonzero(edge | (doc > least))[0]
        yield from reply(keys, doc[some], tag[some], pos[some].astype(np.int64) * 4 + np.where(edge[some], ASK, WHOLE))

    return run


def _edges(length: int, keys: list[int]):
    side = length - SEED

    def work(batch: pa.RecordBatch, numbers: list[np.ndarray]) -> list[pa.RecordBatch]:
        out, made = Outbox(keys, EDGES, 60_000), []
        data, off = utf8(batch.column(1))
        docs, tags = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for k, got in enumerate(numbers):
            pos = np.unique(got[got & 3 == ASK] >> 2)
            if not len(pos):
                continue
            text = data[off[k] : off[k + 1]]
            idx = pos[:, None] + np.arange(-side, length)
            c = np.where((idx >= 0) & (idx < len(text)), text[np.clip(idx, 0, len(text) - 1)], 0).astype(np.uint8)
            ends = np.ascontiguousarray(np.concatenate([c[:, side : side + 8], c[:, length - 8 : length]], axis=1)).view("<u8")
            seed = gram_names(ends[:, 0], ends[:, 1])
            n = len(pos)
            made += out.add((seed >> U(44)) % U(len(keys)), seed=seed, doc=np.full(n, docs[k]), tag=np.full(n, tags[k]), pos=pos, left=np.minimum(pos, side), right=np.minimum(len(text) - pos - SEED, side), bytes=c)
        return made + list(out.flush())

    return work


def shared_windows(ctx: np.ndarray, seed: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, length: int, q: int, most: int = 64) -> np.ndarray:
    """For each context and each window that holds its seed (by the bytes left of the seed): has a smaller document the window?

    Windows go in blocks of q neighbours. A block's core lies in all of them; contexts with one
    core form a text, each with the up to q - 1 bytes on either side, once each. Texts of over
    ``most`` contexts go by smaller blocks.
    """
    n, side = len(ctx), length - SEED
    taken = np.zeros((n, side + 1), bool)
    if n < 2:
        return taken
    flat, wide = np.ascontiguousarray(ctx).reshape(-1), ctx.shape[1]
    rows_, lows = [], []
    for low in range(0, side + 1, q):
        high = min(low + q - 1, side)
        ok = np.nonzero((left >= low) & (right >= side - high))[0]
        rows_.append(ok)
        lows.append(np.full(len(ok), low))
    row, low = np.concatenate(rows_), np.concatenate(lows)
    high = np.minimum(low + q - 1, side)
    core_lo, core_hi = side - low, length + side - high
    lo, hi = side - np.minimum(high, left[row]), length + np.minimum(side - low, right[row])
    core = mix(byte_names(flat, row * wide + core_lo, row * wide + core_hi)[0] + mix(seed[row]) + low.astype(np.uint64))
    # an entry: equal bytes from lo to hi
    entry = (byte_classes(flat, row * wide + lo, row * wide + hi) * (wide + 1) + lo) * (wide + 1) + hi
    order = np.lexsort((doc[row], entry, core))
    row, low, high, lo, hi, core, entry = (x[order] for x in (row, low, high, lo, hi, core, entry))
    new_core = np.r_[True, core[1:] != core[:-1]]
    new = new_core | np.r_[True, entry[1:] != entry[:-1]]
    which = np.cumsum(new) - 1
    heads = np.nonzero(new)[0]
    core_of = np.cumsum(new_core)[heads] - 1
    per_core = np.bincount(core_of)
    many = per_core[core_of]
    if q > 2 and (many > most).any():
        # the rows of large texts again, by smaller blocks; they are left out here
        again = np.unique(row[many[which] > most])
        finer = shared_windows(ctx[again], seed[again], doc[again], left[again], right[again], length, 2, most)
        taken[again] |= finer
    least = np.repeat(doc[row[heads]][:, None], q, axis=1)  # of each entry and window: the smallest document
    some = np.nonzero((many > 1) & ((many <= most) | (q <= 2)))[0]
    if len(some):
        r, a, b = row[heads[some]], lo[heads[some]], hi[heads[some]]
        size = b - a + 1
        last = np.r_[core_of[some][1:] != core_of[some][:-1], True]
        first = np.cumsum(size) - size
        at = ranges(a, size)
        owner = np.repeat(np.arange(len(some)), size)
        sym = ctx[r[owner], np.minimum(at, ctx.shape[1] - 1)].astype(np.int64) + 2
        ends = first + size - 1
        sym[ends] = np.where(last, 0, 1)
        start = np.r_[0, np.nonzero(sym == 0)[0] + 1]
        sa, _ = suffix_arrays(sym, start)
        # windows of the texts in suffix order: neighbours with equal bytes are one string
        room = size - 1 - length + 1
        shift = np.arange(len(sym)) - first[owner]
        is_window = (shift < room[owner])[sa]
        wins = sa[is_window]
        who = owner[wins]
        bytes_lo = a[who] + shift[wins]
        here = r[who] * wide + bytes_lo
        text_of = np.searchsorted(start, wins, side="right")
        run = np.ones(len(wins), bool)
        run[1:] = ~equal_bytes(flat, here[1:], here[1:] + length, here[:-1], here[:-1] + length) | (text_of[1:] != text_of[:-1])
        begin = np.nonzero(run)[0]
        if len(begin):
            smallest = np.minimum.reduceat(doc[r[who]], begin)[np.cumsum(run) - 1]
            col = side - bytes_lo - low[heads[some]][who]  # bytes left of the seed, from low
            least[some[who], col] = smallest
    kept = (many <= most) | (q <= 2)
    for j in range(q):
        ok = np.nonzero(kept[which] & (low + j <= high) & (left[row] >= low + j) & (right[row] >= side - low - j))[0]
        hit = ok[doc[row[ok]] > least[which[ok], j]]
        taken[row[hit], low[hit] + j] = True
    return taken


def _resolve(length: int, q: int, keys: list[int]):
    side = length - SEED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gather(batches, EDGES)
        if got is None:
            return
        order = np.argsort(got["seed"], kind="stable")
        ctx = got["bytes"].reshape(-1, side + length)[order]
        seed, doc, tag, pos, left, right = (got[k][order] for k in ("seed", "doc", "tag", "pos", "left", "right"))
        left, right, pos = left.astype(np.int64), right.astype(np.int64), pos.astype(np.int64)
        new = np.r_[True, seed[1:] != seed[:-1]]
        cuts = np.nonzero(new)[0]
        lo = 0
        while lo < len(seed):  # whole seeds, about 30,000 contexts at once
            nxt = np.searchsorted(cuts, lo + 30_000)
            hi = int(cuts[nxt]) if nxt < len(cuts) else len(seed)
            s = slice(lo, hi)
            taken = shared_windows(ctx[s], seed[s], doc[s], left[s], right[s], length, q)
            row, col = np.nonzero(taken)
            if len(row):
                row += lo
                yield from reply(keys, doc[row], tag[row], (pos[row] - col) * 4 + WINDOW)
            lo = hi

    return run


def _cut(length: int):
    side = length - SEED

    def work(batch: pa.RecordBatch, numbers: list[np.ndarray]) -> list[pa.RecordBatch]:
        data, off = utf8(batch.column(1))
        removed, spans, sha = [], [], []
        kept: list[bytes] = []
        for k, got in enumerate(numbers):
            text = data[off[k] : off[k + 1]]
            pos, at = got[got & 3 == WHOLE] >> 2, got[got & 3 == WINDOW] >> 2
            lo, hi = merge_spans(np.r_[np.maximum(pos - side, 0), at], np.r_[np.minimum(pos + length, len(text)), at + length])
            if len(lo):
                keep = np.ones(len(text), bool)
                keep[ranges(lo, hi - lo)] = False
                text = text[keep]
            kept.append(text.tobytes())
            removed.append(int(off[k + 1] - off[k]) - len(kept[-1]))
            spans.append(len(lo))
            sha.append(hashlib.sha256(kept[-1]).hexdigest())
        return [pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])]

    return work


def dedup_substrings(docs: DataFrame, length: int = 50, block: int = 7) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that remain."""
    if length < SEED + 2:
        raise ValueError(f"length must be {SEED + 2} at least")
    n = shuffle_parts(docs.sparkSession)
    keys = even_keys(n)
    rows = keyed(docs, keys)
    ids = rows.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", "tag")
    seeds = ids.mapInArrow(_seeds(length, keys), Outbox.schema(SEEDS))
    first = seeds.repartition(n, "part").mapInArrow(_classes(keys), Outbox.schema(REPLY))
    edges = answered(rows, first, _edges(length, keys), Outbox.schema(EDGES))
    second = edges.repartition(n, "part").mapInArrow(_resolve(length, block, keys), Outbox.schema(REPLY))
    return answered(rows, first.unionByName(second), _cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
