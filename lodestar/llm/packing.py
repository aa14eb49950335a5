"""Packing of tokenised documents into fixed-length sequences (operator 9).

Documents are tokenised where they lie; only longer ones than a sequence are cut. What packing
needs is the histogram of piece lengths, at most one count for each length up to the capacity,
so its size doesn't grow with the data. The driver packs the histogram by bin completion:
around the largest remaining length it enumerates the undominated fillings of what is left of
the sequence, prunes by bounds on waste and sequences, takes a filling as often as the counts
allow, and comes back for fewer; the best-fit packing is the first incumbent, and the one of least
waste by sequence if that doesn't meet the bound. The search ends when the incumbent meets the lower bound or no branch is left, which proves the packing optimal,
or else after ``EFFORT`` steps; then the gap to the lower bound is logged. The plan says, for each length and range of ranks,
which sequence and offset; pieces get their rank from counts by task and prefix sums.

Null text is empty and gives one piece, the end token alone. Rows that repeat are packed each.
"""

from __future__ import annotations

import logging
import unicodedata
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, utf8

log = logging.getLogger(__name__)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, nth long"
#: Steps of the search for a packing with fewer sequences (some seconds on the driver); in the worst case proof takes exponentially many.
EFFORT = 400_000
#: Steps that a node counts as, for its bounds.
NODE = 200
#: Lengths that a filling of three is tried with, and tokens that a filling of two may waste.
TRIES, WASTE = 64, 9
#: Entries of an encoder's cache.
CACHED = 400_000
#: Bytes of a pre-token up to which it is kept.
SHORT = 64
#: Bytes of text that are taken at once; longer texts are cut at white space.
STRETCH = 2 << 20
#: Characters below this one have their own case, class and normal form; texts with others go whole. In UTF-8 their bytes are below ``LEAD``.
PLAIN_BELOW, LEAD = 0x240, 0xC9
#: What a character is to the pre-tokens.
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_signs() -> list[str]:
    """How byte-level vocabularies write each byte: printable Latin-1 as it is, the rest from U+0100 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


BYTE_SIGNS = _byte_signs()


def _kinds() -> np.ndarray:
    """What each character is, by its byte or by lead << 8 | next of its two bytes."""
    out = np.full(1 << 16, ODD, np.uint8)
    for c in range(PLAIN_BELOW):
        raw, kind = chr(c).encode(), unicodedata.category(chr(c))[0]
        if 0x1C <= c < 0x20:
            continue  # white space to some
        out[int.from_bytes(raw)] = SPACE if chr(c).isspace() else {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
    return out


KINDS = _kinds()


class Encoder:
    """Ids of texts (little-endian u32): a stretch of texts is cut into pre-tokens at once, and each distinct one is encoded once.

    Pre-tokens hold no white space and encode alike in any place. Texts with characters whose normal form, case or class
    isn't plain go whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            pre = json.load(f)["pre_tokenizer"]["pretokenizers"][0]
        if pre["pattern"]["Regex"] != PRE_TOKENS:
            raise ValueError(f"unknown pre-tokens: {pre['pattern']['Regex']}")
        self.words: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _one(self, raw: bytes) -> bytes:
        """A single pre-token's ids, its bytes as the vocabulary writes them."""
        word = raw.decode("latin-1")
        if not (word.isascii() and word.isprintable()):
            word = "".join([BYTE_SIGNS[b] for b in raw])
        return array("I", [t.id for t in self.tok.model.tokenize(word)]).tobytes()

    def _known(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some distinct pre-tokens."""
        if len(self.words) >= CACHED:
            self.words.clear()
        out = list(map(self.words.get, words))
        for k, ids in enumerate(out):
            if ids is None:
                out[k] = self._one(words[k])
                if len(words[k]) <= SHORT:
                    self.words[words[k]] = out[k]
        return out

    @staticmethod
    def _starts(low: np.ndarray, off: np.ndarray, kind: np.ndarray, later: np.ndarray) -> np.ndarray:
        """Where pre-tokens start in lower-case UTF-8; ``later`` are the places of second bytes."""
        start = kind != SPACE
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        first = np.zeros(len(low) + 4, bool)
        first[off] = True
        start |= first[: len(low)] & (kind != SPACE)
        start[later] = False
        # an apostrophe that starts one takes the letters of a contraction
        at = np.flatnonzero(start & (low == ord("'")))
        wide = np.r_[low, np.zeros(4, low.dtype)]
        one, two = wide[at + 1].astype(np.int64), wide[at + 2].astype(np.int64)
        short = np.isin(one, list(b"stmd"))
        long = np.isin(one << 8 | two, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")]) & ~first[at + 2]
        held = (short | long) & ~first[at + 1]
        at, after = at[held], (at + np.where(short, 2, 3))[held]
        start[at + 1] = False
        after = after[after < len(low)]
        start[after] = kind[after] != SPACE
        return start

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the n + 1 offsets of the texts in them."""
        data, off = utf8(texts)
        if len(off) == 2 and len(data) > 2 * STRETCH:
            return self._long(data.tobytes())
        low, low_off = utf8(pc.utf8_lower(texts))
        # lower-case letters may have come from others than plain ones
        odd = np.array([b"<|" in raw or b"\xc4\xb0" in raw for raw in (data[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True))], bool)
        odd[np.searchsorted(off, np.flatnonzero(data >= LEAD), "right") - 1] = True
        later = np.flatnonzero(low >= 0x80)
        lead = later[low[later] >= 0xC0]
        later = later[low[later] < 0xC0]
        code = low.astype(np.uint16)
        code[lead] = code[lead] << 8 | low[np.minimum(lead + 1, len(low) - 1)]
        kind = KINDS[code]
        kind[later] = kind[later - 1]
        odd[np.searchsorted(low_off, np.flatnonzero(kind == ODD), "right") - 1] = True
        for k in np.flatnonzero(odd):
            kind[low_off[k] : low_off[k + 1]] = SPACE
        start = self._starts(low, low_off, kind, later)
        inside = kind != SPACE
        letters = low[inside]
        bounds = np.r_[np.flatnonzero(start[inside]), len(letters)].astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
        which = found.indices.to_numpy()
        known = self._known(found.dictionary.to_pylist())
        size = np.fromiter(map(len, known), np.int32, len(known)) // 4
        n = size[which]
        to = np.cumsum(n, dtype=np.int64)
        flat = np.frombuffer(b"".join(known), "<u4")[np.repeat((np.cumsum(size, dtype=np.int64) - size)[which] - (to - n), n) + np.arange(to[-1] if len(to) else 0)]
        ends = np.r_[0, to][np.searchsorted(np.flatnonzero(start), low_off)]
        if odd.any():
            parts = [np.frombuffer(self._whole(texts[k].as_py()), "<u4") if odd[k] else flat[ends[k] : ends[k + 1]] for k in range(len(odd))]
            flat, ends = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return flat, ends

    def _long(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of one long text, by stretches that end at a space."""
        parts, at = [], 0
        while at < len(raw):
            to = raw.find(b" ", at + STRETCH)
            to = len(raw) if to < 0 else to
            texts = pa.array([raw[at:to]], pa.binary()).cast(pa.string())
            parts.append(self.ids(texts)[0] if to - at <= 2 * STRETCH else np.frombuffer(self._whole(texts[0].as_py()), "<u4"))
            at = to
        flat = np.concatenate(parts)
        return flat, np.array([0, len(flat)])

    def encode(self, texts: list[str]) -> list[bytes]:
        flat, ends = self.ids(pa.array(texts, pa.string()))
        return [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder for each vocabulary in a process: its caches serve one task after the other."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(path: str, capacity: int, end: int):
    names = [x.split()[0] for x in PIECES.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, chunk = encoder_of(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            _, off = utf8(batch.column(1))
            for a, b in slices(off, STRETCH):
                flat, ends = encoder.ids(pc.fill_null(batch.column(1).slice(a, b - a), ""))
                size = np.diff(ends) + 1
                flat, ends = np.insert(flat, ends[1:], end), np.r_[0, np.cumsum(size)]
                pieces = -(-size // capacity)
                row = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                raw, lo = memoryview(flat).cast("B"), 4 * (ends[row] + start)
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(lo.tolist(), (lo + 4 * length).tolist(), strict=True)]
                # the place of each piece among those of its length
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length)
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row))
                nth += seen[length] - first
                seen += np.bincount(length, minlength=capacity + 1)
                docs = batch.column(0).slice(a, b - a).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([docs, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), chunk), pa.int64()), pa.array(nth)], names)

    return run


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The greatest of the bounds that count the pieces of a length or more, of those that round lengths over
    capacity - k up and drop those below k, and of those that round lengths to multiples of capacity / k."""
    sizes = np.array(sorted(counts), np.int64)
    if not len(sizes):
        return 0
    n = np.array([counts[int(x)] for x in sizes], np.int64)
    total = int((sizes * n).sum())
    best = -(-total // capacity)
    # a sequence holds capacity // size of the pieces that are as long as that
    best = max(best, int((-(-np.cumsum(n[::-1])[::-1] // (capacity // sizes))).max()))
    # the bound of k changes at the lengths alone
    k = np.r_[0, sizes[sizes <= capacity // 2]]
    number, length = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(sizes * n)]
    half, low, high = np.searchsorted(sizes, capacity // 2, "right"), np.searchsorted(sizes, k), np.searchsorted(sizes, capacity - k, "right")
    high = np.maximum(high, half)
    free = (number[high] - number[half]) * capacity - (length[high] - length[half])
    best = max(best, int((number[-1] - number[half] + np.maximum(0, -((free - (length[half] - length[low])) // capacity))).max()))
    for k in range(1, min(capacity, 100)):
        # (k + 1) x / capacity is rounded down, but counts as it is where it's whole
        part, rest = np.divmod(sizes * (k + 1), capacity)
        best = max(best, -(-int((np.where(rest == 0, sizes * k, part * capacity) * n).sum()) // (k * capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram: (lengths of a sequence with their numbers, how many such)."""
    room: dict[int, list[list]] = {}
    levels: list[int] = []
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect_right(levels, size - 1)
            if k == len(levels):
                per = capacity // size
                whole, rest = divmod(left, per)
                for times, each in ((whole, per), (1 if rest else 0, rest)):
                    if times:
                        _put(room, levels, capacity - size * each, [{size: each}, times])
                left = 0
                break
            level = levels[k]
            group = room[level][-1]
            per = min(level // size, left)
            times = min(group[1], max(1, left // per))
            group[1] -= times
            if not group[1]:
                room[level].pop()
                if not room[level]:
                    del room[level]
                    levels.pop(k)
            _put(room, levels, level - size * per, [group[0] | {size: group[0].get(size, 0) + per}, times])
            left -= per * times
    return [(g[0], g[1]) for groups in room.values() for g in groups]


def _put(room: dict[int, list[list]], levels: list[int], level: int, group: list) -> None:
    if level not in room:
        room[level] = []
        levels.insert(bisect_right(levels, level), level)
    room[level].append(group)


class Stock:
    """Numbers by length, with the lengths that there are as bits, upwards and downwards from the capacity."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.capacity, self.up, self.down = {}, capacity, 0, 0
        for x, n in counts.items():
            self.add(x, n)

    def add(self, x: int, n: int) -> None:
        now = self.left.get(x, 0)
        self.left[x] = now + n
        if (now > 0) != (now + n > 0):
            self.up ^= 1 << x
            self.down ^= 1 << self.capacity - x

    def upto(self, room: int) -> int:
        return self.up & (2 << room) - 1

    def pair(self, room: int) -> tuple[int, ...]:
        """One length or two that fill the room, two as like as can be; none: ()."""
        if self.up >> room & 1:
            return (room,)
        both = self.upto(room // 2) & self.down >> self.capacity - room
        if both >> room // 2 & 1 and room % 2 == 0 and self.left[room // 2] == 1:
            both ^= 1 << room // 2
        a = both.bit_length() - 1
        return (room - a, a) if both else ()

    def filling(self, room: int) -> tuple[int, ...]:
        """Up to two lengths that fill the room, or three with one of the ``TRIES`` largest, or two that waste under ``WASTE``; else the largest that fits."""
        got = self.pair(room)
        fit = self.upto(room - 1)
        for _ in range(TRIES):
            if got or not fit:
                break
            x = fit.bit_length() - 1
            fit ^= 1 << x
            self.add(x, -1)
            rest = self.pair(room - x)
            self.add(x, 1)
            got = rest and (x, *rest)
        for waste in range(1, min(room, WASTE)):
            got = got or self.pair(room - waste)
        return got or (self.upto(room).bit_length() - 1,)


def least_waste(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Sequence by sequence, the largest length left with what fills its room, short pieces last: best fit spends them early on rooms that
    two lengths fill. As ``best_fit`` returns it."""
    stock, plan = Stock({x: n for x, n in counts.items() if n}, capacity), []
    while stock.up:
        large = stock.up.bit_length() - 1
        own, room = {}, capacity
        take = [(large, 1)]
        while take:
            for x, n in take:
                own[x] = own.get(x, 0) + n
                stock.add(x, -n)
                room -= x * n
            many = min(stock.left[large], room // large - 3)
            if many > 0:
                take = [(large, many)]
            else:
                take = [(x, 1) for x in stock.filling(room)] if stock.upto(room) else []
        times = 1 + min(stock.left[x] // n for x, n in own.items())
        for x, n in own.items():
            stock.add(x, -n * (times - 1))
        plan.append((own, times))
    return plan


def undominated(taken: dict[int, int], counts: dict[int, int], waste: int) -> bool:
    """No length that is left could stand for shorter ones of those taken, or for none, within the waste."""
    sums = 1  # bit s: some of the taken lengths add up to s
    for size, n in taken.items():
        step = 1
        while n:
            use = min(step, n)
            sums |= sums << size * use
            n -= use
            step *= 2
    for x, n in counts.items():
        if n > taken.get(x, 0):
            low = max(0, x - waste)
            # sums of x itself count if x isn't taken: they are of several lengths then
            if sums >> low & (1 << x - low + (x not in taken)) - 1:
                return False
    return True


class Spent(Exception):
    """The search has used its steps."""


class Level:
    """What a branch's search reads of the pieces that are left; dropped while deeper branches are searched."""

    __slots__ = ("capacity", "large", "counts", "sizes", "below")

    def __init__(self, capacity: int):
        self.capacity, self.counts = capacity, None

    def load(self, left: dict[int, int]) -> None:
        """The largest length, and the rest by length: numbers, lengths that fit beside it, and sums of all up to each."""
        if self.counts is None:
            self.large = max(left)
            self.counts = left | {self.large: left[self.large] - 1}
            self.sizes = sorted(x for x, n in self.counts.items() if n and x <= self.capacity - self.large)
            self.below = [0]
            for x in self.sizes:
                self.below.append(self.below[-1] + x * self.counts[x])

    def drop(self) -> None:
        self.counts = self.sizes = self.below = None


def fillings(level: Level, spare: int, effort: list[int]) -> Iterator[tuple[int, dict[int, int]]]:
    """All undominated fillings of the room beside a level's largest that waste up to ``spare``, as (waste, numbers by length), large lengths first.

    ``effort`` holds the steps left; ``Spent`` when there are none. Nothing of the level is held from one filling to the next.
    """

    def go(left: int, top: int, taken: dict[int, int], most: int) -> Iterator[tuple[int, dict[int, int]]]:
        effort[0] -= 1
        if effort[0] < 0:
            raise Spent
        k = bisect_right(level.sizes, left, 0, top) - 1
        while k >= 0 and left - level.below[k + 1] <= most:
            x = level.sizes[k]
            count = level.counts[x]
            for n in range(min(count, left // x), 0, -1):
                # one more of x would go where as much is wasted
                yield from go(left - n * x, k, taken | {x: n}, most if n == count else min(most, x - 1))
            most = min(most, x - 1)
            k -= 1
        if left <= most and undominated(taken, level.counts, left):
            yield left, taken

    yield from go(level.capacity - level.large, len(level.sizes), {}, spare)


def complete_bins(counts: dict[int, int], capacity: int, effort: int = EFFORT) -> list[tuple[dict[int, int], int]]:
    """Bin completion: depth-first search from the best-fit incumbent, for the optimal packing or the best in ``effort`` steps.

    A branch fills the sequence of the largest length left, and takes the filling t times, t
    falling; below it the filling isn't taken again, as a larger t stands for that. One count of
    what is left serves all branches of the path, so a deep search holds their fillings alone.
    """
    best = best_fit(counts, capacity)
    n_best, bound = sum(x for _, x in best), lower_bound(counts, capacity)
    if n_best > bound:
        other = least_waste(counts, capacity)
        if sum(x for _, x in other) < n_best:
            best, n_best = other, sum(x for _, x in other)
    total = sum(x * n for x, n in counts.items())
    left = {x: n for x, n in counts.items() if n}
    path: list[tuple[dict[int, int], int, frozenset]] = []
    gone: set[frozenset] = set()
    steps = [effort]

    def spare(waste: int) -> int:
        return (n_best - 1) * capacity - total - waste  # a better packing wastes no more

    def give(own: dict[int, int], times: int) -> None:
        for x, n in own.items():
            now = left.get(x, 0) + n * times
            if now:
                left[x] = now
            else:
                del left[x]

    def branches(level: Level, waste: int) -> Iterator[tuple]:
        for lost, own in fillings(level, spare(waste), steps):
            own = own | {level.large: own.get(level.large, 0) + 1}
            key = frozenset(own.items())
            if key not in gone:
                for times in range(min(left[x] // n for x, n in own.items()), 0, -1):
                    if times * lost <= spare(waste):
                        yield own, times, waste + times * lost, key

    def begin(made: int, waste: int) -> tuple[int, Level, Iterator[tuple]]:
        level = Level(capacity)
        return made, level, branches(level, waste)

    stack = [begin(0, 0)] if n_best > bound else []
    while stack and n_best > bound:
        made, level, options = stack[-1]
        steps[0] -= NODE
        level.load(left)
        try:
            step = next(options, None)
        except Spent:
            log.warning("packing: %d sequences, lower bound %d; the search stopped after %d steps", n_best, bound, effort)
            break
        if step is None:
            stack.pop()
            if path:
                own, times, key = path.pop()
                give(own, times)
                gone.discard(key)
            continue
        own, times, waste, key = step
        give(own, -times)
        if made + times + lower_bound(left, capacity) < n_best:
            rest = best_fit(left, capacity)
            n = made + times + sum(x for _, x in rest)
            if n < n_best:
                best, n_best = [*[p[:2] for p in path], (own, times), *rest], n
            if left:
                path.append((own, times, key))
                gone.add(key)
                level.drop()
                stack.append(begin(made + times, waste))
                continue
        give(own, times)
    return best


def _placed(plan: dict[str, np.ndarray], capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda k: batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)  # noqa: E731,B023
            length, rank = col("length"), col("rank")
            at = np.searchsorted(plan["key"], length.astype(np.int64) << 40 | rank, side="right") - 1
            seq, place = plan["seq"][at] + (rank - plan["rank"][at]), plan["place"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq, pa.int64()), pa.array(place, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def lay_out(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan as rows (length, first rank, first sequence, place), sorted by length and rank."""
    rank: dict[int, int] = {}
    rows, seq = [], 0
    for own, times in patterns:
        place = 0
        for size, each in own.items():
            for _ in range(each):
                rows.append((size, rank.get(size, 0), seq, place))
                rank[size] = rank.get(size, 0) + times
                place += size
        seq += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": table[:, 0] << 40 | table[:, 1], "rank": table[:, 1], "seq": table[:, 2], "place": table[:, 3]}


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialise(text.mapInArrow(_pieces(tokenizer, capacity, end), PIECES), "pieces")
    by_task = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # at most one row for each length up to the capacity
    counts = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = lay_out(complete_bins(counts, capacity))
    ranked = pieces.join(firsts, ["length", "chunk"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_placed(plan, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
