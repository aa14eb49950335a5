"""Shared building blocks of the training-data operators.

The text operators run numpy over the UTF-8 buffers of Arrow batches, and exchange packed
binary columns (one row per flushed slice and target partition), so that millions of
fingerprints cost a few thousand Spark rows.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Text bytes that one numpy pass works on; temporaries take about a hundred times that.
SLICE_BYTES = 1_000_000
#: Bytes up to which a string is hashed in step with others; longer ones go alone.
LONG = 96
_rng = np.random.default_rng(20240607)
KEYS = _rng.integers(1, 2**63, 16, dtype=np.uint64) * U(2) + U(1)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
#: Ids up to which a list of them is broadcast (16 MB); longer ones are joined by a shuffle.
MOST_BROADCAST = 2_000_000


def work_dir(spark: SparkSession) -> str:
    """The application's folder below the shared checkpoint folder (a local one only in local mode, where none is set)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir() + "/lodestar-checkpoints"
    return f"{base.rstrip('/')}/lodestar-{spark.sparkContext.applicationId}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table: cuts lineage for good.

    ``instead_of``, an earlier table that nothing needs any more, is deleted.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lodestar_path = path
    if instead_of is not None:
        discard(spark, instead_of.lodestar_path)
    return out


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def _mur_int(k: int, seed: int = 42) -> int:
    m = 0xFFFFFFFF
    k = (k * 0xCC9E2D51) & m
    k = ((k << 15) | (k >> 17)) & m
    k = (k * 0x1B873593) & m
    h = seed ^ k
    h = ((h << 13) | (h >> 19)) & m
    h = (h * 5 + 0xE6546B64) & m
    h ^= 4
    h ^= h >> 16
    h = (h * 0x85EBCA6B) & m
    h ^= h >> 13
    h = (h * 0xC2B2AE35) & m
    h ^= h >> 16
    return h - 2**32 if h >= 2**31 else h


def even_keys(n: int) -> list[int]:
    """n integers that Spark's hash partitioning deals to n different partitions."""
    keys: list[int | None] = [None] * n
    left, k = n, 0
    while left:
        t = _mur_int(k) % n
        if keys[t] is None:
            keys[t] = k
            left -= 1
        k += 1
    return keys  # type: ignore[return-value]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with up to ``most`` bytes (a longer document stands alone)."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a number (zeros beyond the end)."""
    wide = np.zeros(len(data) + 9, np.uint8)
    wide[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", wide, 0, (1,))


def byte_names(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, second: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Keyed hashes of the byte strings data[lo:hi], 8 bytes a step with a mix between (not a polynomial); long ones by BLAKE2.

    ``second`` asks for 64 independent bits more.
    """
    at, size = loads(data), hi - lo
    h = size.astype(np.uint64) * KEYS[0] + KEYS[1]
    g = h ^ KEYS[2] if second else None
    live = np.nonzero(size <= LONG)[0]
    done = 0
    while len(live):
        left = size[live] - done
        v = at[lo[live] + done] & _MASK[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ v) * KEYS[3])
        if g is not None:
            g[live] = mix((g[live] + v) * KEYS[4])
        done += 8
        live = live[left > 8]
    for k in np.nonzero(size > LONG)[0].tolist():
        digest = hashlib.blake2b(data[lo[k] : hi[k]].tobytes(), digest_size=16).digest()
        h[k] = int.from_bytes(digest[:8], "little")
        if g is not None:
            g[k] = int.from_bytes(digest[8:], "little")
    return h, g


def equal_bytes(data: np.ndarray, a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> np.ndarray:
    """Are data[a_lo:a_hi] and data[b_lo:b_hi] the same bytes?"""
    at, size = loads(data), a_hi - a_lo
    same = size == b_hi - b_lo
    live = np.nonzero(same & (size <= LONG) & (a_lo != b_lo))[0]
    done = 0
    while len(live):
        left = size[live] - done
        ok = ((at[a_lo[live] + done] ^ at[b_lo[live] + done]) & _MASK[np.minimum(left, 8)]) == 0
        same[live[~ok]] = False
        done += 8
        live = live[ok & (left > 8)]
    for k in np.nonzero(same & (size > LONG) & (a_lo != b_lo))[0].tolist():
        same[k] = bool((data[a_lo[k] : a_hi[k]] == data[b_lo[k] : b_hi[k]]).all())
    return same


def byte_classes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, names: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the byte strings data[lo:hi], equal for equal bytes alone: by hash, each compared with its class's first."""
    if names is None:
        names = byte_names(data, lo, hi)[0]
    _, first, which = np.unique(names, return_index=True, return_inverse=True)
    rep = first[which]
    if not equal_bytes(data, lo, hi, lo[rep], hi[rep]).all():
        # two strings of one hash: by the bytes themselves
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], np.int64)
    return which


def window_classes(ids: np.ndarray, at: np.ndarray, width: int, names: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the windows ids[at : at + width], equal for equal ids alone (checked like ``byte_classes``)."""
    if not len(at):
        return np.zeros(0, np.int64)
    if names is None:
        names = Blocks(mix(ids.astype(np.uint64) + KEYS[5])).of(at, at + width)
    _, first, which = np.unique(names, return_index=True, return_inverse=True)
    rep = at[first[which]]
    other = np.nonzero(rep != at)[0]
    a, b = at[other], rep[other]
    if all((ids[a + k] == ids[b + k]).all() for k in range(width)):
        return which
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(ids[p : p + width].tobytes(), len(known)) for p in at.tolist()], np.int64)


class Blocks:
    """Hashes of ranges of 64-bit names by doubling: a range is the two blocks, of a power of two names, that cover it."""

    def __init__(self, names: np.ndarray):
        self.levels = [names]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(join(last[: max(0, len(last) - half)], last[half:]))
        return self.levels[k]

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of names[lo:hi] (one name at least), alike wherever the range lies."""
        size = hi - lo
        out = np.zeros(len(lo), np.uint64)
        k, most = 0, int(size.max()) if len(size) else 0
        while 1 << k <= most:
            own = np.nonzero((size >> k) == 1)[0]
            if len(own):
                level = self.level(k)
                out[own] = join(level[lo[own]], level[hi[own] - (1 << k)]) + size[own].astype(np.uint64)
            k += 1
        return mix(out)

    def every(self, k: int) -> np.ndarray:
        """Hashes of all ranges of k names."""
        lo = np.arange(max(0, len(self.levels[0]) - k + 1))
        return self.of(lo, lo + k)


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two names in order."""
    return mix(a * KEYS[6] + (b ^ (b >> U(31))) * KEYS[7] + KEYS[8])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """m[j] = min(h[j : j + w]), for the windows that fit."""
    m, s = h.copy(), 1
    while s * 2 <= w:
        m = np.minimum(m[: len(m) - s], m[s:])
        s *= 2
    return np.minimum(m[: len(m) - (w - s)], m[w - s :]) if w > s else m


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least of h in one window of w, at least (all of equal least ones)."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    m = window_min(h, w)
    # position i is one if h[i] equals the greatest of the minima of the windows that hold i
    pad = np.concatenate([np.zeros(w - 1, np.uint64), m, np.zeros(w - 1, np.uint64)])
    most = ~window_min(~pad, w)
    return np.nonzero(h == most)[0]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then those from starts[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, counts)


class Outbox:
    """Gathers rows of arrays and deals them to partitions as packed binaries.

    ``kinds`` gives each column's packing: var, doc or raw. A flush sorts the rows by
    partition and yields one Arrow row for each partition that has some.
    """

    def __init__(self, keys: list[int], kinds: dict[str, str], flush_rows: int = 400_000):
        self.keys, self.kinds, self.most = np.array(keys, np.int32), kinds, flush_rows
        self.held: list[dict[str, np.ndarray]] = []
        self.parts: list[np.ndarray] = []
        self.rows = 0

    @staticmethod
    def schema(kinds: dict[str, str]) -> str:
        return "part int, " + ", ".join(f"{k} binary" for k in kinds)

    def add(self, part: np.ndarray, **cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(part):
            self.parts.append(part.astype(np.int32))
            self.held.append(cols)
            self.rows += len(part)
        if self.rows >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        part = np.concatenate(self.parts)
        order = np.argsort(part, kind="stable")
        part = part[order]
        cut = np.nonzero(np.r_[True, part[1:] != part[:-1]])[0]
        ends = np.r_[cut[1:], len(part)]
        arrays: list[pa.Array] = [pa.array(self.keys[part[cut]], pa.int32())]
        for name, kind in self.kinds.items():
            col = np.concatenate([h[name] for h in self.held])[order]
            arrays.append(pa.array([pack(kind, col[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary()))
        self.parts, self.held, self.rows = [], [], 0
        yield pa.RecordBatch.from_arrays(arrays, ["part", *self.kinds])


def pack(kind: str, a: np.ndarray) -> bytes:
    """var: unsigned, as few bytes each as the largest needs; doc: signed, the least, then var; raw: as it is."""
    if kind == "raw":
        return a.tobytes()
    if kind == "doc":
        low = a.min()
        return int(low).to_bytes(8, "little", signed=True) + pack("var", (a - low).astype(np.uint64))
    a = a.astype("<u8")
    width = max(1, (int(a.max()).bit_length() + 7) // 8)
    return bytes([width]) + a.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(kind: str, b: bytes) -> np.ndarray:
    if kind == "raw":
        return np.frombuffer(b, np.uint8)
    if kind == "doc":
        return unpack("var", b[8:]).astype(np.int64) + int.from_bytes(b[:8], "little", signed=True)
    raw = np.frombuffer(b, np.uint8, offset=1).reshape(-1, b[0])
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : b[0]] = raw
    return out.reshape(-1).view("<u8")


def gather(batches: Iterator[pa.RecordBatch], kinds: dict[str, str]) -> dict[str, np.ndarray] | None:
    """All packed rows of a partition as plain arrays (None: no rows)."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in kinds}
    for batch in batches:
        for k, kind in kinds.items():
            col = batch.column(batch.schema.get_field_index(k))
            out[k] += [unpack(kind, x.as_buffer().to_pybytes()) for x in col]
    if not out[next(iter(kinds))]:
        return None
    return {k: np.concatenate(v) for k, v in out.items()}


#: Replies to documents: doc and tag name the row, at holds a number for it.
REPLY = {"doc": "doc", "tag": "var", "at": "var"}


def bucket_of(doc: np.ndarray, n: int) -> np.ndarray:
    """pmod(hash(doc_id), n) as Spark has it."""
    m = np.uint32
    h = np.full(len(doc), 42, m)
    with np.errstate(over="ignore"):
        for k in (doc.astype(np.int64).view(np.uint64) & U(0xFFFFFFFF), doc.astype(np.int64).view(np.uint64) >> U(32)):
            k = k.astype(m) * m(0xCC9E2D51)
            k = ((k << m(15)) | (k >> m(17))) * m(0x1B873593)
            h ^= k
            h = ((h << m(13)) | (h >> m(19))) * m(5) + m(0xE6546B64)
        h ^= m(8)
        h = (h ^ (h >> m(16))) * m(0x85EBCA6B)
        h = (h ^ (h >> m(13))) * m(0xC2B2AE35)
        h ^= h >> m(16)
    return h.view(np.int32).astype(np.int64) % n


def reply(keys: list[int], doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Replies, dealt to the buckets of their documents."""
    out = Outbox(keys, REPLY)
    yield from out.add(bucket_of(doc, len(keys)), doc=doc, tag=tag, at=at)
    yield from out.flush()


def sized(ids: DataFrame) -> DataFrame:
    """Written ids, marked for broadcast if they are few."""
    own = materialise(ids, "ids")
    return F.broadcast(own) if own.count() <= MOST_BROADCAST else own


def keyed(docs: DataFrame, keys: list[int]) -> DataFrame:
    """doc_id, text (null: empty), tag and part, the bucket.

    tag tells rows of one doc_id apart: the text's hash, and 0 where a doc_id comes once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    again = materialise(rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("again")), "again")
    n = again.count()
    if n:
        rows = rows.join(F.broadcast(again) if n <= MOST_BROADCAST else again, F.col("doc_id") == F.col("again"), "left")
        rows = rows.select("doc_id", "text", F.when(F.col("again").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("tag"))
    else:
        rows = rows.withColumn("tag", F.lit(0).cast("long"))
    part = F.element_at(F.array(*[F.lit(k) for k in keys]), F.pmod(F.hash("doc_id"), F.lit(len(keys))) + 1)
    return rows.withColumn("part", part)


def answered(rows: DataFrame, replies: DataFrame, work, schema: str) -> DataFrame:
    """Calls work(rows' batch, numbers) for each bucket: numbers[k] are the replies to row k (empty: none).

    A bucket holds the texts of one shuffle partition and comes to Python as a whole.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        # the replies' packed columns, without the key
        got = gather(iter(right.select(list(REPLY)).to_batches()), REPLY)
        found: dict[tuple[int, int], np.ndarray] = {}
        if got is not None:
            order = np.lexsort((got["tag"], got["doc"]))
            doc, tag, at = got["doc"][order], got["tag"][order].astype(np.int64), got["at"][order].astype(np.int64)
            cut = np.nonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])[0]
            ends = np.r_[cut[1:], len(doc)]
            found = {(d, t): at[a:b] for d, t, a, b in zip(doc[cut].tolist(), tag[cut].tolist(), cut.tolist(), ends.tolist(), strict=True)}
        none = np.zeros(0, np.int64)
        out: list[pa.RecordBatch] = []
        for batch in left.select(["doc_id", "text", "tag"]).combine_chunks().to_batches():
            numbers = [found.get(k, none) for k in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            out += work(batch, numbers)
        return pa.Table.from_batches(out, schema=arrow_schema(schema))

    return rows.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])


def merge_spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that the half-open spans cover."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > hi[:-1]]
    first = np.nonzero(new)[0]
    return lo[first], hi[np.r_[first[1:] - 1, len(lo) - 1]]
