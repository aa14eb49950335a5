"""Language identification by rank-order profiles of n-grams (operator 1).

A profile is a language's most frequent character n-grams (1 to 3, spaces between words
counted) in order of frequency. A document's own most frequent n-grams are ranked alike, and
its out-of-place distance to a profile is the sum of the rank differences, with the profile's
length for an n-gram that it lacks. The nearest profile names the language; the score is
1 - distance / (n-grams * length), the share of the greatest distance that is saved.

N-grams are known by their code points, whatever the script. Profiles are fitted on a bounded
sample: up to ``per_lang`` documents of a language, in expectation, by a hash of their id. Every
document is ranked over its whole text; a long text is counted in stretches.

Text that is null or holds no letter is ``und`` with score 0, as is every text where there
was nothing to learn from. Ties go to the first language by name. Rows that repeat are each
predicted, alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, utf8

#: Bits of a code point; what stands before an n-gram of less than 3 symbols. 0 separates words.
POINT, SHORT = 21, (1 << 21) - 1
#: Characters of a text that are counted at once.
STRETCH = 1_000_000


def _folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, and n + 1 offsets."""
    low = [x.lower() for x in texts]
    off = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(x) for x in low], out=off[1:])
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32), off


_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _packed(s: np.ndarray, doc: np.ndarray, carried: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, count) of the n-grams of 1 to 3 symbols in ``s`` that end after its first ``carried`` ones.

    ``s`` holds code points of letters, and single zeros between words; an n-gram doesn't span a zero but at its ends.
    """
    # the symbols of this text alone, so that a document and an n-gram make one number
    known = np.unique(s[s > 0])
    own = np.where(s > 0, np.searchsorted(known, s) + 1, 0).astype(np.uint64)
    bits = np.uint64(int(len(known) + 2).bit_length())
    lead = np.uint64(len(known) + 1)
    ends = np.arange(len(s)) >= carried
    one = np.nonzero(ends & (s > 0))[0]
    two = np.nonzero(ends[1:] & ((s[:-1] > 0) | (s[1:] > 0)) & ((doc[:-1] == doc[1:]) | (s[1:] == 0)))[0]
    three = np.nonzero(ends[2:] & (s[1:-1] > 0) & (doc[:-2] == doc[1:-1]) & ((doc[1:-1] == doc[2:]) | (s[2:] == 0)))[0]
    found_doc, found, count = [], [], []
    if int(doc.max(initial=0)).bit_length() + 3 * int(bits) > 64:
        raise OverflowError("too many documents and letters in one stretch")
    globe = np.r_[0, known.astype(np.int64), SHORT]
    for d, code in (
        (doc[one], ((lead << bits | lead) << bits) | own[one]),
        (doc[two], ((lead << bits | own[two]) << bits) | own[two + 1]),
        (doc[three], ((own[three] << bits | own[three + 1]) << bits) | own[three + 2]),
    ):
        key = (d.astype(np.uint64) << np.uint64(3) * bits) | code
        key.sort()
        head = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0] if len(key) else np.zeros(0, np.int64)
        count.append(np.diff(np.r_[head, len(key)]))
        key = key[head]
        found_doc.append((key >> np.uint64(3) * bits).astype(np.int64))
        mask = (np.uint64(1) << bits) - np.uint64(1)
        a, b, c = (globe[(key >> np.uint64(k) * bits & mask).astype(np.int64)] for k in (2, 1, 0))
        found.append(a << 2 * POINT | b << POINT | c)
    return np.concatenate(found_doc), np.concatenate(found), np.concatenate(count)


def grams(points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, count) of the n-grams of 1 to 3 symbols of texts: 63 bits of code points."""
    n = len(off) - 1
    if not n:
        return (np.zeros(0, np.int64),) * 3
    # one separator between words and at the ends of documents
    s = np.zeros(len(points) + n + 1, np.int64)
    doc = np.r_[np.repeat(np.arange(n), np.diff(off) + 1), n - 1]
    spots = np.ones(len(s), bool)
    spots[off[:-1] + np.arange(n)] = False
    spots[-1] = False
    s[spots] = np.where(letters()[points], points, 0)
    # of separators in a row the last one stays: it opens what follows
    keep = np.r_[(s[1:] != 0) | (s[:-1] != 0), True]
    return _packed(s[keep], doc[keep], 0)


def long_grams(low: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, count) of one lower-case text, a stretch after the other; the last two symbols go on to the next."""
    carry = np.zeros(1, np.int64)
    found, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(low), STRETCH):
        points = np.frombuffer(low[at : at + STRETCH].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        s = np.r_[carry, np.where(letters()[points], points, 0), np.zeros(int(at + STRETCH >= len(low)), np.int64)]
        keep = np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]
        keep[: len(carry)] = True
        s = s[keep]
        _, gram, n = _packed(s, np.zeros(len(s), np.int64), len(carry))
        found, which = np.unique(np.r_[found, gram], return_inverse=True)
        count = np.bincount(which, np.r_[count, n], len(found)).astype(np.int64)
        carry = s[-2:]
    return found, count


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, count) of texts, and which of them have letters."""
    if len(texts) == 1 and len(texts[0]) > STRETCH:
        gram, count = long_grams(texts[0].lower())
        return np.zeros(len(gram), np.int64), gram, count, np.array([bool(len(gram))])
    points, off = _folded(texts)
    ink = np.concatenate([[0], np.cumsum(letters()[points])])
    lettered = ink[off[1:]] > ink[off[:-1]]
    try:
        return *grams(points, off), lettered
    except OverflowError:
        half = len(texts) // 2
        a, b = gram_counts(texts[:half]), gram_counts(texts[half:])
        return np.r_[a[0], b[0] + half], np.r_[a[1], b[1]], np.r_[a[2], b[2]], lettered


def fit_profiles(docs: DataFrame, per_lang: int = 1000, length: int = 300) -> dict:
    """Profiles from the rows of ``docs`` with text and a lang: {"langs", "profiles", "length"}.

    Counts meet by language and n-gram; the driver gets ``length`` n-grams of each language.
    """
    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text", "doc_id")
    sizes = {r.lang: int(r.n) for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {"langs": [], "profiles": np.zeros((0, length), np.int64), "length": length}
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))])
    sample = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).to_numpy(zero_copy_only=False)
            _, off = utf8(batch.column(1))
            for a, b in slices(off, 500_000):
                doc, gram, n, _ = gram_counts([batch.column(1)[k].as_py() for k in range(a, b)])
                for own in np.unique(lang[a:b].astype(str)).tolist():
                    mine = (lang[a:b] == own)[doc]
                    found, which = np.unique(gram[mine], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array([own] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(np.bincount(which, n[mine], len(found)).astype(np.int64))], ["lang", "gram", "n"])

    totals = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = totals.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("place") <= length)
    langs = sorted(sizes)
    profiles = np.full((len(langs), length), -1, np.int64)
    for r in ranked.collect():
        profiles[langs.index(r.lang), r.place - 1] = r.gram
    return {"langs": langs, "profiles": profiles, "length": length}


def place_table(model: dict) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all profiles, sorted, and each one's rank in each (its length where it isn't in it)."""
    known = np.unique(model["profiles"][model["profiles"] >= 0])
    places = np.full((len(known) + 1, len(model["langs"])), model["length"], np.int64)
    for k, profile in enumerate(model["profiles"]):
        own = profile[profile >= 0]
        places[np.searchsorted(known, own), k] = np.arange(len(own))
    return known, places


def distances(texts: list[str], model: dict, known: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language or -1, score, has letters) of each text; known and places are of place_table."""
    length, n = model["length"], len(texts)
    doc, gram, count, lettered = gram_counts(texts) if n else (*(np.zeros(0, np.int64),) * 3, np.zeros(0, bool))
    best, score = np.full(n, -1), np.zeros(n)
    if not len(model["langs"]) or not n:
        return best, score, lettered
    # a stable sort by gram, then count, then document ranks ties as the profiles do
    order = np.lexsort((gram, -count, doc))
    doc, gram = doc[order], gram[order]
    head = np.searchsorted(doc, np.arange(n))
    rank = np.arange(len(doc)) - head[doc]
    top = rank < length
    doc, gram, rank = doc[top], gram[top], rank[top]
    used = np.bincount(doc, minlength=n)
    total = np.zeros((n, len(model["langs"])))
    at = np.minimum(np.searchsorted(known, gram), max(len(known) - 1, 0))
    at = np.where(known[at] == gram, at, len(known)) if len(known) else np.full(len(gram), 0)
    for k in range(len(model["langs"])):
        place = places[at, k]
        gap = np.where(place < length, np.abs(place - rank), length)
        total[:, k] = np.bincount(doc, gap, minlength=n)
    best = np.where(lettered, total.argmin(axis=1), -1)
    score = np.where(lettered & (used > 0), 1 - total.min(axis=1) / np.maximum(used * length, 1), 0.0)
    return best, np.clip(score, 0, 1), lettered


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """The columns of ``docs`` with lang_pred and score (own columns of these names are replaced)."""
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score")])
    out = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, places = place_table(model)
        names = np.array([*model["langs"], "und"], object)
        for batch in batches:
            _, off = utf8(batch.column(at))
            for a, b in slices(off, 500_000):
                part = batch.slice(a, b - a)
                best, score, lettered = distances([x.as_py() or "" for x in part.column(at)], model, known, places)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best], pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, out)
