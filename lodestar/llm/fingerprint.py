"""Document fingerprints: bottom-k sketches of word shingles, by DataFrame functions alone (operator 13).

A fingerprint is the ``k`` least of the 64-bit hashes of a text's shingles of ``width`` words, in
ascending order (all of them, if it has fewer): a sample of the set of its shingles that any two
texts draw alike. The union's k least hashes are those of the two fingerprints' union, so
fingerprints merge, and the share of them that both hold estimates the resemblance
|A & B| / |A | B|; it is exact where the union has up to k shingles. The place of the k-th least
hash in the range of hashes estimates the number of distinct shingles, and both together the
containment |A & B| / |A|.

Words are runs of anything but ASCII white space. A text with 1 to width - 1 words has one
shingle, all its words; one without words has none, and its fingerprint is empty. Two empty
fingerprints resemble each other wholly, an empty and another not at all. A text of more than
``LONG`` characters is sketched in parts of ``PART`` words, each with the first words of the part
after it, and the parts' sketches are merged: only one part's words are held at once.

Null text is empty. Rows that repeat are each answered, alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts

WIDTH, SIZE = 5, 128
#: Characters from which on a text is sketched in parts, and words of a part.
LONG, PART = 200_000, 8192
_WORD = r"[^\\x20\\x09-\\x0D]++"
_GAP = r"[\\x20\\x09-\\x0D]*+"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once for a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _hashes(words: str, width: int) -> str:
    """Hashes of the shingles of an array of words (one shingle, if they are few)."""
    one = ", ".join(f"{words}[i + {j}]" for j in range(width))
    return f"""case when size({words}) >= {width} then transform(sequence(0, size({words}) - {width}), i -> xxhash64({one}))
        when size({words}) > 0 then array(xxhash64(array_join({words}, ' '))) else cast(array() as array<bigint>) end"""


def _least(values: str, k: int) -> str:
    return f"slice(sort_array(array_distinct({values})), 1, {k})"


def sketch(text: Column | str, k: int = SIZE, width: int = WIDTH) -> Column:
    """The k least hashes of a text's shingles, ascending: array<bigint>."""
    name = text if isinstance(text, str) else "__text"
    words = f"regexp_extract_all(x, '{_WORD}', 0)"
    whole = _let("x", name, _let("w", words, _least(_hashes("w", width), k)))
    # parts overlap by the words that a shingle from the one's last word needs; a last part of fewer words adds nothing of its own
    head = f"slice(regexp_extract_all(parts[p + 1], '{_WORD}', 0), 1, {width - 1})"
    own = f"regexp_extract_all(parts[p], '{_WORD}', 0)"
    joined = f"if(p + 1 < size(parts), concat({own}, {head}), {own})"
    several = f"if(p > 0 and size(w) < {width}, cast(array() as array<bigint>), {_hashes('w', width)})"
    merged = f"aggregate(sequence(0, size(parts) - 1), cast(array() as array<bigint>), (acc, p) -> {_let('w', joined, _least(f'concat(acc, {several})', k))})"
    parts = f"regexp_extract_all({name}, '(?:{_WORD}{_GAP}){{1,{PART}}}+', 0)"
    long = _let("parts", parts, f"if(size(parts) = 0, cast(array() as array<bigint>), {merged})")
    return F.expr(f"if(length({name}) > {LONG}, {long}, {whole})")


def merged(a: Column, b: Column, k: int = SIZE) -> Column:
    """The sketch of two sketched sets' union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimates |A & B| / |A | B| from two sketches; 1 for two empty ones."""
    # the union is bound by a lambda, so that it is made once for a row
    share = lambda u: F.size(F.filter(F.array_intersect(a, b), lambda x: x <= F.element_at(u, -1))) / F.size(u)
    near = F.element_at(F.transform(F.array(merged(a, b, k)), share), 1)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(near)


def distinct(a: Column, k: int = SIZE) -> Column:
    """Estimates the number of shingles: their number if under k, else (k - 1) over the k-th hash's place in (0, 1]."""
    place = (F.element_at(a, -1).cast("double") + 2.0**63 + 1) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, near: Column, k: int = SIZE) -> Column:
    """Estimates |A & B| / |A| (1 for an empty A) from two sketches and their resemblance."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), near / (1 + near) * (distinct(a, k) + distinct(b, k)) / distinct(a, k)))


def text_of(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_sketch(docs: DataFrame, name: str = "sketch", text: str = "text", k: int = SIZE, width: int = WIDTH) -> DataFrame:
    """``docs`` and a column with the sketch of each ``text``; an own column of that name is replaced."""
    return docs.withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn(name, sketch("__text", k, width)).drop("__text")


def group_sketches(sketched: DataFrame, keys: list[str], k: int = SIZE) -> DataFrame:
    """The sketch of the union of each group's documents, from their sketches: only the k least of a task's rows leave it."""
    values = sketched.select(*keys, F.explode("sketch").alias("h")).distinct()
    ranked = values.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).filter(F.col("__n") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def _buckets(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with bucket: about equal ranges of doc_id, the greatest in bucket 0; rows without doc_id by their text's hash, after the others.

    Any bounds are right, as they only deal out the order; so approximate quantiles do.
    """
    at = [k / n for k in range(1, n)]
    bounds = rows.agg(F.percentile_approx("doc_id", at, 100 * n).alias("b")).first()["b"] if at else []
    bounds = sorted(set(bounds or []))
    steps = max(1, len(bounds).bit_length())
    # binary search of how many bounds lie below the id
    found = "0"
    if bounds:
        powers = ", ".join(str(1 << k) for k in reversed(range(steps)))
        tested = f"if(lo + step <= {len(bounds)}, array({', '.join(f'{b}L' if b > -(2**63) else 'cast(-9223372036854775808 as bigint)' for b in bounds)})[lo + step - 1] < doc_id, false)"
        found = f"aggregate(array({powers}), 0, (lo, step) -> if({tested}, lo + step, lo))"
    unnamed = f"{len(bounds) + 1} + cast(shiftrightunsigned(own_hash ^ cast(-9223372036854775808 as bigint), 58) as int)"
    return rows.withColumn("own_hash", F.xxhash64("text")).withColumn("bucket", F.expr(f"if(doc_id is null, {unnamed}, {len(bounds)} - {found})"))


def with_next(docs: DataFrame, k: int = SIZE, width: int = WIDTH) -> DataFrame:
    """doc_id, text, sketch, next_text and next_sketch: the next document by descending doc_id, after the last the first.

    Rows of one doc_id come by their text's hash, then text; those without doc_id come last. Texts
    are shuffled once, by ranges of doc_id; the first row of each range also goes to the range
    before it, so that no range needs another.
    """
    spark = docs.sparkSession
    rows = _buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")), 4 * shuffle_parts(spark))
    # a row for each range: its first document, and the range before it (before the first comes the last)
    first = rows.groupBy("bucket").agg(F.min(F.struct(-F.col("doc_id").cast("decimal(20,0)"), "own_hash")).alias("f"), F.max("doc_id").alias("top"))
    first = first.select("bucket", F.col("top").alias("head_id"), F.col("f.own_hash").alias("head_hash"))
    chain = Window.orderBy("bucket")
    first = first.withColumn("before", F.coalesce(F.lag("bucket").over(chain), F.max("bucket").over(Window.partitionBy())))
    rows = rows.join(F.broadcast(first), "bucket", "left")
    head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("own_hash") == F.col("head_hash"))
    place = lambda bucket, extra: F.struct(F.col(bucket).alias("bucket"), F.lit(extra).alias("extra"))
    rows = rows.select("doc_id", "text", "own_hash", F.explode(F.when(head, F.array(place("bucket", False), place("before", True))).otherwise(F.array(place("bucket", False)))).alias("at"))
    rows = rows.select("doc_id", "text", "own_hash", "at.bucket", "at.extra").repartition("bucket").withColumn("sketch", sketch("text", k, width))
    order = Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("doc_id"), "own_hash", "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    return rows.filter(~F.col("extra")).select("doc_id", "text", "sketch", "next_text", "next_sketch")


def edited_pairs(docs: DataFrame, k: int = SIZE, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text and of its edited form, whose last half is the start of the next document."""
    rows = with_next(docs, k, width).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_sketch", sketch("edited", k, width))
    own, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    rows = rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "sketch", "edited_sketch",
        resemblance(own, edited, k).alias("near_edited"), resemblance(own, after, k).alias("near_next"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", text_of(own).alias("fingerprint"), text_of(edited).alias("edited_fingerprint"), "near_edited", "near_next",
        containment(own, edited, F.col("near_edited"), k).alias("in_edited"), distinct(own, k).alias("n_shingles"),
    )
