"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, fingerprint, html_text, jaccard, langid, lexical, license_scan, packing, pii, recompress, substring, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


def tokenizer_file() -> str:
    """The vocabulary of the packed ids (its place is a parameter of the operator)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op7_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.dedup_passages(table(spark, sf_dir, "documents")).drop("kept")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the rows whose remainder is not 2, and predicts every row."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.fit_profiles(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.train(docs)).select("doc_id", "licences", "n_paragraphs", F.to_json("found").alias("found"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark")).drop("copy")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_exact_topk": op4_exact_topk,
        "op5_ngram_jaccard": op5_ngram_jaccard,
        "op6_html_text": op6_html_text,
        "op7_passage_dedup": op7_passage_dedup,
        "op8_license_scan": op8_license_scan,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_pii": op10_pii,
        "op11_source_divergence": op11_source_divergence,
        "op12_lexical_search": op12_lexical_search,
        "op13_fingerprints": op13_fingerprints,
    }


#: Windows of 50 bytes as hexadecimal text, each one's smallest document, and what later ones cover.
SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 100)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS s FROM d)),
f AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS first FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM f WHERE first < doc_id),
b AS (SELECT doc_id, substr(h, 2 * i + 1, 2) AS c, i FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d)),
k AS (SELECT b.doc_id, string_agg(b.c, '' ORDER BY b.i) AS kept FROM b ANTI JOIN g USING (doc_id, i) GROUP BY 1),
r AS (SELECT doc_id, count(*) AS n, count(CASE WHEN p IS NULL OR i > p + 1 THEN 1 END) AS spans FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM g) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(r.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""

#: Windows of 20 words in order of document and place; all but the first of equal ones go.
PASSAGES = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + 20], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 19, 0))) AS s FROM d)),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM f WHERE n > 1),
b AS (SELECT doc_id, w[i + 1] AS c, i FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d)),
k AS (SELECT b.doc_id, string_agg(b.c, ' ' ORDER BY b.i) AS kept FROM b ANTI JOIN g USING (doc_id, i) GROUP BY 1),
r AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""

TOP_K = """
WITH c AS (SELECT vec_id, i, floor(256 * CAST(x AS DOUBLE)) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
ok AS (SELECT vec_id FROM c GROUP BY 1 HAVING bool_and(x IS NOT NULL AND isfinite(x))),
v AS (SELECT c.* FROM c SEMI JOIN ok USING (vec_id)),
s AS (SELECT q.vec_id AS query_id, p.vec_id, CAST(sum(q.x * p.x) AS BIGINT) AS score FROM v q JOIN v p ON q.i = p.i AND q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


#: Sets of word 5-grams, pairs of classes by shared 5-grams, and what can be reached over links.
NEAR = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS g FROM d),
c AS (SELECT g, min(doc_id) AS class_id FROM s WHERE len(g) > 0 GROUP BY g),
e AS (SELECT class_id, len(g) AS n, unnest(g) AS k FROM c),
p AS (SELECT a.class_id AS a, b.class_id AS b FROM e a JOIN e b ON a.k = b.k AND a.class_id < b.class_id GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
l AS (SELECT a AS class_id, count(*) AS n_links FROM u GROUP BY 1),
r AS (SELECT class_id, class_id AS root FROM l UNION SELECT u.b, r.root FROM r JOIN u ON r.class_id = u.a),
m AS (SELECT class_id, min(root) AS group_id FROM r GROUP BY 1)
SELECT s.doc_id, coalesce(c.class_id, s.doc_id) AS class_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links, coalesce(m.group_id, c.class_id, s.doc_id) AS group_id
FROM s LEFT JOIN c USING (g) LEFT JOIN l USING (class_id) LEFT JOIN m USING (class_id)
"""


#: Every pair of groups over every kept term, term by term.
DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT k, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY 1),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.n + l.v) AS p, 1 + (1000000000::HUGEINT * (kept.total + 1)) // (l.n + l.v) AS q
  FROM s JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = kept.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o) WHERE part = 'pair' OR rank <= 200
"""

#: Every item's terms against every document that holds them.
LEXICAL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT k, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
f AS (SELECT k, term, count(*) AS tf FROM t GROUP BY ALL),
z AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
m AS (SELECT k, doc_id, 75 + CAST(25 * len(w) * z.n AS BIGINT) // CAST(z.l AS BIGINT) AS m FROM d, z WHERE len(w) > 0),
e AS (SELECT term, CAST(floor(1000 * ln((2 * z.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, z GROUP BY term, z.n),
b AS (SELECT item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark),
s AS (SELECT b.item_id, m.k, m.doc_id, sum(e.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * m.m))) AS score FROM b JOIN e USING (term) JOIN f USING (term) JOIN m USING (k) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": DIVERGENCE, "op12_lexical_search": LEXICAL, "op2_substring_dedup": SUBSTRINGS, "op4_exact_topk": TOP_K, "op5_ngram_jaccard": NEAR, "op7_passage_dedup": PASSAGES}
