"""The stages one after the other against what each must do on its own input."""

import re

import corpus_pipeline
from lodestar.llm import pii

SF = "/root/testdata/sf0.001"


def shingles(t):
    w = t.encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        outs.append({r.doc_id: r.text for r in docs.collect()} if name != "best_fit_packing" else docs.collect())
        if name != "best_fit_packing":
            assert docs.columns == columns
    named, unique, clean, private, packed = outs
    raw = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert named == {i: t for i, t in raw.items() if re.search(r"[^\W\d_]", t or "")}
    sets = {i: shingles(t) for i, t in named.items()}
    ids = sorted(sets)
    root = {i: i for i in ids}
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert set(unique) == {i for i in ids if root[i] == i}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i for i, t in unique.items() if any(x in t for x in items)}
    assert held and not held & set(clean) and len(clean) > 0.7 * len(unique)
    found = {r.doc_id for r in pii.find_pii(spark.createDataFrame(list(clean.items()), "doc_id long, text string")).collect() if r.pii}
    assert all((private[i] == clean[i]) == (i not in found) for i in clean) and found
    assert not any("@mail" in t for t in private.values())
    assert {r.doc_id for r in packed} == set(private)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "pii", "best_fit_packing"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, pii string, tag int, part int, node long"


def odd_rows():
    base = " ".join(f"word{k % 23} thing{k % 17}" for k in range(60))
    near = base.replace("word5 ", "other ", 1)
    rows = [(1, base, "en"), (2, near, None), (3, base, "en"), (4, "", "en"), (5, None, None), (6, "12 34", "en"), (None, "an unnamed text of some words", "en"), (None, "an unnamed text of some words", "en"), (None, None, None)]
    rows += [(7, "the mail is a@b.org, write there " + base[:90], "en"), (8, "first text of eight", "en"), (8, "second text of eight", "en"), (8, "second text of eight", "en"), (9, "word " * 30_000, "en")]
    return [(i, t, lang, "s", len(t or ""), 0.5, "x", 3, 4, 5) for i, t, lang in rows]


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "an item that stands nowhere at all"), (None, "x y z"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path)).cache()
        got = at.collect()
        if name != "best_fit_packing":
            assert at.columns == columns
            assert all((r.score, r.pii, r.tag, r.part, r.node) == (0.5, "x", 3, 4, 5) for r in got)
        ids = sorted((r.doc_id for r in got), key=str)
        if name == "language_id":
            assert ids == [1, 2, 3, 7, 8, 8, 8, 9, None, None] and all(r.lang == "en" for r in got)
        elif name != "best_fit_packing":
            assert ids == [1, 7, 8, 8, 9, None]
        if name == "pii":
            assert next(r.text for r in got if r.doc_id == 7).startswith("the mail is <email>, write")
    assert {r.doc_id for r in got} == {1, 7, 8, 9, None}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(got)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
