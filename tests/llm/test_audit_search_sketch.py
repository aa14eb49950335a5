"""Operators 11 to 13 against brute force, on odd rows too."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import divergence, fingerprint, lexical, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
WORD11 = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD12 = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def random_docs(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "B", "bb", "É", "éa", "x1y", "日本", "c-d", "the", "THE", "zz9", "q", "İ", "ﬀ"]
    out = [(i, " ".join(rng.choices(words, [8, 3, 2, 1, 1, 1, 1, 1, 30, 9, 1, 1, 1, 1], k=rng.randint(0, 40))), rng.choice(["en", "de"]), rng.choice(["s1", "s2", "s3", "S"])) for i in range(n)]
    out += [(None, "the a a a bb", None, None), (3, None, "en", "s1"), (3, "the bb", "en", "s9"), (n, "", "fr", "s1"), (n + 1, "12 - 3", "fr", "s2"), (n + 2, "the " * 500, "en", "s1")]
    return out + out[:5]


def brute_audit(docs, least=3, top=200):
    count, held, group = Counter(), Counter(), defaultdict(Counter)
    groups = {(lang or "", s or "") for _, _, lang, s in docs}
    for _, text, lang, s in docs:
        terms = [w.translate(LOW) for w in WORD11.findall(text or "")]
        for w in terms:
            group[lang or "", s or ""][w] += 1
        for w in set(terms):
            held[lang or "", w] += 1
    out = []
    for lang, s in groups:
        kept = [w for (of, w), n in held.items() if of == lang and n >= least]
        v = len(kept)
        mine = [x for x in groups if x[0] == lang]
        whole = {w: sum(group[x][w] for x in mine) for w in kept}
        share = lambda counts: {w: 1 + 10**9 * (counts[w] + 1) // (sum(counts[x] for x in kept) + v) for w in kept}
        p, q = share(group[lang, s]), share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        pairs = [(x[1], sum(f(p[w], r[w]) for w in kept)) for x in mine if x[1] != s for r in [share(group[x])]]
        terms = [(w, f(p[w], q[w])) for w in kept if group[lang, s][w] and p[w] > q[w]]
        for part, found in (("pair", pairs), ("term", terms)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_is_brute_force(spark, seed, monkeypatch):
    docs = random_docs(seed)
    monkeypatch.setattr(divergence, "MOST_TERMS", 7)
    df = spark.createDataFrame(docs, DOCS).repartition(3).withColumn("value", F.lit("own")).withColumn("rank", F.lit(None).cast("int")).withColumn("cells", F.lit(1))
    cols = ("lang", "source", "part", "item", "value", "rank")
    assert rows_of(divergence.audit(df), *cols) == brute_audit(docs)
    assert rows_of(divergence.audit(df, least_docs=9, top=1), *cols) == brute_audit(docs, 9, 1)


def test_histograms_hold_every_kept_term(spark):
    docs = random_docs(5)
    df = spark.createDataFrame(docs, DOCS)
    kept = divergence.kept_terms(df).cache()
    groups = df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    cells = divergence.pair_histograms(kept, groups, sizes).collect()
    v = {r.lang: r.v for r in sizes.collect()}
    whole = Counter()
    for r in cells:
        whole[r.lang, r.s, r.t] += r.m
    assert whole and all(n == v[k[0]] for k, n in whole.items())
    assert len(cells) == len({(r.lang, r.s, r.t, r.a, r.b) for r in cells}) and any(r.a == r.b == 0 for r in cells)


def test_stretches_part_no_term():
    rng = random.Random(0)
    text = "".join(rng.choices("ab é日\n.1", k=5000)).encode()
    want = text.translate(divergence.FOLD).split()
    for most in (1, 7, 100, 10_000):
        assert [t for part in divergence.stretches(text, divergence.FOLD, most) for t in part] == want


@pytest.mark.parametrize("df_rows", [[], [(1, None, None, None)], [(1, "one", "en", "s")]])
def test_audit_of_little(spark, df_rows):
    df = spark.createDataFrame(df_rows, DOCS)
    assert divergence.audit(df).collect() == []


def brute_search(docs, items, k):
    tf = [(i, Counter(w.translate(LOW) for w in WORD12.findall(t or ""))) for i, t, *_ in docs]
    tf = [(i, c, sum(c.values())) for i, c in tf if c]
    n, total = len(tf), sum(x[2] for x in tf)
    df = Counter(w for _, c, _ in tf for w in c)
    out = []
    for item, text in set(items):
        terms = [w.translate(LOW) for w in WORD12.findall(text or "")]
        found = []
        for i, c, size in tf:
            m = 75 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in terms if c[w])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "block", "window"), [(1, 512, 1024), (2, 2, 3)])
def test_search_is_brute_force(spark, seed, block, window, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs = random_docs(seed, 80)
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(["the", "a", "bb", "É", "zz9", "日本", "x1y", "unheard", "q q q"], k=rng.randint(1, 12)))) for i in range(9)]
    items += [(9, None), (10, ""), (11, "unheard of"), (None, "bb zz9"), items[0], (1, "q the other text of item 1")]
    df = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit(1)).withColumn("term", F.lit("x")).withColumn("shard", F.lit("y"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("copy", F.lit(7))
    if window == 3:
        run = lexical.max_score
        monkeypatch.setattr(lexical, "max_score", lambda *a, **b: run(*a, **b))
    index = lexical.build_index(df.repartition(3), shard_docs=11, shard_postings=60)
    assert rows_of(lexical.search(index, asked, k=4), "item_id", "rank", "doc_id", "score") == brute_search(docs, items, 4)


def test_max_score_skips_postings_and_loses_nothing():
    rng = np.random.default_rng(4)
    n = 3000
    sizes = rng.integers(5, 60, n)
    m = 75 + 25 * sizes // 30
    lists, dense = [], np.zeros((n, 8), np.int64)
    edges = np.r_[np.arange(0, n, 100), n]
    for t, share in enumerate([0.9, 0.8, 0.5, 0.3, 0.1, 0.02, 0.01, 0.003]):
        at = np.nonzero(rng.random(n) < share)[0]
        tf = rng.geometric(0.6, len(at))
        w = int(1000 * math.log((2 * n + 2) / (2 * len(at) + 1)))
        top = lexical.frontier(np.zeros(len(at), np.int32), tf, sizes[at])
        lists.append(lexical.Postings(at, tf, w, tf[top], m[at[top]], edges))
        assert lists[-1].bound == (w * lexical.impact(tf, m[at])).max()
        dense[at, t] = w * lexical.impact(tf, m[at])
    stats = Counter()
    reps = np.array([1, 1, 2, 1, 1, 1, 1, 1])
    windows = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    docs, scores = lexical.max_score(lists, reps, m, np.arange(n), np.zeros(n, bool), 10, windows, stats)
    want = (dense * reps).sum(axis=1)
    order = np.lexsort((np.arange(n), -want))[:10]
    assert docs.tolist() == order.tolist() and scores.tolist() == want[order].tolist()
    assert stats["scored"] < 0.5 * stats["held"]


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build_index(docs), items).collect() == []
    full = lexical.build_index(spark.createDataFrame([(1, "a", "", "")], DOCS))
    assert lexical.search(full, items.limit(0)).collect() == []


def hashed(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return h - 2**64 if h >= 2**63 else h


def brute_sketch(text, k=128, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    sets = [w[i : i + width] for i in range(len(w) - width + 1)] if len(w) >= width else [[" ".join(w)]] if w else []
    return sorted({hashed(s) for s in sets})[:k]


def brute_near(a, b, k=128):
    if not a and not b:
        return 1.0
    u = sorted(set(a) | set(b))[:k]
    return len(set(u) & set(a) & set(b)) / len(u) if a and b else 0.0


@pytest.mark.parametrize("long", [200_000, 40])
def test_fingerprints_are_brute_force(spark, long, monkeypatch):
    monkeypatch.setattr(fingerprint, "LONG", long)
    monkeypatch.setattr(fingerprint, "PART", 6)
    rng = random.Random(9)
    docs = [(i * 7 - 90, " ".join(rng.choices(["a", "b", "日本", "é x", "c\td", "\n"], k=rng.randint(0, 120)))) for i in range(40)]
    docs += [(-(2**63), "x y z"), (2**63 - 1, "one two three four five six"), (1000, None), (1001, ""), (1002, "𝒳" * 5), (1003, "a b c d e " * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("sketch", F.lit(0)).withColumn("bucket", F.lit(0))
    got = {r.doc_id: r for r in fingerprint.edited_pairs(df.repartition(3)).collect()}
    order = sorted(docs, key=lambda r: -r[0])
    assert len(got) == len(docs)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = brute_sketch(t), brute_sketch(edited), brute_sketch(nxt)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{h % 2**64:016x}" for h in a) and r.edited_fingerprint == "".join(f"{h % 2**64:016x}" for h in b)
        assert r.near_edited == pytest.approx(brute_near(a, b)) and r.near_next == pytest.approx(brute_near(a, c))


def test_fingerprints_of_repeats_nulls_and_little(spark):
    make = lambda rows: fingerprint.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert make([]).collect() == []
    (one,) = make([(5, "a b c d")]).collect()
    assert one.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest() and one.near_next == 1.0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words"), (None, "null one"), (None, None), (None, "null two"), (2, "z")]
    got = make(rows).collect()
    assert len(got) == len(rows) and all(r.edited_sha256 for r in got)
    alike = [r for r in got if r.fingerprint == "".join(f"{h % 2**64:016x}" for h in brute_sketch("a b c d e f"))]
    # of two equal rows one is followed by the other
    assert len(alike) == 2 and sum(r.near_next == 1.0 for r in alike) == 1


def test_estimates_come_near_the_truth(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    df = fingerprint.with_sketch(spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string"))
    near, inside, number = [], [], []
    for r in fingerprint.edited_pairs(df.select("doc_id", "text")).collect():
        number.append(abs(r.n_shingles - len(sets[r.doc_id])) / max(1, len(sets[r.doc_id])))
    ids = sorted(sets, reverse=True)
    texts = {i: t or "" for i, t in docs}
    got = {r.doc_id: r for r in fingerprint.edited_pairs(df.select("doc_id", "text")).collect()}
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        t = texts[i]
        edited = t[: len(t) - len(t) // 2] + texts[j][: len(t) // 2]
        w = re.findall(r"[^\x20\x09-\x0D]+", edited)
        e = {tuple(w[x : x + 5]) for x in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        near.append(abs(got[i].near_edited - (len(sets[i] & e) / len(sets[i] | e) if sets[i] | e else 1)))
        inside.append(abs(got[i].in_edited - (len(sets[i] & e) / len(sets[i]) if sets[i] else 1)))
    assert np.mean(near) < 0.03 and max(near) < 0.2 and np.mean(inside) < 0.06 and np.mean(number) < 0.08
    whole = fingerprint.group_sketches(df.withColumn("g", F.lit(1)), ["g"]).first().sketch
    assert whole == sorted({h for i in texts for h in brute_sketch(texts[i], 10**9)})[:128]


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_lexical_search"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(str, cur.fetchall()))
