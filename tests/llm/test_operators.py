"""The ten operators against brute force, and on nulls, empties, long texts, ties, repeats, empty tables and odd columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, html_text, jaccard, langid, license_scan, packing, pii, queries, recompress, substring, topk
from lodestar.llm.common import bucket_of, even_keys, pack, unpack
from lodestar.llm.gsaca import suffix_arrays

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, tag string, pii string, sig int"


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    full = [(i, t, lang, "s", len(t or ""), 1, "x", "y", 2) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 120))) for _ in range(n)]
    rows = []
    for i in range(n * 3):
        t = rng.choice(base)
        kind = rng.random()
        if kind < 0.3:
            w = t.split()
            w[rng.randrange(len(w))] = "edited"
            t = " ".join(w)
        elif kind < 0.5:
            a, b = rng.choice(base), rng.choice(base)
            t = a[: len(a) // 2] + " " + b[len(b) // 3 :]
        elif kind < 0.6:
            t = "same line here again and again " * rng.randint(1, 12)
        rows.append((i, t, "en"))
    rows += [(1000, None, None), (1001, "", "en"), (1002, " \n\t ", "en"), (1003, "é𝒳 short", "fr"), (1004, "a" * 5000, "en"), (1005, "ab " * 3000, "en"), (None, base[0], "en"), (7, base[1], "en"), (5, rows[5][1], "en")]
    return rows


def brute_substrings(rows, k=50):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            b = (t or "").encode()
            for p in range(len(b) - k + 1):
                w = b[p : p + k]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - k + 1):
                if first[b[p : p + k]] < i:
                    gone[p : p + k] = b"\1" * k
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_passages(rows, k=20):
    at = {}
    for i, t, _ in rows:
        if i is not None:
            w = (t or "").encode().split()
            for p in range(len(w) - k + 1):
                at.setdefault(tuple(w[p : p + k]), []).append((i, t, p))
    out = []
    for i, t, _ in rows:
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        if i is not None:
            for p in range(len(w) - k + 1):
                if any(j < i or (j == i and u == t and q < p) for j, u, q in at[tuple(w[p : p + k])][:200]):
                    gone[p : p + k] = b"\1" * k
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


key = lambda r: tuple((x is None, x) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_packing_of_columns():
    assert unpack("var", pack("var", np.array([0, 255, 256, 2**40], np.uint64))).tolist() == [0, 255, 256, 2**40]
    assert unpack("doc", pack("doc", np.array([-5, 3, 2**40]))).tolist() == [-5, 3, 2**40]


def test_even_keys_and_buckets(spark):
    keys = even_keys(13)
    got = spark.createDataFrame([(k,) for k in keys], "k int").select(F.pmod(F.hash("k"), F.lit(13)).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(13))
    ids = np.array([0, 1, -7, 2**40, 99], np.int64)
    want = spark.createDataFrame([(int(i),) for i in ids], "k long").select(F.pmod(F.hash("k"), F.lit(13)).alias("p")).collect()
    assert bucket_of(ids, 13).tolist() == [r.p for r in want]


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(100):
        texts = [np.r_[rng.integers(1, 1 + rng.integers(1, 5), rng.integers(0, 40)), 0] for _ in range(rng.integers(1, 9))]
        start = np.r_[0, np.cumsum([len(t) for t in texts])]
        sa, _ = suffix_arrays(np.concatenate(texts), start)
        for k, x in enumerate(texts):
            assert (sa[start[k] : start[k + 1]] - start[k]).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def test_substrings(spark):
    rows = corpus()
    out = substring.dedup_substrings(table(spark, rows).repartition(5))
    same(out.drop("kept").collect(), brute_substrings(rows))


@pytest.mark.parametrize("most", [64, 2])
def test_shared_windows_in_small_and_large_blocks(most):
    rng = np.random.default_rng(2)
    n, length = 40, 50
    side = length - substring.SEED
    ctx = np.tile(rng.integers(97, 101, side + length).astype(np.uint8), (n, 1))
    for r in range(n):
        ctx[r, rng.integers(0, side, 2)] = 120
        ctx[r, rng.integers(length, side + length, 2)] = 121
    doc, full = rng.integers(0, 15, n), np.full(n, side)
    got = substring.shared_windows(ctx, np.zeros(n, np.uint64), doc, full, full, length, 7, most)
    for r in range(n):
        for c in range(side + 1):
            w = ctx[r, side - c : side - c + length].tobytes()
            assert got[r, c] == any(doc[q] < doc[r] and ctx[q, side - c : side - c + length].tobytes() == w for q in range(n))


def test_passages(spark):
    rows = corpus(3)
    same(recompress.dedup_passages(table(spark, rows).repartition(5)).drop("kept").collect(), brute_passages(rows))


def test_recompression_names_equal_interiors_alike():
    rng = np.random.default_rng(4)
    core = rng.integers(0, 9, 60).astype(np.uint64)
    a = np.r_[rng.integers(0, 9, 13).astype(np.uint64), core, rng.integers(0, 9, 5).astype(np.uint64)]
    b = np.r_[rng.integers(0, 9, 31).astype(np.uint64), core, rng.integers(0, 9, 9).astype(np.uint64)]
    inside = []
    for x, at in ((a, 13), (b, 31)):
        name, lo, hi = recompress.recompress(x, np.array([0, len(x)]), 2)[-1]
        inside.append({(n, s - at, e - at) for n, s, e in zip(name.tolist(), lo.tolist(), hi.tolist(), strict=True) if s >= at and e <= at + 60})
    assert inside[0] == inside[1] and inside[0]


@pytest.mark.parametrize("tile", [1024, 3, 1])
def test_near_duplicates(spark, tile):
    rows = corpus(5)
    got = {(r.doc_id): (r.class_id, r.n_links, r.group_id) for r in jaccard.near_duplicates(table(spark, [r for r in rows if r[0] != 7 or rows.index(r) == 7]).repartition(4), tile=tile).collect() if r.doc_id is not None}
    own = {}
    for k, (i, t, _) in enumerate(rows):
        if i is not None and (i != 7 or k == 7):
            w = (t or "").encode().split()
            own[i] = frozenset(tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))) if w else frozenset()
    cls = {}
    for i in sorted(own):
        if own[i]:
            cls.setdefault(own[i], i)
    links = {i: {j for t, j in cls.items() if j != i and 5 * len(s & t) >= 4 * len(s | t)} for s, i in cls.items()}
    root = {i: i for i in links}
    for _ in range(len(root)):
        for i, js in links.items():
            for j in js:
                root[i] = root[j] = min(root[i], root[j])
    for i, s in own.items():
        assert got[i] == ((cls[s], len(links[cls[s]]), root[cls[s]]) if s else (i, 0, i))


def test_bayes_bound_keeps_true_pairs():
    steps = list(range(16, 129, 16))
    need = jaccard.least_matches(0.8, 1e-9, steps)
    rng = np.random.default_rng(0)
    for k, m in zip(steps, need, strict=True):
        assert (rng.binomial(k, 0.8, 20_000) < m).mean() < 1e-3
        assert m >= 0 and (k < 64 or m > 0.3 * k)


def test_top_k(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[::7] = x[0]
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (950, [1.0, float("nan")] * 4), (1000, [1.0, None] * 4), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df.repartition(3), df.filter("vec_id % 50 = 0"), group=1).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    y = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    assert sorted(got) == list(range(0, 400, 50))
    for q in got:
        s = y @ y[q]
        order = [j for j in np.lexsort((np.arange(400), -s)) if j != q][:5]
        assert sorted(got[q]) == [(k + 1, int(s[j]), int(j)) for k, j in enumerate(order)]


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(spark):
    rng = random.Random(9)
    odd = ["", None, "a@b.c+d@e.f x@y z@@q.r", "1.2.3.4.5.6.7.8 0255.1.1.01 256.1.1.1 99999999999.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (234) 555-1234..., +1  +12 ++49 30 1234567-", "a." * 20_000 + "@" + "b." * 20_000, "1 " * 20_000, "+1" + " " * 30_000, "é𝒳 a@b.co 😀 c@d.eu"]
    odd += ["".join(rng.choice("ab1 2.@+-()3é") for _ in range(80)) for _ in range(150)]
    rows = [(i, t, "en") for i, t in enumerate(odd)]
    for r in pii.pii_digest(table(spark, rows)).collect():
        want = base_spans(odd[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert (r.n_email, r.n_card) == (want.count("email:"), want.count("card:"))
    t = "IBAN DE89 3704 0044 0532 0130 00, é𝒳 me@x.org, SSN 123-45-6789, other 123-45-6789"
    out = pii.redact(table(spark, [(1, t, "en"), (2, None, "en")])).orderBy("doc_id").collect()
    assert out[0].text.startswith("IBAN <iban>, é𝒳 <email>, SSN <ssn>") and out[1].text is None and out[0].pii == "y"


def test_language(spark):
    a, b = "the quick brown fox jumps over lazy dogs and runs".split(), "der schnelle braune fuchs springt über faule hunde".split()
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(a if i % 2 else b, k=40)), "en" if i % 2 else "de") for i in range(200)]
    model = langid.fit_profiles(table(spark, rows[:100]))
    out = langid.identify(table(spark, [*rows[100:], (900, None, None), (901, "123 !?", None), (902, "", None)]), model)
    for r in out.collect():
        assert 0 <= r.score <= 1
        assert r.lang_pred == ("und" if r.doc_id >= 900 else "en" if r.doc_id % 2 else "de")
    assert {r.lang_pred for r in langid.identify(table(spark, rows), langid.fit_profiles(table(spark, []))).collect()} == {"und"}


def test_html(spark):
    page = "<body><nav><a>Home</a></nav><article><h1>T &amp; U</h1><p>One<br>two <b>th</b>ree<p>four<div class='ad'>Buy</div><aside>x</aside></article><footer>f</footer><script>var t='</p>';</script>"
    loose = "<div class=menu><a>a</a><a>b</a></div><p>" + "A long enough line of text to be the main one of this page, it is. " * 2 + "</p><div class=comments>me too</div>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, None, loose), (5, "u", "<p>" + "w " * 100_000), (6, "u", "<<< <p <!-- never closed")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "T & U\n\nOne two three\n\nfour"
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0
    assert "menu" not in got[4].text and got[4].text.startswith("A long") and "me too" not in got[4].text
    assert got[5].n_chars == 199_999 and 6 in got


def test_html_distribution():
    long = "A long enough line of text to be the main one of this page, it is. "
    card = f"<article><p>A teaser card.</article><div><p>{long * 3}<p><a href=x>A linked line</a><p>short<p>{long * 2}</div>"
    assert html_text.main_text(card).split("\n\n") == ["A teaser card.", (long * 3).strip(), "A linked line", "short", (long * 2).strip()]
    # far from the largest region, and less than a quarter of it
    gap = "<p><a href=x>go</a>" * 6
    got = html_text.main_text(f"<p>{long * 9}{gap}<p>{long * 2}{gap}<p>tiny").split("\n\n")
    assert (long * 9).strip() in got and (long * 2).strip() in got
    # text that is not dense enough ends the region
    assert html_text.main_text(f"<p>{long * 9}{gap}<p>a<p>b<p>c") == (long * 9).strip()


def test_leaks(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(20)] + [(50, None), (51, "two words"), (None, "a b c d e"), (52, "")]
    docs = [(i, " ".join(rng.choices(words, k=200)), "en") for i in range(60)]
    for i in range(20):
        w = items[i][1].split()
        w = [x if rng.random() > 0.15 else "zzz" for x in w]
        docs.append((100 + i, docs[i][1] + " " + (" ".join(w)).upper() + ", " + docs[i + 1][1], "en"))
    docs += [(900, None, None), (901, "", None), (100, docs[60][1], "en")]
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block=7).collect()}
    assert set(got) == {(100 + i, i) for i in range(20)}
    assert all(0.5 <= s <= 1 for s in got.values())


def test_common_passages_still_leak(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(i, f"w{i} {item} v{i}" if i % 2 else f"only w{i} here", "en") for i in range(300)]
    got = decontaminate.find_leaks(table(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == {i for i in range(300) if i % 2}


@pytest.mark.parametrize("copies", [17, 100, 1000])
@pytest.mark.parametrize("score", [0.85, 0.6])
def test_edited_copies_that_come_often(spark, copies, score):
    words = [f"w{k}x" for k in range(30)]
    copy = " ".join("zzz" if k in (7, 15, 23) else w for k, w in enumerate(words)) if score > 0.6 else " ".join(words[:18])
    rows = [(i, f"a{i} {copy} b{i}", "en") for i in range(copies)] + [(9000 + i, f"{' '.join(words[:4])} c{i}", "en") for i in range(copies)]
    got = {r.doc_id: r.score for r in decontaminate.find_leaks(table(spark, rows), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()}
    assert got == {i: pytest.approx(score) for i in range(copies)}


def test_shared_words_bound_the_score():
    rng = np.random.default_rng(5)
    for _ in range(30):
        texts = [" ".join(f"w{k}" for k in rng.integers(0, 8, rng.integers(3, 12))) for _ in range(4)]
        items = decontaminate.Items(list(range(4)), texts, 3)
        passages = [np.array([items.words[rng.integers(0, len(items.words))] if rng.random() < 0.8 else len(items.vocabulary) for _ in range(rng.integers(1, 30))]) for _ in range(20)]
        hi = np.cumsum([len(p) for p in passages])
        of = rng.integers(0, 4, 20)
        most = items.shared(of, hi - np.array([len(p) for p in passages]), hi, np.concatenate(passages))
        for k, p in enumerate(passages):
            own = items.words[items.off[of[k]] : items.off[of[k] + 1]]
            best, _ = decontaminate.align(own, [p])
            assert best[0] <= decontaminate.MATCH * most[k]
            assert most[k] == sum((Counter(own.tolist()) & Counter(p.tolist())).values())


def test_align():
    item = np.arange(10)
    best, _ = decontaminate.align(item, [np.arange(10), np.r_[99, np.arange(4), 77, np.arange(5, 10)], np.arange(50, 60), np.r_[np.arange(5), 88, np.arange(5, 10)]])
    assert best.tolist() == [20, 17, 0, 19]


def test_licences(spark):
    rows = [(1, "x\nReleased under the MIT License.\ny", "en"), (2, "Licensed under the Apache License, Version 2.0.", "en"), (3, "plain prose without it", "en"), (4, None, None), (5, "", None), (6, "the " * 300 + "licensed under the apache license version 2 0 " + "of " * 300, "en"), (7, "MIT is a university", "en"), (8, "Released under the Foo Bar License.", "en"), (9, "Licensed under CC BY-NC 4.0.", "en")]
    docs = table(spark, rows)
    got = {r.doc_id: r.licences for r in license_scan.scan(docs, license_scan.train(docs)).collect()}
    assert got == {1: "MIT", 2: "Apache-2.0", 3: "", 4: "", 5: "", 6: "Apache-2.0", 7: "", 8: "unknown", 9: "CC-BY-NC"}
    model = license_scan.Classifier([t for _, t, _ in corpus()[:50]])
    assert model.accuracy > 0.9


def test_wrapped_licences(spark):
    mit, isc, bsd = license_scan.TEMPLATES["MIT"][4], license_scan.TEMPLATES["ISC"][1], "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    wrap = lambda t, n: "\n".join(" ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    line = "Redistribution and use in source and binary forms, with or without"
    texts = [f"Some tool\n\n{wrap(mit, 11)}\n\nmain", wrap(isc, 5), wrap(bsd, 4), line, " ".join(mit.split()[:12]), "plain words of prose\nthat go on\nand on to the end"]
    docs = table(spark, [(k, t, "en") for k, t in enumerate(texts)])
    got = {r.doc_id: r for r in license_scan.scan(docs, license_scan.Classifier([t for _, t, _ in corpus()[:50]])).collect()}
    assert got[0].licences == "MIT" and "ISC" in got[1].licences and got[2].licences.startswith("BSD") and got[3].licences.startswith("BSD") and got[4].licences == "MIT" and got[5].licences == ""
    assert got[0].n_paragraphs == 1


def test_encoder_equals_the_library():
    e = packing.Encoder(queries.tokenizer_file())
    rng = random.Random(8)
    texts = ["it's a DOG'S don't 12345 a_b... ÀÉ é́ x", "<|endoftext|> hi", "a\x1cb", "", "  ", "Σας ΟΔΟΣ ǅ ſ K", "x''s 'S a''b 'll'"] + ["".join(rng.choice("abzAZé' .!&12\n\t漢") for _ in range(60)) for _ in range(300)]
    for t, got in zip(texts, e.encode(texts), strict=True):
        assert got == e._whole(t), t


def test_bins():
    rng = random.Random(3)
    for trial in range(30):
        counts = {}
        for _ in range(rng.randint(1, 200)):
            n = rng.randint(1, 100)
            counts[n] = counts.get(n, 0) + rng.randint(1, 4)
        plan = packing.complete_bins(counts, 100)
        used = {}
        for own, times in plan:
            assert sum(k * v for k, v in own.items()) <= 100
            for k, v in own.items():
                used[k] = used.get(k, 0) + v * times
        assert used == counts
        n = sum(t for _, t in plan)
        assert packing.lower_bound(counts, 100) <= n <= sum(t for _, t in packing.best_fit(counts, 100))
    # best fit takes three sequences here, the completion of the largest finds two
    hard = {6: 1, 4: 1, 3: 2, 2: 2}
    assert sum(t for _, t in packing.complete_bins(hard, 10)) == 2
    assert packing.complete_bins({}, 10) == []


def fewest_bins(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, free):
        if len(free) >= best[0]:
            return
        if k == len(items):
            best[0] = len(free)
            return
        for r in set(free):
            if r >= items[k]:
                rest = list(free)
                rest.remove(r)
                go(k + 1, [*rest, r - items[k]])
        go(k + 1, [*free, capacity - items[k]])

    go(0, [])
    return best[0]


def test_bins_are_the_fewest():
    rng = random.Random(11)
    for trial in range(150):
        items = [rng.randint(1, 30) for _ in range(rng.randint(1, 11))]
        counts = {x: items.count(x) for x in items}
        plan = packing.complete_bins(counts, 40)
        used = {}
        for own, times in plan:
            assert sum(k * v for k, v in own.items()) <= 40
            for k, v in own.items():
                used[k] = used.get(k, 0) + v * times
        assert used == counts and sum(t for _, t in plan) == fewest_bins(items, 40)
        assert packing.lower_bound(counts, 40) <= fewest_bins(items, 40)
    # three greedy completions found four
    assert sum(t for _, t in packing.complete_bins({36: 1, 17: 1, 46: 1, 47: 1, 41: 1, 39: 1, 19: 1, 52: 1}, 100)) == 3


def test_pack_documents(spark):
    docs = table(spark, [*corpus(9), (2000, "word " * 9000, "en")])
    out = packing.pack_documents(docs.repartition(3), queries.tokenizer_file(), 512).collect()
    by_seq = {}
    for r in out:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_seq.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 512
    counts = {}
    for r in out:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert len(by_seq) == sum(t for _, t in packing.complete_bins(counts, 512))
    assert len({r.piece for r in out if r.doc_id == 2000}) == -(-9001 // 512)
    assert [r.length for r in out if r.doc_id == 1000] == [1]


def test_empty_tables(spark):
    none = table(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (substring.dedup_substrings(none), recompress.dedup_passages(none), jaccard.near_duplicates(none), pii.pii_digest(none), packing.pack_documents(none, queries.tokenizer_file()), decontaminate.find_leaks(none, bench), license_scan.scan(none, license_scan.Classifier([])), html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")), topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), spark.createDataFrame([], "vec_id long, embedding array<float>"))):
        assert df.count() == 0
