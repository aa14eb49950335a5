"""Cases that were wrong once: ids of odd characters, articles in wrappers."""

import random
import zlib

import numpy as np
import pytest

from lodestar.llm import html_text, packing, queries

from test_operators import table

PARAGRAPH = "This is a paragraph of an article, long enough to be one. " * 3
TEXT = [PARAGRAPH.strip()] * 4
ARTICLE = f"<h1>Title of it</h1>{f'<p>{PARAGRAPH}</p>' * 4}"
SIDE = '<div class="sidebar"><a href=x>Link</a><p>Subscribe to our newsletter to get the latest of the news every day of the week.</p></div>'
TALK = '<div class="comments">' + "<p>Nice post, I like it very much, thanks for it and for all the rest of it, it is good.</p>" * 30 + "</div>"


@pytest.mark.parametrize(
    "html",
    [
        f'<body><div class="site has-sidebar">{ARTICLE}{SIDE}</div><footer>© 2024 Firm, all rights reserved</footer>',
        f'<body><div class="sidebar layout">{ARTICLE}</div><footer>© 2024 Firm. Contact us at our office in the street, any day of the week you like.</footer>',
        f'<div class="post comments-open">{ARTICLE}{TALK}</div>',
        f'<div class="post">{ARTICLE}</div>{TALK}',
        f'<div class="comments-area">{ARTICLE}{TALK}</div>',
        f'<body><form action="/x"><div id=top><a href=/>Home</a></div>{ARTICLE}<input type=text></form></body>',
        '<article><div class="elementor-widget elementor-heading"><h1>Title of it</h1></div>' + f'<div class="elementor-widget elementor-text"><p>{PARAGRAPH}</p></div>' * 4 + "</article>",
        f'<article><h1>Title of it</h1><div class="elementor-widget">{f"<p>{PARAGRAPH}</p>" * 4}</div></article>',
        f"<ul><li>Home</li><li>Products</li><li>About us</li><li>Contact</li></ul>{ARTICLE}<p>Copyright 2024 The Firm Inc. All rights reserved.</p>",
        f'<article>{ARTICLE}</article><div class="widget"><p>{PARAGRAPH}</p></div>',
    ],
)
def test_wrappers_keep_their_article(html):
    assert html_text.main_text(html).split("\n\n") == ["Title of it", *TEXT]


def test_marks_hold_where_the_page_has_text_of_its_own():
    assert html_text.main_text("<article><p>Some text <span class='social'>share this</span> goes on here in the line.</p></article>") == "Some text goes on here in the line."
    assert html_text.main_text("<body><footer>© 2024 Firm. Contact us at our office in the street, any day of the week you like to come</footer>") == ""
    items = f"{ARTICLE}<ul><li>a dozen eggs</li><li>milk, a quart</li><li>flour, two pounds</li></ul><p>{PARAGRAPH}</p>"
    assert html_text.main_text(items).split("\n\n") == ["Title of it", *TEXT, "a dozen eggs", "milk, a quart", "flour, two pounds", TEXT[0]]
    # an advert that isn't closed ends with the next block
    assert html_text.main_text(f"<p class=ad>Buy this now.{ARTICLE}").split("\n\n") == ["Title of it", *TEXT]


def test_encoder_knows_every_character_below_u0300():
    enc = packing.Encoder(queries.tokenizer_file())
    want = lambda t: np.array(enc.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    signs = [chr(c) for c in range(0x300)]
    cases = [f(c) for c in signs for f in (str, lambda c: f".{c}", lambda c: f"{c}%", lambda c: f"a{c}b", lambda c: f"1{c} {c}{c}", lambda c: f"x {c} y")]
    rng = random.Random(8)
    cases += ["".join(rng.choices(signs, k=rng.randint(1, 12))) for _ in range(20_000)]
    cases += ["".join(rng.choices(signs[:0x250], k=rng.randint(1, 30))) for _ in range(20_000)] + ["a word\x01 and\x7f more", ".Ɔ", "%Ɛ", "K", "K k"]
    got = enc.encode(cases)
    assert [c for c, g in zip(cases, got, strict=True) if g != want(c)] == []


def test_ids_of_odd_characters_through_spark(spark):
    enc = packing.Encoder(queries.tokenizer_file())
    texts = ["a word\x01 and\x7f more", ".Ɔ %Ɛ", "\x00\x08\x0e", "Ɛ̃ɔ", None]
    got = {r.doc_id: r for r in packing.pack_documents(table(spark, [(k, t, "en") for k, t in enumerate(texts)]), queries.tokenizer_file()).collect()}
    for k, t in enumerate(texts):
        ids = np.array([*enc.tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[k].length, got[k].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_bound_counts_pieces_by_length():
    assert packing.lower_bound({3: 5_700_000}, 4096) == -(-5_700_000 // (4096 // 3))
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.randint(5, 30)
        counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(4)}
        assert packing.lower_bound(counts, capacity) <= sum(n for _, n in packing.best_fit(counts, capacity))
