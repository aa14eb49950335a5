"""What packing costs: distinct pre-tokens are encoded once, and the bound is met without a search where it can be."""

import random
import sys

import numpy as np
import pyarrow as pa

from lodestar.llm import packing, queries


def test_python_steps_do_not_grow_with_repeated_words():
    enc = packing.Encoder(queries.tokenizer_file())
    texts = ["extraordinary, words%%% it's 42 "] * 50
    enc.encode(texts)
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event == "call"

    sys.setprofile(count)
    try:
        got = enc.encode(texts * 40)
    finally:
        sys.setprofile(None)
    # a word with a sign after it took a call each time that it came
    assert calls[0] < 4 * len(got)
    assert got == [enc._whole(texts[0])] * 2000


def test_texts_that_meet_in_one_stretch():
    enc = packing.Encoder(queries.tokenizer_file())
    texts = ["it'", "s", "", "a'", "re", "'", "", "'", "ll", "x'l", "l", "1", "²3", "a", "b.", ".c", "don't.", "''s", "a'vex 'tis", "漢 it's", "<|endoftext|> a", "İx", "K", "Ⱥ", "é'll", "'", ""]
    want = [enc._whole(t) for t in texts]
    assert enc.encode(texts) == want
    rng = random.Random(5)
    for _ in range(40):
        order = rng.sample(range(len(texts)), len(texts))
        assert enc.encode([texts[k] for k in order]) == [want[k] for k in order]
    flat, ends = enc.ids(pa.array(["no", None, "word's"]).fill_null("").slice(1, 2))
    assert ends.tolist() == [0, 0, len(flat)] and flat.tobytes() == enc._whole("word's")


def test_long_texts_go_by_stretches(monkeypatch):
    enc = packing.Encoder(queries.tokenizer_file())
    monkeypatch.setattr(packing, "STRETCH", 50)
    rng = random.Random(6)
    for _ in range(60):
        text = "".join(rng.choice(["a", "bé", " ", "\n", "'s", "12", "...", "漢", "word "]) for _ in range(rng.randint(80, 400)))
        assert enc.encode([text]) == [enc._whole(text)]
    assert enc.encode(["x" * 500 + " y"]) == [enc._whole("x" * 500 + " y")]


def test_few_tokens_to_spare():
    for seed in (1, 3):
        rng = np.random.default_rng(seed)
        lengths = np.r_[rng.integers(2049, 4096, 20_000), rng.integers(5, 2048, 20_000), rng.integers(5, 300, 4000)]
        counts = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        plan = packing.complete_bins(counts, 4096, 1)
        used: dict[int, int] = {}
        for own, times in plan:
            assert sum(x * n for x, n in own.items()) <= 4096
            for x, n in own.items():
                used[x] = used.get(x, 0) + n * times
        assert used == counts
        bound = packing.lower_bound(counts, 4096)
        # best fit alone is above it, and the search spent all its steps there
        assert sum(n for _, n in packing.best_fit(counts, 4096)) > bound == sum(n for _, n in plan)
