"""A search for fewer sequences may go deep: its memory is that of the fillings taken."""

import tracemalloc

import numpy as np

from lodestar.llm import packing


def test_memory_of_a_deep_search():
    rng = np.random.default_rng(1)
    counts = {x + 1: int(n) for x, n in enumerate(rng.integers(1, 50, 4096))}
    assert sum(n for _, n in packing.best_fit(counts, 4096)) > packing.lower_bound(counts, 4096)
    tracemalloc.start()
    plan = packing.complete_bins(counts, 4096, 30_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # every level of the path held all lengths with their numbers: some 50 MB in this many steps
    assert peak < 20e6
    used: dict[int, int] = {}
    for own, times in plan:
        assert sum(x * n for x, n in own.items()) <= 4096
        for x, n in own.items():
            used[x] = used.get(x, 0) + n * times
    assert used == counts
