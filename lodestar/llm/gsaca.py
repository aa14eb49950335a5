"""Linear grouping suffix sort of many short texts at once.

Phase 1 puts each suffix into the group of its longest Lyndon prefix: the groups are processed
in descending order; each suffix of a group looks up its previous smaller suffix (the nearest
earlier one in a lower group, along the pointers of what is done), and the suffixes so
pointed at move up to a new group right behind their old one, by how often they were pointed
at. Phase 2 goes through the groups in ascending order and emits each group's order: a suffix
is its Lyndon prefix and then its next smaller suffix, which stands in a lower group and is in
order already. Nothing is renamed and nothing recurs.

All texts of a batch advance together, one group of each text a step, so that the work is in
array operations.
"""

from __future__ import annotations

import numpy as np

from .common import ranges


def suffix_arrays(sym: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix arrays of concatenated texts: text t is sym[start[t]:start[t + 1]], and its last
    symbol must be less than all its others. Returns (sa, rank) over global positions; sa holds
    the suffixes of text t at start[t]:start[t + 1]."""
    n, texts = len(sym), len(start) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(texts), np.diff(start))
    key = text * (int(sym.max()) + 1) + sym
    sa = np.argsort(key, kind="stable")
    pos = np.empty(n, np.int64)
    pos[sa] = np.arange(n)
    new = np.r_[True, key[sa][1:] != key[sa][:-1]]
    first = np.nonzero(new)[0]
    group = np.empty(n, np.int64)  # of each suffix: where its group starts in sa
    group[sa] = first[np.cumsum(new) - 1]
    size = np.zeros(n, np.int64)
    size[first] = np.diff(np.r_[first, n])
    length = np.ones(n, np.int64)  # of each suffix: its group's Lyndon prefix so far
    prev = np.full(n, -1, np.int64)
    begin = start[:-1][text]
    marked = np.zeros(n, bool)

    live = np.arange(texts)[np.diff(start) > 0]
    top = group[sa[start[live + 1] - 1]]
    while len(live):
        count = size[top]
        i = sa[ranges(top, count)]
        here = np.repeat(top, count)
        p = i - 1
        todo = np.nonzero(p >= begin[i])[0]
        todo = todo[group[p[todo]] >= here[todo]]
        while len(todo):
            q = p[todo]
            q = np.where(group[q] > here[todo], prev[q], q - 1)
            p[todo] = q
            ok = q >= begin[i[todo]]
            ok[ok] = group[q[ok]] >= here[todo][ok]
            todo = todo[ok]
        p = np.where(p >= begin[i], p, -1)
        prev[i] = p
        hit = p >= 0
        if hit.any():
            order = np.argsort(p[hit], kind="stable")
            target, by = p[hit][order], i[hit][order]
            head = np.nonzero(np.r_[True, target[1:] != target[:-1]])[0]
            times = np.diff(np.r_[head, len(target)])
            target, span = target[head], length[by[head]]
            order = np.lexsort((times, group[target]))
            target, times, span = target[order], times[order], span[order]
            old = group[target]
            cut = np.nonzero(np.r_[True, old[1:] != old[:-1]])[0]
            k = np.diff(np.r_[cut, len(old)])
            g = old[cut]
            tail = g + size[g] - k
            marked[target] = True
            slots = ranges(tail, k)
            stay = sa[slots][~marked[sa[slots]]]
            at = pos[target]
            holes = at[at < np.repeat(tail, k)]
            sa[holes], pos[stay] = stay, holes
            sa[slots], pos[target] = target, slots
            marked[target] = False
            run = np.nonzero(np.r_[True, (old[1:] != old[:-1]) | (times[1:] != times[:-1])])[0]
            runs = np.diff(np.r_[run, len(old)])
            size[g] -= k
            size[slots[run]] = runs
            group[target] = np.repeat(slots[run], runs)
            length[target] += times * span
        more = top > start[live]
        live, top = live[more], top[more]
        top = group[sa[top - 1]]

    # phase 2: repeats of a group's own prefix count first, then the lower suffix behind them
    after = np.minimum(np.arange(n) + length, n - 1)
    same = (np.arange(n) + length < start[1:][text]) & (group[after] == group)
    reps, jump = same.astype(np.int64), np.where(same, after, np.arange(n))
    while True:
        add = reps[jump]
        if not add.any():
            break
        reps, jump = reps + add, jump[jump]
    base = jump + length[jump]
    rank = group.copy()
    heads = np.nonzero((size > 1) & (group[sa] == np.arange(n)))[0]
    if len(heads):
        owner = text[sa[heads]]
        first_of = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0]
        nth = np.arange(len(heads)) - np.repeat(first_of, np.diff(np.r_[first_of, len(owner)]))
        order = np.argsort(nth, kind="stable")
        for part in np.split(heads[order], np.cumsum(np.bincount(nth))[:-1]):
            slots = ranges(part, size[part])
            i = sa[slots]
            i = i[np.lexsort((rank[np.minimum(base[i], n - 1)], reps[i], np.repeat(part, size[part])))]
            sa[slots], rank[i] = i, slots
    return sa, rank
