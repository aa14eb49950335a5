"""A bounded cache of evaluations that can be saved, merged and replaced."""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict

from .registry import Registry


class EvaluationCache:
    """Results by formula text and the functions it was read with; the oldest go first."""

    def __init__(self, most: int = 5000):
        self.most, self.hits, self.misses = most, 0, 0
        self.held: OrderedDict[str, dict] = OrderedDict()

    @staticmethod
    def key(text: str, functions: Registry) -> str:
        state = json.dumps(functions.functions, sort_keys=True)
        return f"{hashlib.sha256(state.encode()).hexdigest()[:16]}:{text}"

    def get(self, text: str, functions: Registry) -> dict | None:
        k = self.key(text, functions)
        if k in self.held:
            self.hits += 1
            self.held.move_to_end(k)
            return self.held[k]
        self.misses += 1
        return None

    def put(self, text: str, functions: Registry, result: dict) -> None:
        self.held[self.key(text, functions)] = result
        while len(self.held) > self.most:
            self.held.popitem(last=False)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.held, f)

    def load(self, path: str, replace: bool = False) -> int:
        """Merges a saved cache (its entries win), or takes its place; the number of entries read."""
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
        if replace:
            self.held.clear()
        for k, v in got.items():
            self.held[k] = v
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return len(got)

    def clear(self) -> None:
        self.held.clear()
        self.hits = self.misses = 0
