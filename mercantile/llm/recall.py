"""A bounded memory of results by key, for what occurs again and again in a corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Recent(dict):
    """Looks a key up, or computes and keeps it. Holds at most ``2 * half`` keys: when the younger half is full it becomes
    the older one, and keys of that are taken over when they are met again."""

    def __init__(self, compute: Callable, half: int):
        super().__init__()
        self.compute, self.half, self.older = compute, half, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def fill(self, keys: Iterable, compute_all: Callable) -> None:
        """Make all ``keys`` known; what is not, is computed together."""
        absent = []
        for key in keys:
            if key not in self:
                value = self.older.get(key)
                if value is None:
                    absent.append(key)
                else:
                    self[key] = value
        self.update(zip(absent, compute_all(absent), strict=True))

    def trim(self) -> None:
        """To be called between texts."""
        if len(self) > self.half:
            self.older = dict(self)
            self.clear()
