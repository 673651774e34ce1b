"""A bounded memo for values that are costly to derive from short strings."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable
from itertools import filterfalse


def calm_collector() -> None:
    """Let the cycle collector look less often: workers hold large dicts of plain strings, which
    have no cycles and which each full collection would walk."""
    gc.set_threshold(100_000, 50, 100)


class Memo:
    """Two generations of at most ``room`` entries: what is used again survives, the rest goes.

    ``derive`` maps a list of missing keys to the list of their values.
    """

    def __init__(self, derive: Callable[[list], list], room: int):
        self.derive, self.room = derive, room
        self.young: dict = {}
        self.old: dict = {}

    def fill(self, keys: Iterable) -> dict:
        """A dict that holds at least ``keys``, valid until the next call."""
        if len(self.young) > self.room:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = set(filterfalse(young.__contains__, keys))
        if old:
            for key in old.keys() & missing if len(missing) > 64 else [k for k in missing if k in old]:
                young[key] = old[key]
                missing.discard(key)
        if missing:
            listed = list(missing)
            young.update(zip(listed, self.derive(listed)))
        return young
