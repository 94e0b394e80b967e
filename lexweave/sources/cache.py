"""Tables that are kept for a while."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame


class TableCache:
    """Persisted tables by key: the least recently used goes beyond ``size``,
    and one older than ``seconds`` is loaded again."""

    def __init__(self, load: Callable[[Hashable], DataFrame], size: int = 32, seconds: float = 3600.0):
        self._load, self._size, self._seconds = load, size, seconds
        self._kept: OrderedDict[Hashable, tuple[float, DataFrame]] = OrderedDict()

    def get(self, key: Hashable) -> DataFrame:
        found = self._kept.pop(key, None)
        if found is not None and time.monotonic() - found[0] > self._seconds:
            found[1].unpersist()
            found = None
        if found is None:
            found = (time.monotonic(), self._load(key).persist())
        self._kept[key] = found
        while len(self._kept) > self._size:
            self._kept.popitem(last=False)[1][1].unpersist()
        return found[1]

    def clear(self) -> None:
        for _, frame in self._kept.values():
            frame.unpersist()
        self._kept.clear()
