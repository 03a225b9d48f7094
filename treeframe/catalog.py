"""Named documents and frames: attach, unload, free."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


@dataclass
class Segment:
    """What is kept under a name, and whether its frames are cached."""

    name: str
    value: Any = None
    loaded: bool = False

    def frames(self) -> list[DataFrame]:
        if isinstance(self.value, DataFrame):
            return [self.value]
        return list(getattr(self.value, "tables", {}).values())


class Catalog:
    """One registry of segments, with a current one."""

    def __init__(self) -> None:
        self._segments: dict[str, Segment] = {}
        self.current: Segment | None = None

    def create_or_get(self, name: str) -> Segment:
        self.current = self._segments.setdefault(name, Segment(name))
        return self.current

    def attach(self, name: str, load: Callable[[], Any], force_reload: bool = False) -> Any:
        """What is loaded under the name; otherwise what `load` makes."""
        segment = self.create_or_get(name)
        if segment.loaded and not force_reload:
            return segment.value
        if segment.loaded:
            self.unload(name)
        segment.value = load()
        segment.loaded = True
        return segment.value

    def cache(self, name: str) -> None:
        for df in self._segments[name].frames():
            df.cache()

    def exists(self, name: str) -> bool:
        return name in self._segments

    def is_loaded(self, name: str) -> bool:
        return self.exists(name) and self._segments[name].loaded

    def size(self, name: str) -> int:
        """Bytes that Spark expects of the frames."""
        return sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in self._segments[name].frames())

    def unload(self, name: str) -> None:
        """Drops what is cached and keeps the name; a warning if nothing is loaded."""
        if not self.is_loaded(name):
            log.warning("%s isn't loaded", name)
            return
        for df in self._segments[name].frames():
            df.unpersist()
        self._segments[name].loaded = False

    def free(self, name: str) -> None:
        """Forgets the name."""
        if self.is_loaded(name):
            self.unload(name)
        segment = self._segments.pop(name, None)
        if segment is None:
            log.warning("%s doesn't exist", name)
        if self.current is segment:
            self.current = None

    def names(self) -> list[str]:
        return sorted(self._segments)

    def clear(self) -> None:
        for name in self.names():
            self.free(name)


#: the registry of the process
CATALOG = Catalog()
