"""Named, versioned operators and the queries bound to the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Entry:
    name: str
    version: int
    group: str
    fn: Callable[..., DataFrame]
    oracle: str | None = None


@dataclass
class Registry:
    """Name -> entry; a lower version never replaces a higher one."""

    entries: dict[str, Entry] = field(default_factory=dict)

    def add(self, entry: Entry) -> None:
        old = self.entries.get(entry.name)
        if old is not None and entry.version < old.version:
            raise ValueError(f"{entry.name}: version {entry.version} is older than {old.version}")
        self.entries[entry.name] = entry

    def operator(self, name: str, version: int = 1, group: str = "", oracle: str | None = None):
        def wrap(fn):
            self.add(Entry(name, version, group, fn, oracle))
            return fn

        return wrap

    def get(self, name: str) -> Entry:
        return self.entries[name]

    def names(self, group: str | None = None) -> list[str]:
        return [n for n, e in self.entries.items() if group is None or e.group == group]


QUERIES = Registry()
