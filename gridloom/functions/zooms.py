"""Zoom levels."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ZoomLevels:
    """A set of zoom levels; made from one, a list, bounds or a mapping with min and max."""

    levels: tuple[int, ...]

    @classmethod
    def of(cls, value) -> ZoomLevels:
        if isinstance(value, ZoomLevels):
            return value
        if isinstance(value, dict):
            if set(value) != {"min", "max"}:
                raise ValueError("zoom levels need min and max")
            low, high = value["min"], value["max"]
            if not all(isinstance(v, int) for v in (low, high)) or low > high:
                raise ValueError("min must not exceed max")
            value = [low, high]
        if isinstance(value, bool) or not isinstance(value, (int, Iterable)) or isinstance(value, str):
            raise ValueError(f"not zoom levels: {value!r}")
        value = [value] if isinstance(value, int) else list(value)
        if not value or any(isinstance(v, bool) or not isinstance(v, int) or v < 0 for v in value):
            raise ValueError(f"not zoom levels: {value!r}")
        # Two numbers are the ends of a range; more must be the range itself.
        low, high = min(value), max(value)
        if len(value) > 2 and sorted(value) != list(range(low, high + 1)):
            raise ValueError(f"zoom levels must not have gaps: {value}")
        return cls(tuple(range(low, high + 1)))

    def __iter__(self):
        return iter(self.levels)

    def __len__(self) -> int:
        return len(self.levels)

    def __contains__(self, zoom: int) -> bool:
        return zoom in self.levels

    @property
    def min(self) -> int:
        return min(self.levels)

    @property
    def max(self) -> int:
        return max(self.levels)

    def descending(self) -> list[int]:
        return sorted(self.levels, reverse=True)

    def intersection(self, other: ZoomLevels) -> ZoomLevels:
        found = tuple(z for z in self.levels if z in other)
        if not found:
            raise ValueError(f"no common zoom levels: {self.levels} and {other.levels}")
        return ZoomLevels(found)

    def difference(self, other: ZoomLevels) -> ZoomLevels:
        """A set: what is left may have a gap."""
        return ZoomLevels(tuple(z for z in self.levels if z not in other))

    def intersects(self, other: ZoomLevels) -> bool:
        return any(z in other for z in self.levels)

    def column(self) -> Column:
        return F.array(*[F.lit(z) for z in self.levels])
