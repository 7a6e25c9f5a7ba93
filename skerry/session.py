"""Interactive use: searches that replace each other, paging, and previews that are kept."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

PREVIEWS = 64


class Typing:
    """Runs the newest search only: a newer one interrupts the jobs of those before it, and late results are dropped."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.sequence = spark, 0

    def _tag(self, n: int) -> str:
        return f"skerry-typing-{id(self)}-{n}"

    def run(self, search: Callable[[], DataFrame]) -> list[Row] | None:
        """Rows of a search, or None if a newer one has begun meanwhile."""
        self.sequence += 1
        mine = self.sequence
        if mine > 1:
            self.spark.interruptTag(self._tag(mine - 1))
        self.spark.addTag(self._tag(mine))
        try:
            rows = search().collect()
        except Exception:
            if mine != self.sequence:
                return None
            raise
        finally:
            self.spark.removeTag(self._tag(mine))
        return rows if mine == self.sequence else None


class Page:
    """A cursor over a result list that shows ``height`` rows at a time."""

    def __init__(self, total: int, height: int) -> None:
        self.total, self.height, self.cursor, self.offset = total, height, 0, 0

    def move(self, by: int) -> int:
        self.cursor = min(max(0, self.cursor + by), max(0, self.total - 1))
        self.offset = min(max(self.offset, self.cursor - self.height + 1), self.cursor)
        return self.cursor

    def keep(self, results: DataFrame, path: str) -> int:
        """Put the cursor on a path of a new result list, on the first row if it is gone."""
        row = results.where(F.col("path") == path).select("rank").first()
        self.cursor = row.rank - 1 if row else 0
        return self.move(0)


class Previews:
    """The last previews by key; the oldest goes first, a new catalog version clears them."""

    def __init__(self, load: Callable[[str], object], size: int = PREVIEWS) -> None:
        self.load, self.size = load, size
        self.kept: OrderedDict[str, object] = OrderedDict()

    def get(self, key: str) -> object:
        if key not in self.kept:
            if len(self.kept) >= self.size:
                self.kept.popitem(last=False)
            self.kept[key] = self.load(key)
        return self.kept[key]

    def clear(self) -> None:
        self.kept.clear()


def reference(path: str, line: int = 0) -> str:
    """``path`` or ``path:line``, as it is copied."""
    return f"{path}:{line}" if line > 0 else path
