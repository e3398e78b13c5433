"""Exact medians of many columns by distributed selection.

For each rank that is searched, a pass asks the tasks for a sketch of the values that may still have it, and then counts how many
values are below each of three cuts around the rank's place and how many equal them. That either finds the value or narrows
the range, some hundred times with each pass, until it is small enough to be sorted. All columns share the passes; no task
holds a column, and nothing is shuffled but sketches and counts.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a range that are sorted in one place.
FEW = 10_000
#: A sketch's ranks are off by a share of 1 / SKETCH at most.
SKETCH = 1_000


@dataclass
class _Search:
    """For the value at ``rank`` (from 0): between low and high, neither of them itself, ``below`` values before the range."""

    values: Column
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    found: float | None = None

    def here(self) -> Column:
        v = self.values
        range_ = v.isNotNull()
        range_ = range_ if self.low is None else range_ & (v > F.lit(self.low))
        return F.when(range_ if self.high is None else range_ & (v < F.lit(self.high)), v)

    def open(self) -> bool:
        return self.found is None and self.inside > FEW

    def shares(self) -> list[float]:
        at = (self.rank - self.below + 0.5) / self.inside
        return [min(1.0, max(0.0, at + x)) for x in (-2.0 / SKETCH, 0.0, 2.0 / SKETCH)]

    def cut(self, at: float, less: int, same: int) -> None:
        """``less`` values of all are below ``at``, ``same`` equal it."""
        if less <= self.rank < less + same:
            self.found = at
        elif self.rank < less:
            self.high, self.inside = at, min(self.inside, less - self.below)
        elif self.low is None or at > self.low:
            self.inside -= less + same - self.below
            self.low, self.below = at, less + same


def medians(df: DataFrame, values: Mapping[str, Column]) -> dict[str, float | None]:
    """The median of each expression, as double; null without values. Between two middle values it is their mean. NaN is
    larger than any number."""
    if not values:
        return {}
    held = df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())])
    plain = {n: F.when(~F.isnan(f"v{i}"), F.col(f"v{i}")) for i, n in enumerate(values)}
    first = held.agg(*[F.count(f"v{i}") for i in range(len(values))], *[F.count(v) for v in plain.values()]).first()
    total = dict(zip(values, first[: len(values)], strict=True))
    numbers = dict(zip(values, first[len(values) :], strict=True))  # the rest is NaN
    searches = {(n, r): _Search(plain[n], r, numbers[n]) for n in values for r in {(total[n] - 1) // 2, total[n] // 2} if 0 <= r < numbers[n]}
    while going := [s for s in searches.values() if s.open()]:
        cuts = held.agg(*[F.percentile_approx(s.here(), s.shares(), SKETCH) for s in going]).first()
        asked = [(s, at) for s, own in zip(going, cuts, strict=True) for at in sorted(set(own))]
        counts = [F.count(F.when(x, 1)) for s, at in asked for x in (s.values < F.lit(at), s.values == F.lit(at))]
        seen = held.agg(*counts).first()
        for i, (s, at) in enumerate(asked):
            if s.found is None:
                s.cut(at, seen[2 * i], seen[2 * i + 1])
    if last := [s for s in searches.values() if s.found is None]:
        for s, own in zip(last, held.agg(*[F.sort_array(F.collect_list(s.here())) for s in last]).first(), strict=True):
            s.found = own[s.rank - s.below]
    out: dict[str, float | None] = {}
    for n in values:
        a, b = (searches[n, r].found if (n, r) in searches else float("nan") for r in ((total[n] - 1) // 2, total[n] // 2))
        out[n] = None if not total[n] else a if a == b else 0.5 * a + 0.5 * b
    return out
