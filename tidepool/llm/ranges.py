"""Dealing rows out by ranges of an id, in order, without a global sort in one task.

The bounds are quantiles of the id. An id that is a quantile several times, and the rows without an id, have a great share of all rows; they are
dealt out over as many ranges by a hash, so that no range holds much more than another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Ranges:
    """nulls: ranges of rows without an id, the first ones. bounds: (id, repeats) in order; a range ends before each, and an id with repeats above 1 has
    so many ranges of its own."""

    nulls: int
    bounds: list[tuple[int, int]]

    @property
    def n(self) -> int:
        return self.nulls + 1 + sum(1 if r == 1 else r + 1 for _, r in self.bounds)

    def id_of(self, key: str, mark: Column, descending: bool = False) -> Column:
        """A row's range. A binary search in the plan's own tree. mark: a 64-bit hash; ranges of one id are in its order, or against it."""

        def part(r: int) -> Column:
            place = F.least(F.floor((mark / F.lit(2.0**64) + 0.5) * r), F.lit(r - 1))
            return F.lit(r - 1) - place if descending else place

        first = [self.nulls]  # the first range of each gap between bounds
        for _, r in self.bounds:
            first.append(first[-1] + (1 if r == 1 else r + 1))
        k = F.col(key)

        def tree(lo: int, hi: int) -> Column:
            if lo == hi:
                if lo == 0 or self.bounds[lo - 1][1] == 1:
                    return F.lit(first[lo]).cast("long")
                own, r = self.bounds[lo - 1]
                return F.when(k == F.lit(own), F.lit(first[lo] - r) + part(r)).otherwise(F.lit(first[lo])).cast("long")
            mid = (lo + hi) // 2
            return F.when(k >= F.lit(self.bounds[mid][0]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

        return F.when(k.isNull(), part(max(1, self.nulls))).otherwise(tree(0, len(self.bounds))).cast("int")


def range_count(df: DataFrame) -> int:
    """As many ranges as shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ranges_of(ids: DataFrame, key: str) -> Ranges:
    """About as many ranges as shuffle partitions, with about as many rows each. As many numbers reach the driver."""
    n = range_count(ids)
    at = [k / n for k in range(1, n)]
    wanted = F.percentile_approx(F.col(key), at, 10_000) if at else F.lit(None).cast("array<bigint>")
    found = ids.agg(wanted.alias("q"), F.count(F.lit(1)).alias("rows"), F.count(key).alias("known")).first()
    repeats: dict[int, int] = {}
    for q in found.q or []:
        repeats[q] = repeats.get(q, 0) + 1
    missing = found.rows - found.known
    return Ranges(max(1, round(n * missing / found.rows)) if missing else 0, sorted(repeats.items()))


def by_range(df: DataFrame, key: str, mark: Column, ties: list[str], ids: DataFrame) -> DataFrame:
    """Adds range_id and sorts each partition by (range_id, key, mark, ties). A partition holds one range. The bounds come from one read
    of the key's column alone, in ids."""
    ranges = ranges_of(ids.select(key), key)
    return df.withColumn("range_id", ranges.id_of(key, mark)).repartitionById(ranges.n, "range_id").sortWithinPartitions(F.col(key).asc_nulls_first(), mark, *ties)
