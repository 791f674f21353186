"""Places of rows in an order, without a task that has to order them all.

Rows are dealt to ranges of the order and sorted there; each gets its range and its
place in it while the ranged rows are written, once. All that follows reads that
table: the bounds of the ranges are drawn from a sample, so a plan that dealt the
rows again, for another set of columns, could draw others and lose or repeat places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import staged

#: Pairs of range and group that go to every task; where there are more they meet their rows by a shuffle.
MAX_BROADCAST = 200_000


def numbered(df: DataFrame, order: Sequence[str], within: Sequence[str] = (), place: str = "pos") -> DataFrame:
    """df with `place`: how many rows of the same `within` values come before by order, from 0.

    Rows equal in `within` and order get places in an order of their own, fixed when
    this is called, as rows are written to the shared folder then. Nulls come first.
    A range holds a run of the order, so no group has to be one task; pairs of range and
    group number less than ranges and groups together.
    """
    keys = [*within, *order]
    ids = F.monotonically_increasing_id()
    ranged = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", ids), "ranged")
    part = F.shiftright("__id", 33)
    sizes = ranged.groupBy(part.alias("__part"), *within).agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    window = W.partitionBy(*within).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(window), F.lit(0)) - F.col("__first")).drop("__n", "__first")
    before = staged(before.select("__part", "__before", *[F.col(c).alias(f"__w{i}") for i, c in enumerate(within)]), "range-starts")
    small = before if before.count() > MAX_BROADCAST else F.broadcast(before)
    met = part == F.col("__part")
    for i, c in enumerate(within):
        met = met & F.col(c).eqNullSafe(F.col(f"__w{i}"))
    return ranged.join(small, met).select(*df.columns, (F.col("__before") + F.col("__id")).cast("long").alias(place))
