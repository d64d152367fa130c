"""Running sums and ordinals over groups of any size, without a window over a whole group.

Rows are dealt by range of (group, order), so that each partition sums its own rows; the partitions' totals, a row for
each partition and group, give every partition its offset. A hot group spreads over as many partitions as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.storage import cut

#: Offsets are short rows; up to so many are broadcast, more are joined by shuffle.
BROADCAST_OFFSETS = 500_000


def running(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """`df` with, for each name, the sum of its value over the rows before in the group (exclusive).

    `order` must be total within a group, or ties are broken arbitrarily.
    """
    spark = df.sparkSession
    values = {f"__v_{name}": c for name, c in sums.items()}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written once: the range bounds are sampled, and a second sampling could deal rows otherwise
    dealt = cut(df.withColumns(values).repartitionByRange(n, *group, *order)).withColumn("__part", F.spark_partition_id())
    here = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({name: F.coalesce(F.sum(f"__v_{name}").over(here), F.lit(0)) for name in sums})
    # ranges of groups meet at partition bounds: at most partitions + groups rows
    totals = cut(dealt.groupBy("__part", *group).agg(*(F.sum(f"__v_{name}").alias(f"__t_{name}") for name in sums)))
    ahead = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("__part").alias("__p"), *(F.col(g).alias(f"__g_{g}") for g in group),
        *(F.coalesce(F.sum(f"__t_{name}").over(ahead), F.lit(0)).alias(f"__o_{name}") for name in sums),
    )
    on = F.col("__part") == F.col("__p")
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    small = totals.limit(BROADCAST_OFFSETS + 1).count() <= BROADCAST_OFFSETS
    joined = local.join(F.broadcast(offsets) if small else offsets.hint("shuffle_merge"), on)
    return joined.select(*df.columns, *((F.col(name) + F.col(f"__o_{name}")).alias(name) for name in sums))


def ordinal(df: DataFrame, order: Sequence[str], name: str = "ordinal", group: Sequence[str] = ()) -> DataFrame:
    """`df` with a dense number from 0 in the order, in each group."""
    return running(df, group, order, {name: F.lit(1).cast("long")})
