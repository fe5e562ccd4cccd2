"""Running totals over one long order, computed bucket by bucket.

A running total over a whole table would be one window in one task. Here the
rows are cut into buckets by a function that grows with the order, the totals
of the buckets are accumulated in a table of one row per bucket, and each
bucket runs its own window on top of its starting value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cleargrain.session import stage

BUCKET_WIDTH = 1 << 18
MANY_BUCKETS = 1 << 17  # totals of one group that one task may accumulate


def running(
    df: DataFrame,
    by: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    sparse: bool = False,
) -> DataFrame:
    """Add inclusive running sums and maxima along ``order`` within ``by``.

    ``bucket`` must never decrease along ``order``. Rows whose ``by`` is null form a group of their own, and rows with a
    null bucket come first. With ``sparse``, buckets are counted first; where a group has more than MANY_BUCKETS of them,
    as with far-apart numbers, the rows are cut into ranges of equal numbers of rows in their place.
    """
    by = list(by)
    sums, maxes = dict(sums or {}), dict(maxes or {})

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by, "__bucket").agg(
            *[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()],
            *[F.max(c).alias(f"__t_{n}") for n, c in maxes.items()],
        )

    cut = df.withColumn("__bucket", bucket)
    totals = summed(cut)
    if sparse:
        totals = stage(totals, "bucket-totals")
        most = totals.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most > MANY_BUCKETS:
            parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            cut = stage(df.repartitionByRange(parts, *by, *order).withColumn("__bucket", F.spark_partition_id()), "ranges")
            totals = summed(cut)
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate([*by, "__bucket"])],
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums],
        *[F.max(f"__t_{n}").over(before).alias(f"__o_{n}") for n in maxes],
    )
    inside = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate([*by, "__bucket"])]
    joined = cut.join(starts, same)
    out = [F.col(c) for c in df.columns]
    out += [(F.sum(c).over(inside) + F.col(f"__o_{n}")).alias(n) for n, c in sums.items()]
    out += [F.greatest(F.max(c).over(inside), F.col(f"__o_{n}")).alias(n) for n, c in maxes.items()]
    return joined.select(*out)


def integer_bucket(name: str, width: int = BUCKET_WIDTH) -> Column:
    """Bucket of a whole number; at most ``width`` distinct numbers share one."""
    return F.floor(F.col(name) / F.lit(width))


def rank_in_group(df: DataFrame, by: Sequence[str], name: str = "rank", width: int = BUCKET_WIDTH) -> DataFrame:
    """Zero-based rank of a row among the rows with the same ``by``, by ``row_id``.

    Same result as a ``row_number`` window, with hot groups cut into buckets.
    """
    ranked = running(df, by, integer_bucket("row_id", width), ["row_id"], sums={name: F.lit(1)})
    return ranked.withColumn(name, F.col(name) - 1)


def with_row_id(df: DataFrame, order_by: Sequence[str], name: str = "row_id") -> DataFrame:
    """Dense zero-based position of every row in the order of ``order_by``.

    The rows are range-partitioned, sorted and staged, so the positions are
    fixed once; partition sizes then give each partition its first number.
    Ties are broken by a hash of the row, which also splits a hot order value.
    """
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    keyed = df.withColumn("__tie", tie)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = keyed.repartitionByRange(parts, *order_by, "__tie").sortWithinPartitions(*order_by, "__tie")
    laid = stage(laid.drop("__tie").withColumn("__pos", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("__pos", 33)
    sizes = laid.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    # one row per partition, so the broadcast side is bounded by the partition count
    joined = laid.withColumn("__part", part).join(F.broadcast(starts), "__part")
    inside = F.col("__pos").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.select(*df.columns, (F.col("__start") + inside).alias(name))
