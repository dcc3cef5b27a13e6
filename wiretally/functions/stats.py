"""Relational statistics: entropy and running sums that never need one big task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entropy_from_counts(n: Column | str) -> Column:
    """Aggregate: Shannon entropy in bits of the category counts in a group.

    log2(N) - sum(n*log2 n)/N needs only three mergeable sums, so it is combined on the
    map side and a hot key never gathers its categories in one place.
    """
    n = F.col(n) if isinstance(n, str) else n
    total = F.sum(n)
    value = F.log2(total.cast("double")) - F.sum(n * F.log2(n.cast("double"))) / total
    return F.when(F.count(F.lit(1)) <= 1, F.lit(0.0)).otherwise(F.greatest(value, F.lit(0.0)))


def entropy(df: DataFrame, keys: list[str], category: str, alias: str = "entropy") -> DataFrame:
    """Entropy of a categorical column per key: count per category, then merge."""
    counts = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.sum("_n").alias("observations"), entropy_from_counts("_n").alias(alias)
    )


def running_sum(
    df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, alias: str
) -> DataFrame:
    """Exact running sum per key, in two levels.

    ``bucket`` must be ordered like ``order``. Inside a (key, bucket) cell a window adds
    up; between cells only one total per cell is accumulated. A key that holds a large
    share of all rows is therefore spread over its buckets.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    across = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total"))
    offsets = totals.select(
        *keys, bucket, F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_offset")
    )
    return (
        df.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets, [*keys, bucket])
        .withColumn(alias, F.col("_offset") + F.col("_inside"))
        .drop("_inside", "_offset")
    )


def order_statistics(rows: DataFrame, key: str, value: str, n: str) -> DataFrame:
    """Exact quartiles and median absolute deviation per key of (key, value, n) rows.

    Returns ``key``, ``count``, ``q1``, ``q2``, ``q3`` and ``mad``. ``n`` is how often a value
    occurs, so a key holds as many rows as it has distinct values, whatever its weight. The
    element at a position is that of the row whose running weight covers it; quartiles are
    medians of the halves, without the middle one of an odd count. A second running weight,
    in the order of the distance from the median, gives the deviation. One shuffle by key;
    the windows are sorts within it and spill. Rows without a value are left out.
    """
    rows = rows.where(F.col(value).isNotNull() & (F.col(n) > 0)).select(key, F.col(value).alias("_v"), F.col(n).alias("_n"))
    of_key = Window.partitionBy(key)
    up_to = (Window.unboundedPreceding, Window.currentRow)

    def at(position: Column, upper: str) -> Column:
        upper = F.col(upper)
        return F.max(F.when((upper - F.col("_n") <= position) & (position < upper), F.col("_pick")))

    def half(c: Column) -> Column:
        return F.floor(c / 2)

    def middle(start: Column, size: Column, upper: str, over=None) -> Column:
        low, high = at(start + half(size - 1), upper), at(start + half(size), upper)
        if over is not None:
            low, high = low.over(over), high.over(over)
        return (low + high) / F.lit(2.0)

    total, none = F.col("_total"), F.lit(0)
    placed = rows.select(
        "*",
        F.sum("_n").over(of_key).alias("_total"),
        F.sum("_n").over(of_key.orderBy("_v").rowsBetween(*up_to)).alias("_upper"),
        F.col("_v").alias("_pick"),
    )
    placed = placed.withColumn("_median", middle(none, total, "_upper", of_key))
    placed = placed.withColumn("_off", F.abs(F.col("_v") - F.col("_median")))
    placed = placed.withColumn("_reach", F.sum("_n").over(of_key.orderBy("_off").rowsBetween(*up_to)))
    lower, start = half(total), half(total + 1)
    off = lambda position: F.max(
        F.when((F.col("_reach") - F.col("_n") <= position) & (position < F.col("_reach")), F.col("_off"))
    )
    return placed.groupBy(key).agg(
        F.max("_total").alias("count"),
        middle(none, lower, "_upper").alias("q1"),
        F.max("_median").alias("q2"),
        middle(start, lower, "_upper").alias("q3"),
        ((off(half(total - 1)) + off(half(total))) / F.lit(2.0)).alias("mad"),
    )


def char_entropy(text: Column) -> Column:
    """Entropy over the characters of one short label, 6 decimals."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)

    def part(c: Column) -> Column:
        p = F.size(F.filter(chars, lambda x: x == c)) / n
        return p * F.log2(p)

    total = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - part(c))
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.round(total, 6))
