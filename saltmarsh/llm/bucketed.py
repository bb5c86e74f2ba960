"""Ranks and running sums over groups of any size, with DataFrame operations only.

A window over a whole source would put a third of all rows into one task. Here the rows are range-partitioned by the whole
sort key, whose last part tells all rows apart, so no key, source or group of copies, however hot, is more than its
share of rows in a range. A small table has one row a group and range, a window over it gives each its offset, and the
rows' own window runs inside a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows that a range holds on average.
RANGE_ROWS = 50_000


def ranges_for(n_rows: int, range_rows: int = RANGE_ROWS) -> int:
    return max(1, -(-n_rows // range_rows))


def running(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, n: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group that come before in the order; n ranges.

    ``order`` must tell all rows of a group apart. Group columns must not be null (see :func:`group_key`), so that the
    join with the offsets and the window after it share one shuffle.
    """
    r, v, o = f"{out}__range", f"{out}__value", f"{out}__offset"
    # Written, so that every later step sees a row in the same range.
    df = written(df.withColumn(v, value).repartitionByRange(n, *group, *order).withColumn(r, F.spark_partition_id()), "ranges")
    keys = [*group, r]
    sums = df.groupBy(*keys).agg(F.sum(v).alias(f"{out}__sum"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy(r)
    offsets = sums.select(*keys, (F.sum(f"{out}__sum").over(before) - F.col(f"{out}__sum")).alias(o))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = df.join(offsets, keys)
    return joined.withColumn(out, F.sum(v).over(inside) - F.col(v) + F.col(o)).drop(r, v, o)


def group_key(column: Column) -> Column:
    """A text that is never null, orders by code point and puts null last."""
    return F.when(column.isNull(), "1").otherwise(F.concat(F.lit("0"), column.cast("string")))
