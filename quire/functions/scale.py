"""Running totals and numbering that do not put one group into one task.

``order`` is split into buckets by a monotone, deterministic expression (an hour
of the timestamp, ``ord div 1024``). Counts per (key, bucket) are pre-aggregated,
the running total over buckets is taken on that small table, and only the rows of
one bucket share a task. A key that holds a third of all rows is thus spread over
as many tasks as it has buckets.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_total(df, keys, bucket, order, value, out):
    """Add ``out`` = sum of ``value`` over earlier rows and this one, per key."""
    keys = list(keys)
    base = df.withColumn("_bucket", bucket)
    offsets = (
        base.groupBy(*keys, "_bucket")
        .agg(F.sum(value).alias("_part"))
        .withColumn(
            "_before",
            F.sum("_part").over(
                W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
            ),
        )
        .drop("_part")
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        base.join(offsets, [*keys, "_bucket"])
        .withColumn(out, F.sum(value).over(inside) + F.coalesce("_before", F.lit(0)))
        .drop("_bucket", "_before")
    )


def number_rows(df, keys, bucket, order, out):
    """``row_number`` per key, computed bucket by bucket."""
    return running_total(df, keys, bucket, order, F.lit(1), out)
