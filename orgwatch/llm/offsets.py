"""Running totals that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_start(df: DataFrame, keys: list[str], part: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``keys`` that come before, by ``part`` and then ``order``.

    ``part`` cuts each key into pieces small enough for a task. Totals of the pieces (map-side combined) are summed
    first, over as many rows as there are pieces; each piece then counts on from its own start. A key with a third of
    all rows is thus spread over as many tasks as it has pieces. ``keys`` and ``part`` must not be null.
    """
    totals = df.groupBy(*keys, part).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, part, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return local.join(starts, [*keys, part]).withColumn(out, F.col("_start") + F.col("_within")).drop("_start", "_within")
