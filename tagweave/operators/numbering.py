"""Row numbers without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import written


def numbered(df: DataFrame, column: str, start: int = 0) -> DataFrame:
    """df with column: start + 1, start + 2 and so on, as strings, in the order of the rows' partitions.

    Rows get a partition and a place in it, in a table; the sums of the partitions before are one row a partition."""
    own = df.drop(column)
    rows = written(own.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)), "numbered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + F.col("__before") + start
    return rows.join(parts, "__part").withColumn(column, place.cast("string")).select(*own.columns, column)
