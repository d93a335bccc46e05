"""As-of join: each row with the last row of a table at or before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, table: DataFrame, keys: list[str], at: str, table_at: str, values: str = "held") -> DataFrame:
    """``rows`` with the struct ``values`` of all columns of that row of ``table`` which has equal ``keys`` and the greatest ``table_at`` <= ``at``.

    Both sides are laid in one order and the last table row is carried along,
    so the work is a sort by key, whatever number of rows meet. Null where no
    table row comes before.
    """
    inner = F.struct(*[F.col(c) for c in table.columns])
    marks = table.select(*keys, F.col(table_at).alias("_at"), F.lit(0).alias("_side"), inner.alias(values), F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("_row"))
    asked = rows.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(marks.schema[values].dataType).alias(values), F.struct("*").alias("_row"))
    order = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asked).withColumn(values, F.last(values, ignorenulls=True).over(order)).where("_side = 1")
    return both.select("_row.*", values)
