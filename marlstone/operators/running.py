"""Running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import written


def running_sums(df: DataFrame, group: list[str], order: list[str], sums: dict) -> DataFrame:
    """``df`` with each of ``sums`` (a number per row, by name) summed up to and including the row.

    Rows are cut into slices of about equal size by ``group`` and ``order``, so one group that holds a third of all
    rows lies in a third of the slices; sums within slices and sums of slices are added. ``order`` must tell the
    rows of a group apart for the result to be defined.
    """
    sliced = df.withColumns({f"_{n}": e for n, e in sums.items()}).repartitionByRange(*group, *order).withColumn("_slice", F.spark_partition_id())
    sliced = written(sliced, "slices")
    parts = sliced.groupBy(*group, "_slice").agg(*[F.sum(f"_{n}").alias(f"_part_{n}") for n in sums])
    before = Window.partitionBy(*group).orderBy("_slice")
    base = parts.select(*group, "_slice", *[(F.sum(f"_part_{n}").over(before) - F.col(f"_part_{n}")).alias(f"_base_{n}") for n in sums])
    inner = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = sliced.withColumns({f"_in_{n}": F.sum(f"_{n}").over(inner) for n in sums}).join(base, [*group, "_slice"])
    return out.select(*df.columns, *[(F.col(f"_in_{n}") + F.col(f"_base_{n}")).alias(n) for n in sums])
