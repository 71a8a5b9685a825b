"""Global order, row numbers and running sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.plans.storage import save

PART, SUM = "_skein_part", "_skein_before"


def range_parts(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned by ``keys`` and stored, with each row's part number in ``_skein_part``."""
    n = partitions or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return save(df.repartitionByRange(n, *keys).withColumn(PART, F.spark_partition_id()), "ranged")


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over earlier rows of the same ``group`` in ``order`` (exclusive).

    Rows are dealt by ranges of (group, order), so one huge group spreads over
    many tasks; only one sum per (group, part) travels to make the offsets.
    """
    parts = range_parts(df, [*group, *order], partitions)
    same = lambda *names: [F.coalesce(F.col(n).cast("string"), F.lit("\x00null")) for n in names]
    sums = parts.groupBy(PART, *group).agg(F.sum(value).alias("_skein_sum"))
    w = Window.partitionBy(*same(*group)).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn(SUM, F.coalesce(F.sum("_skein_sum").over(w), F.lit(0))).drop("_skein_sum")
    p, q = parts.alias("p"), before.alias("q")
    on: Column = F.col(f"p.{PART}") == F.col(f"q.{PART}")
    for g in group:
        on = on & F.col(f"p.{g}").eqNullSafe(F.col(f"q.{g}"))
    joined = p.join(q, on).select("p.*", f"q.{SUM}")
    inside = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, (F.col(SUM) + F.coalesce(F.sum(value).over(inside), F.lit(0)))).drop(PART, SUM)


def global_row_number(df: DataFrame, order: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """Adds ``out``: 0-based dense position in the global ``order``."""
    one = df.withColumn("_skein_one", F.lit(1).cast("long"))
    return running_sum(one, [], order, "_skein_one", out, partitions).drop("_skein_one")
