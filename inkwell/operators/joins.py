"""Joins beyond plain equality, rewritten so that Spark can hash or merge them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def either_key_join(left: DataFrame, right: DataFrame, row: str, first: str, second: str, key: str) -> DataFrame:
    """Left rows with the right row that ``first`` or ``second`` points to: two equi-joins instead of a nested loop over an OR.
    ``row`` names left rows; a right row that both keys point to comes once; left rows without any stay, with nulls."""
    side = right.select(F.col(key).alias("_key"), *[F.col(c).alias(f"r_{c}") for c in right.columns])
    keys = F.array_distinct(F.array_compact(F.array(first, second)))
    exploded = left.withColumn("_key", F.explode_outer(keys)).join(side, "_key", "left").drop("_key")
    # of a row whose keys both miss, or of which one misses, keep what matched, else one row of nulls
    from pyspark.sql import Window

    w = Window.partitionBy(row)
    hit = F.col(f"r_{key}").isNotNull()
    ranked = exploded.withColumn("_hits", F.sum(hit.cast("int")).over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.col(f"r_{key}").asc_nulls_last())))
    return ranked.where(hit | ((F.col("_hits") == 0) & (F.col("_n") == 1))).drop("_hits", "_n")


def next_greater(left: DataFrame, right: DataFrame, by: list[str], value: str, of: str) -> DataFrame:
    """For each left row the smallest ``of`` in ``right`` greater than its ``value`` (as-of forward), null where there is none.
    One sort of both sides together replaces a range join."""
    from pyspark.sql import Window

    a = left.withColumn("_v", F.col(value)).withColumn("_side", F.lit(1)).withColumn("_of", F.lit(None).cast(dict(right.dtypes)[of]))
    b = right.select(*by, F.col(of).alias("_v"), F.lit(0).alias("_side"), F.col(of).alias("_of"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.col("_v").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # rows of equal value: the left ones come first in descending order, so they don't see their equal
    return both.withColumn(f"next_{of}", F.last("_of", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side", "_of")


def within_one_edit(a: Column, b: Column) -> Column:
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b) <= 1)
