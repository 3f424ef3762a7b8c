"""Totals and averages over trailing periods, days without activity included."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.plans.runtime import ship_package

#: Monoids a window can be folded with: combining function and identity. Only associativity is needed, no inverse.
MONOIDS: dict[str, tuple[Callable, object]] = {
    "total": (lambda a, b: a + b, 0),
    "max": (lambda a, b: b if a is None else a if b is None else max(a, b), None),
    "min": (lambda a, b: b if a is None else a if b is None else min(a, b), None),
}


class TwoStackWindow:
    """First-in-first-out window of ``size`` values with its fold at hand in amortised constant time.

    The back stack holds the newest values and one running fold; when the front runs empty the back is turned
    over once, leaving suffix folds. No value is ever subtracted, so maximum, minimum or sketches do as well as sums.
    """

    __slots__ = ("back", "fold", "front", "identity", "op", "size")

    def __init__(self, size: int, op: Callable, identity: object) -> None:
        self.size, self.op, self.identity = size, op, identity
        self.front: list = []
        self.back: list = []
        self.fold = identity

    def push(self, value: object) -> object:
        self.back.append(value)
        self.fold = self.op(self.fold, value)
        if len(self.front) + len(self.back) > self.size:
            if not self.front:
                acc = self.identity
                while self.back:
                    acc = self.op(self.back.pop(), acc)
                    self.front.append(acc)
                self.fold = self.identity
            self.front.pop()
        return self.op(self.front[-1], self.fold) if self.front else self.fold


def daily_totals(df: DataFrame, key: str, entity: str, ts: str, value: str) -> DataFrame:
    """(entity, day, day_total, day_max, day_min): every ``key`` counted once, by one shuffle of the rows, then folded to days.

    Rows without entity or time are left out; a null value counts as 0; rows whose key is null can't be recognised as
    repeats and count each; deliveries of one key that differ in entity, day or value count each. Columns of other names in ``df`` don't matter.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(entity).alias("_entity"), F.col(ts).cast("date").alias("_day"), F.coalesce(F.col(value), F.lit(0)).cast("bigint").alias("_value")).where("_entity is not null and _day is not null")
    once = rows.groupBy("_key", "_entity", "_day", "_value").agg(F.count(F.lit(1)).alias("_n"))
    times = F.when(F.col("_key").isNull(), F.col("_n")).otherwise(1)
    return once.groupBy(F.col("_entity").alias("entity"), F.col("_day").alias("day")).agg(F.sum(F.col("_value") * times).alias("day_total"), F.max("_value").alias("day_max"), F.min("_value").alias("day_min"))


def rolling_totals(df: DataFrame, key: str, entity: str, ts: str, value: str, periods: tuple[int, ...] = (7, 30), extremes: bool = False) -> DataFrame:
    """For each entity and each calendar day from its first to its last: day number, the day's total, and for each
    period p total_p and avg_p (total_p / p, days without rows and days before the first counting as 0);
    with ``extremes`` also max_p and min_p over the single values, null where the period holds none.

    Rows are shuffled once by id; after that only one row per entity and active day is shuffled and sorted, and each task walks its sorted partition once,
    holding one window per period, so memory doesn't grow with the data. An empty table gives an empty result.
    """
    ship_package(df.sparkSession)
    daily = daily_totals(df, key, entity, ts, value)
    kind = dict(daily.dtypes)["entity"]
    folds = ["total", "max", "min"] if extremes else ["total"]
    columns = [(f"{f}_{p}", f, p) for p in periods for f in folds]
    schema = f"entity {kind}, usage_day date, day_number int, day_total bigint, " + ", ".join(f"{c} bigint" for c, _, _ in columns)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, idle = datetime.timedelta(days=1), {"total": 0, "max": None, "min": None}
        last_entity, last_day, number, windows = None, None, 0, []
        for batch in batches:
            out: list[tuple] = []

            for e, day, total, high, low in zip(batch["entity"], batch["day"], batch["day_total"], batch["day_max"], batch["day_min"]):
                if e != last_entity:
                    last_entity, last_day, number = e, day - one, 0
                    windows = [(TwoStackWindow(p, *MONOIDS[f]), f) for _, f, p in columns]
                while last_day + one < day:
                    last_day, number = last_day + one, number + 1
                    out.append((e, last_day, number, 0, *(w.push(idle[f]) for w, f in windows)))
                last_day, number = day, number + 1
                row = {"total": int(total), "max": int(high), "min": int(low)}
                out.append((e, day, number, row["total"], *(w.push(row[f]) for w, f in windows)))
            frame = pd.DataFrame(out, columns=["entity", "usage_day", "day_number", "day_total", *(c for c, _, _ in columns)])
            for c, f, _ in columns:
                if f != "total":
                    frame[c] = frame[c].astype("Int64")
            yield frame

    rolled = daily.repartition("entity").sortWithinPartitions("entity", "day").mapInPandas(walk, schema)
    averages = {f"avg_{p}": F.col(f"total_{p}") / F.lit(p) for p in periods}
    return rolled.withColumns(averages).withColumnRenamed("entity", entity)


def bursts(rolled: DataFrame, entity: str) -> DataFrame:
    """The days, from the 30th on, whose 7-day average is more than twice the 30-day average (exact in integers)."""
    return rolled.where("day_number >= 30 and 15 * total_7 > 7 * total_30").select(entity, F.date_format("usage_day", "yyyy-MM-dd").alias("usage_day"))
