"""Operators on ordered rows: chains, sequences, segments, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def link_hash(parts: list[Column], prev: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], prev), 256)


def build_chain(entries: DataFrame, by: list[str], seq: str, parts: list[str]) -> DataFrame:
    """Adds prev_hash and hash, each entry's hash taken over its parts and its predecessor's. A chain is sequential by nature, so its entries
    go through one task in order; only the running hash is held."""
    import hashlib

    keys = [*by, seq, *parts]
    kinds = dict(entries.dtypes)

    def walk(batches):
        last = prev = None
        for batch in batches:
            out_prev, out_hash = [], []
            for row in batch[keys].itertuples(index=False, name=None):
                chain = row[: len(by)]
                if chain != last:
                    last, prev = chain, GENESIS
                out_prev.append(prev)
                prev = hashlib.sha256("|".join([*("" if v is None else str(v) for v in row[len(by) :]), prev]).encode()).hexdigest()
                out_hash.append(prev)
            yield batch[keys].assign(prev_hash=out_prev, hash=out_hash)

    ordered = entries.select(*keys).repartition(*by).sortWithinPartitions(*by, seq)
    return ordered.mapInPandas(walk, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", prev_hash string, hash string")


def verify_chain(entries: DataFrame, by: list[str], seq: str, parts: list[str]) -> DataFrame:
    """Per chain: entries, first broken sequence number (null if whole). Each row is checked against its own content and its
    predecessor's stored hash, all rows at once."""
    w = Window.partitionBy(*by).orderBy(seq)
    expected = link_hash([F.col(p) for p in parts], F.col("prev_hash"))
    bad = (F.col("hash") != expected) | (F.col("prev_hash") != F.coalesce(F.lag("hash").over(w), F.lit(GENESIS)))
    checked = entries.withColumn("_bad", bad)
    return checked.groupBy(*by).agg(F.count(F.lit(1)).alias("entries"), F.min(F.when(F.col("_bad"), F.col(seq))).alias("broken_at"))


def segments(df: DataFrame, by: list[str], order: list[str], gap: Column) -> DataFrame:
    """Number of the segment each row belongs to; ``gap`` true where a new one begins (first row of a group: always)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_new")


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reserve_until(charges: Column, stop: float) -> Column:
    """Fold of (bound, reported) charges in order: each is taken if what was used and its bound stay within ``stop``, and then adds
    the larger of the two; after the first refusal nothing more is taken. Gives used, taken, stopped."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("taken"), F.lit(False).alias("stopped"))

    def step(acc: Column, c: Column) -> Column:
        fits = ~acc["stopped"] & (acc["used"] + c["bound"] <= stop)
        return F.struct((acc["used"] + F.when(fits, F.greatest(c["bound"], c["reported"])).otherwise(0)).cast("bigint").alias("used"), (acc["taken"] + fits.cast("int")).alias("taken"), (acc["stopped"] | ~fits).alias("stopped"))

    return F.aggregate(charges, start, step)
