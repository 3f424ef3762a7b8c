"""Session helpers: reading tables, cutting lineage, joins against hot keys."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors, once per application, through the shared folder, so that they need no copy of it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.join("inkwell", os.path.relpath(os.path.join(folder, f), root)))
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/inkwell.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(path.toString())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Only on a local master, where one machine is all there is, a temporary
    folder takes its place if none is named; elsewhere that is an error."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="inkwell-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder as a Parquet table and read again: its lineage ends there, it is computed once (an eager
    checkpoint computes it twice) and lies there compressed."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


cut = stored


def discard(df: DataFrame) -> None:
    """Remove the table behind ``df`` if ``stored`` wrote it and nothing reads it any more, as in loops that hand a table on."""
    if path := getattr(df, "_stored_at", None):
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


HOT_PARTS, HOT_ROWS = 256, 10_000


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], row_id: str, how: str = "inner") -> DataFrame:
    """Join where single keys of ``left`` may hold a large share of its rows.

    A key with more than 1/HOT_PARTS of the rows of ``left``, and more than HOT_ROWS, is hot: there are fewer than HOT_PARTS of
    them whatever the data, and that list is broadcast. Rows of a hot key are spread over HOT_PARTS salts by their ``row_id`` and the
    right rows of that key are repeated once per salt; all other keys, and everything where no key is hot, join as usual.
    ``right`` must not be hot in the same keys. Inner and left joins only; rows with null keys match nothing.
    """
    assert how in ("inner", "left")
    counts = left.groupBy(*keys).count().where(F.col("count") > HOT_ROWS)
    top = counts.orderBy(F.desc("count")).limit(HOT_PARTS).collect()
    least = left.count() // HOT_PARTS if top else 0
    if not (top := [r for r in top if r["count"] > least]):
        return left.join(right, keys, how)
    hot = left.sparkSession.createDataFrame([(*(r[k] for k in keys), True) for r in top], ", ".join(f"{k} {t}" for k, t in counts.dtypes if k in keys) + ", _hot boolean")
    hot = F.broadcast(hot.select(*keys, "_hot"))
    a = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(row_id), F.lit(HOT_PARTS))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    b = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
