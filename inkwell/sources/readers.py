"""Readers with explicit schemas and limits, and sinks that may be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWERS = "record_id bigint, page int, answer string"


def parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def recorded_json(spark: SparkSession, path: str, schema: str = ANSWERS) -> DataFrame:
    """Recorded answers of a model or search service, one JSON object a line; unreadable lines come as rows of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def relational(spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, parts: int) -> DataFrame:
    """A database table read in ``parts`` ranges of its key; needs the database's driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=parts).load()


def files(spark: SparkSession, path: str, most_bytes: int, glob: str = "*", magic: bytes | None = None) -> DataFrame:
    """Files no larger than ``most_bytes`` (decided on the listing, before anything is read) that begin with ``magic``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).where(F.col("length") <= most_bytes)
    return found.where(F.substring("content", 1, len(magic)) == F.lit(magic)) if magic else found


def html_links(pages: DataFrame, html: str, base: str, suffix: str) -> DataFrame:
    """Adds ``link``: each address in ``html`` whose path ends in ``suffix``, once per page, relative ones completed."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    fitting = F.array_distinct(F.filter(hrefs, lambda h: F.lower(F.substring_index(h, "?", 1)).endswith(suffix)))
    root = F.regexp_extract(base, "^([a-zA-Z]+://[^/]+)", 1)
    return pages.withColumn("link", F.explode(fitting)).withColumn("link", F.when(F.col("link").rlike("^[a-zA-Z]+://"), F.col("link")).when(F.col("link").startswith("/"), F.concat(root, "link")).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), "link")))


def sitemap_links(maps: DataFrame, xml: str) -> DataFrame:
    """Adds ``loc`` and ``is_index``: the entries of a sitemap or sitemap index; XML that can't be read has none."""
    safe = F.when(F.col(xml).rlike(r"^\s*(<\?xml[^>]*>\s*)?<(urlset|sitemapindex)[\s\S]*</(urlset|sitemapindex)>\s*$"), F.regexp_replace(xml, r'\sxmlns="[^"]*"', ""))
    locs = F.when(safe.isNotNull(), F.concat(F.expr("xpath(_safe, '/urlset/url/loc/text()')"), F.expr("xpath(_safe, '/sitemapindex/sitemap/loc/text()')")))
    return maps.withColumn("_safe", safe).withColumn("is_index", F.col("_safe").contains("<sitemapindex")).withColumn("loc", F.explode(locs)).drop("_safe")


def import_key(*columns: str) -> F.Column:
    """Stable key of a record: the hash of its values as JSON in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def merge_by_key(old: DataFrame, new: DataFrame, key: str, rank: list[F.Column]) -> DataFrame:
    """One row per key, the greatest by ``rank`` (old and new told apart by ``is_new``); merging the same input twice changes nothing."""
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    values = F.struct(*[c for c in old.columns if c != key])
    return both.groupBy(key).agg(F.max_by(values, F.struct(*rank)).alias("v")).select(key, "v.*")


def write_batch(path: str):
    """A ``foreachBatch`` sink: each batch replaces its own folder, so a batch that is run again leaves no second copy."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
