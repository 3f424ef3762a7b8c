"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.llm.components import connected_components, star_edges
from inkwell.llm.contacts import company_claims, company_features
from inkwell.llm.leaks import find_leaks
from inkwell.llm.names import link_names
from inkwell.llm.reading import reading_levels
from inkwell.llm.scans import find_noise, restore_text
from inkwell.llm.survivors import survivors
from inkwell.llm.tokens import decode_corpus, encode_corpus
from inkwell.plans.runtime import table


def _scans(spark, sf_dir):
    return tuple(table(spark, sf_dir, t) for t in ("ingestion_pages", "ingestion_occurrences", "ingestion_documents"))


def p2_found(spark, sf_dir):
    return find_noise(*_scans(spark, sf_dir))


def p2_restored(spark, sf_dir):
    return restore_text(*_scans(spark, sf_dir))


def company_groups(spark, sf_dir):
    return connected_components(star_edges(company_features(table(spark, sf_dir, "companies")), "company_id", "feature"))


def p3_found(spark, sf_dir):
    return company_groups(spark, sf_dir).select(F.col("vertex").alias("company_id"), "group_id")


def p3_groups(spark, sf_dir):
    """Every company with its group, companies without any match in a group of their own."""
    groups = company_groups(spark, sf_dir).withColumnRenamed("vertex", "company_id")
    ids = table(spark, sf_dir, "companies").where("id is not null").select(F.col("id").alias("company_id")).distinct()
    return ids.join(groups, "company_id", "left").select("company_id", F.coalesce("group_id", "company_id").alias("group_id"))


def _claims(spark, sf_dir):
    groups = company_groups(spark, sf_dir).withColumnRenamed("vertex", "company_id")
    return company_claims(table(spark, sf_dir, "companies")).join(groups, "company_id")


def p4_found(spark, sf_dir):
    """The stated order goes down to the object that holds a value; which of an object's two places for a field counts, its top or its address, follows the learned order."""
    return survivors(_claims(spark, sf_dir), currency="last")


def p4_currency(spark, sf_dir):
    """Survivors where values without time are ranked by learned value transitions before company ids decide."""
    return survivors(_claims(spark, sf_dir))


def p5_found(spark, sf_dir):
    return link_names(table(spark, sf_dir, "companies"), table(spark, sf_dir, "ingestion_occurrences"))


def p6_ids(spark, sf_dir):
    return encode_corpus(table(spark, sf_dir, "documents"))


def p6_decoded(spark, sf_dir):
    """Every text decoded from its ids again; null texts come back empty."""
    return decode_corpus(p6_ids(spark, sf_dir))


def p7_found(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_levels(spark, sf_dir):
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p8_found(spark, sf_dir):
    return p8_levels(spark, sf_dir).where("band <> 'standard'").select("doc_id", "band")


QUERIES = {"p2_found": p2_found, "p2_restored": p2_restored, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_currency": p4_currency, "p5_found": p5_found, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_found": p7_found, "p8_levels": p8_levels, "p8_found": p8_found}
ORACLES: dict[str, str] = {"p6_decoded": "select doc_id, coalesce(text, '') as text from documents"}
