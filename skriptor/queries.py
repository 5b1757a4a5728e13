"""Queries of the core operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skriptor.operators import orphans, vault_links
from skriptor.plans import audit, checks, corpus, prose, timeline, vault
from skriptor.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault_links.dead_references(load(spark, sf_dir, "obsidian_check"), load(spark, sf_dir, "vault_attachments"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dead(spark, sf_dir).select("note_id", "ref_table", "ref_target", F.date_format("ref_at", "yyyy-MM").alias("ref_month"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(_dead(spark, sf_dir), "ref_table")


QUERIES |= {"p2_found": p2_found, "p2_report": p2_report}
ORACLE |= {
    "p2_found": vault.DEAD,
    "p2_report": f"SELECT ref_table AS table_name, ref_month AS period, count(*) AS orphans FROM ({vault.DEAD}) GROUP BY ALL",
}
for _part in (corpus, vault, prose, audit, timeline, checks):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE
