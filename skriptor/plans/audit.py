"""Check everything: the six read-only checks of a corpus in one summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skriptor.operators import chars, dedup, links, markdown, rules
from skriptor.plans import prose
from skriptor.plans.prose import CLEAN_MAP, PHRASES, RULES
from skriptor.session import load_spread as load
from skriptor.session import release


def counted(row: DataFrame) -> tuple[int, ...]:
    """The numbers of a one-row result; its shuffle files and plans are dropped."""
    got = tuple(row.first())
    release(row.sparkSession)
    return got


def check_all(notes: DataFrame, files: DataFrame, phrases: list[str], rule_list: list[rules.Rule], id_col: str = "note_id") -> DataFrame:
    """(ord, tool, serious_n, other_n, serious): one row a check, and a last row ``total``.

    Serious are errors of the validator, characters of foreign ranges and damaged notes.
    Each check is counted by itself, and what it leaves is dropped before the next one: in one plan, the driver would
    hold all of them at once. The total is that of their six rows.
    """
    error = F.count(F.when(F.col("severity") == "ERROR", 1))
    hard = F.count(F.when(F.col("level") == "hard", 1))
    every, none = F.count(F.lit(1)), F.lit(0).cast("long")
    copies = dedup.exact_duplicates(notes, id_col).select(F.lit(1)).union(dedup.same_names(notes, "rel").select(F.lit(1)))
    checks = [
        ("validator", [lambda: markdown.validate(notes, links.note_keys(notes), files, id_col).agg(error, every - error)]),
        ("characters", [lambda: chars.char_findings(notes, id_col).agg(every, none)]),
        ("integrity", [lambda: chars.integrity(notes, id_col).agg(every, none)]),
        ("duplicates", [lambda: copies.agg(every, none), lambda: dedup.near_pairs(notes, id_col).agg(none, every)]),
        ("phrases", [lambda: rules.phrase_totals(notes, phrases, id_col).agg(none, F.coalesce(F.sum("total"), F.lit(0)))]),
        ("rules", [lambda: rules.rule_findings(notes, rule_list, id_col).agg(hard, every - hard)]),
    ]
    rows = []
    for n, (tool, parts) in enumerate(checks, 1):
        serious, other = (sum(x) for x in zip(*[counted(part()) for part in parts]))
        rows.append((n, tool, serious, other, n <= 3 and serious > 0))
    body = notes.sparkSession.createDataFrame(rows, "ord int, tool string, serious_n bigint, other_n bigint, serious boolean").coalesce(1)
    total = body.agg(F.sum("serious_n").alias("serious_n"), F.sum("other_n").alias("other_n"), F.max("serious").alias("serious"))
    return body.unionByName(total.select(F.lit(7).alias("ord"), F.lit("total").alias("tool"), "serious_n", "other_n", "serious"))


def cleaning_rehearsal(docs: DataFrame, phrases: list[str], mapping: dict[str, str], rule_list: list[rules.Rule], id_col: str = "doc_id") -> DataFrame:
    """(source, what, action, n): phrases with their planned action, and hard rules that would be cut or replaced."""
    plan = rules.cleaning_plan(rules.phrase_totals(docs, phrases, id_col), mapping).select(F.lit("phrase").alias("source"), F.col("phrase").alias("what"), "action", F.col("total").alias("n"))
    cuts = rules.rule_findings(docs, rule_list, id_col).where("level = 'hard'").groupBy("cat").agg(F.count(F.lit(1)).alias("n"))
    return plan.unionByName(cuts.select(F.lit("rule").alias("source"), F.col("cat").alias("what"), F.lit("cut").alias("action"), "n"))


def audit(spark: SparkSession, d: str) -> DataFrame:
    notes = load(spark, d, "obsidian_check").dropDuplicates(["note_id"])
    files = load(spark, d, "vault_attachments").where("vault is not null").select(F.col("vault").alias("grp"), "file_name", "rel")
    return check_all(notes, files, PHRASES, RULES)


def rehearsal(spark: SparkSession, d: str) -> DataFrame:
    return cleaning_rehearsal(load(spark, d, "documents"), PHRASES, CLEAN_MAP, RULES)


QUERIES = {"audit": audit, "rehearsal": rehearsal}
ORACLE = {
    "rehearsal": f"""SELECT 'phrase' AS source, phrase AS what, action, total AS n FROM ({prose.ORACLE['cleaning_plan']})
UNION ALL SELECT 'rule', cat, 'cut', count(*) FROM ({prose.RULE_HITS}) WHERE level = 'hard' GROUP BY cat""",
}
