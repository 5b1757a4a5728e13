"""Links of a vault's notes and those that lead nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriptor.functions import links
from skriptor.operators.orphans import orphan_references


def note_references(notes: DataFrame) -> DataFrame:
    """(note_id, ref_table, ref_target, ref_group, ref_key, ref_at): one row a note and target.

    Notes without vault, text or creation time have none.
    """
    rows = notes.where("vault is not null and text is not null and created_at is not null")
    wiki = F.transform(links.wiki_targets(F.col("text")), links.clean_wiki)
    markdown = F.transform(links.markdown_targets(F.col("text")), links.clean_markdown)
    each = rows.where(F.col("text").contains("[")).select(
        "note_id", F.col("vault").alias("ref_group"), F.col("created_at").alias("ref_at"), F.explode(F.array_union(wiki, markdown)).alias("ref_target")
    )
    key = links.last_component(F.col("ref_target"))
    table = F.when(F.col("ref_target").rlike(links.EXTENSION), "vault_attachments").otherwise("obsidian_check")
    return each.where("ref_target <> ''").select("note_id", table.alias("ref_table"), "ref_target", "ref_group", key.alias("ref_key"), "ref_at").distinct()


def vault_parents(notes: DataFrame, attachments: DataFrame) -> DataFrame:
    """(ref_group, ref_key, born, gone) of all notes and attachments."""
    a = notes.select(F.col("vault").alias("ref_group"), F.lower(F.trim("stem")).alias("ref_key"), F.col("created_at").alias("born"), F.col("deleted_at").alias("gone"))
    b = attachments.select(F.col("vault").alias("ref_group"), F.lower(F.trim("file_name")).alias("ref_key"), F.col("added_at").alias("born"), F.col("removed_at").alias("gone"))
    return a.unionByName(b)


def dead_references(notes: DataFrame, attachments: DataFrame) -> DataFrame:
    """The references of ``notes`` without a live target when the note was made."""
    return orphan_references(note_references(notes), vault_parents(notes, attachments))
