"""Link graph of a vault: edges, broken links, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriptor.functions import links as L


def note_keys(notes: DataFrame, rel_col: str = "rel", stem_col: str = "stem", group_col: str = "vault") -> DataFrame:
    """(grp, path, stem, note): what a link may name; ``path`` is the note's path in its vault, lower-case without .md.

    The first folder of ``rel`` may be the vault's own name; both paths count.
    """
    return notes.select(
        F.col(group_col).alias("grp"),
        F.regexp_replace(F.lower(F.col(rel_col)), r"\.md$", "").alias("path"),
        F.lower(F.col(stem_col)).alias("stem"),
        F.col("note_id").alias("note"),
    ).where("grp is not null")


def edges(notes: DataFrame, markdown: bool = False) -> DataFrame:
    """(note, grp, folder, kind, target, base): distinct targets of each note's links outside code; kind is wiki
    or, if asked for, markdown; ``folder`` is the note's own, lower-case."""
    rows = notes.where("vault is not null and text is not null").dropDuplicates(["note_id"])
    told = lambda kind, targets: F.transform(F.array_distinct(targets), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target")))
    found = told("wiki", F.transform(L.wiki_targets(F.col("text")), L.clean_wiki))
    if markdown:
        found = F.concat(found, told("markdown", F.transform(L.markdown_targets(F.col("text")), L.clean_markdown)))
    folder = F.lower(F.regexp_extract(F.coalesce(F.col("rel"), F.lit("")), r"^(.*)/[^/]*$", 1))
    each = rows.select(F.col("note_id").alias("note"), F.col("vault").alias("grp"), folder.alias("folder"), F.explode(found).alias("l"))
    return each.select("note", "grp", "folder", "l.kind", "l.target").where("target <> ''").withColumn("base", L.last_component(F.col("target")))


def unresolved(links: DataFrame, keys: DataFrame, files: DataFrame) -> DataFrame:
    """The links (grp, folder, kind, target, base, ...) whose target is no note's path or stem, no attachment's name and,
    for markdown links, no file seen from the note's folder: anti joins only.  files: grp, file_name and, if known, rel."""
    paths = keys.select("grp", F.col("path").alias("target")).distinct()
    names = keys.select("grp", F.col("stem").alias("base")).union(files.select("grp", F.lower("file_name").alias("base"))).distinct()
    places = keys.select("grp", F.col("path").alias("place"))
    if "rel" in files.columns:
        places = places.union(files.select("grp", F.lower("rel").alias("place")))
    places = places.distinct()
    lost = links.join(paths, ["grp", "target"], "left_anti").join(names, ["grp", "base"], "left_anti")
    placed = lost.withColumn("place", F.when(F.col("kind") == "markdown", L.relative_path(F.col("folder"), F.col("target"))))
    return placed.join(places, ["grp", "place"], "left_anti").drop("place")


def broken_links(links: DataFrame, keys: DataFrame, files: DataFrame) -> DataFrame:
    """(note, grp, kind, target) of the links that lead nowhere."""
    return unresolved(links, keys, files).select("note", "grp", "kind", "target").distinct()


def resolved_edges(links: DataFrame, keys: DataFrame) -> DataFrame:
    """(src, dst): a path match first, else the smallest note with that stem."""
    by_path = keys.groupBy("grp", F.col("path").alias("target")).agg(F.min("note").alias("p"))
    by_stem = keys.groupBy("grp", F.col("stem").alias("base")).agg(F.min("note").alias("s"))
    both = links.join(by_path, ["grp", "target"], "left").join(by_stem, ["grp", "base"], "left")
    return both.select(F.col("note").alias("src"), F.coalesce("p", "s").alias("dst")).where("dst is not null").distinct()


def orphan_notes(links: DataFrame, keys: DataFrame) -> DataFrame:
    """(note, grp) without links of their own and without links from other notes."""
    incoming = resolved_edges(links, keys).where("src <> dst").select(F.col("dst").alias("note"))
    return keys.select("note", "grp").distinct().join(links.select("note").distinct(), "note", "left_anti").join(incoming.distinct(), "note", "left_anti")


def backlinks(links: DataFrame, keys: DataFrame) -> DataFrame:
    """(note, incoming, outgoing) of every note."""
    e = resolved_edges(links, keys).where("src <> dst")
    into = e.groupBy(F.col("dst").alias("note")).agg(F.count(F.lit(1)).alias("incoming"))
    out = e.groupBy(F.col("src").alias("note")).agg(F.count(F.lit(1)).alias("outgoing"))
    notes = keys.select("note").distinct()
    return notes.join(into, "note", "left").join(out, "note", "left").na.fill(0, ["incoming", "outgoing"])
