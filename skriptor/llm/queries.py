"""Queries of the llm operators over the test tables, and the SQL of some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skriptor.llm import bpe, encoding, forms, names, neardup, packing, quality, stuffing
from skriptor.session import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = names.linked_pairs(load(spark, sf_dir, "name_registry"), load(spark, sf_dir, "given_names"))
    return pairs.select(F.col("a").alias("entry_a"), F.col("b").alias("entry_b"))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked_entries(load(spark, sf_dir, "name_registry"), load(spark, sf_dir, "given_names")).withColumnRenamed("id", "entry_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.found(load(spark, sf_dir, "text_stats"), "stat_id").select("stat_id")


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.statistics(load(spark, sf_dir, "text_stats"), "stat_id").dropDuplicates(["stat_id"])
    return quality.outliers(stats, "stat_id")


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.unify(load(spark, sf_dir, "obsidian_check"), "note_id").select("note_id", "form", "kinds").dropDuplicates(["note_id"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = load(spark, sf_dir, "obsidian_check")
    model = encoding.train([(notes, "text")])
    odd = forms.unify(notes.where(forms.may_differ(F.col("text"))), "note_id").where("size(kinds) > 0")
    return encoding.flag_garbled(odd, model, "note_id", "text").where("not garbled").select(F.col("rec_id").alias("note_id")).distinct()


def _restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes, checks = load(spark, sf_dir, "obsidian_check"), load(spark, sf_dir, "full_check")
    model = encoding.train([(notes, "text")])
    a = encoding.find_garbled(notes, model, "note_id", "text").withColumn("table_name", F.lit("obsidian_check"))
    b = encoding.find_garbled(checks, model, "check_id", "range_name").withColumn("table_name", F.lit("full_check"))
    return a.union(b)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _restored(spark, sf_dir).select("table_name", "rec_id").distinct()


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _restored(spark, sf_dir).dropDuplicates(["table_name", "rec_id"]).select("table_name", "rec_id", "restored", "complete", "pairs")


def _checks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(load(spark, sf_dir, "full_check"), "check_id", "body", threshold=0.7)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neardup.document_pairs(*_checks(spark, sf_dir))
    return pairs.select(F.col("a").alias("check_a"), F.col("b").alias("check_b"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.document_classes(*_checks(spark, sf_dir))


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir)[1]


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(load(spark, sf_dir, "documents"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = load(spark, sf_dir, "pack_sizes").where("capacity > 0").select("capacity").distinct()
    capacities = [r["capacity"] for r in sizes.collect()]  # a fixed list of permitted sizes
    return packing.pack(bpe.count_tokens(load(spark, sf_dir, "documents")), capacities)


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        packing.containers(_packed(spark, sf_dir))
        .groupBy("layout", "capacity")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("unused").alias("unused"))
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.found(stuffing.collocations(load(spark, sf_dir, "documents"))).select("doc_id").distinct()


def p9_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.collocations(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_entities": p1_entities,
    "p3_found": p3_found,
    "p3_scores": p3_scores,
    "p4_found": p4_found,
    "p4_forms": p4_forms,
    "p5_found": p5_found,
    "p5_restored": p5_restored,
    "p6_found": p6_found,
    "p6_classes": p6_classes,
    "p6_links": p6_links,
    "p7_ids": p7_ids,
    "p8_packed": p8_packed,
    "p9_found": p9_found,
    "p9_collocations": p9_collocations,
    "p8_summary": p8_summary,
}

_WORDS = "regexp_extract_all(replace(lower(body), 'ё', 'е'), '[а-яa-z]+')"
_SETS = f"""WITH w AS (SELECT DISTINCT check_id AS id, {_WORDS} AS w FROM full_check WHERE body IS NOT NULL),
s AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 15),
e AS (SELECT id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT x.id AS a, y.id AS b, x.n + y.n AS n, count(*) AS c FROM e x JOIN e y ON x.t = y.t AND x.id < y.id GROUP BY ALL)"""

_CLASSES = f"""WITH w AS (SELECT DISTINCT check_id AS id, {_WORDS} AS w FROM full_check WHERE body IS NOT NULL),
s AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) >= 15),
r AS (SELECT min(id) AS rep, s, count(*) AS copies FROM s GROUP BY s), e AS (SELECT rep, len(s) AS n, unnest(s) AS t FROM r),
p AS (SELECT x.rep AS a, y.rep AS b, x.n + y.n AS n, count(*) AS c FROM e x JOIN e y ON x.t = y.t AND x.rep < y.rep GROUP BY ALL),
l AS (SELECT a, b, c AS common, c / (n - c) AS jaccard FROM p WHERE c * 10 >= (n - c) * 7)"""

ORACLE: dict[str, str] = {
    "p6_links": _CLASSES + " SELECT * FROM l",
    "p6_classes": _CLASSES + " SELECT id, rep, copies, (SELECT count(*) FROM l WHERE a = rep OR b = rep) AS links FROM s JOIN r USING (s)",
    "p6_found": _SETS + " SELECT a AS check_a, b AS check_b FROM p WHERE c * 10 >= (n - c) * 7",
}
