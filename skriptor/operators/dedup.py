"""Exact and near duplicates of documents, and names used twice."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skriptor.functions import text as T
from skriptor.session import cut, release


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(hash, copies, first_id) of texts that occur more than once, white space apart.

    Empty and blank texts have no hash, so they are no copies of each other.
    """
    rows = df.where(F.col(text_col).rlike(rf"[^{T.SPACE}]")).select(F.col(id_col).alias("id"), T.content_hash(F.col(text_col)).alias("hash"))
    return rows.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")).where("copies > 1")


def same_names(df: DataFrame, path_col: str = "path") -> DataFrame:
    """(stem, ext, files) of file names that occur in more than one place."""
    name = F.regexp_extract(F.col(path_col), r"[^/]*$", 0)
    rows = df.where(F.col(path_col).isNotNull()).select(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")).alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"))
    return rows.groupBy("stem", "ext").agg(F.count(F.lit(1)).alias("files")).where("files > 1")


def near_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, width: int = 5, min_words: int = 15) -> DataFrame:
    """(a, b, jaccard): pairs of representatives of different shingle sets with a Jaccard similarity of ``threshold``.

    Texts with equal sets are one class, named by its smallest id.  Candidates
    share one of the rarest shingles of each set: a pair at the threshold has so
    much in common that the n - ceil(threshold * n) + 1 rarest of either set cannot
    all be missed, so boilerplate in many texts is never joined.  Exact.
    """
    limit = Fraction(str(threshold))
    num, den = limit.numerator, limit.denominator
    worded = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), T.shingle_tokens(F.col(text_col)).alias("w"))
    sets = worded.select("id", T.shingles(F.col("w"), width, min_words).alias("s")).where("s is not null")
    hashed = sets.select("id", F.array_sort(F.array_distinct(F.transform("s", lambda x: F.xxhash64(x)))).alias("h"))
    reps = cut(hashed.groupBy("h").agg(F.min("id").alias("id")).select("id", "h", F.size("h").alias("n")))
    release(df.sparkSession)
    # counted where they are kept, in one shuffle; a shingle of one text leads nowhere
    ranked = reps.select("id", "n", F.explode("h").alias("t")).withColumn("f", F.count(F.lit(1)).over(Window.partitionBy("t"))).where("f > 1")
    lone = F.col("n") - F.size("l")
    keep = F.col("n") - F.floor((F.col("n") * num + den - 1) / den) + 1
    ordered = ranked.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("l"))  # bounded by one text's shingles
    prefix = cut(ordered.select("id", "n", F.explode(F.slice("l", F.lit(1), F.greatest(keep - lone, F.lit(0)).cast("int"))).alias("p")).select("id", "n", "p.t"))
    release(df.sparkSession)
    x, y = prefix.alias("x"), prefix.alias("y")
    fits = F.least("x.n", "y.n").cast("long") * den >= F.greatest("x.n", "y.n").cast("long") * num
    met = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.id") < F.col("y.id")) & fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    sides = met.join(reps.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a").join(reps.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")
    both = sides.select("a", "b", F.size(F.array_intersect("ha", "hb")).cast("long").alias("c"), (F.size("ha") + F.size("hb")).cast("long").alias("n"))
    return both.where(F.col("c") * den >= (F.col("n") - F.col("c")) * num).select("a", "b", F.round(F.col("c") / (F.col("n") - F.col("c")), 2).alias("jaccard"))
