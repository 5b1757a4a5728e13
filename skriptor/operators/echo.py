"""Turns of phrase that several documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriptor.functions import text as T
from skriptor.functions import words as W


def echo(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, min_files: int = 2, top: int | None = 25, name_words: list[str] = (), lang: str | None = None
) -> DataFrame:
    """(ngram, files, count, example_id, example): runs of ``n`` words of a sentence in at least ``min_files`` documents.

    Runs of stop words only and runs with one of ``name_words`` don't count.  The
    example is the first sentence of the smallest id.  Most files first, then most
    frequent, then by the run; ``top`` None gives all.  Occurrences are summed a
    document first, so that a run that is everywhere is small before the shuffle.
    """
    if not 2 <= n <= 6 or min_files < 2:
        raise ValueError("n must be 2 to 6 and min_files at least 2")
    stops = [w.replace("ё", "е") for w in (W.ECHO_EN if lang == "en" else W.ECHO_RU)]
    names = [w.lower().replace("ё", "е") for w in name_words]
    sents = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(T.sentences(F.col(text_col))).alias("no", "sentence"))
    worded = sents.select("id", "no", "sentence", T.echo_tokens(F.col("sentence")).alias("w"))
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    runs = F.when(F.size("w") >= n, F.transform(at, lambda i: F.slice("w", i, n)))
    stop_set, name_set = F.array(*map(F.lit, stops)), F.array(*map(F.lit, names)).cast("array<string>")
    each = worded.select("id", "no", F.substring("sentence", 1, 300).alias("sentence"), F.explode(runs).alias("g")).where(
        (F.size(F.array_except("g", stop_set)) > 0) & ~F.arrays_overlap("g", name_set)
    )
    a_doc = each.groupBy(F.array_join("g", " ").alias("ngram"), "id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("no", "sentence")).alias("first"))
    out = (
        a_doc.groupBy("ngram")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("count"), F.min(F.struct("id", "first")).alias("e"))
        .where(F.col("files") >= min_files)
        .select("ngram", "files", "count", F.col("e.id").alias("example_id"), F.col("e.first.sentence").alias("example"))
    )
    return out.orderBy(F.desc("files"), F.desc("count"), "ngram").limit(top) if top else out
