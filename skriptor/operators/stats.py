"""Volume statistics of documents, fillers, and the volume diary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skriptor.functions import text as T
from skriptor.functions import words as W

DIALOGUE = rf"^[{T.SPACE}]*[—–-][{T.SPACE}]*[^{T.SPACE}]"
DIALOGUE_QUOTED = rf"^[{T.SPACE}]*[\"“«][{T.SPACE}]*[^{T.SPACE}]"


def is_dialogue(line: Column, lang: str | None = None) -> Column:
    """A line that opens with a dash; for ``en`` also with a quotation mark."""
    dash = line.rlike(DIALOGUE)
    return dash | line.rlike(DIALOGUE_QUOTED) if lang == "en" else dash


def text_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str | None = None) -> DataFrame:
    """(id, words, sents, avg_sent, dialog_share) of each text, without a shuffle.

    Null texts have no row; empty texts have zeros.
    """
    c = F.col(text_col)
    rows = df.where(c.isNotNull()).select(
        F.col(id_col),
        F.regexp_count(c, F.lit(T.COUNT_TOKEN)).cast("long").alias("words"),
        F.size(T.sentences(c)).cast("long").alias("sents"),
        T.lines(c).alias("_l"),
    )
    full = F.size(F.filter("_l", lambda x: T.strip(x) != ""))
    spoken = F.size(F.filter("_l", lambda x: is_dialogue(x, lang)))
    return rows.select(
        id_col,
        "words",
        "sents",
        F.when(F.col("sents") > 0, F.round(F.col("words") / F.col("sents"), 1)).otherwise(F.lit(0.0)).alias("avg_sent"),
        F.when(full > 0, F.round(F.lit(100.0) * spoken / full, 1)).otherwise(F.lit(0.0)).alias("dialog_share"),
    )


def filler_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fillers: list[str] | None = None) -> DataFrame:
    """(id, filler, n, per_1000): fillers that occur, bounded by words, with ё as е; rate over the text's words."""
    fillers = W.FILLERS_RU if fillers is None else fillers
    low = T.fold_yo(F.lower(F.col(text_col)))
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), low.alias("_t"), F.regexp_count(F.col(text_col), F.lit(T.COUNT_TOKEN)).alias("_w"))

    def counted_of(f: str) -> Column:
        folded = f.lower().replace("ё", "е")
        n = F.regexp_count("_t", F.lit(T.word_bounded(folded))).cast("long")
        # most texts hold no filler at all, and looking for a plain word is far cheaper than for a bounded one
        return F.struct(F.lit(f).alias("filler"), F.when(F.col("_t").contains(folded.split()[0]), n).otherwise(F.lit(0).cast("long")).alias("n"))

    each = [counted_of(f) for f in fillers]
    counted = rows.select(id_col, "_w", F.explode(F.array(*each)).alias("s")).where("s.n > 0")
    rate = F.when(F.col("_w") > 0, F.round(F.lit(1000.0) * F.col("s.n") / F.col("_w"), 1)).otherwise(F.lit(0.0))
    return counted.select(id_col, "s.filler", "s.n", rate.alias("per_1000"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: documents, words, sents, avg_sent (of the totals), dialog_share (mean of the documents')."""
    return stats.agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("words"),
        F.coalesce(F.sum("sents"), F.lit(0)).alias("sents"),
        F.coalesce(F.round(F.try_divide(F.sum("words"), F.sum("sents")), 1), F.lit(0.0)).alias("avg_sent"),
        F.coalesce(F.round(F.avg("dialog_share"), 1), F.lit(0.0)).alias("dialog_share"),
    )


def filler_totals(counts: DataFrame, total_words: DataFrame, top: int | None = 12) -> DataFrame:
    """(filler, n, documents, per_1000 of the corpus' words), most frequent first."""
    sums = counts.groupBy("filler").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))
    words = total_words.agg(F.sum("words").alias("_w"))
    out = sums.crossJoin(F.broadcast(words)).select("filler", "n", "documents", F.coalesce(F.round(F.try_divide(F.lit(1000.0) * F.col("n"), F.col("_w")), 1), F.lit(0.0)).alias("per_1000"))
    return out.orderBy(F.desc("n"), "filler").limit(top) if top else out


def diary_runs(diary: DataFrame, stamp: str = "stamp", words: str = "words") -> DataFrame:
    """(stamp, words, files) of each run of the volume diary; rows without a stamp or count are left out."""
    return diary.where(F.col(stamp).isNotNull() & F.col(words).isNotNull()).groupBy(F.col(stamp).alias("stamp")).agg(F.sum(words).cast("long").alias("words"), F.count(F.lit(1)).alias("files"))


def diary_days(runs: DataFrame) -> DataFrame:
    """(day, words, delta, days, tempo): a day's level is its last run; tempo is the change a day since the day before it.

    The first day's delta is its level.  The running lag needs one order over all days; days are few.
    """
    days = runs.groupBy(F.to_date("stamp").alias("day")).agg(F.max_by("words", "stamp").alias("words"))
    # one row a calendar day, so one partition is bounded by the number of days
    w = Window.orderBy("day")
    before, then = F.lag("words").over(w), F.lag("day").over(w)
    delta = F.col("words") - F.coalesce(before, F.lit(0))
    gap = F.coalesce(F.datediff("day", then), F.lit(0))
    return days.select("day", "words", delta.alias("delta"), gap.alias("days"), F.when(gap > 0, F.round(delta / gap, 0)).cast("long").alias("tempo"))
