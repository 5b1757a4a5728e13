"""Style report: words repeated close by and long sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skriptor.functions import state
from skriptor.functions import text as T
from skriptor.functions import words as W


def nearby_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, lang: str | None = None, exclude: list[str] = (), per_word: int = 3, min_length: int = 3
) -> DataFrame:
    """(id, para, line_no, word, gap, fragment): words met again within ``window`` words of their paragraph.

    Stop words, ``exclude`` and short words don't count; at most ``per_word`` hits a
    word and text, the first ones.  Words are lower-case, ё as е.
    """
    stops = sorted({*(w.replace("ё", "е") for w in W.style_stop_words(lang)), *exclude})

    def words(lines: Column) -> Column:
        each = F.flatten(F.transform(lines, lambda x: F.transform(T.name_tokens(x["line"]), lambda w: F.struct(T.fold_yo(F.lower(w)).alias("word"), x["line_no"].alias("line_no"), x["line"].alias("line")))))
        placed = F.transform(each, lambda x, i: F.struct(x["word"].alias("word"), (i + 1).alias("pos"), x["line_no"].alias("line_no"), x["line"].alias("line")))
        return F.array_sort(F.filter(placed, lambda x: (F.length(x["word"]) >= min_length) & ~x["word"].isin(stops)))

    def repeats(para: Column) -> Column:
        def near(sorted_: Column) -> Column:
            def hit(i: Column) -> Column:
                x, before = F.get(sorted_, i), F.get(sorted_, i - 1)
                gap = F.when(x["word"] == before["word"], x["pos"] - before["pos"])
                return F.struct(x["word"].alias("word"), para["para"].alias("para"), x["pos"].alias("pos"), gap.alias("gap"), x["line_no"].alias("line_no"), x["line"].alias("line"))

            return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(sorted_) - 1, F.lit(1))), hit), lambda h: h["gap"] <= window)

        return T.let(words(para["lines"]), near)

    found = F.array_sort(F.flatten(F.transform(state.paragraphs(F.col(text_col)), repeats)))
    first = lambda hits: F.filter(hits, lambda h, i: (i < per_word) | (F.get(hits, i - per_word)["word"] != h["word"]))
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.explode(T.let(found, first)).alias("h"))
    return rows.select(id_col, "h.para", "h.line_no", "h.word", "h.gap", F.substring(T.strip(F.col("h.line")), 1, 60).alias("fragment"))


def long_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 25) -> DataFrame:
    """(id, para, words, start): sentences of a paragraph's joined lines with more than ``threshold`` words."""
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.explode(state.paragraphs(F.col(text_col))).alias("p"))
    text = F.array_join(F.transform("p.lines", lambda x: T.strip(x["line"])), " ")
    each = rows.select(id_col, F.col("p.para").alias("para"), F.explode(T.sentences(text)).alias("s"))
    counted = each.withColumn("words", F.size(T.name_tokens(F.col("s"))).cast("long")).where(F.col("words") > threshold)
    start = F.concat(F.substring("s", 1, 100), F.when(F.length("s") > 100, "…").otherwise(""))
    return counted.select(id_col, "para", "words", start.alias("start"))
