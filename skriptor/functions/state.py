"""Line states of markdown: fences, front matter, paragraphs and islands of consecutive lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skriptor.functions import text as T


def numbered_lines(df: DataFrame, id_col: str, text_col: str, newline_only: bool = True) -> DataFrame:
    """One row a line: id, line_no (from 1), line. Null texts have none."""
    parts = F.split(F.col(text_col), "\n") if newline_only else T.lines(F.col(text_col))
    return df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.posexplode(parts).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


SOFT = T.SPACE.replace(r"\t-\r", r"\t\x{0b}-\r")  # white space but for the line end


def _blocks(fences: tuple[str, ...], front_matter: bool) -> str:
    """Pattern of the blocks of whole lines that are masked."""
    matter = rf"\A[{SOFT}]*---[{SOFT}]*(?:\n(?:.*?^[{SOFT}]*---[{SOFT}]*$|.*\z)|\z)"
    fence = rf"^[{SOFT}]*({'|'.join(fences)})[^\n]*(?:\n(?:.*?^[{SOFT}]*\1[^\n]*$|.*\z)|\z)"
    return "(?dms)" + (f"{matter}|{fence}" if front_matter else fence)


def masked_lines(text: Column, fences: tuple[str, ...] = ("```", "~~~"), front_matter: bool = True) -> Column:
    """array<struct<line, masked>>, one for each line: whether it lies in a fence or in front matter.

    Front matter runs from a first line ``---`` to the next one.  A fence opens at a
    line that begins with a marker and closes at one that begins with the same.
    Marker lines themselves are masked.  The text is cut at its blocks, so the work
    is linear in its lines.
    """
    pattern = _blocks(fences, front_matter)

    def flagged(body: Column, masked: bool) -> Column:
        return F.transform(F.split(body, "\n"), lambda x: F.struct(x.alias("line"), F.lit(masked).alias("masked")))

    def piece(x: Column, i: Column) -> Column:
        gap, last = x["gap"], x["hit"].isNull()
        # a gap has a line end at each side where a block stands
        begin = F.when(i > 0, 2).otherwise(1)
        size = F.length(gap) - (begin - 1) - F.when(last, 0).otherwise(1)
        none = F.array().cast("array<struct<line:string,masked:boolean>>")
        plain = F.when(size < 0, none).otherwise(flagged(F.substring(gap, begin, size), False))
        return F.when(last, plain).otherwise(F.concat(plain, flagged(x["hit"], True)))

    zipped = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    return F.flatten(F.transform(zipped, piece))


def masks(text: Column, fences: tuple[str, ...] = ("```", "~~~"), front_matter: bool = True) -> Column:
    """array<boolean>, one for each line: the flags of ``masked_lines``."""
    return F.transform(masked_lines(text, fences, front_matter), lambda x: x["masked"])


def state_lines(df: DataFrame, id_col: str, text_col: str, fences: tuple[str, ...] = ("```", "~~~"), front_matter: bool = True) -> DataFrame:
    """One row a line with its mask."""
    each = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.posexplode(masked_lines(F.col(text_col), fences, front_matter)).alias("n", "s"))
    return each.select(id_col, (F.col("n") + 1).alias("line_no"), "s.line", "s.masked")


def paragraphs(text: Column) -> Column:
    """array<struct<para, lines>>: paragraphs outside fences and front matter; ``para`` is the line on which one begins,
    ``lines`` its filled lines as (line_no, line).  Masked lines don't end a paragraph, blank ones do.

    Everything stays in the text's own row: nothing is shuffled.
    """
    lines = F.transform(masked_lines(text), lambda x, i: F.struct((i + 1).alias("line_no"), x["line"].alias("line"), x["masked"].alias("masked"), (T.strip(x["line"]) != "").alias("solid")))
    none = F.array().cast("array<struct<para:int,lines:array<struct<line_no:int,line:string>>>>")

    def cut(kept: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(kept) - 1, F.lit(0)))
        begins = F.filter(at, lambda i: F.get(kept, i)["solid"] & ((i == 0) | ~F.get(kept, i - 1)["solid"]))

        def paragraph(starts: Column) -> Column:
            def one(b: Column, j: Column) -> Column:
                after = F.coalesce(F.get(starts, j + 1), F.size(kept))
                own = F.filter(F.slice(kept, b + 1, after - b), lambda x: x["solid"])
                return F.struct(F.get(kept, b)["line_no"].alias("para"), F.transform(own, lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"))).alias("lines"))

            return F.transform(starts, one)

        return F.when(F.size(kept) > 0, T.let(begins, paragraph)).otherwise(none)

    return T.let(F.filter(lines, lambda x: ~x["masked"]), cut)


def islands(df: DataFrame, id_col: str, flag: Column) -> DataFrame:
    """``df`` (id, line_no, ...) of flagged lines with ``island``: the line on which their run begins."""
    by_id = Window.partitionBy(id_col).orderBy("line_no")
    kept = df.where(flag)
    group = F.col("line_no") - F.row_number().over(by_id)
    return kept.withColumn("_g", group).withColumn("island", F.min("line_no").over(Window.partitionBy(id_col, "_g"))).drop("_g")
