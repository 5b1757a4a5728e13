"""Character audits: foreign ranges, invisible characters, mixed scripts, and their removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skriptor.functions import text as T

# Label, pattern, whether one at the very start of the text is no finding.
RANGES = [
    ("Китайские иероглифы (CJK Unified)", r"[\x{4e00}-\x{9fff}]", False),
    ("Китайские иероглифы (CJK Ext A)", r"[\x{3400}-\x{4dbf}]", False),
    ("Китайские иероглифы (CJK Compat)", r"[\x{f900}-\x{faff}]", False),
    ("Китайская пунктуация", r"[\x{3000}-\x{303f}]", False),
    ("Fullwidth формы", r"[\x{ff00}-\x{ffef}]", False),
    ("Хирагана (японская азбука)", r"[\x{3040}-\x{309f}]", False),
    ("Катакана (японская азбука)", r"[\x{30a0}-\x{30ff}]", False),
    ("Хангыль (корейская азбука)", r"[\x{ac00}-\x{d7af}]", False),
    ("Хангыль Jamo", r"[\x{1100}-\x{11ff}]", False),
    ("Иврит", r"[\x{0590}-\x{05ff}]", False),
    ("Арабский", r"[\x{0600}-\x{06ff}]", False),
    ("Тайский", r"[\x{0e00}-\x{0e7f}]", False),
    ("Мойбейк (UTF-8 как latin-1)", r"[ÐÑÂÃ][\x{80}-\x{bf}]", False),
    ("Мойбейк (UTF-8 как cp1251)", r"â€[\x{90}-\x{bf}\x{2018}-\x{2122}]", False),
    ("Невидимые управляющие символы", r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}]", False),
    ("BOM внутри текста", r"\x{feff}", True),
]
# Kinds of traces that no keyboard leaves, and emoji.
TRACES = {
    "zero_width": r"[\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}]",
    "soft_hyphen": r"\x{ad}",
    "bidi": r"[\x{202a}-\x{202e}\x{2066}-\x{2069}]",
    "tag": r"[\x{e0000}-\x{e007f}]",
    "odd_space": r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]",
}
EMOJI = r"[\x{1f300}-\x{1faff}\x{2600}-\x{27bf}\x{1f1e6}-\x{1f1ff}\x{fe0f}\x{200d}]"
MIXED_WORD = r"[A-Za-z]+[А-ЯЁа-яё][A-Za-zА-ЯЁа-яё]*|[А-ЯЁа-яё]+[A-Za-z][A-Za-zА-ЯЁа-яё]*"
FINDINGS_CAP = 501  # a feature of the report: it stops after so many findings of a text


def char_findings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: list[tuple] | None = None, cap: int | None = FINDINGS_CAP) -> DataFrame:
    """(id, line_no, col, glyph, codepoints, range_name, context): the first hit of each range on each line.

    A byte order mark at the very start is none.  At most ``cap`` findings a text
    in reading order (None: all).  Null texts have none.
    """
    ranges = RANGES if ranges is None else ranges
    # each alternative may stand alone, so one test sorts out the clean texts
    rows = df.where(F.col(text_col).rlike("|".join(p for _, p, _ in ranges)))
    lines = rows.select(F.col(id_col), F.posexplode(T.lines(F.col(text_col))).alias("n", "line"))
    found = []
    for order, (name, pattern, skip) in enumerate(ranges):
        exempt = (F.col("n") == 0) & F.col("line").startswith("﻿") if skip else F.lit(False)
        body = F.when(exempt, F.expr("substring(line, 2)")).otherwise(F.col("line"))
        glyph = F.regexp_extract(body, pattern, 0)
        at = F.call_function("instr", body, glyph)  # in code points, unlike regexp_instr
        hit = F.struct(F.lit(order).alias("order"), (at + F.when(exempt, 1).otherwise(0)).alias("col"), glyph.alias("glyph"), F.lit(name).alias("range_name"))
        found.append(F.when(body.rlike(pattern), hit))
    each = lines.select(id_col, (F.col("n") + 1).alias("line_no"), F.substring(T.strip(F.col("line")), 1, 140).alias("context"), F.explode(F.array_compact(F.array(*found))).alias("f"))
    out = each.select(id_col, "line_no", "f.col", "f.glyph", T.code_points(F.col("f.glyph")).alias("codepoints"), "f.range_name", "context", "f.order")
    if cap is not None:
        w = Window.partitionBy(id_col).orderBy("line_no", "order")
        out = out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
    return out.drop("order")


# Characters that no text should hold, in the order they are looked for.
BAD = [
    ("control", r"[\x00-\x08\x{0b}\x{0e}-\x{1f}\x{7f}-\x{84}\x{86}-\x{9f}]"),
    ("replacement", r"\x{fffd}"),
    ("noncharacter", r"[\x{fdd0}-\x{fdef}\x{fffe}\x{ffff}]"),
    ("private use", r"[\x{e000}-\x{f8ff}\x{f0000}-\x{ffffd}]"),
    ("line separator", r"[\x{2028}\x{2029}]"),
]


def bad_unicode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, kind, codepoints, n): characters that no text should hold, one row a line and kind with the first one's code point."""
    rows = df.where(F.col(text_col).rlike("|".join(p for _, p in BAD)))
    lines = rows.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("n", "line"))
    each = [F.when(F.col("line").rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("line", p, 0).alias("c"), F.regexp_count("line", F.lit(p)).alias("n"))) for k, p in BAD]
    found = lines.select(id_col, (F.col("n") + 1).alias("line_no"), F.explode(F.array_compact(F.array(*each))).alias("f"))
    return found.select(id_col, "line_no", "f.kind", T.code_points(F.col("f.c")).alias("codepoints"), "f.n")


def strip_bad(s: Column) -> Column:
    """Without the characters ``bad_unicode`` finds; a separator becomes a line end."""
    s = F.regexp_replace(s, "|".join(p for k, p in BAD if k != "line separator"), "")
    return F.regexp_replace(s, BAD[-1][1], "\n")


def range_counts(findings: DataFrame) -> DataFrame:
    """(range_name, findings, texts)."""
    first = findings.columns[0]
    return findings.groupBy("range_name").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct(first).alias("texts"))


def ai_traces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one count for each kind of trace, mixed_words) of the texts that have any."""
    c = F.col(text_col)
    counts = [F.regexp_count(c, F.lit(p)).cast("long").alias(k) for k, p in TRACES.items()]
    rows = df.where(c.isNotNull()).select(F.col(id_col), *counts, F.regexp_count(c, F.lit(MIXED_WORD)).cast("long").alias("mixed_words"))
    return rows.where(" + ".join([*TRACES, "mixed_words"]) + " > 0")


def strip_invisible(s: Column) -> Column:
    """Without zero-width, bidi and tag characters and soft hyphens; odd spaces become spaces."""
    s = F.regexp_replace(s, "|".join(TRACES[k] for k in ("zero_width", "soft_hyphen", "bidi", "tag")), "")
    return F.regexp_replace(s, TRACES["odd_space"], " ")


def strip_emoji(s: Column) -> Column:
    """Without emoji; a space before a removed one goes with it."""
    return F.regexp_replace(s, f" ?{EMOJI}+", "")


def strip_foreign(s: Column, ranges: list[tuple] | None = None) -> Column:
    """Without the characters of ``ranges``; a byte order mark at the start stays."""
    patterns = "|".join(p for _, p, skip in (RANGES if ranges is None else ranges) if not skip)
    return F.regexp_replace(F.regexp_replace(s, patterns, ""), r"(?<=[\s\S])\x{feff}", "")


def whitelist(s: Column, allowed: str = r"\r\n\t\x{20}-\x{7e}А-ЯЁа-яё«»„“”’‘—–…№§°") -> Column:
    """Only characters of a class."""
    return F.regexp_replace(s, f"[^{allowed}]", "")


def is_binary(content: Column) -> Column:
    """A NUL among the first 8 KiB."""
    return F.hex(F.substring(content, 1, 8192)).rlike("^(?:[0-9A-F]{2})*?00")


def integrity(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(id, issue): EMPTY, FRONT_MATTER_OPEN (not closed within ``window`` lines), NO_HEADING (no line ``## ``).

    Null texts count as empty; an empty text has no other issue.
    """
    lines = F.split(F.regexp_replace(F.col(text_col), r"^\x{feff}", ""), "\n")
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), F.coalesce(lines, F.array()).alias("_l"))
    dashes = lambda x: T.strip(x) == "---"
    open_ = dashes(F.get("_l", F.lit(0))) & ~F.exists(F.slice("_l", 2, window - 1), dashes)
    issues = F.when(F.col("_t") == "", F.array(F.lit("EMPTY"))).otherwise(
        F.array_compact(F.array(F.when(open_, "FRONT_MATTER_OPEN"), F.when(~F.exists("_l", lambda x: x.startswith("## ")), "NO_HEADING")))
    )
    return rows.select(id_col, F.explode(issues).alias("issue"))
