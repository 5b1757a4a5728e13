"""Per-document text statistics and outlier scores that tell prose from lists, tables and junk.

Every statistic of a text is compared with those of its language: its exact rank
there, over all different texts, gives the share of texts at least as extreme, and
the weighted negative logarithms of these tail shares are the outlier score.
Ranks come from a range-partitioned sort of the distinct values, each with its
number of different texts: running totals within a partition plus the totals of the
partitions before it.  No task sees a whole language.  A language with few texts
leans on the ranks over all texts by a fixed number of pseudo-texts (LEAN), so
nothing switches with size.

A class of texts that holds a share s of its language is extreme in all statistics
at once, so its scores lie around -ln s and beyond, with a stretch before them in
which the share of texts above a score hardly falls.  The cut-off is the middle of
the lowest such stretch and so follows the size of the class.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skriptor.session import cut, prepare

# Frequent function words.
COMMON = {
    "ru": "и в во на не с со у за под над после до из к ко по от о об а но что как так же то это был была было были он она они "
    "я мы ты вы его её их для без при чтобы если когда пока хотя потому зато чего тем временем всё ещё уже бы ли только или между "
    "возле среди перед через вот там тут",
    "en": "the a an and or but of in on at by to from with without for as if so that this it is was were be been he she they we you i "
    "his her their not no after before under over behind beside beyond until although because while when meanwhile which who",
    "uk": "і й та в у на не з із до від за під над що як це був була було були він вона вони його її їх але або для без при коли якщо через між також",
    "de": "der die das den dem des ein eine einen und oder aber in im an am auf aus bei mit nach von vor zu zum zur für ist war waren sind nicht er sie es wir ihr sich auch als wie dass wenn",
    "fr": "le la les un une des et ou mais de du dans en sur sous avec sans pour par est était étaient sont ne pas il elle ils elles nous vous se que qui comme si plus",
    "es": "el la los las un una y o pero de del en con sin por para es era eran son no se que como su sus al lo más cuando donde también",
    "it": "il lo la gli le un una e o ma di del della in nel nella con senza per è era erano sono non si che come più anche quando",
}
LISTS = {k: frozenset(v.split()) for k, v in COMMON.items()}
WORDS = LISTS["ru"] | LISTS["en"]
SCRIPTS = {"CYRILLIC": ("ru", "uk"), "LATIN": ("en", "de", "fr", "es", "it")}  # the first is meant where no list speaks clearly
CLEAR = 0.12  # share of words in another list, one and a half times that of the first, from which the text is in that language
KNOWN_SHARE = 0.003  # share of a corpus' texts from which a word counts as known
PROSE_SHARE = 0.6  # found: the exact check; less than this share of the characters stands in prose lines
LEAN = 50  # pseudo-texts with the ranks of all languages

#: Statistic and the tail in which lists, tables and junk lie, and its weight in the score.
TAILS = {"words": "high", "mean_length": "both", "symbols": "high", "ends": "low", "common": "low", "known": "low", "per_line": "low"}
WEIGHTS = {"words": 0.04, "mean_length": 0.04, "symbols": 0.08, "ends": 0.25, "common": 0.35, "known": 0.04, "per_line": 0.2}
BIN = 0.02  # width of a cell of the score histogram
WINDOW, FLAT, BEYOND = 0.08, 0.45, 5  # a stretch: d ln(share above) / d ln(score) over +-8 %, at most so steep, with so many texts above
OVERLAP = 0.93  # found: scores from so much of the cut-off go to the exact check
NO_CLASS = 0.4  # least score for the exact check where no class stands apart (or the texts are too few to tell)
HEAVY = 200  # values of more than one text in so many are joined by broadcast: at most so many a language and statistic

_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_MARK = re.compile(r"\s*(?:[-*+•◦▪‣]|\d{1,4}[.)]|\[[ xX]\])\s+")
_END = re.compile(r"[.!?…][»”\"')]*$")
_CELL = re.compile(r"[;|\t]| {3,}")
WORD_SQL = r"\p{L}+(?:[-'’]\p{L}+)*"


def known_words(df: DataFrame, text_col: str = "text", share: float = KNOWN_SHARE) -> set[str]:
    """Words in at least ``share`` of the different texts; copies count once.

    The set cannot hold more than (mean distinct words of a text) / share words,
    however many texts there are.
    """
    texts = df.select(F.lower(F.col(text_col).cast("string")).alias("t")).where("trim(t) <> ''")
    each = texts.distinct().select(F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(WORD_SQL), F.lit(0)))).alias("w"))
    least = max(2.0, share * texts.select(F.xxhash64("t")).distinct().count())  # only hashes are shuffled
    return {r["w"] for r in each.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("w").collect()}


def _line_is_prose(line: str, known: frozenset[str] | set[str], common_words: frozenset[str] = WORDS) -> bool:
    m = _MARK.match(line)
    body = line[m.end() :] if m else line
    words = [w.lower() for w in _WORD.findall(body)]
    solid = _solid(body)
    if not words or sum(map(len, words)) < 0.7 * solid:
        return False
    longer = [w for w in words if len(w) > 1]
    if sum(w in known or w in common_words for w in longer) < 0.5 * len(longer):
        return False
    common = sum(w in common_words for w in words)
    if not common and len(_CELL.findall(body)) >= 2:
        return False
    if m:
        return len(words) >= 6 and common > 0
    return len(words) >= 6 or len(words) >= 3 and (common > 0 or bool(_END.search(body)))


_SPEAKS = {w: tuple(k for k in LISTS if w in LISTS[k]) for k in LISTS for w in LISTS[k] if len(w) > 1}  # languages of a function word
_NOT_USUAL = re.compile(r"[^a-zЀ-ӿ]")


def language(words: list[str]) -> str:
    """Language of lower-case words: by the script of most, within it by function words; none without words."""
    if not words:
        return ""
    firsts = "".join([w[0] for w in words])
    cyrillic = sum("Ѐ" <= c <= "ӿ" for c in firsts)
    if not _NOT_USUAL.search(firsts):
        script = "CYRILLIC" if 2 * cyrillic > len(firsts) else "LATIN"
        script = "CYRILLIC" if 2 * cyrillic == len(firsts) else script
    else:
        counts: dict[str, int] = {}
        for c in firsts:
            name = "LATIN" if c.isascii() else "CYRILLIC" if "Ѐ" <= c <= "ӿ" else unicodedata.name(c, "OTHER").split()[0]
            counts[name] = counts.get(name, 0) + 1
        script = max(sorted(counts), key=counts.get)
    first, *others = SCRIPTS.get(script, (script.lower(),))
    hits: dict[str, int] = {}
    for w in words:
        for k in _SPEAKS.get(w, ()):
            hits[k] = hits.get(k, 0) + 1
    best = max(((hits.get(k, 0), k) for k in others), default=(0, first))
    return best[1] if best[0] >= max(3, CLEAR * len(words)) and best[0] >= 1.5 * hits.get(first, 0) else first


def _solid(text: str) -> int:
    """Characters that are no white space."""
    return len("".join(text.split()))


def describe(text: str, known: set[str]) -> tuple:
    """(language, words, mean word length, symbols, ends, common, known, per line, prose)."""
    words = _WORD.findall(text)
    n = len(words)
    low = [w.lower() for w in words]
    lang = language(low)
    common = WORDS if lang in ("ru", "en") else LISTS.get(lang, WORDS)
    solid = _solid(text)
    lines = [x for x in map(str.strip, text.splitlines()) if x]
    good = sum(_solid(x) for x in lines if _line_is_prose(x, known, common))
    letters = sum(map(str.isalpha, text))
    return (
        lang,
        n,
        sum(map(len, words)) / n if n else 0.0,
        (solid - letters) / max(solid, 1),
        sum(bool(_END.search(x)) for x in lines) / max(len(lines), 1),
        sum(w in common for w in low) / max(n, 1),
        sum(w in known or w in common for w in low) / max(n, 1),
        n / max(len(lines), 1),
        good / max(solid, 1),
    )


FIELDS = "lang string, words bigint, mean_length double, symbols double, ends double, common double, known double, per_line double, prose double, same bigint"


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, words, mean_length, symbols, ends, common, known, per_line, prose, same) of each text.

    Null, empty and blank texts have no row.  ``lang`` is empty for texts without a
    word.  Rows that repeat come out as often as they come in; copies of a text have
    one ``same``.
    """
    spark = prepare(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).where(r"text rlike '\\S'").withColumn("same", F.xxhash64("text"))
    shared = spark.sparkContext.broadcast(known_words(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "words", "mean_length", "symbols", "ends", "common", "known", "per_line", "prose"]
        types = [pa.string(), pa.int64(), *[pa.float64()] * 7]
        for batch in batches:
            done = list(zip(*(describe(t, shared.value) for t in batch.column(1).to_pylist()))) or [[]] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(d, t) for d, t in zip(done, types)), batch.column(2)], ["key", *names, "same"])

    return cut(rows.mapInArrow(run, f"key {id_type}, {FIELDS}")).withColumnRenamed("key", id_col)


def tail_shares(stats: DataFrame, id_col: str, tails: dict[str, str] | None = None, lean: float = 0) -> DataFrame:
    """(id, stat, tail): share of the different texts of the same language at least as extreme.

    Shares within the language and over all texts are weighed by its number of texts and ``lean``.
    """
    tails = tails or TAILS
    same = F.col("same" if "same" in stats.columns else id_col).alias("same")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), F.col(k).cast("double").alias("value")) for k in tails])).alias("s")
    long = stats.select(F.col(id_col).alias("key"), "lang", same, each).select("key", "lang", "same", "s.stat", "s.value")
    own = long.groupBy("lang", "stat", "value").agg(F.count_distinct("same").alias("n"))
    values = own.select(F.explode(F.array("lang", F.lit("*"))).alias("lang"), "stat", "value", "n").groupBy("lang", "stat", "value").agg(F.sum("n").alias("n"))
    ranged = values.repartitionByRange("lang", "stat", "value").sortWithinPartitions("lang", "stat", "value")

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = TaskContext.get().partitionId(), {}
        for x in batches:
            x = x.copy()
            x["upto"] = x.groupby(["lang", "stat"], sort=False)["n"].cumsum()
            for key, some in x.groupby(["lang", "stat"], sort=False):
                x.loc[some.index, "upto"] += held.get(key, 0)
                held[key] = held.get(key, 0) + int(some["n"].sum())
            x["part"] = part
            yield x[["lang", "stat", "value", "n", "upto", "part"]]

    local = cut(ranged.mapInPandas(running, "lang string, stat string, value double, n bigint, upto bigint, part int"))
    totals = local.groupBy("part", "lang", "stat").agg(F.max("upto").alias("own"))  # partitions x languages x statistics
    before = Window.partitionBy("lang", "stat").orderBy("part")
    whole = Window.partitionBy("lang", "stat")
    offsets = totals.select(
        "part",
        "lang",
        "stat",
        F.coalesce(F.sum("own").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("own").over(whole).alias("texts"),
    )
    side = F.lit("low")
    for stat, tail in tails.items():
        side = F.when(F.col("stat") == stat, F.lit(tail)).otherwise(side)
    upto = F.col("upto") + F.col("offset")
    low, high = upto / F.col("texts"), (F.col("texts") - upto + F.col("n")) / F.col("texts")
    tail = F.when(side == "low", low).when(side == "high", high).otherwise(F.least(F.lit(1.0), 2 * F.least(low, high)))
    ranks = local.join(offsets, ["part", "lang", "stat"]).select("lang", "stat", "value", "n", "texts", tail.alias("tail"))
    everywhere = ranks.where("lang = '*'").select("stat", "value", F.col("n").alias("n_all"), F.col("texts").alias("all_texts"), F.col("tail").alias("all_tail"))
    within = ranks.where("lang <> '*'").select("lang", "stat", "value", "n", "texts", "tail")
    leaning = (F.col("tail") * F.col("texts") + lean * F.col("all_tail")) / (F.col("texts") + lean)
    joined = within.join(everywhere, ["stat", "value"]).select(
        "lang", "stat", "value", (F.col("n") * HEAVY >= F.col("texts")).alias("heavy"), F.when(F.col("lang") == "", F.col("all_tail")).otherwise(leaning).alias("tail")
    )
    joined = cut(joined)
    key = ["lang", "stat", "value"]
    heavy, light = joined.where("heavy").drop("heavy"), joined.where("not heavy").drop("heavy")
    common = long.join(F.broadcast(heavy), key)  # ties such as 1.0 would be one hot key
    others = long.join(F.broadcast(heavy.select(*key)), key, "left_anti").join(light, key)
    return common.select("key", "stat", "tail").union(others.select("key", "stat", "tail")).withColumnRenamed("key", id_col)


def outliers(stats: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``stats`` with ``score``: the weighted negative logarithms of the tail shares (one row an id)."""
    weight = F.lit(0.0)
    for stat, w in WEIGHTS.items():
        weight = F.when(F.col("stat") == stat, F.lit(w)).otherwise(weight)
    scores = tail_shares(stats, id_col, lean=LEAN).groupBy(id_col).agg(F.sum(-F.ln("tail") * weight).alias("score"))
    return stats.join(scores, id_col)


def cut_off(counts: np.ndarray) -> float | None:
    """Middle of the lowest stretch of scores over which the share of texts above hardly falls; None if there is none.

    ``counts``: different texts in each cell of BIN.
    """
    n = int(counts.sum())
    above = np.append(np.cumsum(counts[::-1])[::-1], 0)
    begin = int(np.searchsorted(-above, -0.6 * n, side="right"))
    best: tuple[float, float] | None = None
    for i in range(max(begin, 1), len(counts)):
        half = max(WINDOW * i, 1.0)
        a, b = round(i - half), min(round(i + half), len(counts))
        if above[b] < BEYOND:
            break
        slope = (np.log(above[a]) - np.log(above[b])) / (b - a) * i
        if slope <= FLAT and (best is None or slope < best[0]):
            best = slope, i * BIN
        elif best and slope > FLAT:
            break
    return best[1] if best else None


def cut_offs(scores: DataFrame) -> dict[str, float]:
    """Cut-off of every language and, as ``*``, of all texts; from histograms of at most 50 ln(texts) cells each."""
    cells = scores.groupBy("lang", F.floor(F.col("score") / BIN).alias("cell")).agg(F.count_distinct("same").alias("n")).toPandas()
    out = {}
    for lang, some in [("*", cells), *cells.groupby("lang")]:
        counts = np.bincount(some["cell"].to_numpy(np.int64), weights=some["n"].to_numpy(float)) if len(some) else np.zeros(1)
        if (at := cut_off(counts)) is not None:
            out[lang] = at
    return out


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """Rows mainly made of a list, a table or junk: outliers by score, the ``check`` of lines following.

    Without ``check`` the score alone decides.
    """
    stats = statistics(df, id_col, text_col).dropDuplicates([id_col])
    scores = cut(outliers(stats, id_col))
    at = cut_offs(scores)
    usual = at.get("*", NO_CLASS / OVERLAP)
    least = F.lit(usual)
    for lang, t in at.items():
        least = F.when(F.col("lang") == lang, F.lit(t)).otherwise(least)
    if not check:
        return scores.where(F.col("score") >= least)
    return scores.where((F.col("score") >= OVERLAP * least) & (F.col("prose") < PROSE_SHARE))
