"""Queries of statistics, style, echo and duplicates over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skriptor.functions import text as T
from skriptor.functions import words as W
from skriptor.operators import dedup, echo, stats, style
from skriptor.plans import sql
from skriptor.session import load_spread as load


def text_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.text_stats(load(spark, d, "documents"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.corpus_stats(text_stats(spark, d))


def source_stats(spark: SparkSession, d: str) -> DataFrame:
    """Words, sentences and texts of each source, with a total row."""
    rows = text_stats(spark, d).join(load(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rows.rollup("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("words").alias("words"), F.sum("sents").alias("sents"), F.grouping("source").cast("int").alias("total"))


def filler_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.filler_counts(load(spark, d, "documents"), fillers=FILLERS)


def filler_totals(spark: SparkSession, d: str) -> DataFrame:
    return stats.filler_totals(filler_counts(spark, d), text_stats(spark, d))


def diary_runs(spark: SparkSession, d: str) -> DataFrame:
    return stats.diary_runs(load(spark, d, "text_stats").dropDuplicates(["stat_id"]))


def diary_days(spark: SparkSession, d: str) -> DataFrame:
    return stats.diary_days(diary_runs(spark, d))


def nearby_repeats(spark: SparkSession, d: str) -> DataFrame:
    return style.nearby_repeats(load(spark, d, "documents"), window=50)


def long_sentences(spark: SparkSession, d: str) -> DataFrame:
    return style.long_sentences(load(spark, d, "documents"), threshold=25)


def echo_all(spark: SparkSession, d: str) -> DataFrame:
    return echo.echo(load(spark, d, "documents"), n=4, min_files=2, top=None).drop("example")


def echo_top(spark: SparkSession, d: str) -> DataFrame:
    return echo.echo(load(spark, d, "documents"), n=3, min_files=2, top=25)


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_duplicates(load(spark, d, "documents"))


def same_names(spark: SparkSession, d: str) -> DataFrame:
    return dedup.same_names(load(spark, d, "obsidian_check").select("note_id", "rel").distinct(), "rel")


def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_pairs(load(spark, d, "documents"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    pages = load(spark, d, "documents").where("ext in ('html', 'htm', '.html', '.htm') and text is not null")
    # the pages hold no entities, so some are added
    return pages.select("doc_id", T.html_to_text(F.concat("text", F.lit(" &eacute;&#1087;&#x41F;&hellip;&amp;lt;&frac12;&none;"))).alias("plain"))


def hashes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where("text is not null").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


FILLERS = [*W.FILLERS_RU, *W.FILLERS_EN, "на пристани", "by the well", "в архиве"]

QUERIES = {f.__name__: f for f in (text_stats, corpus_stats, source_stats, filler_counts, filler_totals, diary_runs, diary_days, nearby_repeats, long_sentences, echo_all, echo_top, exact_duplicates, same_names, near_duplicates, html_text, hashes)}

_STATS = f"""
SELECT doc_id, words, sents, CASE WHEN sents > 0 THEN round(words / sents, 1) ELSE 0.0 END AS avg_sent,
       CASE WHEN n > 0 THEN round(100.0::DOUBLE * spoken / n, 1) ELSE 0.0 END AS dialog_share
FROM (SELECT doc_id, len({sql.all_matches('text', T.COUNT_TOKEN)}) AS words, len({sql.sentences('text')}) AS sents,
             len(list_filter(l, lambda x: {sql.strip('x')} <> '')) AS n,
             len(list_filter(l, lambda x: regexp_matches(x, {sql.lit(stats.DIALOGUE)}))) AS spoken
      FROM (SELECT doc_id, text, {sql.lines('text')} AS l FROM documents WHERE text IS NOT NULL))"""

_FILLER = " UNION ALL ".join(
    f"SELECT doc_id, {sql.lit(f)} AS filler, {sql.bounded_count(sql.fold('lower(text)'), f.replace('ё', 'е'))} AS n, len({sql.all_matches('text', T.COUNT_TOKEN)}) AS w FROM documents WHERE text IS NOT NULL" for f in FILLERS
)
_FILLER = f"SELECT doc_id, filler, n, CASE WHEN w > 0 THEN round(1000.0::DOUBLE * n / w, 1) ELSE 0.0 END AS per_1000 FROM ({_FILLER}) WHERE n > 0"

_RUNS = "SELECT stamp, sum(words)::BIGINT AS words, count(*) AS files FROM (SELECT DISTINCT stat_id, stamp, words FROM text_stats) WHERE stamp IS NOT NULL AND words IS NOT NULL GROUP BY stamp"

_ECHO = """
WITH s AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS no FROM (SELECT doc_id, {sentences} AS ss FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, no, sentence, {words} AS w FROM s),
g AS (SELECT doc_id, no, sentence, unnest({ngrams}) AS ngram FROM w),
k AS (SELECT * FROM g WHERE len(list_filter(string_split(ngram, ' '), lambda x: x NOT IN {stops})) > 0)
SELECT ngram, count(DISTINCT doc_id) AS files, count(*) AS count, min(doc_id) AS example_id{example}
FROM k GROUP BY ngram HAVING count(DISTINCT doc_id) >= 2"""


def _echo(n: int, example: str = "") -> str:
    return _ECHO.format(
        sentences=sql.sentences("text"), words=sql.all_matches(sql.fold("lower(sentence)"), T.ECHO_TOKEN), ngrams=sql.ngrams("w", n), stops=sql.words_in([w.replace("ё", "е") for w in W.ECHO_RU]), example=example
    )


_SHINGLES = f"""
w AS (SELECT doc_id, {sql.all_matches(sql.fold('lower(text)'), '[а-яa-z]+')} AS w FROM documents WHERE text IS NOT NULL),
s0 AS (SELECT doc_id, list_sort(list_distinct({sql.ngrams('w', 5)})) AS s FROM w WHERE len(w) >= 15),
s AS (SELECT min(doc_id) AS id, s FROM s0 GROUP BY s)"""

_STYLE_STOPS = sql.words_in(sorted({w.replace("ё", "е") for w in W.style_stop_words(None)}))
ORACLE = {
    "nearby_repeats": f"""WITH t AS (SELECT doc_id, para, n, left({sql.strip('line')}, 60) AS fragment, unnest(w) AS raw, generate_subscripts(w, 1) AS i FROM (SELECT *, {sql.all_matches('line', T.NAME_TOKEN)} AS w FROM {sql.paragraphs('documents', 'doc_id')})),
p AS (SELECT doc_id, para, n, fragment, {sql.fold('lower(raw)')} AS word, row_number() OVER (PARTITION BY doc_id, para ORDER BY n, i) AS pos FROM t),
g AS (SELECT *, pos - lag(pos) OVER (PARTITION BY doc_id, para, word ORDER BY pos) AS gap FROM p WHERE length(word) >= 3 AND word NOT IN {_STYLE_STOPS}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY para, pos) AS r FROM g WHERE gap <= 50)
SELECT doc_id, para, n AS line_no, word, gap, fragment FROM r WHERE r <= 3""",
    "long_sentences": f"""SELECT doc_id, para, len({sql.all_matches('s', T.NAME_TOKEN)}) AS words, left(s, 100) || CASE WHEN length(s) > 100 THEN '…' ELSE '' END AS start FROM (
SELECT doc_id, para, unnest({sql.sentences('t')}) AS s FROM (SELECT doc_id, para, string_agg({sql.strip('line')}, ' ' ORDER BY n) AS t FROM {sql.paragraphs('documents', 'doc_id')} GROUP BY ALL))
WHERE len({sql.all_matches('s', T.NAME_TOKEN)}) > 25""",
    "html_text": f"""SELECT doc_id, {sql.strip("regexp_replace(regexp_replace(regexp_replace(text0 || ' éпП…&lt;½&none;'" + r", '[ \t\f]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS plain FROM (
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS text0
FROM documents WHERE ext IN ('html', 'htm', '.html', '.htm') AND text IS NOT NULL)""",
    "text_stats": _STATS,
    "corpus_stats": f"SELECT count(*) AS documents, sum(words)::BIGINT AS words, sum(sents)::BIGINT AS sents, round(sum(words) / sum(sents), 1) AS avg_sent, round(avg(dialog_share), 1) AS dialog_share FROM ({_STATS})",
    "source_stats": f"SELECT source, count(*) AS texts, sum(words)::BIGINT AS words, sum(sents)::BIGINT AS sents, grouping(source)::INT AS total FROM ({_STATS}) JOIN documents USING (doc_id) GROUP BY ROLLUP (source)",
    "filler_counts": _FILLER,
    "filler_totals": f"""SELECT filler, sum(n)::BIGINT AS n, count(*) AS documents, round(1000.0::DOUBLE * sum(n) / (SELECT sum(words) FROM ({_STATS})), 1) AS per_1000
FROM ({_FILLER}) GROUP BY filler ORDER BY n DESC, filler LIMIT 12""",
    "diary_runs": _RUNS,
    "diary_days": f"""WITH d AS (SELECT CAST(stamp AS DATE) AS day, arg_max(words, stamp) AS words FROM ({_RUNS}) GROUP BY 1)
SELECT day, words, words - coalesce(lag(words) OVER (ORDER BY day), 0) AS delta, coalesce(date_diff('day', lag(day) OVER (ORDER BY day), day), 0)::INT AS days,
       round((words - lag(words) OVER (ORDER BY day)) / date_diff('day', lag(day) OVER (ORDER BY day), day)::DOUBLE, 0)::BIGINT AS tempo FROM d""",
    "echo_all": _echo(4),
    "echo_top": f"SELECT ngram, files, count, example_id, left(e.sentence, 300) AS example FROM ({_echo(3, ', arg_min(struct_pack(sentence := sentence), doc_id * 100000 + no) AS e')}) ORDER BY files DESC, count DESC, ngram LIMIT 25",
    "exact_duplicates": f"""SELECT hash, count(*) AS copies, min(doc_id) AS first_id FROM (
SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, {sql.lit(f'[{T.SPACE}]+')}), lambda x: x <> ''), chr(10))) AS hash
FROM documents WHERE regexp_matches(text, {sql.lit(f'[^{T.SPACE}]')})) GROUP BY hash HAVING count(*) > 1""",
    "hashes": f"SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, {sql.lit(f'[{T.SPACE}]+')}), lambda x: x <> ''), chr(10))) AS hash FROM documents WHERE text IS NOT NULL",
    "same_names": r"""SELECT stem, ext, count(*) AS files FROM (SELECT lower(regexp_replace(n, '\.[^.]*$', '')) AS stem, lower(regexp_extract(n, '\.([^.]*)$', 1)) AS ext
FROM (SELECT regexp_extract(rel, '[^/]*$') AS n FROM (SELECT DISTINCT note_id, rel FROM obsidian_check) WHERE rel IS NOT NULL)) GROUP BY stem, ext HAVING count(*) > 1""",
    "near_duplicates": f"""WITH {_SHINGLES}, e AS (SELECT id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT x.id AS a, y.id AS b, x.n + y.n AS n, count(*) AS c FROM e x JOIN e y ON x.t = y.t AND x.id < y.id GROUP BY ALL)
SELECT a, b, round(c / (n - c), 2) AS jaccard FROM p WHERE c * 10 >= (n - c) * 7""",
}
