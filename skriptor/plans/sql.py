"""SQL fragments with the semantics of ``skriptor.functions.text``, for the checks against another engine."""

from __future__ import annotations

from skriptor.functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words_in(values: list[str]) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


STRIP = lit(rf"^[{T.SPACE}]+|[{T.SPACE}]+$")
SENT = lit(T.SENTENCE_END.replace("$", r"\z"))


def strip(x: str) -> str:
    return f"regexp_replace({x}, {STRIP}, '', 'g')"


def sentences(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, {SENT}), lambda s: {strip('s')}), lambda s: s <> '')"


def lines(x: str) -> str:
    p = f"regexp_split_to_array({x}, {lit(T.LINE_END)})"
    return f"(CASE WHEN {x} = '' THEN [] WHEN {p}[-1] = '' THEN {p}[:-2] ELSE {p} END)"


def fold(x: str) -> str:
    return f"replace(replace({x}, 'ё', 'е'), 'Ё', 'Е')"


def all_matches(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, {lit(pattern)})"


def ngrams(w: str, n: int) -> str:
    return f"(CASE WHEN len({w}) >= {n} THEN list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' ')) ELSE [] END)"


def bounded_count(x: str, phrase: str) -> str:
    """Occurrences bounded by words, without look-around: every end of a run of letters is doubled first."""
    body = "".join("\\" + c if c in r".^$*+?()[]{}|\/-" else rf"[{T.SPACE}]+" if c == " " else c for c in phrase)
    spread = f"regexp_replace({x}, {lit(f'([^{T.LETTER}])')}, '\\1\\1', 'g')"
    gap = body.replace(rf"[{T.SPACE}]+", rf"[{T.SPACE}]+")
    return f"len(regexp_extract_all(' ' || {spread} || ' ', {lit(f'[^{T.LETTER}]{gap}[^{T.LETTER}]')}))"


def masked_lines(source: str, key: str) -> str:
    """(key, n, line, masked): masked in front matter and fences; a text has fences of one kind of marker here."""
    return f"""(SELECT {key}, n, line, matter OR fence OR fences % 2 = 1 AS masked FROM (SELECT *, sum(CASE WHEN fence AND NOT matter THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY n) AS fences FROM (
 SELECT *, opened AND (dashes <= 1 OR (dashes = 2 AND dash)) AS matter FROM (
  SELECT *, max(CASE WHEN n = 1 AND dash THEN 1 ELSE 0 END) OVER (PARTITION BY {key}) = 1 AS opened, sum(dash::INT) OVER (PARTITION BY {key} ORDER BY n) AS dashes FROM (
   SELECT {key}, n, line, {strip('line')} = '---' AS dash, regexp_matches(line, {lit(rf'^[{T.SPACE}]*(?:```|~~~)')}) AS fence
   FROM (SELECT {key}, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT {key}, string_split(text, chr(10)) AS l FROM {source} WHERE text IS NOT NULL)))))))"""


def state_lines(source: str, key: str) -> str:
    """(key, n, line) outside front matter and fences."""
    return f"(SELECT {key}, n, line FROM {masked_lines(source, key)} WHERE NOT masked)"


def paragraphs(source: str, key: str) -> str:
    """(key, n, line, para) of filled lines; para is the line on which the paragraph begins."""
    solid = f"{strip('line')} <> ''"
    return f"""(SELECT * FROM (SELECT *, max(CASE WHEN begins THEN n END) OVER (PARTITION BY {key} ORDER BY n) AS para FROM (
 SELECT *, {solid} AND NOT coalesce(lag({solid}) OVER (PARTITION BY {key} ORDER BY n), false) AS begins FROM {state_lines(source, key)})) WHERE {solid})"""
