"""Queries of character audits and of the link graph over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skriptor.functions import links as L
from skriptor.operators import chars, links
from skriptor.plans import sql
from skriptor.session import load_spread as load


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "obsidian_check").dropDuplicates(["note_id"])


def char_findings(spark: SparkSession, d: str) -> DataFrame:
    return chars.char_findings(load(spark, d, "documents"))


def range_counts(spark: SparkSession, d: str) -> DataFrame:
    return chars.range_counts(chars.char_findings(_notes(spark, d), "note_id"))


def ai_traces(spark: SparkSession, d: str) -> DataFrame:
    return chars.ai_traces(_notes(spark, d), "note_id")


def stripped_notes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return _notes(spark, d).where(c.isNotNull()).select("note_id", F.md5(chars.strip_invisible(c)).alias("visible"), F.md5(chars.strip_emoji(c)).alias("no_emoji"), F.md5(chars.whitelist(c)).alias("listed"))


def integrity(spark: SparkSession, d: str) -> DataFrame:
    return chars.integrity(load(spark, d, "documents"))


def _keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    notes = _notes(spark, d)
    files = load(spark, d, "vault_attachments").where("vault is not null").select(F.col("vault").alias("grp"), "file_name", "rel")
    return links.edges(notes, markdown=True), links.note_keys(notes), files


def note_links(spark: SparkSession, d: str) -> DataFrame:
    return links.edges(_notes(spark, d), markdown=True).select("note", "target").distinct()


def broken_links(spark: SparkSession, d: str) -> DataFrame:
    return links.broken_links(*_keys(spark, d)).select("note", "kind", "target")


def orphan_notes(spark: SparkSession, d: str) -> DataFrame:
    e, k, _ = _keys(spark, d)
    return links.orphan_notes(e.where("kind = 'wiki'"), k).select("note")


def backlinks(spark: SparkSession, d: str) -> DataFrame:
    e, k, _ = _keys(spark, d)
    return links.backlinks(e.where("kind = 'wiki'"), k)


QUERIES = {f.__name__: f for f in (char_findings, range_counts, ai_traces, stripped_notes, integrity, note_links, broken_links, orphan_notes, backlinks)}

_NOTES = "(SELECT DISTINCT note_id, vault, rel, stem, text FROM obsidian_check)"


def _ranges() -> str:
    return "(VALUES " + ", ".join(f"({i}, {sql.lit(n)}, {sql.lit(p)}, {str(s).lower()})" for i, (n, p, s) in enumerate(chars.RANGES)) + ") AS r(ord, range_name, pattern, skip)"


def _findings(source: str, key: str) -> str:
    tests = " ".join(f"WHEN {i} THEN regexp_extract(body, {sql.lit(p)})" for i, (_, p, _s) in enumerate(chars.RANGES))
    points = "array_to_string(list_transform(string_split(glyph, ''), lambda c: 'U+' || lpad(upper(hex(ord(c))), 4, '0')), ' ')"
    return f"""
SELECT {key}, line_no, (instr(body, glyph) + CASE WHEN exempt THEN 1 ELSE 0 END)::INT AS col, glyph, codepoints, range_name, context FROM (
 SELECT *, {points.replace('upper(hex(ord(c)))', "printf('%X', ord(c))")} AS codepoints, row_number() OVER (PARTITION BY {key} ORDER BY line_no, ord) AS rn FROM (
  SELECT *, CASE ord {tests} END AS glyph FROM (
   SELECT {key}, line_no, line, left({sql.strip('line')}, 140) AS context, ord, range_name, skip AND line_no = 1 AND line[1] = chr(65279) AS exempt,
          CASE WHEN skip AND line_no = 1 AND line[1] = chr(65279) THEN line[2:] ELSE line END AS body
   FROM (SELECT {key}, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (SELECT {key}, {sql.lines('text')} AS l FROM {source} WHERE text IS NOT NULL)), {_ranges()})
  WHERE glyph <> '')) WHERE rn <= {chars.FINDINGS_CAP}"""


_N = lambda x, p: f"len({sql.all_matches(x, p)})"
_TRACES = ", ".join(f"{_N('text', p)} AS {k}" for k, p in chars.TRACES.items())
_BLANK = r'[ \t\x0b-\r\x{a0}\x{2000}-\x{200a}\x{3000}]*\n'
_CODE = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?ms)^[ \t]*```[^\n]*(?:\n.*?^[ \t]*```[`~]*[ \t]*$|.*\z)', chr(1), 'g'), '(?m)(?:\A|^{_BLANK})(?:{_BLANK})* {{4}}[^\n]*(?:\n|\z)(?: {{4}}[^\n]*(?:\n|\z)|{_BLANK})*', chr(10), 'g'), '`[^`]*`', '', 'g')"
_FINISH = r"trim(regexp_replace(lower(trim(regexp_replace(replace({x}, '\', '/'), '[\x{{a0}}\s]+', ' ', 'g'))), '\.md$', ''))"
_WIKI = f"list_transform(regexp_extract_all(t, {sql.lit(L.WIKI)}, 1), lambda x: {_FINISH.format(x=chr(39).join(['regexp_extract(x, ', '^[^|#]*', ')']))})"
_INNER = r"CASE WHEN regexp_matches(trim(x), '^<.*>$') THEN regexp_replace(trim(x), '^<|>$', '', 'g') ELSE trim(x) END"
_MD = (
    r"list_transform(list_filter(list_transform(regexp_extract_all(t, '(?:^|[^\[])\[(?:[^\[\]\n]|\[[^\[\]\n]*\])*\]\((<[^<>\n]*>|(?:[^()\n]|\([^()\n]*\))*)\)', 1), lambda x: "
    + _INNER
    + f"), lambda y: NOT regexp_matches(y, {sql.lit(L.SCHEME)})), lambda y: "
    + _FINISH.format(x="url_decode(regexp_extract(y, '^[^|#]*'))")
    + ")"
)


def _edges(found: str, kind: str) -> str:
    folder = "lower(regexp_extract(coalesce(rel, ''), '^(.*)/[^/]*$', 1))"
    return f"SELECT DISTINCT note_id AS note, vault AS grp, {folder} AS folder, '{kind}' AS kind, unnest({found}) AS target FROM (SELECT note_id, vault, rel, {_CODE} AS t FROM {_NOTES} WHERE vault IS NOT NULL AND text IS NOT NULL)"


_WIKI_EDGES = f"SELECT *, trim(regexp_extract(target, '[^/]*$')) AS base FROM ({_edges(_WIKI, 'wiki')}) WHERE target <> ''"
_ALL_EDGES = f"SELECT *, trim(regexp_extract(target, '[^/]*$')) AS base FROM ({_edges(_WIKI, 'wiki')} UNION ALL {_edges(_MD, 'markdown')}) WHERE target <> ''"
_PLACE = "list_reduce(string_split(CASE WHEN starts_with(target, '/') THEN target ELSE folder || '/' || target END, '/'), lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/?[^/]*$', '') WHEN x IN ('', '.') THEN acc WHEN acc = '' THEN x ELSE acc || '/' || x END, '')"
_KEYS = f"SELECT vault AS grp, regexp_replace(lower(rel), '\\.md$', '') AS path, lower(stem) AS stem, note_id AS note FROM {_NOTES} WHERE vault IS NOT NULL"
_GRAPH = f"""WITH l AS ({_WIKI_EDGES}), k AS ({_KEYS}), p AS (SELECT grp, path, min(note) AS p FROM k GROUP BY ALL), s AS (SELECT grp, stem, min(note) AS s FROM k GROUP BY ALL),
e AS (SELECT DISTINCT note AS src, coalesce(p.p, s.s) AS dst FROM l LEFT JOIN p ON l.grp = p.grp AND l.target = p.path LEFT JOIN s ON l.grp = s.grp AND l.base = s.stem WHERE coalesce(p.p, s.s) IS NOT NULL)"""

ORACLE = {
    "char_findings": _findings("documents", "doc_id"),
    "range_counts": f"SELECT range_name, count(*) AS findings, count(DISTINCT note_id) AS texts FROM ({_findings(_NOTES, 'note_id')}) GROUP BY range_name",
    "ai_traces": f"SELECT * FROM (SELECT note_id, {_TRACES}, {_N('text', chars.MIXED_WORD)} AS mixed_words FROM {_NOTES} WHERE text IS NOT NULL) WHERE {' + '.join([*chars.TRACES, 'mixed_words'])} > 0",
    "stripped_notes": f"""SELECT note_id,
md5(regexp_replace(regexp_replace(text, {sql.lit('|'.join(chars.TRACES[k] for k in ('zero_width', 'soft_hyphen', 'bidi', 'tag')))}, '', 'g'), {sql.lit(chars.TRACES['odd_space'])}, ' ', 'g')) AS visible,
md5(regexp_replace(text, {sql.lit(' ?' + chars.EMOJI + '+')}, '', 'g')) AS no_emoji,
md5(regexp_replace(text, {sql.lit('[^' + r'\r\n\t\x{20}-\x{7e}А-ЯЁа-яё«»„“”’‘—–…№§°' + ']')}, '', 'g')) AS listed
FROM {_NOTES} WHERE text IS NOT NULL""",
    "integrity": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, string_split(regexp_replace(coalesce(text, ''), '^\\x{{feff}}', ''), chr(10)) AS l FROM documents)
SELECT doc_id, 'EMPTY' AS issue FROM t WHERE text = ''
UNION ALL SELECT doc_id, 'FRONT_MATTER_OPEN' FROM t WHERE text <> '' AND {sql.strip('l[1]')} = '---' AND NOT list_contains(list_transform(l[2:50], lambda x: {sql.strip('x')}), '---')
UNION ALL SELECT doc_id, 'NO_HEADING' FROM t WHERE text <> '' AND len(list_filter(l, lambda x: starts_with(x, '## '))) = 0""",
    "note_links": f"SELECT DISTINCT note, target FROM ({_ALL_EDGES})",
    "broken_links": f"""WITH l AS (SELECT *, CASE WHEN kind = 'markdown' THEN {_PLACE} END AS place FROM ({_ALL_EDGES})), k AS ({_KEYS})
SELECT DISTINCT note, kind, target FROM l WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.grp = l.grp AND k.path = l.target) AND NOT EXISTS (SELECT 1 FROM k WHERE k.grp = l.grp AND k.stem = l.base)
AND NOT EXISTS (SELECT 1 FROM vault_attachments a WHERE a.vault = l.grp AND lower(a.file_name) = l.base)
AND NOT EXISTS (SELECT 1 FROM k WHERE k.grp = l.grp AND k.path = l.place) AND NOT EXISTS (SELECT 1 FROM vault_attachments a WHERE a.vault = l.grp AND lower(a.rel) = l.place)""",
    "orphan_notes": _GRAPH + " SELECT DISTINCT note FROM k WHERE note NOT IN (SELECT note FROM l) AND note NOT IN (SELECT dst FROM e WHERE src <> dst)",
    "backlinks": _GRAPH + """ SELECT n.note, coalesce(i.c, 0) AS incoming, coalesce(o.c, 0) AS outgoing FROM (SELECT DISTINCT note FROM k) n
LEFT JOIN (SELECT dst, count(*) AS c FROM e WHERE src <> dst GROUP BY 1) i ON n.note = i.dst LEFT JOIN (SELECT src, count(*) AS c FROM e WHERE src <> dst GROUP BY 1) o ON n.note = o.src""",
}

_ALL_NOTES = "(SELECT DISTINCT note_id, vault, stem, text, created_at, deleted_at FROM obsidian_check)"
DEAD = f"""WITH r AS (SELECT DISTINCT note_id, grp, made, target, trim(regexp_extract(target, '[^/]*$')) AS key FROM (
 SELECT note_id, vault AS grp, created_at AS made, unnest(list_concat({_WIKI}, {_MD})) AS target FROM (SELECT note_id, vault, created_at, {_CODE} AS t FROM {_ALL_NOTES} WHERE vault IS NOT NULL AND text IS NOT NULL AND created_at IS NOT NULL)) WHERE target <> ''),
p AS (SELECT vault AS grp, lower(trim(stem)) AS key, created_at AS born, deleted_at AS gone FROM {_ALL_NOTES} UNION ALL SELECT vault, lower(trim(file_name)), added_at, removed_at FROM vault_attachments)
SELECT note_id, CASE WHEN regexp_matches(target, '\\.[a-z0-9]*[a-z][a-z0-9]*$') THEN 'vault_attachments' ELSE 'obsidian_check' END AS ref_table, target AS ref_target, strftime(made, '%Y-%m') AS ref_month
FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.grp = r.grp AND p.key = r.key AND p.born <= r.made AND (p.gone IS NULL OR p.gone > r.made))"""
