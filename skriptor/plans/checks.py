"""Queries of single checks and repairs over the test tables; their SQL is written from what the checks are meant to
find and takes no pattern from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skriptor.functions import text as T
from skriptor.operators import chars, clean, links, markdown, registry, rules
from skriptor.plans import prose, sql
from skriptor.session import load_spread as load
from skriptor.sources import files

ICONS = {"—": "<i class=dash></i>", "…": "<i class=dots></i>", "««": "<i></i>", "«": "<q>", "»": "</q>"}


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents")


def control_pass(spark: SparkSession, d: str) -> DataFrame:
    return rules.control_pass(_docs(spark, d), prose.RULES)


def yo_occurrences(spark: SparkSession, d: str) -> DataFrame:
    found = rules.yo_occurrences(_docs(spark, d), targets=rules.yo_targets(prose.YO))
    return found.groupBy("doc_id", "line_no", F.lower("found").alias("found"), "right", "cat").agg(F.count(F.lit(1)).alias("n"))


def bad_unicode(spark: SparkSession, d: str) -> DataFrame:
    return chars.bad_unicode(_docs(spark, d))


def foreign_stripped(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(chars.strip_foreign(F.col("text"))).alias("stripped"))


def icons_replaced(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(clean.replace_icons(F.col("text"), ICONS)).alias("replaced"))


def unlisted_forms(spark: SparkSession, d: str) -> DataFrame:
    entries = load(spark, d, "name_registry").dropDuplicates(["entry_id"])
    each = registry.unlisted_forms(entries).select("entity", "field", F.explode("missing").alias("form"))
    return each.groupBy("field", "form").agg(F.count(F.lit(1)).alias("entries"))


def declined_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Single-word names in any case among the listed forms of their vault's entries."""
    entries = load(spark, d, "name_registry").dropDuplicates(["entry_id"])
    listed = registry.terms(entries, {"name": "ok"}, group_col="vault").where("term rlike '^[а-я]+$'")
    texts = entries.select("entry_id", "vault", F.array_join("forms", ". ").alias("text"))
    return registry.entity_matrix(registry.mentions(texts, registry.inflected(listed), "entry_id", group_col="vault"), "entry_id")


def newest_backups(spark: SparkSession, d: str) -> DataFrame:
    notes = load(spark, d, "obsidian_check").where("rel is not null and created_at is not null").select("rel", "created_at").distinct()
    place = F.concat(F.lit("/v/md_replace_backups/"), F.date_format("created_at", "yyyyMMdd"), F.lit("/"), "rel")
    return files.newest_backups(notes.select(place.alias("path"))).select("original", "backup")


def corpora(spark: SparkSession, d: str) -> DataFrame:
    notes = load(spark, d, "obsidian_check").dropDuplicates(["note_id"])
    both = files.union_corpora(notes, _docs(spark, d).withColumn("ext", F.regexp_replace("ext", r"^\.", "")))
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("characters"))


def line_checks(spark: SparkSession, d: str) -> DataFrame:
    """The validator's findings but for those on the values of front matter."""
    return prose.note_checks(spark, d).where("code not in ('FM_YAML', 'FM_DESC', 'FM_TAGS')").distinct()


def heading_checks(spark: SparkSession, d: str) -> DataFrame:
    found = markdown.validate(_docs(spark, d), id_col="doc_id").where("code like 'H\\\\_%' or code like 'TBL%' or code in ('TAG_NUMERIC', 'BAD_SEP')")
    return found.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


BROKEN = "---\ndescription: one: two\nlinks: [[A]], [[B]]\ntags: [a]\n---\n| a | b |\n| - | - |\n| `x|y` | 1 |\n| `x|y` | 1 | 2 |\n\n"
MENDED = "---\ndescription: \"one: two\"\nlinks:\n  - \"[[A]]\"\n  - \"[[B]]\"\ntags: [a]\n---\n| a | b |\n| - | - |\n| `x\\|y` | 1 |\n| `x|y` | 1 | 2 |\n\n"


def repaired_notes(spark: SparkSession, d: str) -> DataFrame:
    """The notes hold no such defects, so some are put before each."""
    notes = load(spark, d, "obsidian_check").dropDuplicates(["note_id"]).where("text is not null")
    return markdown.repaired(notes.withColumn("text", F.concat(F.lit(BROKEN), "text"))).select("note_id", F.md5("text_new").alias("text_new"))


def encodings(spark: SparkSession, d: str) -> DataFrame:
    """Texts as bytes of their own encoding, audited."""
    raw = _docs(spark, d).where("text is not null").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode(F.col("text"), "utf-8").alias("content"))
    return files.encoding_audit(files.decoded(raw))


QUERIES = {
    f.__name__: f
    for f in (control_pass, yo_occurrences, bad_unicode, foreign_stripped, icons_replaced, unlisted_forms, declined_mentions, newest_backups, corpora, line_checks, heading_checks, repaired_notes, encodings)
}

_WORD = r"\p{L}\p{M}\p{N}\p{Pc}"
_HITS = " UNION ALL ".join(f"SELECT {sql.lit(r.level)} AS level, len(regexp_extract_all({{t}}, {sql.lit('(?i)' + r.source)})) AS n FROM documents" for r in prose.RULES)


def _yo_lines() -> str:
    """Words of each line that are one of the spellings."""
    listed = ", ".join(f"({sql.lit(w.lower())}, {sql.lit(r)}, {sql.lit(c)})" for w, r, c in rules.yo_targets(prose.YO))
    lines = f"SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, {sql.lines('text')} AS l FROM documents WHERE text IS NOT NULL)"
    return f"""WITH t(w, r, c) AS (VALUES {listed}), w AS (SELECT doc_id, n, lower(unnest(regexp_extract_all(line, '[{_WORD}]+'))) AS word FROM ({lines}))
SELECT doc_id, n AS line_no, word AS found, r AS "right", c AS cat, count(*) AS n FROM w JOIN t ON word = t.w GROUP BY ALL"""


# where a code point may stand in a text: ranges as plain numbers
_BAD = "\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f-\\x{84}\\x{86}-\\x{9f}", "\\x{fffd}", "\\x{fdd0}-\\x{fdef}\\x{fffe}\\x{ffff}", "\\x{e000}-\\x{f8ff}\\x{f0000}-\\x{ffffd}", "\\x{2028}\\x{2029}"
_KINDS = ("control", "replacement", "noncharacter", "private use", "line separator")
_FOREIGN = "[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{f900}-\\x{faff}\\x{3000}-\\x{30ff}\\x{ff00}-\\x{ffef}\\x{ac00}-\\x{d7af}\\x{1100}-\\x{11ff}\\x{590}-\\x{6ff}\\x{e00}-\\x{e7f}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{206f}]|[ÐÑÂÃ][\\x{80}-\\x{bf}]|â€[\\x{90}-\\x{bf}\\x{2018}-\\x{2122}]"
_LINES = "(SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
_ICONS = "text"
for _k in sorted(ICONS, key=lambda x: (-len(x), x)):
    _ICONS = f"replace({_ICONS}, {sql.lit(_k)}, {sql.lit(ICONS[_k])})"

# headings, tables, tags and links of notes, line by line
_BLANK = r"[\t\x0b-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NOTES = "(SELECT DISTINCT note_id, vault, rel, stem, text FROM obsidian_check)"


def _line_checks(source: str, key: str, links_sql: str = "") -> str:
    cells = lambda x: f"(1 + length(regexp_replace(regexp_replace(trim({x}), '\\\\.', 'xx', 'g'), '[^|]', '', 'g')) - CASE WHEN starts_with(trim({x}), '|') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(trim({x}), '[^\\\\]\\|$') THEN 1 ELSE 0 END)"
    bare = "regexp_replace(line, '`[^`]*`', '', 'g')"
    return f"""u AS (SELECT {key}, n, line, masked FROM {sql.masked_lines(source, key)} WHERE NOT masked),
h AS (SELECT {key}, n, line, length(regexp_extract(line, '^(#{{1,6}})(?:{_BLANK}|$)', 1)) AS level FROM u WHERE starts_with(line, '#')),
full_h AS (SELECT *, lag(level) OVER (PARTITION BY {key} ORDER BY n) AS before FROM h WHERE level > 0 AND {sql.strip('line[level + 1:]')} <> ''),
tl AS (SELECT {key}, n, line, n - row_number() OVER (PARTITION BY {key} ORDER BY n) AS g FROM u WHERE starts_with(regexp_replace(line, '^{_BLANK}+', ''), '|')),
tb AS (SELECT *, row_number() OVER (PARTITION BY {key}, g ORDER BY n) AS i, count(*) OVER (PARTITION BY {key}, g) AS size, {cells('line')} AS cols, {cells(bare)} AS bare FROM tl),
tw AS (SELECT *, max(CASE WHEN i = 1 THEN cols END) OVER (PARTITION BY {key}, g) AS want FROM tb WHERE size > 1),
s1 AS (SELECT {key}, n, line, n - row_number() OVER (PARTITION BY {key} ORDER BY n) AS g FROM u WHERE length(line) <= 1),
f AS (SELECT {key}, n, 'H_NO_SPACE' AS code FROM h WHERE level = 0 AND regexp_matches(line, '^#{{1,6}}[^#{_BLANK[1:-1]}]') AND NOT regexp_matches(line, '^#[{_WORD}/-]+(?:{_BLANK}|$)')
UNION ALL SELECT {key}, n, 'H_EMPTY' FROM h WHERE level > 0 AND {sql.strip('line[level + 1:]')} = ''
UNION ALL SELECT {key}, n, 'H_JUMP' FROM full_h WHERE level > before + 1
UNION ALL SELECT {key}, 0, 'H_MULTI_H1' FROM full_h WHERE level = 1 GROUP BY {key} HAVING count(*) > 1
UNION ALL SELECT {key}, n, 'BAD_SEP' FROM tw WHERE i = 2 AND NOT regexp_matches(line, '^\\s*\\|?\\s*:?-+:?\\s*(\\|\\s*:?-+:?\\s*)*\\|?\\s*$')
UNION ALL SELECT {key}, n, CASE WHEN bare = want THEN 'TBL_PIPE_IN_CODE' ELSE 'TBL_COLS' END FROM tw WHERE i > 1 AND cols <> want AND NOT (i = 2 AND NOT regexp_matches(line, '^\\s*\\|?\\s*:?-+:?\\s*(\\|\\s*:?-+:?\\s*)*\\|?\\s*$'))
UNION ALL SELECT {key}, n, 'TAG_NUMERIC' FROM (SELECT {key}, n, unnest(regexp_extract_all({bare}, '(?:^|[\\s,;()\\[\\]{{}}<>!?''"])#(\\d+)[.:]*(?:$|[\\s,;()\\[\\]{{}}<>!?''"])', 1)) FROM u)
UNION ALL SELECT {key}, min(n), 'EXPLODED' FROM s1 GROUP BY {key}, g HAVING count(*) >= 40 AND count(*) FILTER (length(line) = 1) >= 20 AND count(*) FILTER ({sql.strip('line')} <> '') * 10 >= count(*) FILTER (length(line) = 1) * 6{links_sql})"""


_SEVERITY = "CASE WHEN code IN ('FM_UNCLOSED', 'FENCE_UNCLOSED', 'BAD_SEP', 'TBL_COLS', 'TBL_PIPE_IN_CODE', 'H_NO_SPACE', 'EXPLODED') THEN 'ERROR' WHEN code IN ('H_MULTI_H1', 'H_JUMP', 'TAG_NUMERIC', 'WIKI_EMPTY') THEN 'INFO' ELSE 'WARN' END"
_CLEAN = r"trim(regexp_replace(lower(trim(regexp_replace(replace({x}, '\', '/'), '[\x{{a0}}\s]+', ' ', 'g'))), '\.md$', ''))"
_LINKED = rf"""
UNION ALL SELECT note_id, n, 'FM_UNCLOSED' FROM (SELECT note_id, 1 AS n, list_slice(string_split(regexp_replace(text, '^\x{{feff}}', ''), chr(10)), 1, 201) AS l FROM {_NOTES} WHERE regexp_matches(text, '^\x{{feff}}?---[ \t\r]*\n')) WHERE len(list_filter(l[2:], lambda x: {sql.strip('x')} IN ('---', '...'))) = 0
UNION ALL SELECT note_id, max(n), 'FENCE_UNCLOSED' FROM {sql.masked_lines("(SELECT note_id, text || chr(10) || chr(1) AS text FROM " + _NOTES + ")", 'note_id')} GROUP BY note_id HAVING arg_max(masked, n) AND count(*) FILTER (regexp_matches(line, '^{_BLANK}*(?:```|~~~)')) > 0
UNION ALL SELECT note_id, n, 'WIKI_EMPTY' FROM w WHERE (target = '' AND NOT starts_with(raw, '#')) OR target IN ('...', '…')
UNION ALL SELECT note_id, n, CASE WHEN kind = 'markdown' THEN 'MDLINK_BROKEN' WHEN contains(base, '.') THEN 'WIKI_ATTACH_MISSING' ELSE 'WIKI_BROKEN' END FROM lost"""


_WHOLE = "".join(
    part.replace("note_id", "doc_id").replace("(SELECT DISTINCT doc_id, vault, rel, stem, text FROM obsidian_check)", "documents")
    for part in _LINKED.partition("\nUNION ALL SELECT note_id, n, 'WIKI_EMPTY'")[:1]
) + """
UNION ALL SELECT doc_id, n, 'WIKI_EMPTY' FROM (SELECT doc_id, n, unnest(regexp_extract_all(regexp_replace(line, '`[^`]*`', '', 'g'), '\\[\\[([^\\[\\]\\n]*)\\]\\]', 1)) AS raw FROM u) WHERE regexp_matches(raw, '^\\s*(?:\\|.*)?$|^\\s*(?:\\.\\.\\.|…)\\s*(?:[|#].*)?$')"""


def _note_line_checks() -> str:
    from skriptor.plans import vault

    bare = "regexp_replace(line, '`[^`]*`', '', 'g')"
    md = vault._MD.replace("regexp_extract_all(t,", f"regexp_extract_all({bare},")
    body = _line_checks(_NOTES, "note_id", _LINKED)
    head, rest = body.split("\nh AS (", 1)
    links_sql = f"""
w AS (SELECT note_id, n, raw, {_CLEAN.format(x="regexp_extract(raw, '^[^|#]*')")} AS target FROM (SELECT note_id, n, unnest(regexp_extract_all({bare}, '\\[\\[([^\\[\\]\\n]*)\\]\\]', 1)) AS raw FROM u)),
a AS (SELECT note_id, n, 'wiki' AS kind, target FROM w WHERE target NOT IN ('', '…') AND NOT contains(target, '..') UNION ALL SELECT note_id, n, 'markdown', target FROM (SELECT note_id, n, unnest({md}) AS target FROM u) WHERE target <> ''),
l AS (SELECT a.*, vault AS grp, lower(regexp_extract(coalesce(rel, ''), '^(.*)/[^/]*$', 1)) AS folder, trim(regexp_extract(target, '[^/]*$')) AS base FROM a JOIN {_NOTES} USING (note_id) WHERE vault IS NOT NULL),
p AS (SELECT *, CASE WHEN kind = 'markdown' THEN {vault._PLACE} END AS place FROM l),
k AS ({vault._KEYS}),
lost AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.grp = p.grp AND k.path = p.target) AND NOT EXISTS (SELECT 1 FROM k WHERE k.grp = p.grp AND k.stem = p.base)
AND NOT EXISTS (SELECT 1 FROM vault_attachments x WHERE x.vault = p.grp AND lower(x.file_name) = p.base)
AND NOT EXISTS (SELECT 1 FROM k WHERE k.grp = p.grp AND k.path = p.place) AND NOT EXISTS (SELECT 1 FROM vault_attachments x WHERE x.vault = p.grp AND lower(x.rel) = p.place)),
h AS ("""
    return f"WITH {head}{links_sql}{rest} SELECT note_id, n::INT AS line_no, code, {_SEVERITY} AS severity FROM f"


def _undescribed(source: str, key: str) -> str:
    """FM_DESC: front matter that is closed within 200 lines and has no description."""
    lines = f"SELECT {key}, list_slice(string_split(regexp_replace(text, '^\\x{{feff}}', ''), chr(10)), 1, 201) AS l FROM {source} WHERE regexp_matches(text, '^\\x{{feff}}?---[ \\t\\r]*\\n')"
    closed = f"SELECT {key}, l, list_position(list_transform(l[2:], lambda x: {sql.strip('x')} IN ('---', '...')), true) AS e FROM ({lines})"
    return f"SELECT {key}, 1 AS line_no, 'FM_DESC' AS code, 'WARN' AS severity FROM ({closed}) WHERE e IS NOT NULL AND len(list_filter(l[2:e], lambda x: regexp_matches(x, '^description:\\s*[^\\s#]'))) = 0"


def _rolled(found: str, key: str) -> str:
    return f"SELECT severity, code, count(*) AS n, count(DISTINCT {key}) AS notes FROM ({found}) GROUP BY ROLLUP (severity, code)"


def _audit(checks: str) -> str:
    """All parts over the notes, under the name that their SQL reads."""
    from skriptor.plans import corpus, vault

    hits = "SELECT level, count(*) AS n FROM (" + prose.RULE_HITS + ") GROUP BY level"
    return f"""WITH documents AS (SELECT note_id AS doc_id, text FROM {_NOTES}), p(ord, tool, serious_n, other_n) AS (
SELECT 1, 'validator', count(*) FILTER (severity = 'ERROR'), count(*) FILTER (severity <> 'ERROR') FROM ({checks})
UNION ALL SELECT 2, 'characters', count(*), 0 FROM ({vault.ORACLE['char_findings']})
UNION ALL SELECT 3, 'integrity', count(*), 0 FROM ({vault.ORACLE['integrity']})
UNION ALL SELECT 4, 'duplicates', (SELECT count(*) FROM ({corpus.ORACLE['exact_duplicates']})) + (SELECT count(*) FROM ({corpus.ORACLE['same_names']})), (SELECT count(*) FROM ({corpus.ORACLE['near_duplicates']}))
UNION ALL SELECT 5, 'phrases', 0, coalesce(sum(total), 0)::BIGINT FROM ({prose.ORACLE['phrase_totals']})
UNION ALL SELECT 6, 'rules', coalesce(sum(n) FILTER (level = 'hard'), 0)::BIGINT, coalesce(sum(n) FILTER (level = 'soft'), 0)::BIGINT FROM ({hits}))
SELECT ord::INT AS ord, tool, serious_n::BIGINT AS serious_n, other_n::BIGINT AS other_n, ord <= 3 AND serious_n > 0 AS serious FROM p
UNION ALL SELECT 7, 'total', sum(serious_n)::BIGINT, sum(other_n)::BIGINT, bool_or(ord <= 3 AND serious_n > 0) FROM p"""


# declension by the ending of the last word, the first line that fits counts
_ENDINGS = [
    ("[гкх]ий", 2, "ого ому им ом"), ("[жчшщ]ий", 2, "его ему им ем"), ("ний", 2, "его ему им ем"), ("[^аеёиоуыэюя][ыо]й", 2, "ого ому ым ом"), ("[^аеёиоуыэюя]ая", 2, "ой ую"), ("няя", 2, "ей юю"),
    ("(?:[оеё]в|[иы]н)а", 1, "ой у"), ("[^аеёиоуыэюя](?:[оеё]в|[иы]н)", 0, "а у ым е"), ("ия", 1, "и ю ей"), ("[гкх]а", 1, "и е у ой"), ("[жчшщц]а", 1, "и е у ей"), ("[^аеёиоуыэюя]а", 1, "ы е у ой"),
    ("я", 1, "и е ю ей"), ("ий", 1, "я ю ем и"), ("[аеоуэыя]й", 1, "я ю ем е"), ("ь", 1, "я ю ем е"), ("[жчшщц]", 0, "а у ем е"), ("[бвгдзклмнпрстфх]", 0, "а у ом е"),
]
_FORMS = "CASE " + " ".join(f"WHEN regexp_matches(z, '^[а-яё]{{3,}}$') AND regexp_matches(z, '(?:{e})$') THEN list_transform([{', '.join(sql.lit(x) for x in own.split())}], lambda e: z[1:length(z) - {c}] || e)" for e, c, own in _ENDINGS) + " ELSE [] END"
_UNLISTED = f"""WITH e AS (SELECT entry_id, lower({sql.strip('name')}) AS name, [lower(trim(x)) for x in coalesce(forms, [])] AS f1, [lower(trim(x)) for x in coalesce(old_forms, [])] AS f2,
 [lower(trim(x)) for x in coalesce(typos, [])] AS f3, [lower(trim(x)) for x in coalesce(old_dangerous, [])] AS f4 FROM (SELECT DISTINCT ON (entry_id) * FROM name_registry) WHERE regexp_matches(name, '\\S')),
l AS (SELECT entry_id, 1 AS o, 'forms' AS field, unnest(f1) AS t FROM e UNION ALL SELECT entry_id, 2, 'old_forms', unnest(f2) FROM e UNION ALL SELECT entry_id, 3, 'typos', unnest(f3) FROM e),
z AS (SELECT *, regexp_extract(t, '([^\\s]+)$', 1) AS z FROM l),
x AS (SELECT DISTINCT entry_id, o, field, t[1:length(t) - length(z)] || unnest({_FORMS}) AS form FROM z WHERE z <> ''),
y AS (SELECT entry_id, form, min(o) AS o, arg_min(field, o) AS field FROM x GROUP BY ALL)
SELECT field, form, count(*) AS entries FROM y JOIN e USING (entry_id) WHERE NOT list_contains(list_concat([e.name], f1, f2, f3, f4), form) GROUP BY ALL"""


def _between(x: str, left: str, what: str, right: str, image: str, times: int = 2) -> str:
    """What stands between two contexts replaced; again, since a context is used up by a match."""
    for _ in range(times):
        x = f"regexp_replace({x}, {sql.lit(f'({left}){what}({right})')}, {sql.lit(chr(92) + '1' + image + chr(92) + '2')}, 'g')"
    return x


def _typography() -> str:
    space = r"\t\x0b-\r \n\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    solid, ru, alone, digit = f"[^{space}]", "[А-Яа-яЁё]", rf"^|[^{_WORD}-]", r"\p{Nd}"
    x = _between("s", alone, r"т\.", r"[дпченко]\.", "т. ")
    x = _between(x, solid, " +", r"[,.;:!?…](?:[^)]|$)", "")
    x = _between(x, "[,;]", "", "[А-Яа-яЁё«(]", " ", 1)
    x = _between(x, "[.!?…]", "", r"[А-ЯЁ«—]|\([^)]|\($", " ")
    x = _between(x, solid, " {2,}", f"[^{space}|]", " ")
    x = _between(x, "[?!]", r"\.{3,}", "", "..", 1)
    x = f"regexp_replace({x}, '\\.{{3,}}', '…', 'g')"
    x = _between(x, solid, " - ", solid, " — ")
    x = _between(x, solid, "(?: -- |--)", solid, " — ")
    x = _between(x, f"[{space}]", "—", solid, "— ")
    x = _between(_between(x, digit + "{4}", "-", digit + "{4}", "—"), digit, "–", digit, "—")
    first = _between(x, f"^[{space}]*", "- ", solid, "— ", 1)
    single = "regexp_replace(s, '„([^“\"]*)“', '«\\1»', 'g')"
    fits = f"""len(p) > 1 AND len(p) % 2 = 1 AND NOT contains(q, '=') AND NOT regexp_matches(q, 'https?://|www\\.|\\]\\(') AND len(list_filter(p, lambda y, i: i % 2 = 0 AND NOT regexp_matches(y, '{ru}'))) = 0"""
    quotes = f"""(SELECT CASE WHEN {fits} AND contains(q, '«') THEN regexp_replace(q, '"([^"]*)"', '„\\1“', 'g') WHEN {fits} THEN regexp_replace(q, '"([^"]*)"', '«\\1»', 'g') ELSE q END FROM (SELECT q, string_split(q, '"') AS p FROM (SELECT {single} AS q)))"""
    y = _between(_between("s", "[«„]", " +", f"[^{space}—–-]", ""), f"[^{space}—–-]", " +", "[»“]", "")
    tied = _between(y, "[А-ЯЁ]", r"\. ", "[А-ЯЁ]", ".\u00a0")
    tied = _between(tied, alone, "и ", r"(?:др|пр|т)\.", "и\u00a0")
    tied = _between(tied, alone, r"т\. ", r"[дпченко]\.", "т.\u00a0")
    tied = _between(tied, digit, " ", r"гг?\.|вв?\.|тыс\.|млн|млрд|руб\.|коп\.|стр\.|[А-Яа-яЁёA-Za-z«]", "\u00a0")
    tied = _between(tied, f"(?:{alone})(?i:в|и|с|к|о|у|а|но|не|ни|на|по|за|из|от|до|об|для|при|над|под|как|что|же|ли|бы|б)", " ", solid, "\u00a0", 3)
    tied = _between(_between(tied, "№", " ", solid, "\u00a0"), solid, " ", f"—(?:[{space}]|$)", "\u00a0")
    dirty = "(SELECT doc_id, replace(replace(text, ' — ', ' - '), '…', '...') AS text FROM documents WHERE text IS NOT NULL)"
    parts = f"""SELECT doc_id, n, masked, line, len(string_split(line, '`')) % 2 = 1 AS paired, unnest(CASE WHEN masked THEN [line] WHEN len(string_split(line, '`')) % 2 = 1 THEN string_split(line, '`') ELSE [line] END) AS s,
 generate_subscripts(CASE WHEN masked THEN [line] WHEN len(string_split(line, '`')) % 2 = 1 THEN string_split(line, '`') ELSE [line] END, 1) AS i FROM {sql.masked_lines(dirty, 'doc_id')}"""
    own = "NOT masked AND (NOT paired OR i % 2 = 1)"
    return f"""WITH a AS MATERIALIZED ({parts}), b AS MATERIALIZED (SELECT doc_id, n, i, paired, masked, CASE WHEN {own} THEN {first} ELSE s END AS s FROM a),
c AS MATERIALIZED (SELECT doc_id, n, i, paired, masked, CASE WHEN {own} THEN {quotes} ELSE s END AS s FROM b),
e AS (SELECT doc_id, n, i, CASE WHEN {own} AND paired THEN {tied} WHEN {own} THEN {y} ELSE s END AS s FROM c),
l AS (SELECT doc_id, n, string_agg(s, '`' ORDER BY i) AS line FROM e GROUP BY ALL)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY n)) AS "set" FROM l GROUP BY doc_id"""


def _typography_check() -> str:
    space = r"\t\x0b-\r \n\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    solid = f"[^{space}]"
    tests = {
        "straight_quotes": '"', "double_space": rf"{solid} {{2,}}[^{space}|]", "space_before_sign": rf"{solid} +[,.;:!?…](?:[^)]|$)", "no_space_after_sign": r"[,;][А-Яа-яЁё«(]|[.!?…](?:[А-ЯЁ«—]|\([^)]|\($)",
        "hyphen_for_dash": rf"{solid} - {solid}|{solid}--{solid}", "dots_for_ellipsis": r"\.{3,}", "hyphen_in_years": r"\p{Nd}{4}-\p{Nd}{4}", "dots_after_mark": r"[?!]\.{3,}",
        "space_in_quotes": rf"[«„] +[^{space}—–-]|[^{space}—–-] +[»“]",
    }
    segs = f"SELECT doc_id, n, CASE WHEN len(string_split(line, '`')) % 2 = 1 THEN list_filter(string_split(line, '`'), lambda x, i: i % 2 = 1) ELSE [line] END AS g FROM {sql.state_lines('documents', 'doc_id')}"
    each = " UNION ALL ".join(f"SELECT doc_id, {sql.lit(k)} AS issue FROM g WHERE len(list_filter(g, lambda x: regexp_matches(x, {sql.lit(v)}))) > 0" for k, v in tests.items())
    pairs = "SELECT doc_id, 'unpaired_quotes' FROM g WHERE len(list_filter(g, lambda x: length(replace(x, '«', '')) <> length(replace(x, '»', '')))) > 0"
    return f"WITH g AS MATERIALIZED ({segs}) SELECT issue, count(*) AS n, count(DISTINCT doc_id) AS documents FROM ({each} UNION ALL {pairs}) GROUP BY issue"


def _rule_findings() -> str:
    parts = []
    for r in prose.RULES:
        p = sql.lit("(?i)" + r.source)
        parts.append(
            f"""SELECT doc_id, text, {sql.lit(r.cat)} AS cat, {sql.lit(r.level)} AS level, {sql.lit(r.hint)} AS hint, unnest(h) AS fragment,
unnest(list_transform(range(1, len(h) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS pos
FROM (SELECT doc_id, text, regexp_extract_all(text, {p}) AS h, regexp_split_to_array(text, {p}) AS g FROM documents WHERE text IS NOT NULL) WHERE len(h) > 0"""
        )
    body = sql.strip("replace(text[greatest(pos - 40, 0) + 1:least(pos + length(fragment) + 40, length(text))], chr(10), ' ')")
    return f"""SELECT doc_id, (1 + length(text[1:pos]) - length(replace(text[1:pos], chr(10), '')))::INT AS line_no, cat, level, fragment,
CASE WHEN pos > 40 THEN '…' ELSE '' END || {body} || CASE WHEN pos + length(fragment) + 40 < length(text) THEN '…' ELSE '' END AS context, hint FROM ({' UNION ALL '.join(parts)})"""


def _yo_fixed() -> str:
    x, edge = "text", f"[^{_WORD}]"
    for wrong, right in (("тёмную", "темную"), ("ещё", "еще")):
        for a, b in ((wrong[0].upper(), right[0].upper()), (wrong[0], right[0])):
            x = _between(x, f"^|{edge}", f"{a}(?i:{wrong[1:]})", f"$|{edge}", b + right[1:])
    return f"SELECT doc_id, md5({x}) AS fixed FROM documents WHERE text IS NOT NULL"


def _selective() -> str:
    p = "(?i:в лодочном сарае)".replace("е", "[её]")
    done = f"regexp_replace(regexp_replace(line, {sql.lit('(^|[.!?' + chr(13) + '])([ ' + chr(9) + ']*)' + p)}, '\\1\\2В сарае', 'g'), {sql.lit(p)}, 'в сарае', 'g')"
    return f"""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
m AS (SELECT doc_id, min(n) AS first FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM (SELECT doc_id, {sql.lines('text')} AS x FROM documents WHERE text IS NOT NULL)) WHERE contains({sql.fold('lower(line)')}, 'в лодочном сарае') GROUP BY doc_id)
SELECT doc_id, md5(string_agg(CASE WHEN n = first THEN {done} ELSE line END, chr(10) ORDER BY n)) AS text_new FROM l LEFT JOIN m USING (doc_id) GROUP BY doc_id"""


ORACLE = {
    "typography": _typography(),
    "typography_check": _typography_check(),
    "rule_findings": _rule_findings(),
    "yo_fixed": _yo_fixed(),
    "selective_clean": _selective(),
    "repaired_notes": f"SELECT note_id, md5({sql.lit(MENDED)} || text) AS text_new FROM {_NOTES} WHERE text IS NOT NULL",
    "control_pass": f"""SELECT level, sum(b)::BIGINT AS before, sum(a)::BIGINT AS "left" FROM (
SELECT level, n AS b, 0 AS a FROM ({_HITS.format(t='text')}) UNION ALL SELECT level, 0, n FROM ({_HITS.replace('{t}', prose._rule_clean())})) GROUP BY level""",
    "yo_occurrences": _yo_lines(),
    "bad_unicode": "SELECT doc_id, n::INT AS line_no, kind, 'U+' || lpad(printf('%X', ord(c)), 4, '0') AS codepoints, k::INT AS n FROM (" + " UNION ALL ".join(
        f"SELECT doc_id, n, {sql.lit(k)} AS kind, regexp_extract(line, '[{p}]') AS c, len(regexp_extract_all(line, '[{p}]')) AS k FROM {_LINES}" for k, p in zip(_KINDS, _BAD)
    ) + ") WHERE k > 0",
    "foreign_stripped": f"SELECT doc_id, md5(CASE WHEN text[1] = chr(65279) THEN chr(65279) ELSE '' END || replace(regexp_replace(text, {sql.lit(_FOREIGN)}, '', 'g'), chr(65279), '')) AS stripped FROM documents WHERE text IS NOT NULL",
    "icons_replaced": f"SELECT doc_id, md5({_ICONS}) AS replaced FROM documents WHERE text IS NOT NULL",
    "unlisted_forms": _UNLISTED,
    "declined_mentions": f"""WITH n AS (SELECT DISTINCT ON (entry_id) entry_id, vault, name, forms FROM name_registry),
t AS (SELECT DISTINCT vault, {sql.strip('name')} AS entity, {sql.fold("lower(" + sql.strip('name') + ")")} AS z FROM n WHERE regexp_matches({sql.fold("lower(" + sql.strip('name') + ")")}, '^[а-я]+$')),
x AS (SELECT DISTINCT vault, entity, {sql.fold(f"unnest(list_concat([z], {_FORMS}))")} AS w FROM t),
y AS (SELECT entry_id, vault, unnest(regexp_extract_all({sql.fold("lower(array_to_string(forms, '. '))")}, '[а-яa-z]+(?:-[а-яa-z]+)*')) AS w FROM n)
SELECT entity, entry_id, count(*) AS n FROM y JOIN x USING (vault, w) GROUP BY ALL""",
    "newest_backups": """SELECT '/v/' || rel AS original, max('/v/md_replace_backups/' || strftime(created_at, '%Y%m%d') || '/' || rel) AS backup FROM obsidian_check WHERE rel IS NOT NULL AND created_at IS NOT NULL GROUP BY rel""",
    "corpora": f"""SELECT origin, count(*) AS texts, sum(length(text))::BIGINT AS characters FROM (SELECT 'note' AS origin, text FROM {_NOTES} UNION ALL
SELECT lower(ltrim(ext, '.')), text FROM documents WHERE lower(ltrim(ext, '.')) <> 'md') GROUP BY origin""",
    "line_checks": f"SELECT DISTINCT * FROM ({_note_line_checks()})",
    "note_checks": (_CHECKS := f"SELECT * FROM ({_note_line_checks()}) UNION ALL {_undescribed(_NOTES, 'note_id')}"),
    "note_check_counts": _rolled(_CHECKS, "note_id"),
    "document_checks": _rolled(f"SELECT * FROM (WITH {_line_checks('documents', 'doc_id', _WHOLE)} SELECT doc_id, n AS line_no, code, {_SEVERITY} AS severity FROM f) UNION ALL {_undescribed('documents', 'doc_id')}", "doc_id"),
    "audit": _audit(_CHECKS),
    "heading_checks": f"WITH {_line_checks('documents', 'doc_id')} SELECT code, {_SEVERITY} AS severity, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT * FROM f) WHERE code <> 'EXPLODED' GROUP BY code",
    "encodings": "SELECT CASE WHEN text[1] = chr(65279) THEN 'utf-8-sig' ELSE 'utf-8' END AS encoding, count(*) AS files, 0::BIGINT AS not_utf8 FROM documents WHERE text IS NOT NULL GROUP BY ALL",
}
