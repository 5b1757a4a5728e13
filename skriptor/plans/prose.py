"""Queries of rules, phrases, names, cleaners and markdown checks over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skriptor.functions import state
from skriptor.functions import text as T
from skriptor.functions import words as W
from skriptor.operators import clean, links, markdown, registry, rules
from skriptor.plans import sql
from skriptor.session import load_spread as load

PHRASES = ["в лодочном сарае", "у северной стены", "ничего не записывай", "below the town hall", "don’t touch it", "спустя неделю", *rules.PHRASE_MAP]
RULES = rules.make_rules(
    [
        {"cat": "place", "level": "hard", "re": "в подвале ратуши|below the town hall"},
        {"cat": "manner", "level": "soft", "re": "торопливо|hastily"},
        {"cat": "manner", "level": "hard", "re": "украдкой|secretly", "fix": "тайно"},
        {"cat": "weather", "level": "soft", "re": "перед грозой|before the storm", "hint": "once a chapter"},
    ]
)
CLEAN_MAP = {"в лодочном сарае": "в сарае", "всё-таки": "", "secretly": ""}
# Names taken by well-known products.
RESERVED = [("app", x) for x in "Word Excel Teams Telegram Viber Zoom Slack Notion Obsidian Steam".split()] + [("system", x) for x in "Android Windows Linux macOS".split()]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "name_registry").dropDuplicates(["entry_id"])


def phrase_totals(spark: SparkSession, d: str) -> DataFrame:
    return rules.phrase_totals(_docs(spark, d), PHRASES)


def cleaning_plan(spark: SparkSession, d: str) -> DataFrame:
    return rules.cleaning_plan(phrase_totals(spark, d), CLEAN_MAP)


def phrase_review(spark: SparkSession, d: str) -> DataFrame:
    return rules.phrase_review(_docs(spark, d), PHRASES)


def rule_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.rule_findings(_docs(spark, d), RULES)


def rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return rules.rule_counts(rule_findings(spark, d))


def rule_clean(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(rules.rule_clean(F.col("text"), RULES)).alias("cleaned"))


def yo_counts(spark: SparkSession, d: str) -> DataFrame:
    return rules.yo_counts(_docs(spark, d), targets=rules.yo_targets(YO))


def yo_letters(spark: SparkSession, d: str) -> DataFrame:
    return rules.yo_letters(_docs(spark, d))


def yo_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(rules.yo_fix(F.col("text"), [("тёмную", "темную"), ("ещё", "еще")])).alias("fixed"))


def name_candidates(spark: SparkSession, d: str) -> DataFrame:
    return registry.name_candidates(_docs(spark, d)).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


def name_pairs(spark: SparkSession, d: str) -> DataFrame:
    return registry.pair_candidates(_docs(spark, d)).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def registry_candidates(spark: SparkSession, d: str) -> DataFrame:
    return registry.registry_candidates(_docs(spark, d))


def new_candidates(spark: SparkSession, d: str) -> DataFrame:
    return registry.new_candidates(registry_candidates(spark, d), registry.terms(_entries(spark, d)))


def cast_list(spark: SparkSession, d: str) -> DataFrame:
    return registry.cast_list(_docs(spark, d))


def spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    notes = load(spark, d, "obsidian_check").select(F.col("note_id").alias("doc_id"), F.when(F.col("deleted_at").isNotNull(), F.translate("text", "ё", "е")).otherwise(F.col("text")).alias("text"))
    return registry.spelling_variants(registry.cast_list(notes))


def registry_terms(spark: SparkSession, d: str) -> DataFrame:
    return registry.terms(_entries(spark, d))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return registry.mentions(_docs(spark, d), registry.terms(_entries(spark, d), group_col="vault"), group_col="source")


def entity_matrix(spark: SparkSession, d: str) -> DataFrame:
    return registry.entity_matrix(_mentions(spark, d))


def consistency(spark: SparkSession, d: str) -> DataFrame:
    return registry.consistency(_mentions(spark, d))


def entity_notes(spark: SparkSession, d: str) -> DataFrame:
    return registry.entity_notes(entity_matrix(spark, d))


def name_risk(spark: SparkSession, d: str) -> DataFrame:
    return registry.name_risk(_entries(spark, d), spark.createDataFrame(RESERVED, "category string, reserved string"))


def missing_forms(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d).where(r"name rlike '\\S'").select(T.strip(F.col("name")).alias("entity"), F.array(T.strip(F.col("name"))).alias("forms")).distinct()
    return registry.missing_forms(_entries(spark, d).where(r"name rlike '\\S'"), e).distinct()


def whitespace_clean(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.concat(F.replace("text", F.lit(". "), F.lit(".  ")), F.lit("  \n\n\n\n\tend \t"))
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(clean.clean_whitespace(dirty)).alias("cleaned"))


def separator_clean(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return _docs(spark, d).where(c.isNotNull()).select("doc_id", clean.separator_lines(c).alias("removed"), F.md5(clean.clean_separators(c)).alias("cleaned"))


def typography(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.replace(F.replace("text", F.lit(" — "), F.lit(" - ")), F.lit("…"), F.lit("..."))
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(clean.typography(dirty, nbsp=True, dialogue=True, front_matter=True)).alias("set"))


def typography_counts(spark: SparkSession, d: str) -> DataFrame:
    return clean.typography_counts(_docs(spark, d))


def typography_check(spark: SparkSession, d: str) -> DataFrame:
    return clean.typography_check(_docs(spark, d)).groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


def phrase_clean(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(clean.replace_phrases(F.col("text"), CLEAN_MAP)).alias("cleaned"))


def mass_replace(spark: SparkSession, d: str) -> DataFrame:
    out = clean.replace_all(_docs(spark, d), "text", "фонарь", "фонарик", path_col="path", exclude="черновики")
    return out.select("doc_id", "changes", F.md5("text_new").alias("text_new"))


def selective_clean(spark: SparkSession, d: str) -> DataFrame:
    lines = state.numbered_lines(_docs(spark, d), "doc_id", "text")
    found = rules.phrase_review(_docs(spark, d), ["в лодочном сарае"])
    chosen = found.groupBy("doc_id", "phrase").agg(F.min("line_no").alias("line_no"))  # the first line of each text
    return clean.apply_selection(lines, chosen, CLEAN_MAP).select("doc_id", F.md5("text_new").alias("text_new"))


def note_checks(spark: SparkSession, d: str) -> DataFrame:
    notes = load(spark, d, "obsidian_check")
    files = load(spark, d, "vault_attachments").where("vault is not null").select(F.col("vault").alias("grp"), "file_name", "rel")
    return markdown.validate(notes, links.note_keys(notes), files)


def note_check_counts(spark: SparkSession, d: str) -> DataFrame:
    return markdown.code_counts(note_checks(spark, d))


def document_checks(spark: SparkSession, d: str) -> DataFrame:
    return markdown.code_counts(markdown.validate(_docs(spark, d), id_col="doc_id"))


def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    return markdown.blocks(_docs(spark, d)).groupBy("kind", "level").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


YO = rules.YO_PAIRS | {"частые": [("еще", "ещё"), ("темную", "тёмную"), ("кочегар", "кочегар")]}

QUERIES = {
    f.__name__: f
    for f in (
        phrase_totals, cleaning_plan, phrase_review, rule_findings, rule_counts, rule_clean, yo_counts, yo_letters, yo_fixed, name_candidates, name_pairs, registry_candidates, new_candidates, cast_list,
        spelling_variants, registry_terms, entity_matrix, consistency, entity_notes, name_risk, missing_forms, whitespace_clean, separator_clean, typography, typography_counts, typography_check,
        phrase_clean, mass_replace, selective_clean, note_checks, note_check_counts, document_checks, markdown_blocks,
    )
}

_LOW = sql.fold("lower(text)")
_TOTALS = " UNION ALL ".join(
    f"SELECT {sql.lit(p)} AS phrase, ((length(t) - length(replace(t, {sql.lit(p.lower().replace('ё', 'е'))}, ''))) / {len(p)})::BIGINT AS n FROM f" for p in PHRASES
)
_TOTALS = f"WITH f AS (SELECT {_LOW} AS t FROM documents WHERE text IS NOT NULL) SELECT phrase, sum(n)::BIGINT AS total, count(*) AS documents FROM ({_TOTALS}) WHERE n > 0 GROUP BY phrase"
_PLAN = "(VALUES " + ", ".join(f"({sql.lit(k)}, {sql.lit(v)})" for k, v in CLEAN_MAP.items()) + ") AS p(phrase, image)"
RULE_HITS = " UNION ALL ".join(f"SELECT {sql.lit(r.cat)} AS cat, {sql.lit(r.level)} AS level, unnest(regexp_extract_all(text, {sql.lit('(?i)' + r.source)})) AS hit FROM documents" for r in RULES)


def _yo_sql() -> str:
    edge = r"\p{L}\p{N}_"
    spread = f"regexp_replace(text, {sql.lit(f'([^{edge}])')}, '\\1\\1', 'g')"
    parts = []
    for w, r, c in rules.yo_targets(YO):
        pattern = f"(?i)[^{edge}]{w}[^{edge}]"
        parts.append(f"SELECT {sql.lit(c)} AS cat, {sql.lit(w)} AS wrong, {sql.lit(r)} AS right, len(regexp_extract_all(' ' || s || ' ', {sql.lit(pattern)})) AS n FROM y")
    return f"WITH y AS (SELECT {spread} AS s FROM documents WHERE text IS NOT NULL) SELECT cat, wrong, \"right\", sum(n)::BIGINT AS n, count(*) AS documents FROM ({' UNION ALL '.join(parts)}) WHERE n > 0 GROUP BY ALL".replace(" AS right", ' AS "right"')


_STOPS = sql.words_in(sorted({w.replace("ё", "е") for w in W.stop_words(None)} | set(W.stop_words(None))))
_SENT = f"SELECT doc_id, unnest({sql.sentences('text')}) AS s FROM documents WHERE text IS NOT NULL"
_TOK = f"SELECT doc_id, {sql.all_matches('s', T.NAME_TOKEN)} AS w FROM ({_SENT})"
_SINGLE = f"""SELECT doc_id, {sql.fold('lower(x)')} AS word FROM (SELECT doc_id, unnest(w[2:]) AS x FROM ({_TOK}))
WHERE x[1] <> lower(x[1]) AND x <> upper(x) AND length(x) >= 3 AND {sql.fold('lower(x)')} NOT IN {_STOPS}"""
_PAIRS = f"""SELECT doc_id, a || ' ' || b AS pair FROM (SELECT doc_id, {sql.fold('lower(p[1])')} AS a, {sql.fold('lower(p[2])')} AS b, p FROM (
SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS p FROM ({_TOK}) WHERE len(w) > 1))
WHERE p[1][1] <> lower(p[1][1]) AND p[2][1] <> lower(p[2][1]) AND length(p[1]) >= 3 AND length(p[2]) >= 3 AND a NOT IN {_STOPS} AND b NOT IN {_STOPS}"""
_CANDIDATES = f"SELECT kind, name, count(*) AS n FROM (SELECT 'word' AS kind, word AS name FROM ({_SINGLE}) UNION ALL SELECT 'pair', pair FROM ({_PAIRS})) GROUP BY ALL HAVING count(*) >= 2"
_TERM = f"array_to_string(regexp_extract_all({sql.fold('lower(t)')}, '[а-яa-z]+(?:-[а-яa-z]+)*'), ' ')"
_TERMS = "SELECT DISTINCT * FROM (" + " UNION ALL ".join(
    f"SELECT {sql.strip('name')} AS entity, '{k}' AS kind, {_TERM} AS term FROM (SELECT name, unnest({'[name]' if f == 'name' else f}) AS t FROM name_registry WHERE regexp_matches(name, '\\S'))" for f, k in registry.FIELDS.items()
) + ") WHERE term <> ''"

_SOFT = T.SPACE.replace(r"\t-\r", r"\t\x{0b}-\r")  # white space but for line ends
_DIRTY = "replace(text, '. ', '.  ') || '  ' || repeat(chr(10), 4) || chr(9) || 'end ' || chr(9)"
_WHITE = f"regexp_replace(regexp_replace(regexp_replace({_DIRTY}, {sql.lit(f'(?m)[{_SOFT}]+$')}, '', 'g'), '[ \\t]{{2,}}|\\t', ' ', 'g'), '^\\n+', '')"
_JUNK = "|".join(rf"[{c}](?: *[{c}]){{2,}}" if c not in "^]-" else rf"\{c}(?: *\{c}){{2,}}" for c in clean.SEPARATORS)
_OWN_TERMS = _TERMS.replace("SELECT DISTINCT * FROM (SELECT", "SELECT DISTINCT * FROM (SELECT vault AS source,", 1).replace("UNION ALL SELECT", "UNION ALL SELECT vault AS source,").replace("(SELECT name, unnest", "(SELECT vault, name, unnest")
_FOUND = f"""WITH w AS (SELECT doc_id, source, n, c, {sql.all_matches('chunk', '[а-яa-z]+(?:-[а-яa-z]+)*')} AS w FROM (
SELECT doc_id, source, n, unnest(cs) AS chunk, generate_subscripts(cs, 1) AS c FROM (SELECT doc_id, source, n, regexp_split_to_array(line, {sql.lit(rf'[^{T.LETTER} «»"“”„-]+|[ ]-[ ]')}) AS cs FROM (
SELECT doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, source, {sql.lines(sql.fold('lower(text)'))} AS l FROM documents WHERE text IS NOT NULL))))),
g AS ({' UNION ALL '.join(f"SELECT doc_id, source, n, c, ap, {k} AS k, array_to_string(w[ap:ap + {k - 1}], ' ') AS term FROM (SELECT *, unnest(range(1, len(w) - {k - 2})) AS ap FROM w WHERE len(w) >= {k})" for k in range(1, 9))}),
m AS (SELECT *, max(ap + k) OVER (PARTITION BY doc_id, n, c, entity, kind ORDER BY ap, k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM g JOIN ({_OWN_TERMS}) USING (term, source)),
f AS (SELECT * FROM m WHERE ap >= coalesce(covered, 0))"""


def _cast(source: str) -> str:
    names = f"SELECT doc_id, name, count(*) AS n, count(*) FILTER (i > 1) AS mid FROM (SELECT doc_id, unnest(w) AS name, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(s, '(?:^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])([А-ЯЁ][а-яё]+(?:-[а-яё]+)?)', 1) AS w FROM ({{sents}}))) GROUP BY ALL"
    pairs = "SELECT unnest(regexp_extract_all(s, '(?:^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])([А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+)', 1)) AS name FROM ({sents})"
    sents = f"SELECT doc_id, unnest({sql.sentences('text')}) AS s FROM {source} WHERE text IS NOT NULL"
    names, pairs = names.replace("{sents}", sents).replace("{{", "{").replace("}}", "}"), pairs.replace("{sents}", sents).replace("{{", "{").replace("}}", "}")
    stops = sql.words_in(sorted(set(W.stop_words(None))))
    return f"SELECT 'name' AS kind, name, sum(n)::BIGINT AS n FROM ({names}) WHERE NOT ({sql.fold('lower(name)')} IN {stops} AND mid = 0) GROUP BY name UNION ALL SELECT 'pair', name, count(*) FROM ({pairs}) GROUP BY name"


def _review() -> str:
    parts = []
    for p in PHRASES:
        q = p.lower().replace("ё", "е")
        parts.append(
            f"SELECT doc_id, n, line, {sql.lit(p)} AS phrase, {len(q)} AS k, unnest(list_transform(range(1, len(string_split(f, {sql.lit(q)}))), lambda i: length(array_to_string(string_split(f, {sql.lit(q)})[1:i], '')) + (i - 1) * {len(q)})) AS pos FROM l WHERE contains(f, {sql.lit(q)})"
        )
    lines = f"SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, {sql.lines('text')} AS ls FROM documents WHERE text IS NOT NULL)"
    body = sql.strip("line[greatest(pos - 30, 0) + 1:least(pos + k + 30, length(line))]")
    return f"""WITH l AS (SELECT *, {sql.fold('lower(line)')} AS f FROM ({lines}))
SELECT doc_id, n AS line_no, phrase, CASE WHEN pos > 30 THEN '…' ELSE '' END || {body} || CASE WHEN pos + k + 30 < length(line) THEN '…' ELSE '' END AS fragment FROM ({' UNION ALL '.join(parts)})"""


def _rule_clean() -> str:
    out = "text"
    for r in RULES:
        if r.level == "hard":
            pattern = rf'(?i)[ \t]*(?:{r.source})(?:[ \t]*([\n.,!?;:…—)»"]|\z))?'
            out = f"regexp_replace({out}, {sql.lit(pattern)}, {sql.lit(r.fix + chr(92) + '1')}, 'g')"
    return out


def _phrase_clean() -> str:
    out = "text"
    for phrase in sorted(CLEAN_MAP, key=lambda x: (-len(x), x)):
        image, p = CLEAN_MAP[phrase], "(?i:" + "".join("[её]" if c in "её" else c for c in phrase) + ")"
        if image:
            out = f"regexp_replace({out}, {sql.lit(rf'(^|[.!?{chr(10)}{chr(13)}])([ {chr(9)}]*){p}')}, {sql.lit(chr(92) + '1' + chr(92) + '2' + image[:1].upper() + image[1:])}, 'g')"
            out = f"regexp_replace({out}, {sql.lit(p)}, {sql.lit(image)}, 'g')"
        else:
            out = f"regexp_replace({out}, {sql.lit(rf'([^ {chr(9)}{chr(10)}{chr(13)}])[ {chr(9)}]*{p}[ {chr(9)}]*([^ {chr(9)}{chr(10)}{chr(13)}])')}, {sql.lit(chr(92) + '1 ' + chr(92) + '2')}, 'g')"
            out = f"regexp_replace({out}, {sql.lit(rf'(^|[{chr(10)}{chr(13)}])[ {chr(9)}]*{p}[ {chr(9)}]*([^ {chr(9)}{chr(10)}{chr(13)}])')}, {sql.lit(chr(92) + '1' + chr(92) + '2')}, 'g')"
            out = f"regexp_replace({out}, {sql.lit(rf'[ {chr(9)}]*{p}')}, '', 'g')"
    return out


_MARKED = f"regexp_replace(text, {sql.lit(f'(?m)^[{_SOFT}]*(?:{_JUNK})[{_SOFT}]*$')}, chr(1), 'g')"
_HEAD = "regexp_extract(m, '^[\\n\\x01]*\\x01[\\n\\x01]*')"
_BODY = "regexp_replace(regexp_replace(m, '^[\\n\\x01]*\\x01[\\n\\x01]*', ''), '[\\n\\x01]*\\x01[\\n\\x01]*\\z', '')"
_BODY = f"repeat(chr(10), greatest(least(1, length(replace({_HEAD}, chr(1), '')) - length(replace({_HEAD}, chr(10), ''))), 0)) || {_BODY}"
for _ in range(2):
    _BODY = f"regexp_replace({_BODY}, '([^\\n\\x01])\\n+\\x01[\\n\\x01]*([^\\n\\x01])', '\\1' || chr(10) || chr(10) || '\\2', 'g')"
_BODY = f"regexp_replace({_BODY}, '\\n+\\z', '')"
_SEPARATED = f"""SELECT doc_id, (length(m) - length(replace(m, chr(1), '')))::INT AS removed,
md5(CASE WHEN NOT contains(m, chr(1)) THEN text WHEN {_BODY} = '' THEN '' WHEN ends_with(text, chr(10)) THEN {_BODY} || chr(10) ELSE {_BODY} END) AS cleaned FROM (SELECT doc_id, text, {_MARKED} AS m FROM documents WHERE text IS NOT NULL)"""

_KIND = rf"""CASE WHEN masked AND regexp_matches(line, '^\s*(?:```|~~~|---\s*$)') THEN 'marker' WHEN masked THEN 'code' WHEN regexp_matches(line, '^#{{1,6}}\s') THEN 'heading'
WHEN regexp_matches({sql.strip('line')}, '^(?:-{{3,}}|\*{{3,}}|_{{3,}}|(?:\* ){{2,}}\*)$') THEN 'rule' WHEN regexp_matches(line, '^\s*[-*+]\s') THEN 'bullet' WHEN regexp_matches(line, '^\s*\d+[.)]\s') THEN 'number'
WHEN regexp_matches(line, '^\s*>') THEN 'quote' WHEN starts_with({sql.strip('line')}, '|') THEN 'table' ELSE 'text' END"""
_BLOCKS = rf"""SELECT kind, CASE WHEN kind = 'heading' THEN length(regexp_extract(line, '^#{{1,6}}')) WHEN kind IN ('bullet', 'number') THEN floor(length(regexp_extract(line, '^\s*')) / 2) + 1 ELSE 0 END::INT AS level, doc_id
FROM (SELECT *, {_KIND} AS kind FROM {sql.masked_lines('documents', 'doc_id')} WHERE {sql.strip('line')} <> '') WHERE kind <> 'marker'"""

ORACLE = {
    "markdown_blocks": f"SELECT kind, level, count(*) AS n, count(DISTINCT doc_id) AS documents FROM ({_BLOCKS}) GROUP BY ALL",
    "separator_clean": _SEPARATED,
    "rule_clean": f"SELECT doc_id, md5({_rule_clean()}) AS cleaned FROM documents WHERE text IS NOT NULL",
    "phrase_clean": f"SELECT doc_id, md5({_phrase_clean()}) AS cleaned FROM documents WHERE text IS NOT NULL",
    "entity_notes": _FOUND + """, x AS (SELECT entity, doc_id, count(*) AS n FROM f GROUP BY ALL)
SELECT entity, 0 AS part, count(*)::INT AS texts, '# ' || entity || chr(10) || string_agg('- [[' || doc_id || ']] — ' || n, chr(10) ORDER BY n DESC, doc_id) AS note FROM x GROUP BY entity""",
    "whitespace_clean": f"SELECT doc_id, md5(regexp_replace(regexp_replace({_WHITE}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\n+$', '') || chr(10)) AS cleaned FROM documents WHERE text IS NOT NULL",
    "entity_matrix": _FOUND + " SELECT entity, doc_id, count(*) AS n FROM f GROUP BY ALL",
    "consistency": _FOUND + """ SELECT entity, count(*) FILTER (kind = 'ok') AS ok, count(*) FILTER (kind = 'old') AS old, count(*) FILTER (kind = 'dangerous') AS dangerous, count(*) FILTER (kind = 'typo') AS typo,
count(*) FILTER (kind <> 'ok') > 0 AS "check" FROM f GROUP BY entity""",
    "cast_list": _cast("documents"),
    "spelling_variants": f"""SELECT {sql.fold('lower(name)')} AS folded, list(name ORDER BY n DESC, name) AS spellings, sum(n)::BIGINT AS n FROM ({_cast("(SELECT note_id AS doc_id, CASE WHEN deleted_at IS NOT NULL THEN replace(text, 'ё', 'е') ELSE text END AS text FROM obsidian_check)")})
WHERE kind = 'name' GROUP BY 1 HAVING count(*) > 1""",
    "phrase_review": _review(),
    "missing_forms": f"""SELECT DISTINCT e.entity, [e.entity] AS missing FROM (SELECT {sql.strip('name')} AS entity, forms FROM name_registry WHERE regexp_matches(name, '\\S')) e
WHERE NOT list_contains(list_transform(coalesce(forms, []), lambda x: lower(x)), lower(entity))""",
    "phrase_totals": _TOTALS,
    "cleaning_plan": f"SELECT t.*, CASE WHEN image IS NULL THEN 'manual' WHEN image = '' THEN 'delete' ELSE 'replace' END AS action, image FROM ({_TOTALS}) t LEFT JOIN {_PLAN} USING (phrase)",
    "rule_counts": f"SELECT cat, level, count(*) AS n FROM ({RULE_HITS}) GROUP BY GROUPING SETS ((level, cat), (level), ())",
    "yo_counts": _yo_sql(),
    "yo_letters": "SELECT sum(n)::BIGINT AS letters, count(*) FILTER (n > 0) AS documents FROM (SELECT len(regexp_extract_all(text, '[ёЁ]')) AS n FROM documents)",
    "name_candidates": f"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS documents FROM ({_SINGLE}) GROUP BY word",
    "name_pairs": f"SELECT pair, count(*) AS n FROM ({_PAIRS}) GROUP BY pair",
    "registry_candidates": _CANDIDATES,
    "registry_terms": _TERMS,
    "new_candidates": f"SELECT * FROM ({_CANDIDATES}) WHERE {sql.fold('lower(name)')} NOT IN (SELECT term FROM ({_TERMS}))",
    "mass_replace": """SELECT doc_id, CASE WHEN path IS NULL OR text IS NULL OR regexp_matches(path, 'черновики') THEN 0 ELSE len(regexp_extract_all(text, 'фонарь')) END::INT AS changes,
md5(CASE WHEN path IS NULL OR regexp_matches(path, 'черновики') THEN text ELSE replace(text, 'фонарь', 'фонарик') END) AS text_new FROM documents""",
    "name_risk": f"""WITH n AS (SELECT DISTINCT name, lower({sql.strip('name')}) AS low FROM name_registry), r AS (SELECT {[x[1].lower() for x in RESERVED]!r} AS l)
SELECT name, coalesce(list_sort(list_filter(l, lambda x: x = low OR (length(x) >= 5 AND low <> '' AND (contains(low, x) OR contains(x, low))))), []) AS hits,
CASE WHEN coalesce(low, '') = '' THEN 'empty' WHEN list_contains(l, low) THEN 'high' WHEN regexp_matches(low, '^[a-z]{{1,12}}$') THEN 'raised'
WHEN NOT contains(low, ' ') AND length(low) >= 5 AND regexp_matches(low, '[^\\x00-\\x7f]') THEN 'medium' ELSE 'low' END AS risk FROM n, r""",
}
