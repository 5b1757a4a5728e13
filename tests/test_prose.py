"""Cleaners, rules, names, characters and markdown checks on small fixtures."""

import pytest
from pyspark.sql import functions as F

from skriptor.operators import chars, clean, links, markdown, registry, rules


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("r")).first()["r"]


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "doc_id int, text string")


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("a  b \t c  \n\n\n\nd\n```\nx  y \n```\n", "a b c\n\nd\n```\nx  y \n```\n"),
        ("\n\na", "a\n"),
        ("", ""),
        ("   ", ""),
    ],
)
def test_whitespace(spark, given, wanted):
    got = one(spark, clean.clean_whitespace, given)
    assert got == wanted
    assert one(spark, clean.clean_whitespace, got) == got


def test_whitespace_breaks(spark):
    assert one(spark, lambda s: clean.clean_whitespace(s, keep_breaks=True), "a b  \nc ") == "a b  \nc\n"


@pytest.mark.parametrize(
    "given, wanted, removed",
    [
        ("a\n\n/////\n\n*****\n\nb\n", "a\n\nb\n", 2),
        ("a\n* * *\nb\n———\n=====\nc", "a\n\nb\n\nc", 3),
        ("a\n--\nb", "a\n--\nb", 0),
        ("```\n-----\n```\n", "```\n-----\n```\n", 0),
        ("#### x\n- y\n| - |", "#### x\n- y\n| - |", 0),
        ("-----", "", 1),
        ("*****\na\n*****\n", "a\n", 2),
    ],
)
def test_separators(spark, given, wanted, removed):
    assert one(spark, clean.clean_separators, given) == wanted
    assert one(spark, clean.separator_lines, given) == removed
    assert one(spark, clean.clean_separators, wanted) == wanted


def test_separator_front_matter(spark):
    text = "---\na: b\n---\nx\n-----\ny"
    assert one(spark, lambda s: clean.clean_separators(s, front_matter=True), text) == "---\na: b\n---\nx\n\ny"


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("слово ,слово", "слово, слово"),
        ("Да.Нет", "Да. Нет"),
        ("example.com v1.2.3", "example.com v1.2.3"),
        ("слово - слово", "слово — слово"),
        ("слово--слово", "слово — слово"),
        ("что?...", "что?.."),
        ("ну...", "ну…"),
        ("1941-1945", "1941—1945"),
        ("5–7", "5—7"),
        ('он сказал "привет" и "пока"', "он сказал «привет» и «пока»"),
        ('«он сказал "привет"»', "«он сказал „привет“»"),
        ('class="x"', 'class="x"'),
        ("`a - b` и a - b", "`a - b` и a — b"),
        ("« слово »", "«слово»"),
    ],
)
def test_typography(spark, given, wanted):
    assert one(spark, clean.typography, given) == wanted


def test_nbsp_and_dialogue(spark):
    got = one(spark, lambda s: clean.typography(s, nbsp=True, dialogue=True), "- В лесу 5 км, № 7, А. С. Пушкин — поэт")
    assert got == "— В лесу 5 км, № 7, А. С. Пушкин — поэт"


def test_typography_check(spark):
    text = 'он "x"  y ,z\nслово - слово...\n```\n"a"\n```\n1941-1945 `"` «a'
    got = {(r["line_no"], r["issue"]) for r in clean.typography_check(docs(spark, text, None)).collect()}
    assert got == {(1, "straight_quotes"), (1, "double_space"), (1, "space_before_sign"), (2, "hyphen_for_dash"), (2, "dots_for_ellipsis"), (6, "hyphen_in_years"), (6, "unpaired_quotes")}


@pytest.mark.parametrize(
    "given, phrase, image, wanted",
    [
        ("Стоит отметить, что дом пуст.", "стоит отметить, что", "", "дом пуст."),
        ("Он, как известно, ушёл.", "как известно,", "", "Он, ушёл."),
        ("В наше время тихо. В НАШЕ ВРЕМЯ и в наше время", "в наше время", "сегодня", "Сегодня тихо. Сегодня и сегодня"),
        ("все чаще и чаще", "всё чаще", "редко", "Редко и чаще"),
        ("конец просто  \nновая", "просто", "", "конец  \nновая"),
    ],
)
def test_phrases(spark, given, phrase, image, wanted):
    assert one(spark, lambda s: clean.replace_phrase(s, phrase, image), given) == wanted


def test_words_icons_selection(spark):
    assert one(spark, lambda s: clean.replace_word(s, "еще", "ещё"), "Еще еще неещё ещё") == "Ещё ещё неещё ещё"
    assert one(spark, lambda s: clean.replace_icons(s, {"☀": "sun", "☀️": "SUN"}), "☀️ ☀") == "SUN sun"
    lines = spark.createDataFrame([(1, 1, "ну просто"), (1, 2, "ну просто да")], "doc_id int, line_no int, line string")
    chosen = spark.createDataFrame([(1, 2, "просто")], "doc_id int, line_no int, phrase string")
    assert clean.apply_selection(lines, chosen, {"просто": ""}).first()["text_new"] == "ну просто\nну да"
    r = clean.replace_all(docs(spark, "a.b", None), "text", "a.", "$1\\").orderBy("doc_id").collect()
    assert (r[0]["text_new"], r[0]["changes"]) == ("$1\\b", 1) and r[1]["text_new"] is None


def test_rules(spark):
    own = rules.make_rules([{"cat": "a", "level": "hard", "re": "с решимост\\w*"}, {"cat": "a", "re": "решимост\\w*"}, {"cat": "b", "level": "soft", "re": "луч\\w*"}])
    d = docs(spark, "Она с решимостью шла.\nЛучший луч", None, "")
    got = [(r["line_no"], r["fragment"], r["level"]) for r in rules.rule_findings(d, own).orderBy("line_no", "context").collect()]
    assert sorted(got) == [(1, "с решимостью", "hard"), (2, "Лучший", "soft"), (2, "луч", "soft")]
    assert one(spark, lambda s: rules.rule_clean(s, own), "Она с решимостью шла с решимостью.") == "Она шла."
    counts = {(r["cat"], r["level"]): r["n"] for r in rules.rule_counts(rules.rule_findings(d, own)).collect()}
    assert counts == {("a", "hard"): 1, ("b", "soft"): 2, (None, "hard"): 1, (None, "soft"): 2, (None, None): 3}
    for bad in ({"re": "x"}, {"cat": "a"}, {"cat": "a", "re": "x", "word": "y"}, {"cat": "a", "re": "("}, {"cat": "a", "re": "x*"}, {"cat": "a", "re": "x", "level": "z"}):
        with pytest.raises(ValueError):
            rules.make_rules([bad])


def test_phrase_counts_and_yo(spark):
    d = docs(spark, "Как известно, все. Всё!", "нет", None)
    assert [(r["phrase"], r["total"]) for r in rules.phrase_totals(d, ["как известно,", "нету"]).collect()] == [("как известно,", 1)]
    assert {(r["wrong"], r["n"]) for r in rules.yo_counts(d).collect()} == {("все", 1), ("всё", 1)}
    plan = {r["phrase"]: r["action"] for r in rules.cleaning_plan(rules.phrase_totals(d, ["как известно,", "нет"]), {"нет": "да"}).collect()}
    assert plan == {"как известно,": "manual", "нет": "replace"}
    assert rules.yo_letters(d).first()["letters"] == 1


def test_names(spark):
    d = docs(spark, "Вчера Иван Петров шёл. Иван ждал Капитан Петров и ПЕТРОВ.", "Вот Артём и Артем.", None)
    assert sorted(r["word"] for r in registry.name_candidates(d).collect()) == ["артем", "артем", "иван", "петров", "петров"]
    assert sorted(r["pair"] for r in registry.pair_candidates(d).collect()) == ["артем артем", "вот артем", "вчера иван", "иван петров", "петров петров"]
    assert [r["spellings"] for r in registry.spelling_variants(registry.cast_list(d)).collect()] == [["Артем", "Артём"]]


REG = "name string, forms array<string>, old_forms array<string>, old_dangerous array<string>, typos array<string>"


def test_mentions(spark):
    reg = spark.createDataFrame([("Иван Петров", ["Иван Петров", "Иван", "Ивана"], ["Ваня"], None, ["Иваан"]), ("", ["x"], None, None, None)], REG)
    d = docs(spark, "Иван Петров видел Ивана.\nВаня, Иваан; иванов", "Иван. Петров", None)
    m = registry.mentions(d, registry.terms(reg))
    assert sorted((r["doc_id"], r["line_no"], r["term"]) for r in m.collect()) == [(1, 1, "иван петров"), (1, 1, "ивана"), (1, 2, "ваня"), (1, 2, "иваан"), (2, 1, "иван")]
    c = registry.consistency(m).first()
    assert (c["ok"], c["old"], c["dangerous"], c["typo"], c["check"]) == (3, 1, 0, 1, True)
    assert registry.entity_notes(registry.entity_matrix(m)).first()["note"].startswith("# Иван Петров\n- [[1]] — 4")


def test_name_risk(spark):
    reserved = spark.createDataFrame([("app", "Telegram")], "category string, reserved string")
    names = spark.createDataFrame([("telegram",), ("Мой Telegram",), ("abc",), ("Словечко",), ("Две части",), (" ",), (None,)], "name string")
    got = {r["name"]: r["risk"] for r in registry.name_risk(names, reserved).collect()}
    assert got == {"telegram": "high", "Мой Telegram": "low", "abc": "raised", "Словечко": "medium", "Две части": "low", " ": "empty", None: "empty"}


def test_chars(spark):
    d = docs(spark, "﻿чисто\nа一б丁 ！\nx​y﻿", "Ð¡ ok", "чисто", None)
    got = {(r["doc_id"], r["line_no"], r["col"], r["codepoints"]) for r in chars.char_findings(d).collect()}
    assert got == {(1, 2, 2, "U+4E00"), (1, 2, 6, "U+FF01"), (1, 3, 2, "U+200B"), (1, 3, 4, "U+FEFF"), (2, 1, 1, "U+00D0 U+00A1")}
    assert chars.char_findings(d, cap=2).where("doc_id = 1").count() == 2
    t = chars.ai_traces(docs(spark, "сло­во pоза", "чисто")).first()
    assert (t["soft_hyphen"], t["mixed_words"]) == (1, 1)
    assert one(spark, chars.strip_invisible, "a​b­c d") == "abc d"
    assert one(spark, chars.strip_emoji, "да 👩‍🚀!") == "да!"
    issues = sorted((r["doc_id"], r["issue"]) for r in chars.integrity(docs(spark, "", None, "---\nа\n## x", "## x")).collect())
    assert issues == [(1, "EMPTY"), (2, "EMPTY"), (3, "FRONT_MATTER_OPEN")]


def test_validator(spark):
    note = "---\ndescription: d\ntags: [a]\n---\n# A\n#\n### C\n# B\n##X\n| a | b |\n| x |\n| 1 | 2 | 3 |\n| `a|b` | c |\n\n#123 [[]]\n```\nopen"
    d = spark.createDataFrame([(1, note, "v"), (2, "\n".join("экспл" * 20), "v"), (3, "---\na: b\n", "v"), (4, None, "v"), (5, "\n" * 60, "v")], "note_id int, text string, vault string")
    got = {(r["note_id"], r["code"]) for r in markdown.validate(d).collect()}
    need = {(1, "H_EMPTY"), (1, "H_JUMP"), (1, "H_MULTI_H1"), (1, "BAD_SEP"), (1, "TBL_COLS"), (1, "TBL_PIPE_IN_CODE"), (1, "TAG_NUMERIC"), (1, "WIKI_EMPTY"), (1, "FENCE_UNCLOSED"), (2, "EXPLODED"), (3, "FM_UNCLOSED")}
    assert need <= got and not {n for n, _ in got} & {4, 5}
    fixed = markdown.repair("\n".join("слово и слово" * 4))
    assert fixed == "слово и слово" * 4 and markdown.repair(fixed) == fixed
    assert markdown.repair("| `a|b` | c |") == "| `a\\|b` | c |"
    assert one(spark, markdown.table_cells, "| a \\| b | c |") is not None
    kinds = [r["kind"] for r in markdown.blocks(docs(spark, "# a\n- b\n1. c\n> d\n| e |\n---\nf\n```\ng\n```")).orderBy("line_no").collect()]
    assert kinds == ["heading", "bullet", "number", "quote", "table", "rule", "text", "code"]


def test_link_graph(spark):
    notes = spark.createDataFrame(
        [(1, "v", "a.md", "a", "[[b]] [[ghost]]"), (2, "v", "sub/b.md", "b", "[[A#x]] [[pic.png]]"), (3, "v", "lonely.md", "lonely", "text `[[a]]`"), (4, "w", "a.md", "a", None)],
        "note_id int, vault string, rel string, stem string, text string",
    )
    keys, files = links.note_keys(notes), spark.createDataFrame([("v", "PIC.png")], "grp string, file_name string")
    e = links.edges(notes)
    assert [r["target"] for r in links.broken_links(e, keys, files).collect()] == ["ghost"]
    assert sorted(r["note"] for r in links.orphan_notes(e, keys).collect()) == [3, 4]
    assert {(r["note"], r["incoming"], r["outgoing"]) for r in links.backlinks(e, keys).collect()} == {(1, 1, 1), (2, 1, 1), (3, 0, 0), (4, 0, 0)}
