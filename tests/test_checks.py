"""Typography with counts, case forms, dictionaries, Word texts, repairs, links in code, exit codes and the plain reader."""

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from skriptor.functions import links as L
from skriptor.functions import morph, state
from skriptor.functions import text as T
from skriptor.operators import chars, clean, links, markdown, registry, rules
from skriptor.plans import contract
from skriptor.sources import docx, files, plain, sinks

NB = " "


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("r")).first()["r"]


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "doc_id int, text string")


# typography -----------------------------------------------------------------

CASES = [
    ("Да,нет", "Да, нет", {"punct": 1}),
    ("слово , слово", "слово, слово", {"punct": 1}),
    ("Он ушёл.Свет погас", "Он ушёл. Свет погас", {"punct": 1}),
    ("А.С.Пушкин писал", "А. С. Пушкин писал", {"punct": 2}),
    ("Это так,т.е. потому что", "Это так, т. е. потому что", None),
    ("Тишина  стояла  кругом", "Тишина стояла кругом", {"punct": 2}),
    ("в 12:30 версия 1.2.3 вышла", None, {"punct": 0}),
    ("улыбнулся :) и :))", None, {"punct": 0}),
    ("| 5  | десять |", None, {"punct": 0}),
    ("пример.ру и сайт.com", None, {"punct": 0}),
    ("слово  -  слово", "слово — слово", {"dash": 1}),
    ("война 1941-1945 годов", "война 1941—1945 годов", {"dash": 1}),
    ("страницы 10–15", "страницы 10—15", {"dash": 1}),
    ("телефон +7-912-345-67-89", None, {"dash": 0}),
    ("Что?...", "Что?..", {"dots": 1}),
    ("Ну!...", "Ну!..", None),
    ("Подожди...", "Подожди…", None),
    ("Что?..", None, {"dots": 0}),
    ("он произнёс « важная мысль »", "он произнёс «важная мысль»", {"quotes": 2}),
    ("Он сказал: «— Пойдём.»", None, {"quotes": 0}),
    ('он сказал "да" и "нет"', "он сказал «да» и «нет»", {"quotes": 2}),
]


def test_typography_and_counts(spark):
    df = docs(spark, *[c[0] for c in CASES])
    set_ = {r["doc_id"]: r["t"] for r in df.select("doc_id", clean.typography(F.col("text")).alias("t")).collect()}
    counts = {r["doc_id"]: r for r in clean.typography_counts(df).collect()}
    for i, (given, wanted, n) in enumerate(CASES, 1):
        assert set_[i] == (given if wanted is None else wanted)
        assert all(counts[i][k] == v for k, v in (n or {}).items()), (given, counts[i])


@pytest.mark.parametrize(
    "given, wanted, n",
    [
        ("И.И. Иванов вошёл", f"И.{NB}И.{NB}Иванов вошёл", 2),
        ("и т.д. и др. факты", f"и{NB}т.{NB}д. и{NB}др. факты", 3),
        ("в 1812 году отдадим 5 тыс. руб.", f"в{NB}1812{NB}году отдадим 5{NB}тыс. руб.", None),
        ("шли 10 лет до 12 марта", f"шли 10{NB}лет до{NB}12{NB}марта", None),
    ],
)
def test_no_break_spaces(spark, given, wanted, n):
    assert one(spark, lambda s: clean.typography(s, nbsp=True), given) == wanted
    if n is not None:
        assert clean.typography_counts(docs(spark, given), nbsp=True).first()["nbsp"] == n


def test_counts_leave_code_alone(spark):
    r = clean.typography_counts(docs(spark, "`a - b` и a - b\n```\na - b\n```\n`a - б", None)).collect()
    assert len(r) == 1 and r[0]["dash"] == 2


def test_long_texts_in_linear_time(spark):
    text = "\n".join(["слово - слово ..."] * 60000) + "\n```\nкод\n```\n"
    df = docs(spark, text).cache()
    for expr in (lambda c: F.size(state.masks(c)), lambda c: F.size(T.offsets(c, "слово")), lambda c: F.length(clean.clean_separators(c))):
        began = time.perf_counter()
        df.select(expr(F.col("text"))).collect()
        assert time.perf_counter() - began < 25


def test_rules_overlap(spark):
    own = rules.make_rules([{"cat": "a", "re": "бв"}, {"cat": "b", "re": "абв|вг"}, {"cat": "c", "level": "soft", "re": "г+"}])
    got = sorted((r["fragment"], r["cat"], r["line_no"]) for r in rules.rule_findings(docs(spark, "абвг\nабв вг г", None), own).collect())
    # the first rule keeps its place, so what overlaps it is dropped
    assert got == [("бв", "a", 1), ("бв", "a", 2), ("вг", "b", 2), ("г", "c", 1), ("г", "c", 2)]
    left = {r["level"]: (r["before"], r["left"]) for r in rules.control_pass(docs(spark, "абвг"), own).collect()}
    assert left == {"hard": (1, 0), "soft": (1, 1)} and contract.exit_code(rules.control_pass(docs(spark, "абвг"), own)) == 0


# names ----------------------------------------------------------------------


@pytest.mark.parametrize(
    "word, some",
    [
        ("иван", {"ивана", "ивану", "иваном", "иване"}),
        ("андрей", {"андрея", "андрею", "андреем"}),
        ("игорь", {"игоря", "игорем"}),
        ("мария", {"марии", "марию", "марией"}),
        ("ольга", {"ольги", "ольге", "ольгу", "ольгой"}),
        ("петров", {"петрова", "петрову", "петровым"}),
        ("петрова", {"петровой", "петрову"}),
        ("жилинский", {"жилинского", "жилинскому", "жилинским"}),
        ("жилинская", {"жилинской", "жилинскую"}),
        ("john", set()),
        ("ян", set()),
    ],
)
def test_case_forms(spark, word, some):
    got = set(one(spark, morph.case_forms, word))
    assert got >= {word} | some and (some or got == {word})


def test_terms_and_forms(spark):
    assert one(spark, morph.term_forms, "Мастер Иван")[:2] == ["мастер иван", "мастер ивана"] and one(spark, morph.term_forms, " ") == []
    p = morph.term_pattern(["общество"], ["иван", "общество"])
    assert [r["hit"] for r in one(spark, lambda s: T.offsets(s, p), "Иван, иван и ОБЩЕСТВО")] == ["Иван", "ОБЩЕСТВО"]
    both, keys = morph.combined({"a": "x+", "b": "y"})
    assert both == "(x+)|(y)" and keys == ["a", "b"]
    with pytest.raises(ValueError):
        morph.combined({"a": "(x)"})
    schema = "name string, forms array<string>, old_forms array<string>, old_dangerous array<string>, typos array<string>"
    reg = spark.createDataFrame([("Иван", ["Иван", "Ивану"], ["Пётр"], ["Ольга"], None), (" ", ["Олег"], None, None, None)], schema)
    got = {r["field"]: r["missing"] for r in registry.unlisted_forms(reg).collect()}
    assert got == {"forms": ["ивана", "иване", "иваном"], "old_forms": ["пётра", "пётре", "пётром", "пётру"]}
    found = registry.mentions(docs(spark, "видел Ивана и Иваном"), registry.inflected(registry.terms(reg)))
    assert found.count() == 2


def test_terms_of_any_length(spark):
    schema = "name string, forms array<string>, old_forms array<string>, old_dangerous array<string>, typos array<string>"
    reg = spark.createDataFrame([("Общество друзей старого города", None, None, None, None), ("Издательство «Лобузолунов и сыновья»", None, None, None, None)], schema)
    d = docs(spark, "Вчера общество друзей старого города собралось. Общество друзей", "В издательстве и Издательство «Лобузолунов и сыновья»")
    assert sorted((r["doc_id"], r["entity"]) for r in registry.mentions(d, registry.terms(reg)).collect()) == [(1, "Общество друзей старого города"), (2, "Издательство «Лобузолунов и сыновья»")]
    matrix = spark.createDataFrame([("A", i, 1 + i % 3) for i in range(25)] + [("B", 1, 1)], "entity string, doc_id int, n long")
    notes = registry.entity_notes(matrix, block=10).collect()
    a = sorted((r["part"], r["texts"]) for r in notes if r["entity"] == "A")
    assert a == [(0, 10), (1, 10), (2, 5)] and sum(r["note"].count("[[") for r in notes) == 26


def test_yo_places(spark):
    got = [tuple(r) for r in rules.yo_occurrences(docs(spark, "﻿Все тут.\nОн шел и шёл", None)).orderBy("line_no", "found").collect()]
    assert [(r[1], r[2], r[3]) for r in got] == [(1, "Все", "всё"), (2, "шел", "шёл"), (2, "шёл", "шел")] and got[0][5] == "Все тут."


# characters and pages -------------------------------------------------------


def test_bad_unicode(spark):
    d = docs(spark, "a\x01b\x02\nok�", "чисто", None)
    assert [(r["line_no"], r["kind"], r["codepoints"], r["n"]) for r in chars.bad_unicode(d).orderBy("line_no", "kind").collect()] == [(1, "control", "U+0001", 2), (2, "private use", "U+E000", 1), (2, "replacement", "U+FFFD", 1)]
    assert one(spark, chars.strip_bad, "a\x01b c�") == "ab\nc"


def test_icons_in_pages(spark):
    icons = {"☀️": "<svg id=s/>", "☀": "<svg id=t/>"}
    page = '<style>x</style>\nb.textContent = "☀️";\nt.textContent = msg;'
    done = one(spark, lambda s: clean.icons_in_page(s, icons, always=["= msg"]), page)
    assert 'b.innerHTML = "<svg id=s/>"' in done and "t.innerHTML = msg" in done and done.count(clean.ICON_MARK) == 1
    assert one(spark, lambda s: clean.icons_in_page(s, icons, always=["= msg"]), done) == done
    assert one(spark, lambda s: clean.icons_in_page(s, {}), page) == page
    assert one(spark, lambda s: clean.icon_counts(s, icons), "☀️☀ ☀") == {"☀️": 1, "☀": 2}


@pytest.mark.parametrize("given, wanted", [("&eacute;&#1087;&#x41F;", "éпП"), ("&amp;lt;", "&lt;"), ("&none; &#0; a & b", "&none; � a & b"), ("&lt;b&gt;", "<b>")])
def test_entities(spark, given, wanted):
    assert one(spark, T.html_to_text, given) == wanted


# notes ----------------------------------------------------------------------


def test_links_outside_code(spark):
    text = "[[a]] `[[x]]`\n\n    [[code]]\n\n    [[code2]]\n- item\n    [[b]]\n\n\n    [[code3]]\nтекст [[c]]\n```\n[[y]]\n```\n    [[d]]"
    assert one(spark, lambda s: F.transform(L.wiki_targets(s), L.clean_wiki), text) == ["a", "b", "c", "d"]
    assert one(spark, L.wiki_targets, "    [[x]]\n[[y]]") == ["y"]
    long = "текст\n\n" + "    [[x]]\n" * 20000 + "[[y]]"
    assert one(spark, L.wiki_targets, long) == ["y"]


def test_markdown_links_from_their_folder(spark):
    notes = spark.createDataFrame(
        [(1, "v", "sub/a.md", "a", "[x](../b.md) [y](./c/d.md) [z](gone.md) [w](http://x.y) [p](../pics/i.png)"), (2, "v", "b.md", "b2", ""), (3, "v", "sub/c/d.md", "d3", "")],
        "note_id int, vault string, rel string, stem string, text string",
    )
    attached = spark.createDataFrame([("v", "other.png", "pics/i.png")], "grp string, file_name string, rel string")
    e = links.edges(notes, markdown=True)
    assert [(r["kind"], r["target"]) for r in links.broken_links(e, links.note_keys(notes), attached).collect()] == [("markdown", "gone")]
    assert [r["code"] for r in markdown.validate(notes, links.note_keys(notes), attached).collect()] == ["MDLINK_BROKEN"]


def test_front_matter_and_repair(spark):
    assert markdown.front_matter_codes("---\ndescription: d\ntags: [a]\n---\n") == []
    assert markdown.front_matter_codes("---\na: b: c\n---\n") == ["FM_YAML"] and markdown.front_matter_codes("---\n- a\n---\n") == ["FM_YAML"]
    assert markdown.front_matter_codes("---\ndescription:\ntags: {a: 1}\n---") == ["FM_DESC", "FM_TAGS"]
    given = '---\nlinks: [[A]], [[B]]\nnote: one: two\nok: "x: y"\nlist: [a, b]\n---\n| a | b |\n| - | - |\n| `x|y` | 1 |\n| `x|y` | 1 | 2 |\n'
    wanted = '---\nlinks:\n  - "[[A]]"\n  - "[[B]]"\nnote: "one: two"\nok: "x: y"\nlist: [a, b]\n---\n| a | b |\n| - | - |\n| `x\\|y` | 1 |\n| `x|y` | 1 | 2 |\n'
    assert markdown.repair(given) == wanted and markdown.repair(wanted) == wanted
    assert one(spark, markdown.tags_of, "a #один, #2. b#c ##d (#e) #123") == ["один", "2", "e", "123"]
    assert one(spark, markdown.without_spans, "a `b` c `d") == "a  c `d"


# files ----------------------------------------------------------------------


def test_plain_reader():
    assert plain.load("a: 1\nb:\n- x\n- k: [1, 'b c', \"d\"]\nc: {k: v}\nd: |\n  x\n  y\ne: t # no\nf: ~") == {"a": 1, "b": ["x", {"k": [1, "b c", "d"]}], "c": {"k": "v"}, "d": "x\ny", "e": "t", "f": None}
    assert plain.load("") is None and plain.load("# only\n") is None
    for bad in ("a: b: c", "a: [1", 'a: "x', "\ta: 1", "a: 1\n  b: 2", "x: *y"):
        with pytest.raises(ValueError):
            plain.load(bad)


def test_dictionaries(spark, tmp_path):
    path = tmp_path / "d.yaml"
    path.write_text("ru:\n- просто\n- просто\n-\nen: [just]\n", encoding="utf-8")
    assert files.read_words(str(path), ["x"]) == ["просто", "just"] and files.read_words(str(tmp_path / "none"), ["x"]) == ["x"]
    path.write_text("замены:\n  как известно: \n  в наше время: сегодня\n", encoding="utf-8")
    assert files.read_mapping(str(path), {}) == {"как известно": "", "в наше время": "сегодня"}
    path.write_text("пары:\n- [еще, ещё]\n- [один]\nмел: {мел: мёл}\n", encoding="utf-8")
    assert files.read_pairs(str(path), {}) == {"пары": [("еще", "ещё")], "мел": [("мел", "мёл")]}
    path.write_text("app:\n- Word\n- Excel\n", encoding="utf-8")
    assert files.read_reserved(spark, str(path)).count() == 2 and files.read_reserved(spark, None, [("a", "b")]).count() == 1
    path.write_text("a: [", encoding="utf-8")
    assert files.read_words(str(path), ["x"]) == ["x"] and files.read_mapping(str(path), {"k": "v"}) == {"k": "v"}


def test_registry_round_trip(spark, tmp_path):
    rows = [("Имя «х»", ["Имя", 'a"b'], ["Старое"], [], ["опч"]), ("Б", [], [], ["В: г"], [])]
    path = str(tmp_path / "r" / "registry.yaml")
    for _ in range(2):
        sinks.write_registry(spark.createDataFrame(rows, files.REGISTRY_SCHEMA), path)
    assert sorted(tuple(r) for r in files.read_registry(spark, path).collect()) == sorted(rows)
    many = spark.createDataFrame([(f"n{i}", i) for i in range(5)], "name string, n int")
    assert sinks.registry_yaml(many, 2).startswith("# the 2 most frequent") and sinks.registry_yaml(many, None).count("имя") == 5
    assert "there are more" in sinks.report(many, "T", 2) and "there are more" not in sinks.report(many, "T", None)


def test_versions(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id int, text string, text_new string")
    sinks.write_versions(rows((1, "a", "b"), (2, "c", "c")), path)
    sinks.write_versions(rows((1, "b", "d"), (3, "e", "f")), path)
    first = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/first*").collect()}
    assert first == {1: "a", 3: "e"} and {tuple(r) for r in spark.read.parquet(f"{path}/version2").collect()} == {(1, "d"), (3, "f")}


def test_word_documents(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<?xml version="1.0"?><w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>ста</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>рый д</w:t></w:r><w:r><w:t>ом и старый</w:t></w:r></w:p></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    data, n = docx.replace_in_document(out.getvalue(), "старый", "новый ")
    assert n == 2 and files.docx_text(data) == "новый  дом и новый "
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode()
    assert "<w:b" in xml and "xml:space" in xml
    assert docx.replace_in_document(b"none", "a", "b") == (b"none", 0)
    df = spark.createDataFrame([("a.docx", bytearray(out.getvalue())), ("b.docx", None)], "path string, content binary")
    assert {r["path"]: r["changes"] for r in docx.replace_documents(df, r"ста(\w+)", r"<\1>", regex=True).collect()} == {"a.docx": 2, "b.docx": 0}
    marked = sinks.docx_bytes([("text", 0, "a **b** *c* `d`"), ("table", 0, "| x | y |"), ("table", 0, "|---|---|")])
    assert files.docx_text(marked) == "a b c d\nx\ty"


def test_encodings_by_plausibility():
    for code in ("cp866", "cp1251", "koi8-r"):
        text = "The file holds a word: " + "молоток " + "and so on, only in English. " * 3
        assert files.detect_encoding(text.encode(code)) == code
    assert files.detect_encoding("naïve café".encode("cp1252")) == "cp1252"


# contract -------------------------------------------------------------------


def test_exit_codes_and_smoke(spark, tmp_path):
    frame = lambda c, *v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    assert contract.exit_code(frame("severity", "INFO", "WARN")) == 0 and contract.exit_code(frame("severity", "ERROR")) == 1
    assert contract.exit_code(frame("x")) == 0 and contract.exit_code(frame("x", "a")) == 1
    known = {"good": lambda s, d: frame("x"), "bad": lambda s, d: s.read.parquet(f"{d}/none.parquet")}
    assert contract.run(known, spark, "good", "/tmp") == 0 and contract.run(known, spark, "bad", str(tmp_path)) == 2 and contract.run(known, spark, "other", "/tmp") == 2
    got = {r["query"]: (r["rows"], r["error"] is None) for r in contract.smoke(known, spark, str(tmp_path)).collect()}
    assert got == {"good": (0, True), "bad": (None, False)}


def test_audit_total_is_of_its_rows(spark):
    from skriptor.plans import audit

    out = audit.audit(spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 2  # the checks aren't part of the plan twice
    rows = {r["ord"]: r for r in out.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 7] and rows[7]["serious"] == any(rows[i]["serious"] for i in range(1, 7))
    assert all(rows[7][c] == sum(rows[i][c] for i in range(1, 7)) for c in ("serious_n", "other_n"))


def test_audit_runs_its_checks_one_by_one(spark):
    import re

    from skriptor.plans import audit

    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    audit.audit(spark, "/root/testdata/sf0.001").collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList(before, 1000)
    plans = [ran.apply(i).physicalPlanDescription() for i in range(ran.size())]
    # nodes are listed by number after the tree: what the driver holds for one execution
    most = max(len(set(re.findall(r"^\((\d+)\) Exchange", p, re.M))) for p in plans)
    assert len(plans) >= 7 and 0 < most < 60, (len(plans), most)
