"""Statistics, forms, encodings and stuffed pages on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skriptor.llm import encoding, forms, quality, stuffing

NOUN = "кузнец молот мельник фонарь пекарь колокол швея билет лодочник якорь рыбак посылка".split()
VERB = "нашёл потерял открыл спрятал вернул поднял".split()
PLACE = ["у северной стены", "в пустом зале", "на старом мосту", "под навесом", "за печью", "среди развалин"]


def prose(rng, n):
    return " ".join(f"{rng.choice(NOUN).capitalize()} {rng.choice(VERB)} {rng.choice(NOUN)} {rng.choice(PLACE)}." for _ in range(n))


def docs(spark, rows, key="doc_id"):
    return spark.createDataFrame(rows, f"{key} bigint, text string").withColumn("key", F.lit(1)).withColumn("lang", F.lit("x"))


# text quality ---------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 6)) for i in range(60)]
    lists = ["\n".join(f"- {rng.choice(NOUN)}" for _ in range(15)), "\n".join(f"{rng.choice(NOUN)};{i};{rng.choice(NOUN)};{i}.5" for i in range(15)), "\n".join("%040x" % rng.getrandbits(160) for _ in range(8))]
    rows += [(100 + i, t) for i, t in enumerate(lists)]
    rows += [(200, None), (201, ""), (202, "  \n "), (203, "Кузнец нашёл молот."), (204, prose(rng, 4) + "\n- молот\n- якорь"), (0, rows[0][1]), (205, prose(rng, 30).replace(" у ", "\nу "))]
    got = {r["doc_id"] for r in quality.found(docs(spark, rows)).collect()}
    assert got == {100, 101, 102}
    assert quality.found(docs(spark, rows).where("false")).count() == 0


def test_tail_shares_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["ru", "en"]), float(rng.randrange(6)), float(rng.randrange(1000))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, a double, b double")
    got = {(r["doc_id"], r["stat"]): r["tail"] for r in quality.tail_shares(df, "doc_id", {"a": "low", "b": "high"}).collect()}
    for i, lang, a, b in rows:
        own = [r for r in rows if r[1] == lang]
        assert got[i, "a"] == pytest.approx(sum(r[2] <= a for r in own) / len(own))
        assert got[i, "b"] == pytest.approx(sum(r[3] >= b for r in own) / len(own))


def test_quality_hot_copies(spark):
    rng = random.Random(8)
    hot = "\n".join(f"- {n} {v}" for n, v in zip(NOUN, VERB * 2))
    rows = [(i, prose(rng, 6)) for i in range(60)] + [(100 + i, hot) for i in range(60)]
    rows += [(200 + i, "\n".join("%040x" % rng.getrandbits(160) for _ in range(8))) for i in range(20)]
    rows += [(300 + i, "\n".join(f"{rng.choice(NOUN)};{i};{rng.choice(NOUN)};{i}.5" for i in range(15))) for i in range(10)]
    got = {r["doc_id"] for r in quality.found(docs(spark, rows)).collect()}
    assert got == {x for x, _ in rows if x >= 100}


def test_quality_score_alone(spark):
    rng = random.Random(9)
    for junk in (3, 30, 110):  # the cut-off follows the share of the class
        rows = [(i, prose(rng, rng.randrange(2, 9)) + "\n" * rng.randrange(2) + prose(rng, 2)) for i in range(220)]
        rows += [(1000 + i, "\n".join(f"{k}. {rng.choice(NOUN)}" if i % 2 else f"{rng.choice(NOUN)};{k};{rng.choice(NOUN)}" for k in range(12))) for i in range(junk)]
        got = {r["doc_id"] for r in quality.found(docs(spark, rows), check=False).collect()}
        wanted = {x for x, _ in rows if x >= 1000}
        assert len(got & wanted) >= 0.97 * len(wanted) and len(got) <= (len(wanted) + 2) * 1.05 if junk > 3 else True


def test_quality_languages(spark):
    assert quality.language("der mann und die frau sind nicht in dem haus".split()) == "de"
    assert quality.language("він і вона не були в саду".split()) == "uk"
    assert quality.language("кузнец нашёл молот".split()) == "ru" and quality.language("xq zv de".split()) == "en" and quality.language([]) == ""
    assert quality.language("ἐν ἀρχῇ ἦν".split()) == "greek"


def test_cut_off_needs_a_class_apart():
    rng = np.random.RandomState(1)
    bulk = np.bincount((rng.gamma(4, 0.2, 3000) / quality.BIN).astype(int))
    assert quality.cut_off(bulk) is None and quality.cut_off(np.array([3])) is None
    both = np.bincount((np.concatenate([rng.gamma(4, 0.2, 3000), rng.normal(4, 0.2, 60)]) / quality.BIN).astype(int))
    assert 2.0 < quality.cut_off(both) < 3.6


# forms ----------------------------------------------------------------------


@pytest.mark.parametrize(
    "given, wanted, kinds",
    [
        ("Ａ！", "A!", ["width"]),
        ("cafe\u0301", "caf\u00e9", ["accent"]),
        ("за́мок", "за́мок", []),
        ("сло­во", "слово", ["invisible"]),
        ("a\u2009b\u00a0c", "a b c", ["space"]),
        ("кто‑то", "кто-то", ["hyphen"]),
        ("ﬁnd", "find", ["ligature"]),
        ("pоза", "роза", ["look-alike"]),
        ("nоtіce", "notice", ["look-alike"]),
        ("👩‍🚀 ☀️", "👩‍🚀 ☀️", []),
        ("﻿ok", "﻿ok", []),
        ("ok﻿", "ok", ["invisible"]),
        ("№ 5… — «a» USB-кабель α", "№ 5… — «a» USB-кабель α", []),
        ("", "", []),
    ],
)
def test_forms(given, wanted, kinds):
    apply = forms.transducer()
    assert apply(given) == (wanted, kinds)
    assert apply(wanted)[0] == wanted


def test_forms_frame(spark):
    rows = [(1, "pоза"), (2, None), (3, ""), (1, "pоза"), (None, "x"), (4, "о" * 100000 + "p")]
    got = {r["doc_id"]: (r["form"], r["kinds"]) for r in forms.unify(docs(spark, rows)).collect()}
    assert got[1] == ("роза", ["look-alike"]) and got[2] == (None, []) and got[3] == ("", []) and len(got[4][0]) == 100001
    assert forms.unify(docs(spark, rows).where("false")).count() == 0


def test_table_has_no_conflicts():
    table = forms.build_table()
    assert table["e\u0301"] == ("\u00e9", "accent") and all(k != v[0] for k, v in table.items())


def test_form_of_a_form_is_itself():
    apply, rng = forms.transducer(), random.Random(1)
    blocks = [(0x20, 0x180), (0x300, 0x370), (0x370, 0x530), (0x1100, 0x1200), (0x1E00, 0x2070), (0x2100, 0x2130), (0xFB00, 0xFB07), (0xFE00, 0xFE10), (0xFF00, 0xFF61), (0x1F300, 0x1F400)]
    pool = [chr(c) for r in blocks for c in range(*r)]
    near = list("eoасеКиK\u0301\u0308\u0306\u200b\u200d\ufe0f☀👩\u00ad\u1112\u1161\u11ab ")
    for i in range(8000):
        text = "".join(rng.choice(near if i % 2 else pool) for _ in range(rng.randrange(1, 9)))
        once = apply(text)[0]
        assert apply(once) == (once, apply(once)[1]), text.encode("unicode_escape")


@pytest.mark.parametrize("given, wanted", [("ｅ\u0301", "é"), ("e\u200b\u0301", "é"), ("co\u00ad\u043e\u0301p", "coóp"), ("\u212b", "Å"), ("\u212a", "K"), ("\u1112\u1161\u11ab", "한"), ("a\u0302\u0323", "ậ")])
def test_forms_at_seams(given, wanted):
    assert forms.transducer()(given)[0] == wanted


# encodings ------------------------------------------------------------------


@pytest.mark.parametrize("pair", encoding.PAIRS, ids=lambda p: p[0])
def test_damage_is_undone(pair):
    text = encoding.OWN_SEEDS.get(pair[1], ["Кузнец нашёл молот"])[0]  # encodings without Russian letters
    assert encoding.restore(encoding.damage(text, pair), pair) == (text, True)


def test_garbled(spark):
    rng = random.Random(7)
    clean = [(i, prose(rng, 8)) for i in range(120)]
    bad = []
    for k, name in enumerate(["utf-8 as cp1252", "utf-8 as cp1251", "cp1251 as cp1252", "koi8-r as cp1251", "cp866 as cp1251", "utf-8 as koi8-r"]):
        pair = next(p for p in encoding.PAIRS if p[0] == name)
        bad.append((500 + k, prose(rng, 2) + "\n" + encoding.damage(prose(rng, 2), pair)))
    rows = clean + bad + [(900, None), (901, ""), (902, "зна�ки"), (500, bad[0][1]), (903, "НАДПИСЬ ЗАГЛАВНЫМИ")]
    df = docs(spark, rows)
    model = encoding.train([(df, "text")])
    got = encoding.find_garbled(df, model, "doc_id", "text").collect()
    assert {r["rec_id"] for r in got} == {500, 501, 502, 503, 504, 505, 902}
    assert sum(r["rec_id"] == 500 for r in got) == 2
    assert all(r["complete"] and "Ð" not in r["restored"] for r in got if r["rec_id"] in (500, 502))
    assert not next(r for r in got if r["rec_id"] == 902)["complete"]
    assert encoding.find_garbled(df.where("false"), model, "doc_id", "text").count() == 0


def test_screen_agrees_with_search():
    rng = random.Random(9)
    texts = [prose(rng, 3) for _ in range(40)]
    model = encoding._train(texts)
    pair = encoding.PAIRS[0]
    probe = [*texts[:10], *(encoding.damage(t, pair) for t in texts[10:14]), "слово " + encoding.damage("ещё", pair)]
    marked = [bool(p.any()) for p in model.label(probe)]
    assert all(s for s, m in zip(model.suspects(probe), marked) if m) and marked[10:14] == [True] * 4


def test_long_texts_are_searched_in_stretches():
    rng = random.Random(10)
    texts = [prose(rng, 3) for _ in range(60)]
    model, pair = encoding._train(texts), encoding.PAIRS[2]
    clean = prose(rng, 4000)
    text = clean[:90000] + " " + encoding.damage("Кузнец нашёл молот", pair) + " " + clean[90000:]
    (got,) = encoding.judge(model, [text])
    assert got[0] == clean[:90000] + " Кузнец нашёл молот " + clean[90000:] and got[1]
    whole = prose(rng, 400)
    (got,) = encoding.judge(model, [encoding.damage(whole, pair)])  # longer than a piece
    assert got[0] == whole and got[2] == ["utf-8 as cp1251"]


def test_nothing_is_lost_by_restoring():
    rng = random.Random(12)
    model = encoding._train([prose(rng, 3) for _ in range(60)])
    for text, name in (("Straße über Köln", "utf-8 as cp1252"), ("Łódź i Wrocław są piękne, żółw", "cp1250 as cp1252"), ("你好世界今天", "gbk as cp1252")):
        pair = next(p for p in encoding.PAIRS if p[0] == name)
        (got,) = encoding.judge(model, ["Note: " + encoding.damage(text, pair) + " and more."])
        assert got and "\ufffd" not in got[0] and (got[0] == f"Note: {text} and more." or not got[1])
    assert encoding.judge(model, ["¿Qué hora es?", "Österreich für Mädchen", "5 m³ за £20 ± 3 °C", "日本語テキスト"]) == [None] * 4


def test_sample_is_of_different_texts(spark):
    rng = random.Random(13)
    rows = [(i, "копия " * 30) for i in range(300)] + [(1000 + i, prose(rng, 3)) for i in range(40)]
    model = encoding.train([(docs(spark, rows), "text")], rows=40)
    assert encoding.judge(model, [encoding.damage("Кузнец нашёл молот", encoding.PAIRS[0])])[0][0] == "Кузнец нашёл молот"


def test_model_is_of_all_texts(spark):
    rng = random.Random(17)
    texts = [f"{prose(rng, 2)} {i}" for i in range(1000)] + ["Щегол " * 900 + "Ёжик…"]
    texts += [encoding.damage(t, encoding.PAIRS[2]) for t in texts[:30]]
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:200], "", None])]
    model, whole = encoding.train([(docs(spark, rows), "text")]), encoding._train(texts)
    assert (model.index == whole.index).all() and (model.tables == whole.tables).all()


@pytest.mark.parametrize("pair", [p for p in encoding.PAIRS if p[1] not in encoding.OWN_SEEDS], ids=lambda p: p[0])
def test_damaged_counts_follow_from_clean_ones(pair):
    texts = [*encoding.SEEDS, "Ёжик — друг", "x", "ß"]
    prev, cur, n = encoding._damaged(*encoding.Counts.of(texts).side(False)[:3], pair)
    key, n, _ = encoding._merged([(prev << 21 | cur, n, n)])
    prev, cur, times, _ = encoding.Counts.of([encoding.damage(t, pair) for t in texts]).side(False)
    assert (key == prev << 21 | cur).all() and (n == times).all()


# stuffed pages --------------------------------------------------------------


def test_stuffing(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 12)) for i in range(150)]
    goods = ["букет роз", "шины недорого", "садовый насос"]
    rows.append((500, "; ".join(f"{rng.choice(['купить', 'цена', 'фото'])} букет роз" for _ in range(60))))
    rows.append((501, "\n".join(f"https://a{rng.randrange(10**6)}.test/x" for _ in range(30))))
    rows.append((502, "\n".join(f"- [{rng.choice(goods)}](http://b{i}.example/{i})" for i in range(25))))
    rows.append((503, " ".join(f"#{rng.choice(goods).replace(' ', '_')}" for _ in range(40))))
    rows.append((600, "\n".join(f"{prose(rng, 2)} Источник: [Книга {i}](http://c{i}.test/x)." for i in range(6))))
    rows.append((601, "\n".join(["молот лежит у стены, и фонарь горит в зале"] * 12)))
    rows += [(602, None), (603, ""), (604, prose(rng, 10) + "\n#молот #якорь"), (500, rows[150][1])]
    df = docs(spark, rows)
    got = {r["doc_id"] for r in stuffing.found(stuffing.collocations(df)).collect()}
    assert got == {500, 501, 502, 503}
    assert stuffing.found(stuffing.collocations(df.where("false"))).count() == 0
    zero = {r["doc_id"]: r["pairs"] for r in stuffing.collocations(df).where("doc_id in (602, 603)").collect()}
    assert zero == {602: 0, 603: 0}


def test_stuffing_own_phrase(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 12)) for i in range(150)]
    rows.append((500, " ".join(f"Зумбракс Кварт-7 {rng.choice(['купить', 'цена', 'фото', 'оптом'])}" for _ in range(40))))
    rows += [(600, prose(rng, 40).encode().decode("koi8-r")), (601, prose(rng, 40).encode().decode("cp866"))]
    got = {r["doc_id"] for r in stuffing.found(stuffing.collocations(docs(spark, rows))).collect()}
    assert got == {500}


def test_stuffing_rare_in_a_large_corpus():
    page = " ".join(f"зумбракс кварт {w}" for w in "купить цена фото оптом".split() * 10)
    names = [x.split()[0] for x in ("words x, pairs x, " + stuffing.SCHEMA.split(", ", 2)[2]).split(", ")]
    for size in (2e8, 2e11):
        pairs, words = (np.full(1 << b, max(50.0, size / (1 << b)), np.float32) for b in (stuffing.PAIR_BITS, stuffing.WORD_BITS))
        got = dict(zip(names, stuffing._describe([page], pairs, words, size, size)))
        assert got["kinds"][0] <= stuffing.FEW_WORDS * got["words"][0] ** 0.5 and got["repeated"][0] > 0.3 and got["collocated"][0] > stuffing.STUFFED


def test_stuffing_hot_group(spark):
    rng = random.Random(11)
    links = lambda i: "\n".join(f"https://h{i}x{k}.example/{k}" for k in range(30))
    words = lambda: ", ".join(f"{rng.choice(['купить', 'цена', 'фото'])} букет роз" for _ in range(40))
    rows = [(i, prose(rng, 12)) for i in range(120)] + [(500 + i, links(i)) for i in range(40)] + [(600 + i, words()) for i in range(40)]
    got = {r["doc_id"] for r in stuffing.found(stuffing.collocations(docs(spark, rows))).collect()}
    assert got == {x for x, _ in rows if x >= 500}


def test_stuffing_repeated_lines(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 12)) for i in range(150)]
    rows.append((500, "\n".join(["buy cheap shoes"] * 200)))
    rows.append((501, "\n".join(["шины недорого", "купить шины оптом", "букет роз цена"] * 30)))
    rows.append((600, "\n".join(["молот лежит у стены, и фонарь горит в зале"] * 40)))
    rows.append((601, "\n".join(f"{prose(rng, 2)}\nТихо падал снег." for _ in range(8))))
    rows.append((602, "\n".join(["8 14 51"] * 40)))
    got = {r["doc_id"]: r["reason"] for r in stuffing.found(stuffing.collocations(docs(spark, rows))).collect()}
    assert got == {500: "collocations", 501: "collocations"}


def test_stuffing_lists_of_links(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, 12)) for i in range(150)]
    title = lambda i: f"Слово{i} имя{7 * i} дело{11 * i}"
    rows.append((500, "\n".join(f"{title(i)} https://unique{i}.example" for i in range(30))))
    rows.append((501, "\n".join(f"https://bare{i}.example/{i}" for i in range(5))))
    rows.append((502, prose(rng, 1) + "\n" + ", ".join(f"[{title(i)}](http://z{i}.test)" for i in range(12))))
    rows.append((600, "\n".join(f"{prose(rng, 1)} Источник: http://c{i}.test/x" for i in range(12))))
    rows.append((601, "\n".join(f"{title(i)} scan{i}.pdf" for i in range(12))))
    rows.append((602, "\n".join(f"- [[{title(i)}]]" for i in range(12))))
    rows.append((503, "\n".join(f"https://four{i}.example" for i in range(4))))
    rows.append((504, "\n".join(f"Товар {rng.choice(NOUN)} / {rng.choice(NOUN)} / {rng.randrange(100, 9999)} руб" for _ in range(25))))
    got = {r["doc_id"]: r["reason"] for r in stuffing.found(stuffing.collocations(docs(spark, rows))).collect()}
    assert got == {500: "links", 501: "links", 502: "links", 503: "links", 504: "collocations"}


def gathered_rows(monkeypatch):
    """Lengths of what is brought to the driver from now on."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen = []
    for name in ("collect", "toPandas"):
        plain = getattr(DataFrame, name)
        monkeypatch.setattr(DataFrame, name, lambda self, plain=plain: seen.append(out := plain(self)) or out)
    return seen


def test_corpus_counts_reach_the_driver_packed(spark, monkeypatch):
    words = [f"{a}{b}{c}" for a in "бвгджзклмн" for b in "аеиоу" for c in "прстфхцч"]
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choices(words, k=300))) for i in range(60)]
    seen = gathered_rows(monkeypatch)
    pairs, counted = stuffing.corpus_counts(docs(spark, texts).select("doc_id", "text"))
    assert sum(map(len, seen)) <= 16 and pairs.sum() == 60 * 299 and counted.sum() == 60 * 300
    c, doc, *_ = stuffing.read([t for _, t in texts])
    h, _ = stuffing._pairs(c, doc)
    assert (pairs == np.bincount(stuffing._cell(h, stuffing.PAIR_BITS), minlength=len(pairs))).all()
