"""Near duplicates and name variants against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from skriptor.llm import components, names, neardup

WORDS = [a + b + c for a in "бвгджз" for b in "аеиоу" for c in "клмн"]


def exact(texts, threshold=0.7):
    sets = {}
    for i, t in texts:
        w = [x.lower().replace("ё", "е") for x in neardup._WORD.findall(t or "")]
        if i is not None and len(w) >= 15:
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def corpus(seed, groups=25):
    rng, rows, i = random.Random(seed), [], 0
    shared = [rng.choice(WORDS) for _ in range(12)]
    for _ in range(groups):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(20, 90))] + shared
        for _ in range(rng.randrange(1, 5)):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(WORDS)
            rows.append((i, " ".join(t)))
            i += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_loop(spark, seed):
    rows = corpus(seed)
    rows += [(1000, rows[0][1]), (1001, rows[0][1].replace(" ", ", ").upper()), (1002, None), (1003, ""), (1004, "мало слов"), (None, rows[0][1]), rows[0]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("sig", F.lit(1)).withColumn("rep", F.lit(1)).withColumn("n", F.lit("x"))
    members, links = neardup.near_duplicates(df, threshold=0.7)
    got = [(r["a"], r["b"]) for r in neardup.document_pairs(members, links).collect()]
    assert len(got) == len(set(got)) and set(got) == exact(rows)
    one = neardup.document_classes(members, links).collect()
    assert len(one) == len({r["id"] for r in one}) and {r["copies"] for r in one if r["id"] in (0, 1000, 1001)} == {3}


def test_near_duplicates_long_lists(spark):
    rng = random.Random(4)
    base = [rng.choice(WORDS) for _ in range(60)]
    rows = []
    for i in range(60):  # one cluster that shares nearly all tokens
        t = list(base)
        t[rng.randrange(60)] = rng.choice(WORDS)
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, x) for i, x in corpus(5, 10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    members, links = neardup.near_duplicates(df, threshold=0.7, list_block=3)
    got = [(r["a"], r["b"]) for r in neardup.document_pairs(members, links).collect()]
    assert len(got) == len(set(got)) and set(got) == exact(rows)


@pytest.mark.parametrize("threshold", [0.4, 0.5, 0.9])
def test_near_duplicates_other_thresholds(spark, threshold):
    rows = corpus(7, 15)
    members, links = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), threshold=threshold)
    assert {(r["a"], r["b"]) for r in neardup.document_pairs(members, links).collect()} == exact(rows, threshold)


def test_layout():
    assert neardup.layout(0.7) == (24, 8)
    for threshold in (0.3, 0.5, 0.8):
        k, t = neardup.layout(threshold)
        assert sum(neardup.math.comb(k, i) * threshold**i * (1 - threshold) ** (k - i) for i in range(t)) <= neardup.MISSED
    with pytest.raises(ValueError):
        neardup.layout(0.05)


def test_near_duplicates_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    members, links = neardup.near_duplicates(none)
    assert members.count() == 0 and neardup.document_pairs(members, links).count() == 0
    long = " ".join(WORDS[i % 100] + WORDS[(i * 7) % 90] for i in range(30000))
    rows = spark.createDataFrame([(1, long), (2, long + " ещё"), *[(i, "раз два три четыре пять " * 4) for i in range(10, 40)]], "doc_id bigint, text string")
    members, links = neardup.near_duplicates(rows)
    got = {(r["a"], r["b"]) for r in neardup.document_pairs(members, links).collect()}
    assert (1, 2) in got and len(got) == 1 + 30 * 29 // 2
    assert links.count() == 1


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 200)] + [(rng.randrange(300, 330), rng.randrange(300, 330)) for _ in range(20)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]} or all(got[x] == find(x) for x in got) and len(got) >= 71
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    members = spark.createDataFrame([(i, 1) for i in range(600)] + [(1000, 2)], "id bigint, root bigint")
    assert components.pairs_within(members).count() == 600 * 599 // 2


SCHEMA = "entry_id bigint, name string, forms array<string>, old_forms array<string>, old_dangerous array<string>, typos array<string>, kind string"
GIVEN = [("Николай", "Коля"), ("Марина", "Мариша"), ("Арина", "Ариша"), ("Gregory", "Greg"), ("Gwendolyn", "Gwen"), ("Робин", "Роб")]


def test_names(spark):
    rows = [
        (1, "Николай Пехемегенов", None, None, None, None, "person"),
        (2, "Пехемегенов, Николай", [], [], [], [], "person"),
        (3, "доктор НИКОЛАЙ  ПЕХЕМЕГЕНОВ", None, None, None, None, None),
        (4, "Н. Пехемегенов", None, None, None, None, "person"),
        (5, "Коля Пехемегенов", None, None, None, None, "person"),
        (6, "Nikolay Pekhemegenov", None, None, None, None, "person"),
        (7, "Николай Пехемегнов", None, None, None, None, "person"),
        (8, "Николай Олегович Пехемегенов", None, None, None, None, "person"),
        (9, "Коля", ["Коля", "Николай Пехемегенов"], None, None, None, "person"),
        (10, "Пх Мгнв", None, None, None, ["Николай Пехемегенов"], "person"),
        (11, "Николай Новофамилин", None, ["Пехемегенов Николай"], None, None, "person"),
        (20, "Марина Пехемегенова", None, None, ["Николай Пехемегенов"], None, "person"),
        (21, "Арина Пехемегенова", None, None, None, None, "person"),
        (22, "А. Пехемегенова", None, None, None, None, "person"),
        (30, "Издательство «Лобузолунов и сыновья»", None, None, None, None, "org"),
        (31, "Изд-во Лобузолунов и сыновья", None, None, None, None, "org"),
        (32, "Izdatelstvo Lobuzolunov i synovya", None, None, None, None, None),
        (33, "«ЛОБУЗОЛУНОВ И СЫНОВЬЯ», ИЗДАТЕЛЬСТВО", None, None, None, None, "org"),
        (34, "Артель «Лобузолунов и сыновья»", None, None, None, None, "org"),
        (40, "Коля", None, None, None, None, "person"),
        (41, "Коля", ["Коля"], None, None, None, "person"),
        (50, None, ["Николай Пехемегенов"], None, None, None, "person"),
        (51, "  ", ["Николай Пехемегенов"], None, None, None, "person"),
        (60, "G. Pufotacack", None, None, None, None, "person"),
        (61, "Gregory Pufotacack", None, None, None, None, "person"),
        (62, "Gwendolyn Pufotacack", None, None, None, None, "person"),
        (1, "Николай Пехемегенов", None, None, None, None, "person"),
        (None, "Николай Пехемегенов", None, None, None, None, "person"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(1)).withColumn("m", F.lit("x"))
    table = spark.createDataFrame(GIVEN, "given_name string, short_name string")
    got = {(r["a"], r["b"]) for r in names.linked_pairs(df, table).collect()}
    one = list(range(1, 12))
    want = {(a, b) for a in one for b in one if a < b} | {(a, b) for a in (30, 31, 32, 33) for b in (30, 31, 32, 33) if a < b} | {(21, 22)}
    assert got == want
    assert names.linked_pairs(df.where("false"), table).count() == 0


def test_name_parts():
    given = {names.skeleton(x) for x in ("Николай", "Пётр")}
    assert names.skeleton("Шихафапенов") == names.skeleton("Shikhafapenov", True) and names.skeleton("Benjamin") == "benjamin"
    assert names.parse("И.Петров", None, given) == ("i", "i", "petrov")
    assert names.parse("Коля", None, given) is None
    assert names.parse("", None, given) is None
    assert names.within_one("abcd", "abdc") and names.within_one("abc", "abcd") and not names.within_one("abcd", "badc")


def test_organisations(spark):
    given = {names.skeleton("Николай")}
    assert names.parse("ООО Ромашка", "org", given) == names.parse("Ромашка", "org", given)
    assert names.parse("Acme Ltd", None, given) == names.parse("Acme, Inc.", "org", given) == ("o", "/", "acme")
    assert names.parse("International Business Machines", "org", given) == ("o", "/", "international business machines")
    assert names.parse("IBM", "org", given) == ("a", "/", "ibm") and names.parse("Арт. Северный", None, given) == names.parse("Артель «Северный»", "org", given)
    assert names.parse("Артель Северный", "org", given) != names.parse("Association Северный", "org", given) != names.parse("Академия Северный", "org", given)
    rows = [
        (1, "International Business Machines", None, None, None, None, "org"),
        (2, "IBM", None, None, None, None, "org"),
        (3, "International Business Machines Corp.", [], [], [], [], "org"),
        (4, "Internatonal Business Machines Inc", None, None, None, None, "org"),
        (5, "ООО «Ромашка»", None, None, None, None, "org"),
        (6, "Ромашка, АО", None, None, None, None, "org"),
        (7, "Academy Ромашка", None, None, None, None, "org"),
        (8, "Николай Press", None, None, None, None, "person"),
    ]
    root = {r["id"]: r["root"] for r in names.linked_entries(spark.createDataFrame(rows, SCHEMA), None).collect()}
    assert len({root[i] for i in (1, 2, 3, 4)}) == 1 and root[5] == root[6] and root.get(7) not in (root[5], root[1])


def test_given_names_at_two_sizes(spark):
    rng = random.Random(2)
    first, last = [w.capitalize() for w in WORDS[:12]], [w.capitalize() + "ов" for w in WORDS[20:]]
    small = [(i, f"{rng.choice(first)} {rng.choice(last)}") for i in range(300)]
    more = [(1000 + i, f"{rng.choice([w.capitalize() + 'ий' for w in WORDS[20:32]])} {rng.choice(last)}{rng.choice('абвг')}") for i in range(6000)]
    found = []
    for rows in (small, small + more):
        df = spark.createDataFrame([(i, n, None, None, None, None, "person") for i, n in rows], SCHEMA)
        found.append(names.learn(names.spellings(df), None).given & set(map(names.skeleton, first)))
    assert found[0] == found[1] == set(map(names.skeleton, first))


def test_names_common_error(spark):
    spelt = ["Николай Пехемегенов"] * 300 + ["Никлай Пехемегенов"] * 5
    df = spark.createDataFrame([(i, x, None, None, None, None, "person") for i, x in enumerate(spelt)], SCHEMA)
    root = {r["id"]: r["root"] for r in names.linked_entries(df, spark.createDataFrame(GIVEN, "given_name string, short_name string")).collect()}
    assert len(root) == 305 and len(set(root.values())) == 1  # as many errors as 300 entries explain


def test_near_duplicates_bring_no_row_a_cell(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    seen = []
    for name in ("collect", "toPandas"):
        plain = getattr(DataFrame, name)
        monkeypatch.setattr(DataFrame, name, lambda self, plain=plain: seen.append(len(out := plain(self))) or out)
    rows = corpus(3)
    _, links = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), threshold=0.7)
    assert max(seen) <= 64
    assert {(r["a"], r["b"]) for r in links.select("a", "b").toLocalIterator()} <= exact(rows)


def test_gathered_cells(spark):
    from skriptor.functions import sketch

    want = {0: 1, 5: (1 << 63) - 1, 70_000: -(1 << 63), 99_999: 1 << 32, 3: (1 << 32) - 1}
    got = sketch.gather(spark.createDataFrame(list(want.items()), "cell bigint, n bigint").repartition(3), 100_000)
    assert {int(i): int(got[i]) for i in got.nonzero()[0]} == want
    assert not sketch.gather(spark.createDataFrame([], "cell bigint, n bigint"), 8).any()
