"""Text functions and statistics on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from skriptor.functions import state
from skriptor.functions import text as T
from skriptor.operators import dedup, echo, stats, style


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("r")).first()["r"]


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts, 1)], "doc_id int, text string, words string")


def test_scalars(spark):
    assert one(spark, T.fold_yo, "Ёлка всё") == "Елка все"
    assert one(spark, T.sentences, "Раз. Два!  Три…\nЧетыре") == ["Раз", "Два", "Три", "Четыре"]
    assert one(spark, T.sentences, "") == []
    assert one(spark, T.lines, "a\r\nb\x0bc\n") == ["a", "b", "c"]
    assert one(spark, T.lines, "") == []
    assert one(spark, T.name_tokens, "Я и Анна-Мария x") == ["Анна-Мария"]
    assert one(spark, T.count_tokens, "кто-то и я") == ["кто-то", "и", "я"]
    assert one(spark, lambda s: T.ngrams(F.split(s, " "), 3), "a b c d") == ["a b c", "b c d"]
    assert one(spark, lambda s: T.ngrams(F.split(s, " "), 3), "a b") == []
    assert one(spark, lambda s: T.phrase_count(s, "aa"), "aaaa aa") == 3
    assert one(spark, T.code_points, "aЖ") == "U+0061 U+0416"
    assert [tuple(x) for x in one(spark, lambda s: T.offsets(s, "b+"), "abbc\nb")] == [(1, 1, "bb"), (5, 2, "b")]
    many = "ab\n" * 1000
    assert [tuple(x) for x in one(spark, lambda s: T.offsets(s, "b"), many)] == [(3 * i + 1, i + 1, "b") for i in range(1000)]
    assert one(spark, T.html_to_text, "<p>a &amp; b</p><script>x</script>\n\n\n\n<!-- c -->d") == "a & b \n\nd".replace(" \n", "\n")
    assert one(spark, lambda s: T.clock(s.cast("int")), "125") == "02:05"
    assert one(spark, T.content_hash, "a  b\nc") == one(spark, T.content_hash, " a b c ")


def test_stats(spark):
    d = docs(spark, "— Раз два.\n— Три!\nЧетыре пять.", "", None, "— \n")
    got = {r["doc_id"]: r for r in stats.text_stats(d).collect()}
    assert (got[1]["words"], got[1]["sents"], got[1]["avg_sent"], got[1]["dialog_share"]) == (5, 3, 1.7, 66.7)
    assert (got[2]["words"], got[2]["sents"], got[2]["dialog_share"]) == (0, 0, 0.0) and 3 not in got
    assert got[4]["dialog_share"] == 0.0
    en = stats.text_stats(docs(spark, "“Hello,” he said.\nplain"), lang="en").first()
    assert en["dialog_share"] == 50.0
    fill = stats.filler_counts(docs(spark, "Просто так. Вот и всё, вот! упрощённо просторно как  бы", None), fillers=["просто", "вот", "как бы"])
    assert {(r["filler"], r["n"]) for r in fill.collect()} == {("просто", 1), ("вот", 2), ("как бы", 1)}
    total = stats.corpus_stats(stats.text_stats(d.where("false"))).first()
    assert (total["documents"], total["words"]) == (0, 0)


def test_diary(spark):
    t = dt.datetime
    rows = [(t(2024, 1, 1, 9), 10000), (t(2024, 1, 3, 8), 10700), (t(2024, 1, 3, 9), 10800), (None, 5), (t(2024, 1, 4), None)]
    days = stats.diary_days(stats.diary_runs(spark.createDataFrame(rows, "stamp timestamp, words int"))).orderBy("day").collect()
    assert [(r["words"], r["delta"], r["days"], r["tempo"]) for r in days] == [(10000, 10000, 0, None), (10800, 800, 2, 400)]


def test_repeats_against_loop(spark):
    text = "---\nимя: x\n---\nКузнец нашёл молот. Молот лежал у кузнец\nмолот молот\n```\nмолот\n```\n\nМолот снова молот\n"
    got = [(r["line_no"], r["word"], r["gap"]) for r in style.nearby_repeats(docs(spark, text), window=4).orderBy("line_no").collect()]
    assert got == [(4, "молот", 1), (5, "молот", 3), (5, "молот", 1)]
    assert style.nearby_repeats(docs(spark, None, "")).count() == 0


def test_long_sentences(spark):
    rows = style.long_sentences(docs(spark, "слово " * 30 + "конец.\nдва слова"), threshold=25).collect()
    assert [(r["para"], r["words"]) for r in rows] == [(1, 31)] and rows[0]["start"].endswith("…")


def test_masks(spark):
    text = "---\na\n---\nb\n```py\nc\n~~~\n```\nd"
    assert one(spark, state.masks, text) == [True, True, True, False, True, True, True, True, False]


def test_echo(spark):
    same = "Старый кузнец нашёл молот."
    d = docs(spark, same, "Иначе. " + same, "пусто", same + " " + same)
    got = {r["ngram"]: (r["files"], r["count"], r["example_id"]) for r in echo.echo(d, n=3, top=None).collect()}
    assert got == {"старый кузнец нашел": (3, 4, 1), "кузнец нашел молот": (3, 4, 1)}
    assert echo.echo(d, n=3, name_words=["кузнец"]).count() == 0
    assert echo.echo(d, n=3, top=1).count() == 1
    for bad in ({"n": 1}, {"min_files": 1}):
        try:
            echo.echo(d, **bad)
            raise AssertionError("no error")
        except ValueError:
            pass


def test_dedup(spark):
    base = [f"слово{chr(0x430 + i % 32)}{chr(0x430 + i // 32)}" for i in range(60)]
    near = [*base[:58], "иное", "другое"]
    d = docs(spark, " ".join(base), "  ".join(base), " ".join(near), "", "", None, "мало слов")
    assert [(r["copies"], r["first_id"]) for r in dedup.exact_duplicates(d).collect()] == [(2, 1)]
    assert [(r["a"], r["b"]) for r in dedup.near_pairs(d).collect()] == [(1, 3)]
    assert dedup.near_pairs(d.where("false")).count() == 0


def test_near_pairs_against_loop(spark):
    import random

    rng = random.Random(3)
    words = [a + b for a in "бвгдж" for b in "аеиоу"]
    texts = []
    for _ in range(12):
        t = [rng.choice(words) for _ in range(60)]
        texts.append(" ".join(t))
        for _ in range(rng.randrange(4)):
            u = list(t)
            for _ in range(rng.randrange(1, 5)):
                u[rng.randrange(60)] = rng.choice(words)
            texts.append(" ".join(u))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    want = {(i + 1, j + 1) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sets[i] != sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.7}
    assert {(r["a"], r["b"]) for r in dedup.near_pairs(docs(spark, *texts)).collect()} == want and want
