"""Sources, sinks, streams and the driver contract."""

import datetime as dt

import pytest

from skriptor.operators import markdown, stats
from skriptor.sources import files, sinks
from skriptor.streaming import phases, watch

RU = "Старый кузнец нашёл молот у северной стены и вернулся в пустой зал."


@pytest.mark.parametrize("code", ["utf-8", "cp1251", "koi8-r"])
def test_encodings(code):
    assert files.decode(RU.encode(code)) == RU
    assert (files.bad_utf8_line(("a\n" + RU).encode(code)) is None) == (code == "utf-8")


def test_corpus(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / ".obsidian").mkdir()
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbf" + RU.encode())
    (tmp_path / "b" / "c.txt").write_bytes(RU.encode("koi8-r"))
    (tmp_path / "b" / "d.html").write_text("<p>x</p>")
    (tmp_path / "b" / "e.docx").write_bytes(sinks.docx_bytes([("heading", 1, "A & б"), ("text", 0, "c")]))
    (tmp_path / "b" / "f.docx").write_bytes(b"no zip")
    (tmp_path / "b" / "g.exe").write_bytes(b"x")
    (tmp_path / ".obsidian" / "h.md").write_text("x")
    (tmp_path / "empty.md").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["encoding"]) for r in files.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.md": (RU, "utf-8-sig"), "c.txt": (RU, "koi8-r"), "d.html": ("x", "utf-8"), "e.docx": ("A & б\nc", "docx"), "f.docx": ("", "docx"), "empty.md": ("", "utf-8")}
    assert files.read_corpus(spark, str(tmp_path), limit=2).count() == 2
    assert files.oversized(spark, str(tmp_path), 50).count() > 0
    assert {r["encoding"] for r in files.encoding_audit(files.read_corpus(spark, str(tmp_path))).collect()} >= {"koi8-r"}
    for bad in ("", None, str(tmp_path / "nowhere")):
        with pytest.raises(ValueError):
            files.read_corpus(spark, bad)


def test_registry_rows():
    rows = files.registry_rows([{"имя": "A", "формы": "a", "старое": ["b ", None]}, {"имя": ""}, "x"])
    assert rows == [("A", ["a"], ["b"], [], [])] and files.registry_rows("x") == []


def test_backups(spark):
    paths = spark.createDataFrame([("/v/a.md.bak",), ("/v/md_replace_backups/1/b.md",), ("/v/md_replace_backups/2/b.md",), ("/v/c.md",)], "path string")
    assert {(r["original"], r["backup"]) for r in files.newest_backups(paths).collect()} == {("/v/a.md", "/v/a.md.bak"), ("/v/b.md", "/v/md_replace_backups/2/b.md")}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 9), "a.md", 5, 1, 5.0, 0.0)], "stamp timestamp, file string, words int, sents int, avg_sent double, dialog_share double")
    for _ in range(2):
        sinks.append_diary(rows, str(tmp_path / "diary"))
    back = files.read_diary(spark, str(tmp_path / "diary"))
    assert back.count() == 2 and stats.diary_runs(back).first()["words"] == 10
    sinks.write_texts(rows, str(tmp_path / "out"), ["file"])
    with pytest.raises(Exception):
        sinks.write_texts(rows, str(tmp_path / "out"))
    sinks.write_report(sinks.report(rows, "T|x"), str(tmp_path / "r" / "x.md"))
    assert (tmp_path / "r" / "x.md").read_text().startswith("# T|x")
    assert "- имя: \"a\"" in sinks.registry_yaml(spark.createDataFrame([("a", 1)], "name string, n int"))
    blocks = markdown.blocks(spark.createDataFrame([(1, "# a\ntext")], "doc_id int, text string"))
    assert files.docx_text(bytes(sinks.export_docx(blocks).first()["content"])) == "a\ntext"


def test_timer():
    t, events = phases.simulate([("start", 0), ("tick", 1500), ("tick", 300), ("start", 0), ("tick", 10)])
    assert events == [("phase_start", "work"), ("phase_end", "work"), ("work_done", "1"), ("phase_start", "short"), ("phase_end", "short"), ("phase_start", "work")]
    assert (t.phase, t.left, t.done) == ("work", 1490, 1)
    t, events = phases.simulate([("start", 0), *[("tick", 1500), ("tick", 300), ("start", 0)] * 4])
    assert ("phase_start", "long") in events
    assert phases.clamp("x", 5, 1, 9) == 5 and phases.clamp(99, 5, 1, 9) == 9


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    docs = spark.createDataFrame([(1, RU, dt.datetime(2024, 1, 1)), (2, RU, dt.datetime(2024, 1, 3))], "doc_id bigint, text string, saved_at timestamp")
    docs.write.parquet(src)
    stream = watch.watch(spark, src, "doc_id bigint, text string, saved_at timestamp")
    watch.run_once(watch.streamed_stats(stream), str(tmp_path / "s"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    batch = watch.volume_by_time(docs, "saved_at").orderBy("begin").collect()
    assert [(r["texts"], r["words"]) for r in batch] == [(1, 12), (1, 12)]
    acts = spark.createDataFrame([(7, dt.datetime(2024, 1, 1, 9), "start", 0), (7, dt.datetime(2024, 1, 1, 10), "tick", 1600)], "user_id bigint, ts timestamp, action string, seconds int")
    acts.write.parquet(str(tmp_path / "a"))
    live = spark.readStream.schema(acts.schema).parquet(str(tmp_path / "a"))
    watch.run_once(phases.phase_events(live), str(tmp_path / "p"), str(tmp_path / "pc"))
    got = sorted(r["event"] for r in spark.read.parquet(str(tmp_path / "p")).collect())
    assert got == ["phase_end", "phase_start", "phase_start", "work_done"]


def test_sessions(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t), (1, t + dt.timedelta(minutes=29)), (1, t + dt.timedelta(minutes=70)), (None, t), (2, None)]
    got = sorted(r["events"] for r in watch.sessions(spark.createDataFrame(rows, "user_id int, ts timestamp")).collect())
    assert got == [1, 2]


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
    assert {"p2_found", "text_stats", "echo_all"} <= set(e.queries())
    for name in ("same_names", "yo_letters", "event_days"):
        assert e.queries()[name](spark, "/root/testdata/sf0.001").columns


def test_spread_keeps_rows(spark):
    from skriptor.session import load, load_spread

    a, b = load(spark, "/root/testdata/sf0.001", "documents"), load_spread(spark, "/root/testdata/sf0.001", "documents")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and b.rdd.getNumPartitions() >= 4
