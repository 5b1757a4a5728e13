"""Orphan references: against a plain loop, and at the edges."""

import datetime as dt
import random

from pyspark.sql import functions as F

from skriptor.functions import bloom
from skriptor.operators.orphans import orphan_references, orphan_report
from skriptor.operators.vault_links import dead_references, note_references

D = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
REFS = "ref_group string, ref_key string, ref_at timestamp, id int, t string, maybe string, proof string"
PARENTS = "ref_group string, ref_key string, born timestamp, gone timestamp, r string"


def test_against_loop(spark):
    rng = random.Random(5)
    parents = [(rng.choice("ab"), f"k{rng.randrange(6)}", D(rng.randrange(120)), rng.choice([None, D(rng.randrange(60, 200))]), "x") for _ in range(40)]
    parents = [p for p in parents if p[3] is None or p[3] > p[2]]
    refs = [(rng.choice("abc"), f"k{rng.randrange(9)}", D(rng.randrange(160)), i, None, "y", None) for i in range(300)]
    want = {r[3] for r in refs if not any(p[0] == r[0] and p[1] == r[1] and p[2] <= r[2] and (p[3] is None or p[3] > r[2]) for p in parents)}
    out = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)).collect()
    assert {r["id"] for r in out} == want and len(out) == len(want)
    assert {r["proof"] for r in out} <= {"bloom", "join"}
    assert {r["maybe"] for r in out} == {"y"}


def test_edges(spark):
    none = spark.createDataFrame([], REFS)
    parents = spark.createDataFrame([("a", "k", D(0), None, None), (None, "k", D(0), None, None), ("a", None, D(0), None, None), ("a", "n", None, None, None)], PARENTS)
    assert orphan_references(none, parents).count() == 0
    refs = spark.createDataFrame([("a", "k", D(1), 1, "", "", ""), ("a", "z", D(1), 2, "", "", ""), ("a", "z", D(1), 2, "", "", ""), (None, "z", D(1), 3, "", "", ""), ("a", None, D(1), 4, "", "", ""), ("a", "z", None, 5, "", "", "")], REFS)
    assert sorted(r["id"] for r in orphan_references(refs, parents).collect()) == [2, 2]
    assert sorted(r["id"] for r in orphan_references(refs, spark.createDataFrame([], PARENTS)).collect()) == [1, 2, 2]
    assert orphan_report(orphan_references(refs, parents), "ref_group").collect()[0].asDict() == {"table_name": "a", "period": "2024-01", "orphans": 2}


NOTES = "note_id bigint, vault string, rel string, stem string, text string, created_at timestamp, deleted_at timestamp"
FILES = "att_id bigint, vault string, rel string, file_name string, added_at timestamp, removed_at timestamp"


def test_links(spark):
    text = "\n".join([
        "[[Alpha|x]] ![[Map.PNG#a]] [[dir\\Beta.md]] [[]] [[#a]] `[[Code]]`", "```", "[[Fenced]]", "```", "[a](<x y/Gamma one.md>) [b](https://e.test) [c](mailto:a@b.c) [d](#top) ![e](im%20g.svg)", "[[Alpha]]",
    ])
    notes = spark.createDataFrame([(1, "v", "v/n.md", "n", text, D(5), None), (2, "v", "v/alpha.md", "Alpha", None, D(1), D(3)), (3, None, "", "", "[[q]]", D(5), None), (1, "v", "v/n.md", "n", text, D(5), None)], NOTES)
    got = {(r["ref_table"], r["ref_target"]) for r in note_references(notes).where("note_id = 1").collect()}
    assert got == {("obsidian_check", "alpha"), ("vault_attachments", "map.png"), ("obsidian_check", "dir/beta"), ("obsidian_check", "x y/gamma one"), ("vault_attachments", "im g.svg")}
    files = spark.createDataFrame([(1, "v", "", "MAP.png", D(1), None), (2, "v", "", "im g.svg", D(9), None)], FILES)
    dead = {r["ref_target"] for r in dead_references(notes, files).collect()}
    assert dead == {"alpha", "dir/beta", "x y/gamma one", "im g.svg"}
    assert note_references(notes.where("false")).count() == 0


def test_long_text(spark):
    text = "[[a]] слово " * 20000 + "\n```\n[[b]]\n" + "x" * 100000
    notes = spark.createDataFrame([(1, "v", "", "n", text, D(5), None)], NOTES)
    assert [r["ref_target"] for r in note_references(notes).collect()] == ["a"]


def test_bloom(spark):
    keys = spark.range(1000).select(F.col("id").alias("k"))
    known = bloom.build(keys, ["k"])
    probed = bloom.probe(spark.range(5000).select(F.col("id").alias("k")), ["k"], known)
    assert bloom.sized(10**9).probes == 1 and bloom.sized(1000).probes == bloom.PROBES
    assert probed.where("k < 1000 and not maybe").count() == 0
    assert probed.where("k >= 1000 and maybe").count() < 200
