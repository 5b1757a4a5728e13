"""Token ids against two public encoders; packing against its invariants."""

import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from skriptor.llm import bpe, packing

RANKS = bpe.read_ranks(bpe.tokenizer_path("byte_bpe_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_against_reference():
    own, rng = bpe.ByteBpe(RANKS), random.Random(1)
    parts = ["a", "aa", "ab", "the ", "é", "ж", "  ", "\n", "1", "—", "xxxxx", "'s", "🚀", "​", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(n)) for n in (0, 1, 5, 60, 3000) for _ in range(20)]
    flat, edges = own.encode_batch(texts)
    assert [list(flat[a:b]) for a, b in zip(edges, edges[1:])] == [REFERENCE.encode_ordinary(t) for t in texts]
    assert list(own.count_batch(texts)) == [len(REFERENCE.encode_ordinary(t)) for t in texts]
    long = "ab" * 30000
    assert list(own.encode_batch([long])[0]) == REFERENCE.encode_ordinary(long)


def test_rank_queue_order():
    q = bpe.RankQueue(1000)
    for rank, pos in ((700, 1), (3, 9), (3, 2), (256, 5), (3, 4)):
        q.push(rank, pos)
    assert [q.pop() for _ in range(6)] == [(3, 2), (3, 4), (3, 9), (256, 5), (700, 1), None]


def test_frame(spark):
    rows = [(1, "Привет, мир"), (2, ""), (3, None), (None, "x"), (1, "Привет, мир"), (4, "  ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit(1)).withColumn("ids", F.lit("clash"))
    got = sorted((str(r["doc_id"]), r["ids"]) for r in bpe.encode_corpus(df).collect())
    assert got == sorted((str(i), REFERENCE.encode_ordinary(t or "")) for i, t in rows)
    assert bpe.encode_corpus(df.where("false")).count() == 0
    assert {r["doc_id"]: r["tokens"] for r in bpe.count_tokens(df).collect()}[2] == 0


def check(rows, items, caps):
    for c in caps:
        own = [r for r in rows if r["layout"] == c]
        filled, size = {}, {}
        for r in own:
            filled[r["container"]] = filled.get(r["container"], 0) + r["tokens"]
            size[r["container"]] = r["capacity"]
        assert all(filled[k] <= size[k] <= c and size[k] in caps for k in filled)
        got = {}
        for r in own:
            got.setdefault(r["doc_id"], []).append(r["tokens"])
        assert {k: sum(v) for k, v in got.items()} == {k: max(n or 0, 0) for k, n in items}
        assert all(len(v) == 1 for k, v in got.items() if (dict(items)[k] or 0) <= c)
        assert all(next(x for x in sorted(caps) if x >= filled[k]) == size[k] for k in filled)


def test_packing(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([0, 3, 7, 7, 7, 31, 64, 65, 200, None])) for i in range(400)]
    df = spark.createDataFrame(items, "doc_id bigint, tokens bigint").withColumn("size", F.lit(1)).withColumn("layout", F.lit("x"))
    caps = [16, 64, 32]
    rows = packing.pack(df, caps).collect()
    check(rows, items, caps)
    total = sum(n or 0 for _, n in items)
    for c in packing.containers(packing.pack(df, caps)).groupBy("layout").agg(F.sum("capacity").alias("c")).collect():
        assert c["c"] <= 1.25 * total + 64


def test_packing_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, tokens bigint")
    assert packing.pack(none, [8]).count() == 0
    zeros = spark.createDataFrame([(1, 0), (2, None), (None, 5), (2, 3)], "doc_id bigint, tokens bigint")
    assert packing.pack(zeros, [8]).count() == 4
    with pytest.raises(ValueError):
        packing.pack(zeros, [])
    equal = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(5).alias("tokens"))
    assert packing.containers(packing.pack(equal, [10])).count() == 500
    huge = spark.createDataFrame([(1, 1000)], "doc_id bigint, tokens bigint")
    assert sorted(r["tokens"] for r in packing.pack(huge, [300]).collect()) == [100, 300, 300, 300]
