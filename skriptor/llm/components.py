"""Connected components and pairs within them, without gathering a component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriptor.session import cut

MAX_ROUNDS = 40
BLOCK = 256


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of (a, b) edges; root is the component's smallest node.

    Alternates large-star and small-star steps, so the number of rounds grows with
    the logarithm of the longest path; each round is written to the checkpoint folder.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

    current = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    now = mark(current)
    for _ in range(MAX_ROUNDS):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        following = cut(small.select("e.a", "e.b").where("a <> b").distinct())
        current, last, now = following, now, mark(following)
        if now == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b"), F.col("b")).distinct())


def pairs_within(members: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of ids with the same root, in blocks of members."""
    members = cut(members.select("id", "root").distinct())
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    placed = members.join(sizes.select("root", "blocks"), "root").withColumn("block", F.expr("pmod(xxhash64(id), blocks)"))
    spread = placed.select("root", F.col("id").alias("a"), F.expr("explode(sequence(0L, blocks - 1))").alias("block"))
    return spread.join(placed.select("root", "block", F.col("id").alias("b")), ["root", "block"]).where("a < b").select("a", "b")
