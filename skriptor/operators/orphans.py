"""References to records that do not exist, never existed, were deleted or came later.

A Bloom filter of all parent keys, broadcast at a bounded size, proves most
orphans without a join.  The references it lets through are verified by an exact
as-of join on (group, key, day): a parent is alive at t exactly if the largest
end among the parents that began by t lies beyond t, so parents are reduced to
one row a day before they meet references, no key's rows are paired up, and the
references to a popular key are split by their days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skriptor.functions import bloom
from skriptor.session import cut, prepare

FOREVER = "cast('9999-12-31 00:00:00' as timestamp)"
NEVER = "cast('0001-01-01 00:00:00' as timestamp)"


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of ``refs`` without a live parent, with ``proof``.

    refs: ref_group, ref_key, ref_at and any other columns, which are kept (but for
    one named proof).  parents: ref_group, ref_key, born, gone
    (null: still there); a parent is alive at t if born <= t < gone.  ``proof`` is
    bloom (no such parent ever) or join (none alive at ref_at).  References with a
    null group, key or time are left out, as are parents with a null group, key or
    birth.  Repeated references come out as often as they come in.
    """
    prepare(refs.sparkSession)
    extra = [c for c in refs.columns if c not in ("ref_group", "ref_key", "ref_at", "proof")]
    kept = F.struct(*[F.col(f"`{c}`") for c in extra]) if extra else F.struct(F.lit(0).alias("_"))
    refs = refs.where("ref_group is not null and ref_key is not null and ref_at is not null").select("ref_group", "ref_key", "ref_at", kept.alias("r"))
    life = parents.where("ref_group is not null and ref_key is not null and born is not null").select(
        "ref_group", "ref_key", F.col("born").cast("timestamp").alias("t"), F.coalesce(F.col("gone").cast("timestamp"), F.expr(FOREVER)).alias("ends")
    )
    life = life.groupBy("ref_group", "ref_key", "t").agg(F.max("ends").alias("ends"))
    known = bloom.build(life.select("ref_group", "ref_key").distinct(), ["ref_group", "ref_key"])
    tested = cut(bloom.probe(refs, ["ref_group", "ref_key"], known))
    sure = tested.where("not maybe").drop("maybe").withColumn("proof", F.lit("bloom"))

    day = F.to_date("t").alias("d")
    asked = tested.where("maybe").select("ref_group", "ref_key", F.col("ref_at").cast("timestamp").alias("t"), F.struct("ref_at", "r").alias("r"))
    daily = life.groupBy("ref_group", "ref_key", day).agg(F.max("ends").alias("ends"))
    wanted = asked.select("ref_group", "ref_key", day).distinct().select("*", F.expr(NEVER).alias("ends"))
    by_day = daily.union(wanted).groupBy("ref_group", "ref_key", "d").agg(F.max("ends").alias("ends"))
    earlier = Window.partitionBy("ref_group", "ref_key").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    before = by_day.select("ref_group", "ref_key", "d", F.coalesce(F.max("ends").over(earlier), F.expr(NEVER)).alias("before"))
    within = Window.partitionBy("ref_group", "ref_key", "d").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.select("ref_group", "ref_key", day, "t", F.lit(1).alias("kind"), F.expr(NEVER).alias("ends"), "r").unionByName(
        life.select("ref_group", "ref_key", day, "t", F.lit(0).alias("kind"), "ends"), allowMissingColumns=True
    )
    latest = both.withColumn("latest", F.max("ends").over(within)).where("kind = 1")
    dead = latest.join(before, ["ref_group", "ref_key", "d"], "left").where(F.greatest("latest", F.coalesce("before", F.expr(NEVER))) <= F.col("t"))
    verified = dead.select("ref_group", "ref_key", F.col("r.ref_at").alias("ref_at"), F.col("r.r").alias("r"), F.lit("join").alias("proof"))
    return sure.unionByName(verified).select("ref_group", "ref_key", "ref_at", *[F.col("r")[c].alias(c) for c in extra], "proof")


def orphan_report(orphans: DataFrame, table_col: str, at_col: str = "ref_at") -> DataFrame:
    """(table, period, orphans) with the period as ``yyyy-MM``."""
    return orphans.groupBy(F.col(table_col).alias("table_name"), F.date_format(at_col, "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("orphans"))
