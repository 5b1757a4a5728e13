"""Session helpers: table loading, durable lineage cuts, shipping the package."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table ``table`` of a data folder; a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def load_spread(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """``load``, spread over all cores where the files give fewer splits than there are.

    A single small file would otherwise keep one core busy with every regular
    expression; a table with splits for all cores isn't shuffled.
    """
    df = load(spark, sf_dir, table)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable on executors and lineage cuts possible.

    The package is shipped once per application, so that Python workers find its
    functions by name wherever they run.  ``spark.checkpoint.dir`` is used as it is
    set; only where it is unset (tests, local runs) a private folder is made.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="skriptor")) / "skriptor.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="skriptor-ckpt"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there.

    Unlike a local checkpoint it outlives lost executors.
    """
    prepare(df.sparkSession)
    out = df.checkpoint(eager=True)
    # fresh attributes: joining a checkpoint with itself otherwise fails in the optimizer
    return out.select(*[F.col(f"`{c}`").alias(c) for c in out.columns])


def release(spark: SparkSession) -> None:
    """Drop what is no longer referred to: shuffle files stay on disk, and plans in memory, until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
