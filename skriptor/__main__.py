"""``python -m skriptor QUERY FOLDER [OUT]``: runs a query over a folder of tables; the exit code is 0 (clean), 1 (findings) or 2 (usage)."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from skriptor.plans.contract import USAGE, run
from skriptor.queries import QUERIES


def main(arguments: list[str]) -> int:
    if len(arguments) not in (2, 3) or arguments[0] not in QUERIES:
        print(__doc__, "Queries: " + " ".join(sorted(QUERIES)), sep="\n", file=sys.stderr)
        return USAGE
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return run(QUERIES, spark, *arguments)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
