"""Numbers of many cells, brought to the driver packed: a few bytes a cell instead of a row object each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skriptor.session import prepare


def gather(cells: DataFrame, size: int) -> np.ndarray:
    """``size`` numbers from (cell bigint, n bigint), in which a cell occurs once at most; the others are 0."""
    if size > 1 << 32:
        raise ValueError("cells are sent as 32-bit numbers")
    prepare(cells.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                small = n.min() >= 0 and n.max() < 1 << 32
                packed = [at.astype(np.uint32).tobytes(), (n.astype(np.uint32) if small else n).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], ["at", "n"])

    out = np.zeros(size, np.int64)
    for r in cells.mapInArrow(run, "at binary, n binary").collect():  # 8 or 12 bytes a cell
        out[np.frombuffer(r["at"], np.uint32)] = np.frombuffer(r["n"], np.uint32 if len(r["n"]) == len(r["at"]) else np.int64)
    return out
