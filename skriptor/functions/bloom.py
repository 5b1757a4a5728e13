"""Bloom filters of bounded size, built by the cluster and probed batch by batch."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skriptor.functions import sketch

BITS_EACH, MAX_BITS, PROBES = 12, 1 << 30, 4  # at most 128 MB whatever the number of keys


class Filter(NamedTuple):
    words: np.ndarray
    bits: int  # a power of two
    probes: int  # fewer where many keys share the bits, so that even a crowded filter proves what it can


def positions(key: list[Column], f: Filter) -> list[Column]:
    """Bit positions of a key."""
    return [F.shiftrightunsigned(F.xxhash64(*key, F.lit(i)), 65 - f.bits.bit_length()) for i in range(f.probes)]


def sized(n: int) -> Filter:
    """An empty filter for ``n`` keys."""
    bits = 1 << max(16, min(MAX_BITS, n * BITS_EACH - 1).bit_length())
    bits = min(bits, MAX_BITS)
    probes = min(PROBES, max(1, round(bits / max(1, n) * math.log(2))))
    return Filter(np.zeros(bits // 64, np.uint64), bits, probes)


def build(keys: DataFrame, key: list[str], count: int | None = None) -> Filter:
    """The filter of all rows of ``keys``."""
    out = sized(keys.count() if count is None else count)
    each = keys.select(F.explode(F.array(*positions([F.col(k) for k in key], out))).alias("bit"))
    rows = each.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))
    return out._replace(words=sketch.gather(rows, len(out.words)).view(np.uint64))


def hits(words: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """For each key, given by its bit positions, whether it may be in the filter."""
    ok = np.ones(len(bits[0]), bool)
    for b in bits:
        ok &= (words[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) == 1
    return ok


def probe(df: DataFrame, key: list[str], f: Filter, out: str = "maybe") -> DataFrame:
    """``df`` with a boolean column: false is certain, true is to be verified."""
    shared = df.sparkSession.sparkContext.broadcast(f.words)
    names = [f"_b{i}" for i in range(f.probes)]
    rows = df.select("*", *[p.alias(n) for p, n in zip(positions([F.col(k) for k in key], f), names)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = hits(shared.value, [batch.column(n).to_numpy() for n in names])
            kept = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(ok)], [*kept, out])

    return rows.mapInArrow(run, schema)
