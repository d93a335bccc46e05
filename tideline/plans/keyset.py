"""A small filter that holds a set of 64-bit keys, for passing rows by without moving them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Keys of one segment, about, its bits, and how many of them each key sets.
KEYS, BITS, PROBES = 1 << 15, 1 << 19, 4


def _places(keys: np.ndarray) -> np.ndarray:
    """[PROBES, keys]: the bits of each key within its segment."""
    mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.stack([(mixed >> np.uint64(16 * i)) * np.uint64(2 * i + 5) % np.uint64(BITS) for i in range(PROBES)]).astype(np.int64)


def may_hold(keys: DataFrame) -> Callable[[Column], Column]:
    """A test of longs: true for all of ``keys(key)``, false for nearly all others (one in some hundreds is true as well).

    The filter has two bytes a key. Each segment is made in a task of its own;
    the driver and the executors hold them side by side.
    """
    n = max(1, -(-keys.count() // KEYS))

    def fill(table: pa.Table) -> pa.Table:
        own = table.column("key").to_numpy()
        held = np.zeros(BITS, dtype=bool)
        held[_places(own).ravel()] = True
        return pa.table({"segment": table.column("segment")[:1], "bits": pa.array([np.packbits(held).tobytes()], pa.binary())})

    made = keys.select(F.pmod(F.col("key"), F.lit(n)).cast("int").alias("segment"), "key").groupBy("segment").applyInArrow(fill, "segment int, bits binary").collect()
    segments = {r.segment: bytes(r.bits) for r in made}

    @F.pandas_udf(BooleanType())
    def test(values: pd.Series) -> pd.Series:
        own = values.to_numpy(dtype=np.int64)
        segment, places, out = own % n, _places(own), np.zeros(len(own), dtype=bool)
        for s in np.unique(segment) if n < len(own) else range(n):
            if int(s) in segments:
                at = np.flatnonzero(segment == s)
                bits = np.frombuffer(segments[int(s)], dtype=np.uint8)
                out[at] = np.all((bits[places[:, at] >> 3] >> (7 - (places[:, at] & 7)).astype(np.uint8)) & 1, axis=0)
        return pd.Series(out)

    return test
