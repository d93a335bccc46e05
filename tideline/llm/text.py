"""Words of whole texts, on Arrow columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of an Arrow batch; texts are long, and both sides of the pipe hold whole batches.
BATCH_ROWS = 1024


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to pass at most BATCH_ROWS rows at a time to Python."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def word_lists(texts: pa.Array, kept: str = r"\p{L}\p{N}") -> tuple[pa.Array, np.ndarray]:
    """The lower-cased runs of ``kept`` characters of all texts, and how many each text has. Null is empty."""
    spaced = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), f"[^{kept}]+", " "), " ")
    words = pc.split_pattern(spaced, " ")
    words = pc.if_else(pc.equal(pc.binary_length(spaced), 0), pa.scalar([], words.type), words)
    return pc.list_flatten(words), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def map_texts(docs: DataFrame, text_col: str, compute: Callable[[pa.Array], list[pa.Array]], kinds: list[str], keep: list[str], where: str | None = None, names: list[str] | None = None, block: int = 1024) -> DataFrame:
    """The columns ``keep`` of ``docs`` and what ``compute`` gives for blocks of its texts.

    ``compute`` returns an array for each of ``kinds``; they are r0, r1, ... in
    ``where``, which picks rows, and ``names`` in the result (none: left out).
    Columns of ``docs`` are known by place inside, so their names clash with none.
    """
    others = [c for c in keep if c != text_col]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                yield pa.RecordBatch.from_arrays([*part.columns[0 if text_col in keep else 1 :], *compute(part.column(0))], held + [f"r{i}" for i in range(len(kinds))])

    places = {c: f"c{i}" for i, c in enumerate([text_col, *others])}
    held = [places[c] for c in [text_col, *others] if c in keep]
    own = docs.select(*(F.col(f"`{c}`").alias(p) for c, p in places.items()))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name in held] + [f"r{i} {k}" for i, k in enumerate(kinds)])
    out = bounded_batches(own).mapInArrow(run, schema)
    if where:
        out = out.where(where)
    return out.select(*(F.col(places[c]).alias(c) for c in keep), *(F.col(f"r{i}").alias(n) for i, n in enumerate(names or [])))
