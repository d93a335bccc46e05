"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.plans.scratch import materialize

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Expected copies are kept as whole multiples of 1 / SCALE, so that prefix sums are exact in any order.
SCALE = 1 << 20
#: Parts that the documents of about one size in a source are dealt into for the prefix sums.
PARTS = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, expected) for ``sizes(source, size)``.

    Sources by code point, null last, take the ``weights`` in turn and share one
    and a half times all sizes. A target stops at twice its source's size; the
    excess is shared by weight among the others until none is above. The table
    has one row per source, so its two global windows are small.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight.cast("long"))
    # Sources reach their stop in the order of size per weight. What is left for the rest is (3 * total - 2 * 2 * stopped) / 2.
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    stopped = F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    shares = ranked.withColumn("left", 3 * F.sum("source_size").over(everything) - 4 * stopped).withColumn("rest", rest)
    shares = shares.withColumn("stops", F.col("weight") * F.col("left") >= 4 * F.col("source_size") * F.col("rest"))
    # Once one source doesn't stop, none after it does, and all of those share what was left for the first of them.
    free = F.max(F.when(~F.col("stops"), F.struct("rest", "left"))).over(everything)
    shares = shares.withColumn("free", free)
    share = (F.col("weight") * F.col("free.left")).cast("double") / (2 * F.col("free.rest")).cast("double")
    target = F.when(F.col("stops"), (2 * F.col("source_size")).cast("double")).otherwise(share)
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * SCALE)).otherwise(F.lit(0))
    return shares.withColumn("target", target).select("source", "source_size", "target", expected.cast("long").alias("expected"))


def _offset(seed: int) -> Column:
    """A source's random offset, 0 to SCALE - 1."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\0")))), 1, 5), 16, 10).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``.

    Within a source all documents have the same expected copies, target over
    size of the source. Documents stand in runs of about one size; the prefix
    sum of expected copies plus the source's one random offset gives a copy for
    each integer boundary that the document crosses, so a source's copies fall
    evenly over its sizes and sum to its target but for a part of its largest
    document. ``taken`` is copies times size, at most twice the size.

    A null text has size 0; null is a source of its own, the last. Rows that
    repeat a doc_id are drawn one by one. The order within a source rests on
    the ids and sizes alone, so reruns agree. Other columns are ignored, and an
    empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    # Runs of about one size (its bit length and next four bits), large ones first: what the last copy lacks is then a part of a small document.
    part = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 4), 16, 10).cast("long") % PARTS
    run = F.expr(f"{PARTS} * -(32 * length(bin(size)) + shiftright(16 * size, length(bin(size)) - 1))") + part
    sized = materialize(sized.withColumn("run", run), "sizes")
    targets = source_targets(sized, weights)

    runs = sized.groupBy("source", "run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    runs = runs.join(targets, runs["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    runs = runs.withColumnsRenamed({"source": "run_source", "run": "run_no"})

    placed = sized.join(runs, F.col("source").eqNullSafe(F.col("run_source")) & (F.col("run") == F.col("run_no")))
    within = Window.partitionBy("source", "run").orderBy(F.desc("size"), "doc_id")
    nth = (F.col("before") + F.row_number().over(within)).cast("long")
    placed = placed.withColumn("end", nth * F.col("expected") + _offset(seed))
    copies = F.floor(F.col("end") / SCALE) - F.floor((F.col("end") - F.col("expected")) / SCALE)
    return placed.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), by_source AS (
  SELECT source, sum(size) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source
), shares AS (
  SELECT *, 3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM by_source WINDOW fill AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST)
), first_free AS (
  SELECT remaining AS free_left, rest AS free_rest FROM shares WHERE weight * remaining < 4 * source_size * rest ORDER BY rest DESC LIMIT 1
), targets AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
    CASE WHEN weight * remaining >= 4 * source_size * rest THEN CAST(2 * source_size AS DOUBLE)
         ELSE CAST(weight * free_left AS DOUBLE) / CAST(2 * free_rest AS DOUBLE) END AS target
  FROM shares LEFT JOIN first_free ON true
), expected AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / CAST(source_size AS DOUBLE) * 1048576) AS BIGINT) ELSE 0 END AS expected,
    CAST('0x' || substr(md5('17:' || coalesce(source, chr(0))), 1, 5) AS BIGINT) AS start
  FROM targets
), placed AS (
  SELECT doc_id, size, source_size, target, expected, start + expected * row_number() OVER (
      PARTITION BY s.source
      ORDER BY 64 * -(32 * length(bin(size)) + ((16 * size) >> (length(bin(size)) - 1)))
        + CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 4) AS BIGINT) % 64, size DESC, doc_id NULLS FIRST) AS boundary
  FROM sized s JOIN expected e ON s.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, CAST((boundary // 1048576 - (boundary - expected) // 1048576) * size AS BIGINT) AS taken
FROM placed
"""
