"""Positions that hold while a sequence changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.plans.asof import as_of


def _placed(items: DataFrame, order: list[Column]) -> DataFrame:
    place = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    live = F.when(F.col("deleted"), 0).otherwise(F.col("len"))
    return items.withColumn("before", F.coalesce(F.sum(live).over(place), F.lit(0)).cast("long"))


def relative_positions(items: DataFrame, indices: DataFrame, order: list[Column]) -> DataFrame:
    """``indices(doc_id, index)`` as (doc_id, index, client, clock, assoc): the unit at that place of the live units.

    An index at the end of a document is its end: no unit, assoc -1.
    """
    spans = _placed(items, order).where("not deleted and len > 0").select("doc_id", "client", "clock", "len", "before")
    found = as_of(indices, spans, ["doc_id"], "index", "before", "run")
    inside = F.col("index") < F.col("run.before") + F.col("run.len")
    unit = F.col("run.clock") + F.col("index") - F.col("run.before")
    return found.select("doc_id", "index", F.when(inside, F.col("run.client")).alias("client"), F.when(inside, unit).alias("clock"), F.when(inside, 0).otherwise(-1).alias("assoc"))


def absolute_positions(items: DataFrame, anchors: DataFrame, order: list[Column]) -> DataFrame:
    """``anchors(doc_id, client, clock, assoc)`` with ``index``, where they are now.

    The live units before the anchor's run, and its offset in the run; one more
    for assoc below 0. The offset counts in a deleted run as well.
    """
    runs = _placed(items, order).select("doc_id", "client", F.col("clock").alias("run_clock"), "len", "before")
    found = as_of(anchors, runs, ["doc_id", "client"], "clock", "run_clock", "run").where("clock < run.run_clock + run.len")
    index = F.col("run.before") + F.col("clock") - F.col("run.run_clock") + F.when(F.col("assoc") < 0, 1).otherwise(0)
    return found.select("doc_id", "client", "clock", "assoc", index.alias("index"))
