"""Runs of units: cut, split where something begins inside them, freed of overlaps, and marked as deleted unit by unit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import utf16_slice
from tideline.plans.asof import as_of

RUN = ["doc_id", "client"]


def cut(runs: DataFrame, offset: Column, length: Column) -> DataFrame:
    """``runs`` reduced to ``length`` units from ``offset`` on; runs that would have none are dropped.

    Clock and length are cut, and what holds one part for each unit: ``str`` or
    ``content`` texts and ``vals``. The origin of a run that lost its front is
    the last unit cut off. Half of a surrogate pair becomes U+FFFD.
    """
    names = set(runs.columns)
    rows = runs.withColumn("_cut", offset.cast("long")).withColumn("_len", length.cast("long")).where("_len > 0")
    front, partial = F.col("_cut") > 0, (F.col("_cut") > 0) | (F.col("_len") < F.col("len"))
    changed = {"clock": F.col("clock") + F.col("_cut"), "len": F.col("_len")}
    text = F.col("content_type") == "string" if "content_type" in names else F.lit(True)
    for c in ("str", "content"):
        if c in names and dict(runs.dtypes)[c] == "string":
            changed[c] = F.when(partial & text, utf16_slice(F.col(c), F.col("_cut"), F.col("_len"))).otherwise(F.col(c))
    if {"vals", "content_type"} <= names:
        changed["vals"] = F.when(partial & F.col("content_type").isin("any", "json"), F.slice("vals", (F.col("_cut") + 1).cast("int"), F.col("_len").cast("int"))).otherwise(F.col("vals"))
    last = F.col("clock") + F.col("_cut") - 1
    placed = F.col("content_type") != "gc" if "content_type" in names else F.lit(True)
    if "origin" in names:
        changed["origin"] = F.when(front & placed, F.struct(F.col("client").cast("long").alias("client"), last.alias("clock"))).otherwise(F.col("origin"))
    if {"origin_client", "origin_clock"} <= names:
        changed["origin_client"] = F.when(front & placed, F.col("client")).otherwise(F.col("origin_client"))
        changed["origin_clock"] = F.when(front & placed, last).otherwise(F.col("origin_clock"))
    return rows.withColumns(changed).drop("_cut", "_len")


def cut_front(runs: DataFrame, offset: Column) -> DataFrame:
    """``runs`` without their first ``offset`` units."""
    return cut(runs, offset, F.col("len") - offset)


def without_overlaps(runs: DataFrame) -> DataFrame:
    """Each unit once: of runs that overlap, the later one loses what an earlier one holds."""
    order = Window.partitionBy(*RUN).orderBy("clock", F.desc("len"))
    reached = F.max(F.col("clock") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = runs.withColumn("_known", F.greatest(F.lit(0), F.coalesce(reached, F.lit(0)) - F.col("clock")))
    return cut_front(rows, F.col("_known")).drop("_known")


def split_at(runs: DataFrame, cuts: DataFrame) -> DataFrame:
    """``runs`` without overlaps, split so that a run begins at each of ``cuts(doc_id, client, clock)`` that lies inside one.

    Both are laid in one order of clocks and the last run is carried along, so
    the work is one sort, whatever number of cuts meet a run.
    """
    whole = F.struct(*[F.col(c) for c in runs.columns])
    kind = runs.select(whole.alias("s")).schema["s"].dataType
    marks = runs.select(*RUN, F.col("clock").alias("_at"), F.lit(0).alias("_side"), whole.alias("_run"))
    marks = marks.unionByName(cuts.where("clock is not null").select(*(F.col(c).cast(runs.schema[c].dataType).alias(c) for c in RUN), F.col("clock").cast("long").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_run")))
    order = Window.partitionBy(*RUN).orderBy("_at", "_side")
    # Of several marks at one clock the first stays, a run before a cut.
    fresh = marks.withColumn("_before", F.lag("_at").over(order)).where("_before is null or _before < _at").drop("_before")
    pieces = fresh.withColumn("_next", F.lead("_at").over(order)).withColumn("_run", F.last("_run", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.col("_run.clock") + F.col("_run.len")
    pieces = pieces.where((F.col("_at") < end) | ((F.col("_side") == 0) & (F.col("_run.len") == 0)))
    pieces = pieces.select("_run.*", (F.col("_at") - F.col("_run.clock")).alias("_from"), (F.least(end, F.coalesce("_next", end)) - F.col("_at")).alias("_n"))
    return cut(pieces, F.col("_from"), F.col("_n")).drop("_from", "_n")


def borders(ranges: DataFrame) -> DataFrame:
    """(doc_id, client, clock): where ranges begin, and the clocks after them."""
    return ranges.select(*RUN, F.explode(F.array("clock", F.col("clock") + F.col("len"))).alias("clock"))


def flag_deleted(pieces: DataFrame, ranges: DataFrame, flag: str = "deletes") -> DataFrame:
    """``pieces`` with ``flag``: whether one of ``ranges``, which don't begin or end inside any piece, holds them."""
    from tideline.operators.state import compact_ranges

    compact = compact_ranges(ranges.where("len > 0").select(*RUN, "clock", "len"))
    gone = compact.select(*RUN, F.col("clock").alias("gone_from"), (F.col("clock") + F.col("len")).alias("gone_end"))
    found = as_of(pieces.drop(flag), gone, RUN, "clock", "gone_from", "_gone")
    return found.withColumn(flag, F.coalesce(F.col("clock") < F.col("_gone.gone_end"), F.lit(False))).drop("_gone")


def mark_deleted(runs: DataFrame, ranges: DataFrame, flag: str = "deletes") -> DataFrame:
    """``runs`` split at the borders of ``ranges(doc_id, client, clock, len)``, with ``flag``: whether a range holds the piece."""
    return flag_deleted(split_at(runs.drop(flag), borders(ranges.where("len > 0"))), ranges, flag)


def units(ids: list[tuple[DataFrame, str]]) -> DataFrame:
    """(doc_id, client, clock) of id structs in columns of several tables, nulls left out."""
    parts = [df.where(F.col(c).isNotNull()).select("doc_id", F.col(f"{c}.client").alias("client"), F.col(f"{c}.clock").alias("clock")) for df, c in ids]
    return reduce(DataFrame.unionByName, parts)
