"""State vectors, delete sets, diffs and merges of operation logs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.order import AT_ONCE, each_short, places
from tideline.operators.runs import cut_front, mark_deleted, without_overlaps
from tideline.plans.asof import as_of
from tideline.plans.scratch import discard, materialize, replace

#: Clocks that share a bucket when ranges are joined to units.
BUCKET = 1024


def state_vector(log: DataFrame) -> DataFrame:
    """(doc_id, client, next_clock): the clock after each client's last unit."""
    return log.groupBy("doc_id", "client").agg(F.max(F.col("clock") + F.col("len")).alias("next_clock"))


def compact_ranges(ranges: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Union of (doc_id, client, clock, len) ranges: those that overlap or touch become one. Ranges that differ in ``kinds`` stay apart."""
    keys = ["doc_id", "client", *kinds]
    order = Window.partitionBy(*keys).orderBy("clock", "len")
    reached = F.max(F.col("clock") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.withColumn("starts", F.when(F.col("clock") <= reached, 0).otherwise(1)).withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(F.min("clock").alias("clock"), (F.max(F.col("clock") + F.col("len")) - F.min("clock")).alias("len")).drop("island")


def delete_set(log: DataFrame) -> DataFrame:
    """The compact ranges of deleted units of ``log(doc_id, client, clock, len, deletes)``."""
    return compact_ranges(log.where("deletes").select("doc_id", "client", "clock", "len"))


def merge_delete_sets(*sets: DataFrame) -> DataFrame:
    merged = sets[0]
    for more in sets[1:]:
        merged = merged.unionByName(more)
    return compact_ranges(merged)


def _bucketed(ranges: DataFrame) -> DataFrame:
    first, last = F.floor(F.col("clock") / BUCKET), F.floor((F.col("clock") + F.col("len") - 1) / BUCKET)
    return ranges.where("len > 0").select("doc_id", "client", F.col("clock").alias("low"), (F.col("clock") + F.col("len")).alias("high"), F.explode(F.sequence(first, last)).alias("bucket"))


def in_delete_set(log: DataFrame, deleted: DataFrame) -> DataFrame:
    """What of ``log(doc_id, client, clock, len)`` lies in a range of ``deleted``: runs are cut to the units that do.

    Without a ``len`` each row is one unit.
    """
    runs = log if "len" in log.columns else log.withColumn("len", F.lit(1).cast("long"))
    return mark_deleted(runs, deleted, "_in_set").where("_in_set").select(log.columns)


def unresolved_ranges(log: DataFrame, deleted: DataFrame) -> DataFrame:
    """The parts of the ranges of ``deleted`` whose units ``log`` doesn't hold yet: they wait for their runs."""
    held = compact_ranges(log.select("doc_id", "client", "clock", "len"))
    return mark_deleted(compact_ranges(deleted.select("doc_id", "client", "clock", "len")), held, "_held").where("not _held").drop("_held")


def find_containing(log: DataFrame, ids: DataFrame) -> DataFrame:
    """For each of ``ids(doc_id, client, clock)``: the run of ``log`` that holds it, and the offset within."""
    runs = _bucketed(log).withColumnsRenamed({"low": "run_clock", "high": "run_end"})
    found = ids.withColumn("bucket", F.floor(F.col("clock") / BUCKET)).join(runs, ["doc_id", "client", "bucket"]).where("clock >= run_clock and clock < run_end")
    return found.select("doc_id", "client", "clock", "run_clock", (F.col("clock") - F.col("run_clock")).alias("offset"))


def diff_since(log: DataFrame, known: DataFrame) -> DataFrame:
    """The part of ``log`` at or after ``known(doc_id, client, next_clock)``; a run that is partly known loses its front, content included."""
    rows = log.join(known.select("doc_id", "client", F.col("next_clock").alias("_known")), ["doc_id", "client"], "left")
    return cut_front(rows, F.greatest(F.lit(0), F.coalesce("_known", F.lit(0)) - F.col("clock"))).drop("_known")


def merge_updates(*logs: DataFrame) -> DataFrame:
    """Union of update batches; a unit that several hold counts once. Nothing is lost, parked runs and the rest of longer runs included."""
    merged = logs[0]
    for more in logs[1:]:
        merged = merged.unionByName(more)
    return without_overlaps(merged)


def equal_states(one: DataFrame, two: DataFrame) -> DataFrame:
    """(doc_id, equal): whether two logs have the same state vector and delete set, for each document of either.

    Both logs go through one aggregation and one sort of their deleted runs, side by side.
    """
    part = lambda log, side: log.select("doc_id", "client", "clock", "len", "deletes", F.lit(side).alias("side"))
    both = part(one, 1).unionByName(part(two, -1))
    reached = lambda side: F.max(F.when(F.col("side") == side, F.col("clock") + F.col("len")))
    alone = F.min("side") == F.max("side")
    vectors = both.groupBy("doc_id", "client").agg((alone | ~reached(1).eqNullSafe(reached(-1))).alias("unlike")).select("doc_id", "unlike")
    ranges = compact_ranges(both.where("deletes").select("doc_id", "client", "clock", "len", "side"), ("side",))
    deleted = ranges.groupBy("doc_id", "client", "clock", "len").agg(alone.alias("unlike")).select("doc_id", "unlike")
    return vectors.unionByName(deleted).groupBy("doc_id").agg((~F.max("unlike")).alias("equal"))


def park_gaps(log: DataFrame) -> DataFrame:
    """Each run with ``parked``: whether units before it are missing from its client's log, and from which clock on."""
    order = Window.partitionBy("doc_id", "client").orderBy("clock")
    reached = F.coalesce(F.max(F.col("clock") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gap = F.max(F.when(F.col("clock") > F.col("reached"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = log.withColumn("reached", reached).withColumn("parked", gap == 1)
    missing = F.min(F.when(F.col("clock") > F.col("reached"), F.col("reached"))).over(Window.partitionBy("doc_id", "client"))
    return rows.withColumn("missing_from", F.when(F.col("parked"), missing)).drop("reached")


def causally_ready(items: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """The rows of ``items(doc_id, client, clock, origin_client, origin_clock)`` whose chain of origins is all there.

    An origin may be any unit of a run, where items have a ``len``. Documents of
    up to ``at_once`` runs are each walked in a task, short ones together; in
    longer ones the chains are followed by joins. Origins that form a ring raise.
    """
    runs = items if "len" in items.columns else items.withColumn("len", F.lit(1).cast("long"))
    runs = materialize(runs, "runs")

    def ready(table: pa.Table, sequence: np.ndarray) -> pa.Table:
        whole = places(table, sequence, inside=True) >= 0
        if not whole.all() and (places(table, sequence, inside=True, missing_start=True) < 0).any():
            raise ValueError("the origins of some items form a ring")
        return table.filter(pa.array(whole))

    found, rest = each_short(runs, ["doc_id"], at_once, ready, runs.schema)
    if rest is not None:
        found = found.unionByName(_ready_by_joins(rest))
    return found.select(items.columns)


def _ready_by_joins(runs: DataFrame) -> DataFrame:
    """The same without any document in one task.

    The chain of each item is followed by pointer doubling to where it starts, in rounds
    that grow with the logarithm of the longest chain; items whose chain has
    come to its end take no further part.
    """
    me = F.struct("doc_id", "client", "clock").alias("at")
    starts = runs.where("origin_client is null").select(me)
    held = runs.select("doc_id", F.col("client").alias("origin_client"), F.col("clock").alias("run_clock"), "len")
    asked = runs.where("origin_client is not null").select(me, "doc_id", "origin_client", "origin_clock")
    found = as_of(asked, held, ["doc_id", "origin_client"], "origin_clock", "run_clock", "run").where("origin_clock < run.run_clock + run.len")
    ready, live = materialize(starts, "ready"), found.select("at", F.struct("doc_id", F.col("origin_client").alias("client"), F.col("run.run_clock").alias("clock")).alias("up"))
    live = materialize(live, "waiting")
    for _ in range(64):
        if live.isEmpty():
            break
        # Below a ready item all are ready; the others look twice as far up.
        fresh = live.join(ready.select(F.col("at").alias("up"), F.lit(True).alias("is_ready")), "up", "left")
        fresh = materialize(fresh, "looked")
        ahead = live.select(F.col("at").alias("up"), F.col("up").alias("next"))
        rest = fresh.where("is_ready is null").select("at", "up").join(ahead, "up").select("at", F.col("next").alias("up"))
        ready = materialize(ready.unionByName(fresh.where("is_ready").select("at")), "ready")
        live = replace(live, rest, "waiting")
    else:
        raise ValueError("the origins of some items form a ring")
    return runs.join(ready.select("at.*"), ["doc_id", "client", "clock"], "left_semi")


def ready_until(structs: DataFrame) -> DataFrame:
    """(doc_id, client, ready): the first clock of each client that can't be placed yet; all below it can.

    ``structs(doc_id, client, clock, len, origin, right_origin, parent_id)``
    without overlaps. A run waits if its client's clocks have a gap before it,
    or if a unit that it refers to isn't there or waits itself; with it waits
    all that its client wrote later. Each round lowers the marks of clients
    that refer to what waits, until none moves.
    """
    order = Window.partitionBy("doc_id", "client").orderBy("clock")
    reached = F.coalesce(F.lag(F.col("clock") + F.col("len")).over(order), F.lit(0))
    upto = F.min(F.when(F.col("clock") > F.col("reached"), F.col("reached")))
    marks = structs.withColumn("reached", reached).groupBy("doc_id", "client").agg(F.coalesce(upto, F.max(F.col("clock") + F.col("len"))).alias("ready"))
    marks = materialize(marks, "marks")
    refs = [structs.where(F.col(c).isNotNull()).select("doc_id", "client", "clock", F.col(f"{c}.client").alias("on"), F.col(f"{c}.clock").alias("need")) for c in ("origin", "right_origin", "parent_id")]
    refs = refs[0].unionByName(refs[1]).unionByName(refs[2]).where("on != client or need >= clock")
    # A client's first reference beyond a clock decides, so only the nearest matter: one row for each of its runs that refers to another client.
    refs = materialize(refs, "references")
    for _ in range(10_000):
        there = marks.select("doc_id", F.col("client").alias("on"), "ready")
        short = refs.join(there, ["doc_id", "on"], "left").where(F.col("need") >= F.coalesce("ready", F.lit(0)))
        lower = short.groupBy("doc_id", "client").agg(F.min("clock").alias("lower"))
        moved = materialize(marks.join(lower, ["doc_id", "client"], "left").select("doc_id", "client", F.least("ready", F.coalesce("lower", "ready")).alias("ready"), (F.coalesce("lower", "ready") < F.col("ready")).alias("moved")), "marks")
        settled = moved.where("moved").isEmpty()
        discard(marks)
        marks = moved.select("doc_id", "client", "ready")
        marks.scratch_path = moved.scratch_path
        if settled:
            return marks
    raise ValueError("the marks of clients don't settle")
