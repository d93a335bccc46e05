"""Snapshots, restoring, compaction and undo of operation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.runs import cut, mark_deleted
from tideline.operators.state import compact_ranges, delete_set, state_vector


def capture_snapshot(log: DataFrame) -> DataFrame:
    """(doc_id, sv, ds): each document's state vector and delete set as sorted arrays."""
    vector = state_vector(log).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("client", "next_clock"))).alias("sv"))
    deleted = delete_set(log).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("client", "clock", "len"))).alias("ds"))
    empty = F.array().cast("array<struct<client:bigint,clock:bigint,len:bigint>>")
    return vector.join(deleted, "doc_id", "left").withColumn("ds", F.coalesce("ds", empty))


def restore(log: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``log`` as it was at ``snapshot(doc_id, sv, ds)``: its units below the state vector, deleted where the snapshot says so.

    Documents without a snapshot are left out. Runs are cut at the border of
    the state vector and split where a deleted range begins or ends.
    """
    vector = snapshot.select("doc_id", F.inline("sv")).withColumnRenamed("next_clock", "_upto")
    below = log.drop("deletes").join(vector, ["doc_id", "client"])
    below = cut(below, F.lit(0), F.least(F.col("len"), F.col("_upto") - F.col("clock"))).drop("_upto")
    return mark_deleted(below, snapshot.select("doc_id", F.inline("ds")))


def squash_runs(log: DataFrame, same: list[Column], content: str | None = None) -> DataFrame:
    """Runs of one client with adjacent clocks and equal ``same`` become one: (doc_id, client, clock, len, n_runs), and the texts of ``content`` joined."""
    order = Window.partitionBy("doc_id", "client").orderBy("clock")
    kind = F.struct(*same)
    joins = (F.lag(F.col("clock") + F.col("len")).over(order) == F.col("clock")) & F.lag(kind).over(order).eqNullSafe(kind)
    runs = log.withColumn("run", F.sum(F.when(joins, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("clock", content))), lambda x: x[content]), "").alias(content)] if content else []
    return runs.groupBy("doc_id", "client", "run").agg(F.min("clock").alias("clock"), F.sum("len").alias("len"), F.count("*").alias("n_runs"), *own).drop("run")


def collect_garbage(log: DataFrame) -> DataFrame:
    """``log`` with deleted runs as bare tombstones, adjacent ones merged: (doc_id, client, clock, len, key, value, is_gc)."""
    live = log.where("not deletes").select("doc_id", "client", "clock", "len", "key", "value", F.lit(False).alias("is_gc"))
    dead = compact_ranges(log.where("deletes").select("doc_id", "client", "clock", "len"))
    return live.unionByName(dead.withColumn("is_gc", F.lit(True)), allowMissingColumns=True)


def undo_groups(log: DataFrame, timeout_seconds: float, boundaries: Column | None = None, scope: Column | None = None, origins: list[str] | None = None) -> DataFrame:
    """Stack items: operations of a client in a document that follow each other within the timeout.

    Returns (doc_id, client, item, first_clock, next_clock, n_ops, n_deletes). An
    operation where ``boundaries`` holds begins a new item (capturing stopped).
    Only operations where ``scope`` holds, and whose ``origin_tag`` is among
    ``origins``, are captured; others neither join nor part items.
    """
    tracked = log if scope is None else log.where(scope)
    tracked = tracked if origins is None else tracked.where(F.col("origin_tag").isin(origins))
    order = Window.partitionBy("doc_id", "client").orderBy("ts", "clock")
    seconds = F.unix_micros("ts") / 1e6
    apart = F.coalesce(seconds - F.lag(seconds).over(order) > timeout_seconds, F.lit(True))
    if boundaries is not None:
        apart = apart | boundaries
    items = tracked.withColumn("item", F.sum(F.when(apart, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return items.groupBy("doc_id", "client", "item").agg(F.min("clock").alias("first_clock"), F.max(F.col("clock") + F.col("len")).alias("next_clock"), F.count("*").alias("n_ops"), F.sum(F.col("deletes").cast("long")).alias("n_deletes"))


def _compensation(log: DataFrame, items: DataFrame, inserted: str, deleted: str) -> DataFrame:
    hit = log.join(items, ["doc_id", "client"]).where("clock >= first_clock and clock < next_clock").where("deletes is not null")
    runs = compact_ranges(hit.select("doc_id", "client", "clock", "len", "deletes"), ("deletes",))
    return runs.withColumn("action", F.when(F.col("deletes"), deleted).otherwise(inserted)).select("doc_id", "client", "clock", "len", "action")


def stack_state(groups: DataFrame, undone: int | Column = 0) -> DataFrame:
    """``groups`` of undo_groups with ``stack``: ``redo`` for each client's last ``undone`` items, ``undo`` for those before."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "client").orderBy(F.desc("item")))
    return groups.withColumn("stack", F.when(nth <= undone, "redo").otherwise("undo"))


def stack_sizes(groups: DataFrame, undone: int | Column = 0) -> DataFrame:
    """(doc_id, client, n_undo, n_redo): the sizes of each client's stacks after ``undone`` undos."""
    side = lambda name: F.sum((F.col("stack") == name).cast("long"))
    return stack_state(groups, undone).groupBy("doc_id", "client").agg(side("undo").alias("n_undo"), side("redo").alias("n_redo"))


def undo_last(log: DataFrame, timeout_seconds: float, steps: int = 1) -> DataFrame:
    """What undoing each client's last ``steps`` stack items does: (doc_id, client, clock, len, action).

    Runs that the items inserted are deleted, runs that they deleted come back
    (``revive``).
    """
    items = stack_state(undo_groups(log, timeout_seconds), steps).where("stack = 'redo'")
    return _compensation(log, items.groupBy("doc_id", "client").agg(F.min("first_clock").alias("first_clock"), F.max("next_clock").alias("next_clock")), "delete", "revive")


def redo_next(log: DataFrame, timeout_seconds: float, undone: int) -> DataFrame:
    """What one redo does after ``undone`` undos: the earliest undone item of each client comes back, what it deleted goes again."""
    items = stack_state(undo_groups(log, timeout_seconds), undone).where("stack = 'redo'")
    first = items.groupBy("doc_id", "client").agg(F.min_by(F.struct("first_clock", "next_clock"), "item").alias("top")).select("doc_id", "client", "top.*")
    return _compensation(log, first, "revive", "delete")
