"""Presence: the latest state of each client, its changes and its expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import json_depth

#: Limits of a state: bytes and nesting. A state beyond them counts as removed.
STATE_BYTES, STATE_DEPTH = 1 << 20, 20


def valid_state(state: Column) -> Column:
    """The state, or null where it is no JSON object, too large or too deep."""
    depth = json_depth(state)
    small = (F.octet_length(state) <= STATE_BYTES) & depth.isNotNull() & (depth <= STATE_DEPTH)
    # Checked before it is parsed: the parser has limits of its own.
    parsed = F.try_parse_json(F.when(small & state.rlike(r"^[ \t\r\n]*\{"), state))
    return F.when(parsed.isNotNull(), state)


def removals(states: DataFrame) -> DataFrame:
    """(doc_id, client, clock, state): the updates that announce that the clients of ``states`` have left, a null state at the next clock."""
    return states.select("doc_id", "client", (F.col("clock") + 1).alias("clock"), F.lit(None).cast("string").alias("state"))


def clients_of_peers(updates: DataFrame, most: int = 10_000) -> DataFrame:
    """(doc_id, peer, clients): the clients that each peer of ``updates(doc_id, peer, client, ...)`` has spoken for, and ``over`` where they are more than ``most``."""
    own = updates.select("doc_id", "peer", "client").distinct()
    return own.groupBy("doc_id", "peer").agg(F.count("*").alias("clients"), (F.count("*") > most).alias("over"))


def presence_states(updates: DataFrame, now: Column, timeout_seconds: int) -> DataFrame:
    """(doc_id, client, clock, state, updated_at): the state of the highest clock of each client, if any and not older than the timeout.

    Of several updates with one clock the first to arrive counts, by ``ts`` and
    ``seq``; the others came too late.
    """
    arrival = [c for c in ("ts", "seq") if c in updates.columns]
    latest = F.min_by(F.struct("clock", "state", "ts"), F.struct((-F.col("clock")).alias("c"), *arrival)).alias("last")
    last = updates.groupBy("doc_id", "client").agg(latest).select("doc_id", "client", "last.clock", valid_state(F.col("last.state")).alias("state"), F.col("last.ts").alias("updated_at"))
    return last.where(F.col("state").isNotNull() & (F.col("updated_at").cast("timestamp") >= now - F.make_dt_interval(secs=F.lit(timeout_seconds))))


def presence_changes(updates: DataFrame) -> DataFrame:
    """The accepted updates of each client in order of arrival, each added, updated or removed: (doc_id, client, clock, change).

    An update is accepted only if its clock is above all that came before.
    """
    order = Window.partitionBy("doc_id", "client").orderBy("ts", "seq")
    highest = F.max("clock").over(order.rowsBetween(Window.unboundedPreceding, -1))
    accepted = updates.withColumn("state", valid_state(F.col("state"))).withColumn("highest", highest).where("highest is null or clock > highest")
    before = F.lag("state").over(order)
    change = F.when(before.isNull() & F.col("state").isNotNull(), "added").when(before.isNotNull() & F.col("state").isNull(), "removed").when(F.col("state").isNotNull(), "updated")
    return accepted.withColumn("change", change).where("change is not null").select("doc_id", "client", "clock", "change")
