"""The order of runs in a sequence, from their origins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from tideline.operators.runs import split_at
from tideline.plans.chains import follow
from tideline.plans.scratch import materialize

#: Runs that a task orders at once. Longer sequences are ordered by joins.
AT_ONCE = 1 << 20
#: Runs, about, of the short sequences that are ordered together.
TOGETHER = 1 << 15


def walk_tree(up: np.ndarray, client: np.ndarray, clock: np.ndarray, sequence: np.ndarray | None = None) -> np.ndarray:
    """The place of each node in the pre-order of a forest: ``up`` is its parent's index, -1 for none, -2 for one that is missing.

    Children of one node stand by client, and of one client the later first;
    trees of one ``sequence`` stand together. Nodes below a missing one have
    place -1, and so have rings.
    """
    order = np.lexsort((-clock, client, up) if sequence is None else (-clock, client, sequence, up))
    first, beside = [-1] * (len(up) + 1), [-1] * len(up)
    parents, order = up[order].tolist(), order.tolist()
    for i in range(len(order) - 1, -1, -1):
        if parents[i] != -2:
            beside[order[i]], first[parents[i]] = first[parents[i]], order[i]
    place, now, count = [-1] * len(up), first[-1], 0
    up = up.tolist()
    while now >= 0:
        place[now], count = count, count + 1
        if first[now] >= 0:
            now = first[now]
            continue
        while now >= 0 and beside[now] < 0:
            now = up[now]
        now = beside[now] if now >= 0 else -1
    return np.array(place, dtype=np.int64)


def origins_of(sequence: np.ndarray, client: np.ndarray, clock: np.ndarray, end: np.ndarray, origin_client: pa.Array, origin_clock: pa.Array, inside: bool = False) -> np.ndarray:
    """The index of the run of the same sequence whose last unit is each run's origin; -1 for none, -2 for one that isn't there.

    With ``inside`` the origin may be any unit of a run.
    """
    free = origin_client.is_null().to_numpy(zero_copy_only=False)
    oc, ok = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (origin_client, origin_clock))
    # Ids as one number: sequences, clients and clocks by their rank among all that occur.
    codes = np.unique(np.concatenate([client, oc]), return_inverse=True)[1]
    codes = np.unique(np.concatenate([sequence, sequence]) * (2 * len(client) + 1) + codes, return_inverse=True)[1].reshape(2, -1)
    ranks = np.unique(np.concatenate([clock if inside else end, ok if inside else ok + 1]), return_inverse=True)[1].reshape(2, -1)
    ids, wanted = codes * (2 * len(client) + 1) + ranks
    by = np.argsort(ids, kind="stable")
    if inside:
        at = by[np.maximum(np.searchsorted(ids, wanted, side="right", sorter=by) - 1, 0)]
        found = (codes[0][at] == codes[1]) & (clock[at] <= ok) & (ok < end[at])
    else:
        at = by[np.minimum(np.searchsorted(ids, wanted, sorter=by), len(by) - 1)]
        found = ids[at] == wanted
    return np.where(free, -1, np.where(found, at, -2))


def _codes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """A number from 0 on for each distinct combination of ``keys``, nulls being a value like any other."""
    out = np.zeros(table.num_rows, dtype=np.int64)
    for k in keys:
        own = table.column(k).combine_chunks() if isinstance(table.column(k), pa.ChunkedArray) else table.column(k)
        own = own.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.unique(out * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    return out


def each_short(runs: DataFrame, keys: list[str], at_once: int, place, fields: StructType) -> tuple[DataFrame, DataFrame | None]:
    """``place(table, sequence)`` of the runs of all sequences of ``keys`` that have no more than ``at_once``, and the runs of longer ones, if any.

    Short sequences come together, TOGETHER runs or so at a time, ``sequence``
    telling them apart: most have few runs, and each call has a price.
    """
    long_ones = materialize(runs.groupBy(keys).agg(F.count("*").alias("n")).where(F.col("n") > at_once).drop("n"), "long")  # one row for each million of rows at most
    none_long = long_ones.isEmpty()
    short = runs if none_long else runs.join(long_ones, keys, "left_anti").select(runs.columns)
    groups = max(1, -(-runs.count() // TOGETHER))

    def run(table: pa.Table) -> pa.Table:
        table = table.drop_columns(["_group"]).combine_chunks()
        return place(table, _codes(table, keys))

    placed = short.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups))).groupBy("_group").applyInArrow(run, fields)
    return placed, None if none_long else runs.join(long_ones, keys, "left_semi").select(runs.columns)


def _column(table: pa.Table, name: str) -> pa.Array:
    own = table.column(name)
    return own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own


def places(table: pa.Table, sequence: np.ndarray, inside: bool = False, missing_start: bool = False) -> np.ndarray:
    """The place of each run of ``table`` in its sequence, -1 where it has none yet.

    With ``inside`` an origin may be any unit of a run; with ``missing_start``
    runs whose origin is missing stand at the start, so that only rings have no place.
    """
    client, clock, length = (table.column(c).to_numpy() for c in ("client", "clock", "len"))
    up = origins_of(sequence, client, clock, clock + length, _column(table, "origin_client"), _column(table, "origin_clock"), inside)
    if missing_start:
        up = np.where(up == -2, -1, up)
    pos = walk_tree(up, client, clock, sequence)
    first = np.full(int(sequence.max(initial=0)) + 1, len(pos), dtype=np.int64)
    held = pos >= 0
    np.minimum.at(first, sequence[held], pos[held])
    return np.where(held, pos - first[sequence], -1)


def origin_tree_order(items: DataFrame, keys: list[str] | None = None, at_once: int = AT_ONCE, is_split: bool = False) -> DataFrame:
    """``items(doc_id, client, clock, len, origin_client, origin_clock, ...)`` with ``pos``, their place from 0 on in each sequence of ``keys``.

    The order is the pre-order of the tree of origins: a run stands after the
    unit that is its origin, before what stands after that otherwise; runs of
    one origin stand by client, and of one client the later first. It depends
    on the set of items alone, not on how they arrived. Without a ``len`` each
    item is one unit. Where an origin lies inside a run, the run is split there
    and both pieces return, unless the items are split already. Items whose origin is missing, or waits for one
    that is, have no place yet and are left out.

    Sequences of up to ``at_once`` runs are ordered by walks in tasks, short ones
    together; longer ones by joins, so no sequence need fit a task.
    """
    keys = keys or ["doc_id"]
    runs = items if "len" in items.columns else items.withColumn("len", F.lit(1).cast("long"))
    if "len" in items.columns and not is_split:
        inside = items.where("origin_client is not null").select("doc_id", F.col("origin_client").alias("client"), (F.col("origin_clock") + 1).alias("clock"))
        runs = split_at(items, inside)
    runs = materialize(runs, "runs")
    fields = StructType([*runs.schema.fields]).add("pos", LongType())
    schema = to_arrow_schema(fields)

    def place(table: pa.Table, sequence: np.ndarray) -> pa.Table:
        pos = places(table, sequence)
        out = table.append_column("pos", pa.array(pos)).filter(pa.array(pos >= 0))
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(out.columns, schema)], schema=schema)

    placed, rest = each_short(runs, keys, at_once, place, fields)
    if rest is not None:
        placed = placed.unionByName(_by_joins(rest, keys))
    return placed if "len" in items.columns else placed.drop("len")


def _by_joins(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The same order without any sequence in one task.

    The walk around the tree enters and leaves every run once. Each step knows
    the next one from its neighbours in the tree; pointers double until they
    reach the end, counting the runs entered on the way, so a chain of n runs
    takes log2(2n) joins on keys that no two steps share.
    """
    end = F.col("clock") + F.col("len") - 1
    known = runs.select(*keys, F.col("client").alias("origin_client"), end.alias("origin_clock"), F.struct("client", "clock").alias("up"))
    linked = runs.where("origin_client is not null").join(known, [*keys, "origin_client", "origin_clock"])
    me = F.struct("client", "clock").alias("id")
    rows = linked.select(*keys, me, "up").unionByName(runs.where("origin_client is null").select(*keys, me, F.lit(None).cast("struct<client:bigint,clock:bigint>").alias("up")))
    siblings = Window.partitionBy(*keys, "up").orderBy(F.col("id.client"), F.desc("id.clock"))
    rows = materialize(rows.withColumn("beside", F.lead("id").over(siblings)).withColumn("nth", F.row_number().over(siblings)), "siblings")
    firsts = rows.where("nth = 1 and up is not null").select(*keys, F.col("up").alias("id"), F.col("id").alias("first"))
    rows = rows.join(firsts, [*keys, "id"], "left")

    # A step is a run and whether the walk leaves it; next is null at the end of the walk.
    step = lambda c, leaves: F.when(c.isNotNull(), F.struct(*keys, c.alias("id"), F.lit(leaves).alias("leaves")))
    enters = rows.select(step(F.col("id"), False).alias("at"), F.coalesce(step(F.col("first"), False), step(F.col("id"), True)).alias("next"), F.lit(1).cast("long").alias("n"))
    leaves = rows.select(step(F.col("id"), True).alias("at"), F.coalesce(step(F.col("beside"), False), step(F.col("up"), True)).alias("next"), F.lit(0).cast("long").alias("n"))
    ranked = follow(enters.unionByName(leaves)).where("not at.leaves").select(*(F.col(f"at.{k}").alias(k) for k in keys), F.col("at.id.client").alias("client"), F.col("at.id.clock").alias("clock"), "n")
    # Steps below a missing origin never reach the end of the walk from its start; the others count down from the number of runs.
    sizes = ranked.groupBy(keys).agg(F.max("n").alias("most"))
    places = ranked.join(sizes, keys).select(*keys, "client", "clock", (F.col("most") - F.col("n")).alias("pos"))
    return runs.join(places, [*keys, "client", "clock"]).select(*runs.columns, "pos")
