"""Edits by index: inserts and deletes at places of a rendered sequence become runs with origins and delete ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import utf16_length
from tideline.operators.positions import relative_positions
from tideline.operators.state import compact_ranges
from tideline.plans.asof import as_of


def insert_at(items: DataFrame, inserts: DataFrame, order: list[Column]) -> DataFrame:
    """New runs for ``inserts(doc_id, index, content, client)`` into the live units of ``items(doc_id, client, clock, len, deleted)``.

    A run stands after the unit to the left of its index (its origin) and
    before the one at it (its right origin); its clocks follow its client's
    last one, several inserts of a client in order of index. Returns (doc_id,
    client, clock, len, origin, right_origin, content).
    """
    ident = F.when(F.col("unit_client").isNotNull(), F.struct(F.col("unit_client").alias("client"), F.col("unit_clock").alias("clock")))

    def unit(index: Column, name: str) -> DataFrame:
        asked = inserts.select("doc_id", index.alias("index")).where("index >= 0").distinct()
        found = relative_positions(items, asked, order)
        return found.select("doc_id", F.col("index").alias(f"{name}_index"), F.col("client").alias("unit_client"), F.col("clock").alias("unit_clock")).select("doc_id", f"{name}_index", ident.alias(name))

    rows = inserts.withColumns({"origin_index": F.col("index") - 1, "right_origin_index": F.col("index")})
    rows = rows.join(unit(F.col("index") - 1, "origin"), ["doc_id", "origin_index"], "left").join(unit(F.col("index"), "right_origin"), ["doc_id", "right_origin_index"], "left")
    due = items.groupBy("doc_id", "client").agg(F.max(F.col("clock") + F.col("len")).alias("due"))
    own = Window.partitionBy("doc_id", "client").orderBy("index", "content").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("len", utf16_length(F.col("content"))).where("len > 0").withColumn("earlier", F.coalesce(F.sum("len").over(own), F.lit(0)))
    rows = rows.join(due, ["doc_id", "client"], "left")
    return rows.select("doc_id", "client", (F.coalesce("due", F.lit(0)) + F.col("earlier")).alias("clock"), "len", "origin", "right_origin", "content")


def delete_at(items: DataFrame, deletes: DataFrame, order: list[Column]) -> DataFrame:
    """The delete set of ``deletes(doc_id, index, n)``: the units that are live at those places, as compact ranges.

    A range beyond the end stops there. Each run is cut where a range begins
    or ends: the borders of both, in order of place, part the units.
    """
    before = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    live = items.where("not deleted and len > 0").withColumn("at", F.coalesce(F.sum("len").over(before), F.lit(0)))
    ranges = deletes.where("n > 0").select("doc_id", F.lit(0).cast("long").alias("client"), F.col("index").alias("clock"), F.col("n").alias("len"))
    ranges = compact_ranges(ranges).select("doc_id", F.col("clock").alias("low"), (F.col("clock") + F.col("len")).alias("high"))
    # Pieces begin where a run or a range begins, and where a range ends.
    cuts = live.select("doc_id", "at").unionByName(ranges.select("doc_id", F.explode(F.array("low", "high")).alias("at"))).distinct()
    pieces = as_of(cuts, live.select("doc_id", F.col("at").alias("run_at"), "client", "clock", "len"), ["doc_id"], "at", "run_at", "run")
    pieces = as_of(pieces, ranges, ["doc_id"], "at", "low", "range")
    nexts = F.lead("at").over(Window.partitionBy("doc_id").orderBy("at"))
    ends = F.least(F.coalesce(nexts, F.lit(2**62)), F.col("run.run_at") + F.col("run.len"))
    gone = pieces.withColumn("end", ends).where("at < end and at < range.high")
    return compact_ranges(gone.select("doc_id", "run.client", (F.col("run.clock") + F.col("at") - F.col("run.run_at")).alias("clock"), (F.col("end") - F.col("at")).alias("len")))


def delta_steps(deltas: DataFrame) -> DataFrame:
    """``deltas(doc_id, step, op, insert, n)`` as edits of the state before them: (doc_id, step, op, index, insert, n).

    The cursor moves over what is retained and deleted; an insert stands at the cursor.
    """
    moved = F.when(F.col("op") == "insert", 0).otherwise(F.col("n"))
    cursor = F.sum(moved).over(Window.partitionBy("doc_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    return deltas.withColumn("index", F.coalesce(cursor, F.lit(0))).where("op != 'retain'").select("doc_id", "step", "op", "index", "insert", "n")


_ID = "struct<client:bigint,clock:bigint>"
_NONE = {"origin": _ID, "right_origin": _ID, "parent_name": "string", "parent_id": _ID, "parent_sub": "string", "str": "string", "bin": "binary", "vals": "array<string>", "fmt_key": "string", "type_class": "int", "node_name": "string", "move_target": _ID, "move_len": "bigint"}


def as_structs(rows: DataFrame, **given: Column | str) -> DataFrame:
    """``rows(doc_id, client, clock, len, ...)`` as structs of updates: columns given by expression or taken where they are, all others null."""
    held = set(rows.columns)
    columns = [*("doc_id", "client", "clock", "len"), *([] if "content_type" in given else ["content_type"])]
    made = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in given.items()]
    rest = [F.col(c) if c in held else F.lit(None).cast(kind).alias(c) for c, kind in _NONE.items() if c not in given]
    return rows.select(*columns, *made, *rest)


def _clocks(rows: DataFrame, log: DataFrame, order: list[str]) -> DataFrame:
    """``rows(doc_id, client, len)`` with ``clock``: after all that their client has written in ``log``, in ``order``."""
    due = log.groupBy("doc_id", "client").agg(F.max(F.col("clock") + F.col("len")).alias("_due"))
    earlier = F.sum("len").over(Window.partitionBy("doc_id", "client").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(due, ["doc_id", "client"], "left")
    return rows.withColumn("clock", F.coalesce("_due", F.lit(0)) + F.coalesce(earlier, F.lit(0))).drop("_due")


def _parent(rows: DataFrame) -> dict[str, Column]:
    """Columns parent_name and parent_id of a ``parent``, for rows without an origin."""
    parts = F.split("parent", ":")
    free = F.col("origin").isNull()
    named = F.col("parent").startswith("/")
    ident = F.struct(parts[0].try_cast("long").alias("client"), parts[1].try_cast("long").alias("clock"))
    return {"parent_name": F.when(free & named, F.expr("substring(parent, 2)")), "parent_id": F.when(free & ~named, ident)}


def map_set(items: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(structs, deleted ranges) of ``writes(doc_id, parent, key, value, client, seq)`` to the maps, or attributes, of placed ``items``.

    ``value`` is a JSON text. Each write stands after the last one of its key,
    of this batch in order of ``seq`` or of ``items``, and deletes it if it lives.
    """
    last = items.where("parent_sub is not null").groupBy("doc_id", "parent", F.col("parent_sub").alias("key")).agg(F.max_by(F.struct(F.col("client"), (F.col("clock") + F.col("len") - 1).alias("clock"), "deleted"), "pos").alias("last"))
    rows = _clocks(writes.withColumn("len", F.lit(1).cast("long")), items, ["seq"]).join(last, ["doc_id", "parent", "key"], "left")
    chain = Window.partitionBy("doc_id", "parent", "key").orderBy("seq")
    before = F.lag(F.struct("client", "clock")).over(chain)
    held = F.when(F.col("last").isNotNull(), F.struct("last.client", "last.clock"))
    rows = rows.withColumn("origin", F.coalesce(before, held)).withColumn("_lives", before.isNotNull() | ~F.coalesce("last.deleted", F.lit(True)))
    gone = rows.where("_lives and origin is not null").select("doc_id", "origin.client", "origin.clock", F.lit(1).cast("long").alias("len"))
    keyed = F.when(F.col("origin").isNull(), F.col("key"))
    return as_structs(rows, content_type=F.lit("any"), vals=F.array("value"), origin="origin", parent_sub=keyed, **_parent(rows)), gone


def map_delete(items: DataFrame, keys: DataFrame) -> DataFrame:
    """The deleted ranges of ``keys(doc_id, parent, key)``: their live entries."""
    last = items.where("parent_sub is not null").groupBy("doc_id", "parent", F.col("parent_sub").alias("key")).agg(F.max_by(F.struct("client", (F.col("clock") + F.col("len") - 1).alias("clock"), "deleted"), "pos").alias("last"))
    return last.join(keys, ["doc_id", "parent", "key"], "left_semi").where("not last.deleted").select("doc_id", "last.client", "last.clock", F.lit(1).cast("long").alias("len"))


def _neighbours(items: DataFrame, places: DataFrame) -> DataFrame:
    """``places(doc_id, parent, index, ...)`` with ``origin`` and ``right_origin``: the units left and right of each index among the live countable ones."""
    live = items.where("parent_sub is null and not deleted and content_type not in ('format', 'move')")
    order = Window.partitionBy("doc_id", "parent").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    spans = live.withColumn("before", F.coalesce(F.sum("len").over(order), F.lit(0)).cast("long")).select("doc_id", "parent", "client", "clock", "len", "before")
    rows = places
    for name, at in (("origin", F.col("index") - 1), ("right_origin", F.col("index"))):
        asked = rows.withColumn("_at", at.cast("long"))
        found = as_of(asked, spans, ["doc_id", "parent"], "_at", "before", "_run")
        inside = (F.col("_at") >= 0) & (F.col("_at") < F.col("_run.before") + F.col("_run.len"))
        rows = found.withColumn(name, F.when(inside, F.struct(F.col("_run.client").alias("client"), (F.col("_run.clock") + F.col("_at") - F.col("_run.before")).alias("clock")))).drop("_at", "_run")
    return rows


def insert_nodes(items: DataFrame, inserts: DataFrame) -> DataFrame:
    """Structs of ``inserts(doc_id, parent, index, client, seq, content_type, len, ...)`` among the children, elements or units of placed types.

    Content columns are taken as they are: ``str`` of a text, ``vals`` of list
    elements, ``type_class`` and ``node_name`` of an XML node. A node's own
    children and attributes name it by ``client:clock``.
    """
    rows = _clocks(_neighbours(items, inserts), items, ["seq"])
    free = {k: F.when(F.col("right_origin").isNull(), v) for k, v in _parent(rows).items()}
    return as_structs(rows, origin="origin", right_origin="right_origin", **free)


def format_at(items: DataFrame, formats: DataFrame) -> DataFrame:
    """Structs of ``formats(doc_id, parent, index, n, key, value, client, seq)``: a marker before the first unit and one that ends it after the last.

    ``value`` is a JSON text; the text null ends the attribute over the range
    and needs no second marker.
    """
    ends = F.filter(F.array(F.struct(F.lit(0).alias("i"), F.col("index").alias("index"), F.col("value").alias("value")), F.struct(F.lit(1).alias("i"), (F.col("index") + F.col("n")).alias("index"), F.lit("null").alias("value"))), lambda x: (x["i"] == 0) | (F.col("value") != "null"))
    rows = formats.where("n > 0").select("doc_id", "parent", "key", "client", "seq", F.inline(ends)).withColumn("len", F.lit(1).cast("long"))
    rows = _clocks(_neighbours(items, rows), items, ["seq", "i"])
    free = {k: F.when(F.col("right_origin").isNull(), v) for k, v in _parent(rows).items()}
    return as_structs(rows, content_type=F.lit("format"), fmt_key="key", vals=F.array("value"), origin="origin", right_origin="right_origin", **free)


def delete_children(items: DataFrame, deletes: DataFrame) -> DataFrame:
    """The deleted ranges of ``deletes(doc_id, parent, index, n)``: live children or units at those places, keyed items skipped."""
    live = items.where("parent_sub is null and not deleted and content_type not in ('format', 'move')")
    flat = lambda df: df.withColumn("_doc", F.struct("doc_id", "parent"))
    named = flat(live).select(F.col("_doc").alias("doc_id"), "client", "clock", "len", "deleted", "pos")
    found = delete_at(named, flat(deletes).select(F.col("_doc").alias("doc_id"), "index", "n"), [F.col("pos")])
    return compact_ranges(found.select(F.col("doc_id.doc_id").alias("doc_id"), "client", "clock", "len"))
