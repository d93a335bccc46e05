"""From the structs of decoded updates to the values of their types: texts, lists, maps, rich text and XML.

A type is named by ``parent``: ``/name`` for a root, ``client:clock`` for one
that an item holds. A ``slot`` is the sequence of a type, or one key of its map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import attribute_changes, xml_escape_attribute, xml_escape_text
from tideline.operators.order import origin_tree_order
from tideline.operators.runs import borders, flag_deleted, split_at, units, without_overlaps
from tideline.operators.state import ready_until
from tideline.plans.scratch import materialize
from tideline.sources.updates import resolve_parents

#: Contents that no length of a list or text counts.
UNCOUNTED = ("format", "move", "deleted", "gc")
#: Type classes that hold XML.
ELEMENT, FRAGMENT, XML_TEXT = 3, 4, 6


def root(name: str) -> str:
    return f"/{name}"


def id_name(ident: Column) -> Column:
    return F.concat(ident["client"].cast("string"), F.lit(":"), ident["clock"].cast("string"))


def placed_items(rows: DataFrame) -> DataFrame:
    """The items of decoded ``rows``, in place: (doc_id, parent, parent_sub, slot, pos, deleted, ...) for each piece of a run.

    ``rows`` are those of decode_updates, of any number of updates in any order.
    Units that several hold count once; runs that wait for others, malformed
    updates and tombstones without a parent are left out. Runs are split where
    an origin lies inside them, where a deleted range begins or ends, and at
    the targets of moves, so that deletions are exact to the unit.
    """
    good = materialize(rows.where("error is null").drop("error"), "rows")
    ranges = good.where("content_type = 'range'").select("doc_id", "client", "clock", "len")
    structs = materialize(without_overlaps(good.where("content_type != 'range'")), "structs")
    ready = ready_until(structs)
    structs = structs.join(ready, ["doc_id", "client"]).where("clock + len <= ready").drop("ready")
    structs = materialize(resolve_parents(materialize(structs, "ready")), "parents")
    after = units([(structs, "origin")]).withColumn("clock", F.col("clock") + 1)
    targets = borders(structs.where("content_type = 'move'").select("doc_id", "move_target.client", "move_target.clock", F.col("move_len").alias("len")))
    pieces = materialize(split_at(structs, after.unionByName(targets).unionByName(borders(ranges))), "pieces")
    pieces = flag_deleted(pieces, ranges, "deleted")
    pieces = pieces.withColumn("deleted", F.col("deleted") | F.col("content_type").isin("deleted", "gc"))
    parent = F.coalesce(id_name(F.col("parent_id")), F.concat(F.lit("/"), F.col("parent_name")))
    pieces = pieces.withColumn("parent", parent).where("parent is not null")
    pieces = pieces.withColumn("slot", F.concat("parent", F.when(F.col("parent_sub").isNull(), "").otherwise(F.concat(F.lit("#"), "parent_sub"))))
    flat = pieces.withColumns({"origin_client": F.col("origin.client"), "origin_clock": F.col("origin.clock")})
    return origin_tree_order(flat, ["doc_id", "slot"], is_split=True)


def sequence(items: DataFrame, parent: str | None = None) -> DataFrame:
    """The live items of sequences, of one type if ``parent`` is given."""
    own = items.where("parent_sub is null and not deleted")
    return own if parent is None else own.where(F.col("parent") == parent)


def _joined(column: str, separator: str = "") -> Column:
    own = F.array_sort(F.collect_list(F.struct("pos", column)))
    return F.array_join(F.transform(own, lambda x: x[column]), separator)


def texts(items: DataFrame) -> DataFrame:
    """(doc_id, parent, text) of the types with live text."""
    return sequence(items).where("content_type = 'string'").groupBy("doc_id", "parent").agg(_joined("str").alias("text"))


def text_json(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)


def elements(items: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id, parent, pos, nth, value): the live elements of lists in order, values as JSON texts.

    ``strict`` gives plain values alone; otherwise embeds, binaries, texts and
    nested types are elements too. A move takes the elements it targets to its own
    place; of several that of the lowest client counts, then the lowest clock.
    """
    value = F.when(F.col("content_type").isin("any", "json"), F.col("vals"))
    if not strict:
        value = value.when(F.col("content_type") == "embed", F.col("vals")).when(F.col("content_type") == "string", F.array(text_json(F.col("str"))))
        value = value.when(F.col("content_type") == "binary", F.array(F.concat(F.lit('{"$bytes":"'), F.base64("bin"), F.lit('"}'))))
        value = value.when(F.col("content_type") == "type", F.array(F.concat(F.lit('{"$type":"'), id_name(F.struct("client", "clock")), F.lit('"}'))))
    own = sequence(items)
    moves = own.where("content_type = 'move'").select("doc_id", "parent", F.col("pos").alias("to"), F.col("move_target.client").alias("target"), "move_target.clock", F.col("move_len").alias("len"), F.struct("client", "clock").alias("by"))
    # Pieces are split at the borders of targets, so a piece is a target where it begins at one of its clocks.
    asked = moves.select("doc_id", "parent", F.col("target").alias("client"), F.explode(F.sequence("clock", F.col("clock") + F.greatest("len", F.lit(1)) - 1)).alias("clock"), "to", "by")
    hits = asked.join(own.select("doc_id", "parent", "client", "clock"), ["doc_id", "parent", "client", "clock"])
    won = hits.groupBy("doc_id", "parent", "client", "clock").agg(F.min_by("to", "by").alias("to"))
    moved = own.join(won, ["doc_id", "parent", "client", "clock"], "left")
    rows = moved.withColumn("value", value).where("value is not null").select("doc_id", "parent", F.coalesce("to", "pos").alias("place"), F.col("to").isNull().alias("stays"), "pos", F.posexplode("value").alias("i", "value"))
    order = Window.partitionBy("doc_id", "parent").orderBy("place", "stays", "pos", "i")
    return rows.select("doc_id", "parent", (F.row_number().over(order) - 1).cast("long").alias("nth"), "value")


def lists(items: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id, parent, n, json): each list as a JSON array."""
    own = F.array_sort(F.collect_list(F.struct("nth", "value")))
    found = elements(items, strict).groupBy("doc_id", "parent").agg(own.alias("own"))
    return found.select("doc_id", "parent", F.size("own").cast("long").alias("n"), F.concat(F.lit("["), F.array_join(F.transform("own", lambda x: x["value"]), ","), F.lit("]")).alias("json"))


def entries(items: DataFrame) -> DataFrame:
    """(doc_id, parent, key, client, clock, value, text): the live entry of each key of each map.

    The writes of one key are a sequence of their own, in which a later write
    stands after the one it replaces and concurrent ones by client; the last
    counts, and a key whose last write is deleted is gone. ``value`` is a JSON
    text; ``text`` that of a plain string.
    """
    value = F.when(F.col("content_type") == "string", text_json(F.col("str"))).otherwise(F.element_at("vals", -1))
    plain = F.when(F.col("content_type") == "string", F.col("str")).otherwise(F.get_json_object(F.concat(F.lit('{"v":'), F.element_at("vals", -1), F.lit("}")), "$.v"))
    last = F.max_by(F.struct("client", (F.col("clock") + F.col("len") - 1).alias("clock"), value.alias("value"), plain.alias("text"), "deleted"), "pos").alias("last")
    found = items.where("parent_sub is not null").groupBy("doc_id", "parent", F.col("parent_sub").alias("key")).agg(last).where("not last.deleted")
    return found.select("doc_id", "parent", "key", "last.client", "last.clock", "last.value", "last.text")


def maps(items: DataFrame) -> DataFrame:
    """(doc_id, parent, n_keys, json): each map as a JSON object, keys in order."""
    own = F.array_sort(F.collect_list(F.struct("key", "value")))
    pairs = F.transform("own", lambda x: F.concat(text_json(x["key"]), F.lit(":"), F.coalesce(x["value"], F.lit("null"))))
    return entries(items).groupBy("doc_id", "parent").agg(own.alias("own")).select("doc_id", "parent", F.size("own").cast("long").alias("n_keys"), F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("json"))


_TYPE = ["doc_id", "parent"]


def _attributes_at(items: DataFrame) -> DataFrame:
    """(doc_id, parent, span, attributes): what format markers make of the text between them, for each stretch that any precede.

    ``items`` with ``span``, the number of markers before each. A marker sets
    its key from its place on; null ends it.
    """
    markers = items.where("content_type = 'format'").select(*_TYPE, F.col("fmt_key").alias("key"), "span", F.element_at("vals", 1).alias("value"))
    stretches = items.select(*_TYPE, "span").distinct()
    keys = markers.select(*_TYPE, "key").distinct()
    asked = stretches.join(keys, _TYPE).withColumn("asks", F.lit(True))
    order = Window.partitionBy(*_TYPE, "key").orderBy("span", F.col("asks").asc_nulls_first())
    both = markers.unionByName(asked, allowMissingColumns=True)
    held = F.last(F.when(F.col("asks").isNull(), F.struct("value")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    active = both.withColumn("held", held).where("asks and held.value is not null and held.value not in ('null', 'undefined')")
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.col("held.value").alias("value")))))
    return active.groupBy(*_TYPE, "span").agg(pairs.alias("attributes"))


def _spans(items: DataFrame) -> DataFrame:
    order = Window.partitionBy(*_TYPE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("span", F.sum((F.col("content_type") == "format").cast("long")).over(order))


def rich_text(items: DataFrame) -> DataFrame:
    """(doc_id, parent, step, insert, attributes): texts as inserts with the attributes that are active over them.

    ``attributes`` maps each key to its value as a JSON text, null where none
    is; neighbours of equal attributes are one insert. Embeds are inserts of
    their own, as JSON.
    """
    own = _spans(sequence(items).where("content_type in ('string', 'embed', 'format')"))
    own = materialize(own, "spans")
    shown = own.where("content_type != 'format'").join(_attributes_at(own), [*_TYPE, "span"], "left")
    order = Window.partitionBy(*_TYPE).orderBy("pos")
    kind = F.struct((F.col("content_type") == "embed").alias("embed"), F.coalesce(F.array_sort(F.map_entries("attributes")), F.array().cast("array<struct<key:string,value:string>>")).alias("a"))
    fresh = F.when((F.lag(kind).over(order) == kind) & (F.col("content_type") != "embed"), 0).otherwise(1)
    steps = shown.withColumn("step", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    said = steps.withColumn("said", F.when(F.col("content_type") == "embed", F.element_at("vals", 1)).otherwise(F.col("str")))
    return said.groupBy(*_TYPE, "step").agg(_joined("said").alias("insert"), F.any_value("attributes").alias("attributes"))


def changes(items: DataFrame, is_new: Column, was_deleted: Column) -> DataFrame:
    """The change of texts between two states as operations: (doc_id, parent, step, op, insert, n, attributes).

    ``is_new`` and ``was_deleted`` tell of an item what it was in the state
    before. What is new and live is inserted with its attributes, what was live
    and is not is deleted, what stays is retained with the attributes that
    changed over it, null for those that ended. A last retain without
    attributes is left out. Lengths are UTF-16 units.
    """
    rows = items.where("parent_sub is null and content_type in ('string', 'embed', 'format')").withColumn("_was", ~is_new & ~was_deleted).withColumn("_is", ~F.col("deleted"))
    now = materialize(_spans(rows.where("_is")), "now")
    before = materialize(_spans(rows.where("_was")), "before")
    at = [*_TYPE, "client", "clock"]
    marks = lambda df, name: df.where("content_type != 'format'").join(_attributes_at(df), [*_TYPE, "span"], "left").select(*at, F.col("attributes").alias(name))
    shown = rows.where("content_type != 'format' and (_is or _was)").join(marks(now, "now"), at, "left").join(marks(before, "before"), at, "left")
    empty = F.create_map().cast("map<string,string>")
    op = F.when(F.col("_is") & ~F.col("_was"), "insert").when(F.col("_was") & ~F.col("_is"), "delete").otherwise("retain")
    diff = attribute_changes(F.coalesce("now", empty), F.coalesce("before", empty))
    given = F.when(op == "insert", F.coalesce("now", empty)).when(op == "retain", diff).otherwise(empty)
    rows = shown.withColumn("op", op).withColumn("attributes", F.when(F.size(given) > 0, given))
    order = Window.partitionBy(*_TYPE).orderBy("pos")
    kind = F.struct("op", F.coalesce(F.array_sort(F.map_entries("attributes")), F.array().cast("array<struct<key:string,value:string>>")).alias("a"))
    rows = rows.withColumn("step", F.sum(F.when(F.lag(kind).over(order) == kind, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("said", F.when(F.col("content_type") == "embed", F.element_at("vals", 1)).otherwise(F.col("str")))
    steps = rows.groupBy(*_TYPE, "step").agg(F.first("op").alias("op"), _joined("said").alias("insert"), F.sum("len").alias("n"), F.any_value("attributes").alias("attributes"))
    last = F.max("step").over(Window.partitionBy(*_TYPE))
    steps = steps.withColumn("_last", last).where("not (step = _last and op = 'retain' and attributes is null)").drop("_last")
    return steps.withColumn("insert", F.when(F.col("op") == "insert", F.col("insert")))


def changed_types(items: DataFrame, is_new: Column, was_deleted: Column) -> DataFrame:
    """What observers of each type are told: (doc_id, parent, keys, n_inserted, n_deleted).

    ``keys`` are the map keys or attributes that changed, in order; the numbers
    are units of the sequence.
    """
    came, went = is_new & ~F.col("deleted"), ~is_new & F.col("deleted") & ~was_deleted
    touched = items.where(came | went | (is_new & F.col("parent_sub").isNotNull()))
    count = lambda what: F.coalesce(F.sum(F.when(what & F.col("parent_sub").isNull() & ~F.col("content_type").isin(*UNCOUNTED), F.col("len"))), F.lit(0)).cast("long")
    gone = went & F.col("parent_sub").isNull() & ~F.col("content_type").isin("format", "move")
    return touched.groupBy("doc_id", "parent").agg(F.array_sort(F.collect_set("parent_sub")).alias("keys"), count(came).alias("n_inserted"), F.coalesce(F.sum(F.when(gone, F.col("len"))), F.lit(0)).cast("long").alias("n_deleted"))


def containers(items: DataFrame) -> DataFrame:
    """(doc_id, type, above, path): each nested type with each type that holds it, itself included, and where it stands below: nested types joined to their containers.

    ``path`` is the places on the way from ``above``; an entry of a map has its
    key's place. Pointers double along the containers, so rounds grow with the
    logarithm of the deepest nesting.
    """
    held = items.where("content_type = 'type' and not deleted").select("doc_id", id_name(F.struct("client", "clock")).alias("type"), F.col("parent").alias("up"), F.array("pos").alias("path"))
    held = materialize(held, "held")
    known = held.select("doc_id", "type", F.col("type").alias("above"), F.array().cast("array<bigint>").alias("path"))
    roots = items.where("parent like '/%'").select("doc_id", F.col("parent").alias("type")).distinct()
    out = known.unionByName(roots.select("doc_id", "type", F.col("type").alias("above"), F.array().cast("array<bigint>").alias("path")))
    live = held
    for _ in range(64):
        if live.isEmpty():
            return out
        out = materialize(out.unionByName(live.select("doc_id", "type", F.col("up").alias("above"), "path")), "above")
        up = held.select("doc_id", F.col("type").alias("up"), F.col("up").alias("next"), F.col("path").alias("own"))
        live = materialize(live.join(up, ["doc_id", "up"]).select("doc_id", "type", F.col("next").alias("up"), F.concat("own", "path").alias("path")), "deeper")
    raise ValueError("types hold each other")


def deep_changes(changed: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, parent, n_types): for each type, how many types at or below it have changed: what deep observers are told."""
    below = containers(items).select("doc_id", F.col("type").alias("parent"), "above").distinct()
    return changed.join(below, ["doc_id", "parent"]).groupBy("doc_id", F.col("above").alias("parent")).agg(F.count_distinct("parent").alias("n_types"))


def xml(items: DataFrame, parent: str) -> DataFrame:
    """(doc_id, xml): what the fragment ``parent`` of each document holds, attributes by name, texts escaped, no tag self-closing.

    Every node writes its opening at its path from the fragment and its closing
    after all that begins with that path, so one sort joins a tree of any depth.
    """
    above = containers(items).where(F.col("above") == parent).select("doc_id", "type", "path")
    nodes = items.where("content_type = 'type' and not deleted").select("doc_id", id_name(F.struct("client", "clock")).alias("type"), "type_class", "node_name")
    nodes = materialize(nodes.join(above, ["doc_id", "type"]), "nodes")
    written = entries(items).where("text is not null").select("doc_id", F.col("parent").alias("type"), F.struct("key", F.concat(F.lit(" "), F.col("key"), F.lit('="'), xml_escape_attribute(F.col("text")), F.lit('"')).alias("said")).alias("a"))
    attributes = written.groupBy("doc_id", "type").agg(F.array_join(F.transform(F.array_sort(F.collect_list("a")), lambda x: x["said"]), "").alias("attributes"))
    tags = nodes.where(F.col("type_class") == ELEMENT).join(attributes, ["doc_id", "type"], "left")
    opened = tags.select("doc_id", "path", F.lit(0).alias("i"), F.concat(F.lit("<"), "node_name", F.coalesce("attributes", F.lit("")), F.lit(">")).alias("said"))
    closed = tags.select("doc_id", F.concat("path", F.array(F.lit(2**62))).alias("path"), F.lit(1).alias("i"), F.concat(F.lit("</"), "node_name", F.lit(">")).alias("said"))
    held = above.withColumnRenamed("type", "parent")
    said = sequence(items).where("content_type = 'string'").join(held, ["doc_id", "parent"]).select("doc_id", F.concat("path", F.array("pos")).alias("path"), F.lit(0).alias("i"), xml_escape_text(F.col("str")).alias("said"))
    parts = opened.unionByName(closed).unionByName(said)
    own = F.array_sort(F.collect_list(F.struct("path", "i", "said")))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(own, lambda x: x["said"]), "").alias("xml"))


def children(items: DataFrame) -> DataFrame:
    """(doc_id, parent, nth, kind, name, id): the live XML children of each type, keyed items excluded."""
    own = sequence(items).where("content_type in ('type', 'string')")
    nth = F.row_number().over(Window.partitionBy(*_TYPE).orderBy("pos")) - 1
    kind = F.when(F.col("content_type") == "string", "text").when(F.col("type_class") == XML_TEXT, "text").otherwise("element")
    return own.select(*_TYPE, nth.cast("long").alias("nth"), kind.alias("kind"), F.col("node_name").alias("name"), F.struct("client", "clock").alias("id"))


def attributes(items: DataFrame) -> DataFrame:
    """(doc_id, parent, attributes): the attributes of each element, those that are strings."""
    own = entries(items).where("value like '\"%'")
    return own.groupBy("doc_id", "parent").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "text")))).alias("attributes"))


def lengths(items: DataFrame) -> DataFrame:
    """(doc_id, parent, n): the countable units of each type's sequence; of XML its children."""
    own = sequence(items).where(~F.col("content_type").isin(*UNCOUNTED))
    return own.groupBy("doc_id", "parent").agg(F.sum("len").alias("n"))
