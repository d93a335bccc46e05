"""Values of shared types: texts, lists, maps, rich text and XML, from items in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import utf16_length, xml_escape_attribute, xml_escape_text


def text_value(items: DataFrame, order: list[Column], separator: str = "") -> DataFrame:
    """(doc_id, text, n): the live contents of ``items(doc_id, content, deleted)`` joined in ``order``, and how many they are."""
    live = items.withColumn("at", F.struct(*order)).where("not deleted")
    own = F.array_sort(F.collect_list(F.struct("at", F.coalesce("content", F.lit("")).alias("content"))))
    return live.groupBy("doc_id").agg(own.alias("own")).select("doc_id", F.array_join(F.transform("own", lambda x: x["content"]), separator).alias("text"), F.size("own").cast("long").alias("n"))


def list_value(items: DataFrame, order: list[Column]) -> DataFrame:
    """(doc_id, items): the live contents as an array in ``order``."""
    live = items.withColumn("at", F.struct(*order)).where("not deleted")
    own = F.array_sort(F.collect_list(F.struct("at", "content")))
    return live.groupBy("doc_id").agg(F.transform(own, lambda x: x["content"]).alias("items"))


def list_elements(items: DataFrame, order: list[Column]) -> DataFrame:
    """``items`` that are live, with ``pos``, their rendered place from 0 on."""
    place = Window.partitionBy("doc_id").orderBy(*order)
    return items.where("not deleted").withColumn("pos", (F.row_number().over(place) - 1).cast("long"))


def list_slice(items: DataFrame, order: list[Column], start: int, end: int) -> DataFrame:
    """Live items with start <= pos < end; the end is clamped to the list's."""
    return list_elements(items, order).where((F.col("pos") >= start) & (F.col("pos") < end))


def map_value(log: DataFrame) -> DataFrame:
    """The last write of each key of ``log(doc_id, key, client, clock, deletes, ...)``; a key whose last write deletes is gone.

    Writes of one key are ordered by clock, then client.
    """
    last = F.max_by(F.struct("client", "clock", "value", "deletes"), F.struct("clock", "client")).alias("last")
    return log.groupBy("doc_id", "key").agg(last).where("not last.deletes").select("doc_id", "key", "last.client", "last.clock", "last.value")


def map_entries(log: DataFrame) -> DataFrame:
    """(doc_id, n_keys, json): each document's map, keys in order."""
    own = F.array_sort(F.collect_list(F.struct("key", "value")))
    pairs = map_value(log).groupBy("doc_id").agg(own.alias("own"))
    return pairs.select("doc_id", F.size("own").cast("long").alias("n_keys"), F.to_json(F.map_from_entries("own")).alias("json"))


def list_move(items: DataFrame, moves: DataFrame, order: list[Column]) -> DataFrame:
    """``items`` with ``pos`` after ``moves(doc_id, target_client, target_clock, client, clock, to_rank)``.

    Of several moves of an item the one of the lowest client counts, then of
    the lowest clock. A moved item leaves its place and stands by ``to_rank``
    among the original places, before the item that was there.
    """
    first = moves.groupBy("doc_id", "target_client", "target_clock").agg(F.min_by("to_rank", F.struct("client", "clock")).alias("to_rank"))
    first = first.withColumnsRenamed({"target_client": "client", "target_clock": "clock"})
    ranked = list_elements(items, order).withColumnRenamed("pos", "rank").join(first, ["doc_id", "client", "clock"], "left")
    place = Window.partitionBy("doc_id").orderBy(F.coalesce("to_rank", "rank"), F.col("to_rank").isNull(), "rank")
    return ranked.withColumn("pos", (F.row_number().over(place) - 1).cast("long"))


def attribute_runs(items: DataFrame, order: list[Column]) -> DataFrame:
    """Runs of text with the value of a format attribute that is active over them.

    ``items(doc_id, content, is_marker, attribute)``: a marker sets the attribute
    from its place on, null ends it. Returns (doc_id, run, text, attribute), one
    row for each stretch between markers that has text.
    """
    place = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = items.withColumn("run", F.sum(F.col("is_marker").cast("long")).over(place)).withColumn("at", F.struct(*order))
    own = F.array_sort(F.collect_list(F.when(~F.col("is_marker"), F.struct("at", "content"))))
    merged = runs.groupBy("doc_id", "run").agg(F.max(F.when(F.col("is_marker"), F.col("attribute"))).alias("attribute"), own.alias("own")).where(F.size("own") > 0)
    return merged.select("doc_id", "run", F.array_join(F.transform("own", lambda x: x["content"]), "").alias("text"), "attribute")


def text_delta(items: DataFrame, order: list[Column], is_new: Column, was_deleted: Column) -> DataFrame:
    """The change of a text between two states, as operations in order: (doc_id, step, op, insert, n).

    An item that is new and live is inserted, one deleted between the states is
    deleted, one live in both is retained; neighbours of one kind are one
    operation. Lengths are UTF-16 units. A last retain is left out.
    """
    kind = F.when(is_new & ~F.col("deleted"), "insert").when(~is_new & F.col("deleted") & ~was_deleted, "delete").when(~is_new & ~F.col("deleted"), "retain")
    rows = items.withColumn("op", kind).where("op is not null").withColumn("at", F.struct(*order))
    place = Window.partitionBy("doc_id").orderBy("at")
    rows = rows.withColumn("starts", F.when(F.lag("op").over(place) == F.col("op"), 0).otherwise(1))
    rows = rows.withColumn("step", F.sum("starts").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.array_sort(F.collect_list(F.struct("at", "content")))
    steps = rows.groupBy("doc_id", "step").agg(F.first("op").alias("op"), F.sum(utf16_length(F.col("content"))).alias("n"), own.alias("own"))
    steps = steps.withColumn("insert", F.when(F.col("op") == "insert", F.array_join(F.transform("own", lambda x: x["content"]), ""))).drop("own")
    last = F.max("step").over(Window.partitionBy("doc_id"))
    return steps.withColumn("last", last).where("not (step = last and op = 'retain')").select("doc_id", "step", "op", "insert", "n")


def xml_element(name: str, attributes: dict[str, Column], children: Column) -> Column:
    """``<name a="..">children</name>``, attributes in order of name and left out where null; never self-closing."""
    written = [F.when(v.isNotNull(), F.concat(F.lit(f' {k}="'), xml_escape_attribute(v.cast("string")), F.lit('"'))).otherwise("") for k, v in sorted(attributes.items())]
    return F.concat(F.lit(f"<{name}"), *written, F.lit(">"), F.coalesce(children, F.lit("")), F.lit(f"</{name}>"))


def xml_children(rows: DataFrame, parent: str, order: list[str], xml: str = "xml") -> DataFrame:
    """(parent, children): the XML of each parent's children, joined in ``order``; one level of the tree at a time, leaves first."""
    own = F.array_sort(F.collect_list(F.struct(*order, xml)))
    return rows.groupBy(parent).agg(F.array_join(F.transform(own, lambda x: x[xml]), "").alias("children"))


def xml_text(content: Column) -> Column:
    return xml_escape_text(F.coalesce(content, F.lit("")))
