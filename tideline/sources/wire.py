"""Binary updates written by Spark: varints, state vectors, delete sets, structs and whole updates as column expressions.

A blob is the concatenation of its rows' bytes in order, so each row is coded
where it lies and only the joined bytes of one document meet in one place.
"""

from __future__ import annotations

import base64
import json
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tideline.operators.order import AT_ONCE
from tideline.operators.state import compact_ranges, state_vector
from tideline.sources.written import Struct, by_client, count, each_document, given, sized, tagged

#: Columns of a struct: a run of units as an update holds it. Values of vals are JSON texts.
STRUCT = (
    "client long, clock long, len long, origin struct<client:long,clock:long>, right_origin struct<client:long,clock:long>, "
    "parent_name string, parent_id struct<client:long,clock:long>, parent_sub string, content_type string, str string, bin binary, "
    "vals array<string>, fmt_key string, type_class int, node_name string, move_target struct<client:long,clock:long>, move_len long"
)
#: Content tags of the format.
TAGS = {"gc": 0, "deleted": 1, "json": 2, "binary": 3, "string": 4, "embed": 5, "format": 6, "type": 7, "any": 8, "doc": 9, "skip": 10, "move": 11}
HAS_ORIGIN, HAS_RIGHT, HAS_KEY = 0x80, 0x40, 0x20


def no_bytes() -> Column:
    return F.lit(b"")



def var_uint(value: Column) -> Column:
    """Seven bits a byte, lowest first, the high bit set on all but the last."""
    return F.when(value < 128, F.unhex(F.lpad(F.hex(value), 2, "0"))).otherwise(_var_uint(value))


def _var_uint(value: Column) -> Column:
    last = F.floor((F.length(F.bin(value)) - 1) / 7).cast("int")

    def digit(i: Column) -> Column:
        seven = F.call_function("shiftright", value, i * 7).bitwiseAND(F.lit(127).cast("long"))
        return F.lpad(F.hex(seven + F.when(i < last, 128).otherwise(0)), 2, "0")

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), last), digit), ""))


def var_int(value: Column) -> Column:
    """Sign and magnitude: six bits with the sign in the first byte, then seven a byte."""
    size = F.abs(value)
    first = size.bitwiseAND(F.lit(63).cast("long")) + F.when(value < 0, 64).otherwise(0) + F.when(F.shiftright(size, 6) > 0, 128).otherwise(0)
    rest = F.when(F.shiftright(size, 6) > 0, var_uint(F.shiftright(size, 6))).otherwise(no_bytes())
    return F.concat(F.unhex(F.lpad(F.hex(first), 2, "0")), rest)


def var_bytes(data: Column) -> Column:
    return F.concat(var_uint(F.octet_length(data).cast("long")), data)


def var_string(text: Column) -> Column:
    return var_bytes(F.encode(text, "UTF-8"))


def byte(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2, "0"))


def joined(rows: Column) -> Column:
    """The bytes of an array of binaries, one after the other."""
    return F.unhex(F.array_join(F.transform(rows, F.hex), ""))


def write_any(value, out: bytearray) -> None:
    """One tagged value; map keys in order. A map with the one key $bytes is a base64 byte string."""
    if value is None:
        out.append(126)
    elif value is True or value is False:
        out.append(120 if value else 121)
    elif isinstance(value, int):
        size, sign = abs(value), 64 if value < 0 else 0
        if size >= 1 << 55:
            raise ValueError("the integer needs more than 55 bits")
        out += bytes([125, sign | size & 63 | (128 if size > 63 else 0)])
        size >>= 6
        while size:
            out.append(size & 127 | (128 if size > 127 else 0))
            size >>= 7
    elif isinstance(value, float):
        out += b"\x7b" + struct.pack("<d", value)
    elif isinstance(value, str):
        out.append(119)
        sized(value.encode(), out)
    elif isinstance(value, dict) and set(value) == {"$bytes"}:
        out.append(116)
        sized(base64.b64decode(value["$bytes"]), out)
    elif isinstance(value, dict):
        out.append(118)
        count(len(value), out)
        for k in sorted(value):
            sized(k.encode(), out)
            write_any(value[k], out)
    else:
        out.append(117)
        count(len(value), out)
        for v in value:
            write_any(v, out)


@F.pandas_udf(BinaryType())
def any_values(vals: pd.Series) -> pd.Series:
    """The tagged bytes of JSON texts, one after the other."""

    def one(texts):
        out = bytearray()
        for text in [] if texts is None else texts:
            write_any(None if text == "undefined" else json.loads(text), out)
        return bytes(out)

    return vals.map(one)


def struct_bytes(columns: dict[str, Column] | None = None) -> Column:
    """A row of STRUCT as bytes: info byte, origins, parent if there is no origin, key, content."""
    c = lambda name: (columns or {}).get(name, F.col(name))
    kind = c("content_type")
    tag = F.element_at(F.create_map(*[F.lit(x) for k, v in TAGS.items() for x in (k, v)]), kind)
    plain = kind == "gc"
    has = lambda name: c(name).isNotNull() & ~plain
    flag = lambda condition, bit: F.when(condition, bit).otherwise(0)
    info = tag + flag(has("origin"), HAS_ORIGIN) + flag(has("right_origin"), HAS_RIGHT) + flag(has("parent_sub"), HAS_KEY)
    ident = lambda name: F.concat(var_uint(c(name)["client"]), var_uint(c(name)["clock"]))
    optional = lambda condition, data: F.when(condition, data).otherwise(no_bytes())
    named = F.concat(byte(F.lit(1)), var_string(F.coalesce(c("parent_name"), F.lit(""))))
    parent = F.when(c("parent_id").isNotNull(), F.concat(byte(F.lit(0)), ident("parent_id"))).otherwise(named)
    values = any_values(c("vals"))
    content = (
        F.when(kind.isin("gc", "deleted"), var_uint(c("len")))
        .when(kind == "string", var_string(c("str")))
        .when(kind.isin("json", "any"), F.concat(var_uint(F.size(c("vals")).cast("long")), values))
        .when(kind == "binary", var_bytes(c("bin")))
        .when(kind == "embed", values)
        .when(kind == "format", F.concat(var_string(c("fmt_key")), var_string(F.element_at(c("vals"), 1))))
        .when(kind == "type", F.concat(byte(c("type_class")), optional(c("type_class") == 3, var_string(c("node_name")))))
        .when(kind == "doc", var_string(c("str")))
        .when(kind == "move", F.concat(ident("move_target"), var_uint(c("move_len"))))
    )
    return F.concat(byte(info), optional(has("origin"), ident("origin")), optional(has("right_origin"), ident("right_origin")), optional(~plain & c("origin").isNull() & c("right_origin").isNull(), parent), optional(has("parent_sub"), var_string(c("parent_sub"))), content)


def encode_state_vectors(vectors: DataFrame) -> DataFrame:
    """(doc_id, sv): ``vectors(doc_id, client, next_clock)`` as bytes, clients ascending."""
    own = F.array_sort(F.collect_list(F.struct("client", F.concat(var_uint(F.col("client")), var_uint(F.col("next_clock"))).alias("bytes"))))
    return vectors.groupBy("doc_id").agg(own.alias("own")).select("doc_id", F.concat(var_uint(F.size("own").cast("long")), joined(F.col("own.bytes"))).alias("sv"))


def encode_delete_sets(ranges: DataFrame) -> DataFrame:
    """(doc_id, ds): compact ``ranges(doc_id, client, clock, len)`` as bytes, clients and clocks ascending."""
    each = F.array_sort(F.collect_list(F.struct("clock", F.concat(var_uint(F.col("clock")), var_uint(F.col("len"))).alias("bytes"))))
    clients = ranges.groupBy("doc_id", "client").agg(each.alias("own"))
    part = F.concat(var_uint(F.col("client")), var_uint(F.size("own").cast("long")), joined(F.col("own.bytes")))
    own = F.array_sort(F.collect_list(F.struct("client", part.alias("bytes"))))
    return clients.groupBy("doc_id").agg(own.alias("own")).select("doc_id", F.concat(var_uint(F.size("own").cast("long")), joined(F.col("own.bytes"))).alias("ds"))


def _write_struct(s: Struct, out: bytearray) -> None:
    """What struct_bytes makes of a row."""
    kind = s.content_type
    plain = kind == "gc"
    if kind not in TAGS or kind == "skip":
        raise ValueError(f"unknown content {kind}")
    origin, right, sub = (None, None, None) if plain else (s.origin, s.right_origin, s.parent_sub)
    out.append(TAGS[kind] | (HAS_ORIGIN if origin else 0) | (HAS_RIGHT if right else 0) | (0 if sub is None else HAS_KEY))
    for ident in (origin, right):
        if ident:
            count(ident[0], out)
            count(ident[1], out)
    if not (plain or origin or right):
        if s.parent_id:
            out.append(0)
            count(s.parent_id[0], out)
            count(s.parent_id[1], out)
        else:
            out.append(1)
            sized((s.parent_name or "").encode(), out)
    if sub is not None:
        sized(sub.encode(), out)
    if kind in ("gc", "deleted"):
        count(s.len, out)
    elif kind in ("string", "doc"):
        sized(given(s.str).encode(), out)
    elif kind in ("json", "any"):
        count(len(given(s.vals)), out)
        tagged(s.vals, out)
    elif kind == "binary":
        sized(given(s.bin), out)
    elif kind == "embed":
        tagged(s.vals, out)
    elif kind == "format":
        sized(given(s.fmt_key).encode(), out)
        sized(given(given(s.vals)[0]).encode(), out)
    elif kind == "type":
        out.append(given(s.type_class))
        if s.type_class == 3:
            sized(given(s.node_name).encode(), out)
    else:
        for n in (*given(s.move_target), given(s.move_len)):
            count(n, out)


def _write_update(structs: list[Struct], ranges: list[tuple]) -> bytes:
    clients = by_client(structs)
    out = bytearray()
    count(len(clients), out)
    for client, rows in clients:
        body, n, upto = bytearray(), len(rows), rows[0].clock
        for s in rows:
            if s.clock > upto:
                n += 1
                body.append(TAGS["skip"])
                count(s.clock - upto, body)
            _write_struct(s, body)
            upto = s.clock + s.len
        for x in (n, client, rows[0].clock):
            count(x, out)
        out += body
    gone = by_client(ranges)
    count(len(gone), out)
    for client, own in gone:
        count(client, out)
        count(len(own), out)
        for _, clock, length in own:
            count(clock, out)
            count(length, out)
    return bytes(out)


def encode_updates(structs: DataFrame, ranges: DataFrame | str, at_once: int = AT_ONCE) -> DataFrame:
    """(doc_id, update): each document's structs and delete set as one update in the row format.

    Structs of a client stand by clock, clients ascending. A gap of clocks
    becomes a skip struct, so parked runs keep their clocks. Documents of up to
    ``at_once`` structs and ranges are each written in a task, short ones
    together; longer ones by windows. ``ranges`` may name a column of ``structs``
    instead: those where it holds are deleted.
    """
    found, rest = each_document(structs, ranges, STRUCT, lambda own, gone: [_write_update(own, gone)], at_once)
    return found if rest is None else found.unionByName(_updates_by_windows(*rest))


def _updates_by_windows(structs: DataFrame, ranges: DataFrame) -> DataFrame:
    """The same, each struct coded where it lies."""
    order = Window.partitionBy("doc_id", "client").orderBy("clock")
    gap = F.col("clock") - F.lag(F.col("clock") + F.col("len")).over(order)
    skip = F.when(gap > 0, F.concat(byte(F.lit(TAGS["skip"])), var_uint(gap))).otherwise(no_bytes())
    coded = structs.withColumn("n", F.when(gap > 0, 2).otherwise(1)).withColumn("bytes", F.concat(skip, struct_bytes()))
    each = F.array_sort(F.collect_list(F.struct("clock", "bytes")))
    clients = coded.groupBy("doc_id", "client").agg(each.alias("own"), F.sum("n").cast("long").alias("n"))
    part = F.concat(var_uint(F.col("n")), var_uint(F.col("client")), var_uint(F.col("own")[0]["clock"]), joined(F.col("own.bytes")))
    own = F.array_sort(F.collect_list(F.struct("client", part.alias("bytes"))))
    docs = clients.groupBy("doc_id").agg(own.alias("own")).select("doc_id", F.concat(var_uint(F.size("own").cast("long")), joined(F.col("own.bytes"))).alias("structs"))
    both = docs.join(encode_delete_sets(compact_ranges(ranges)), "doc_id", "full")
    none = F.lit(b"\0")
    return both.select("doc_id", F.concat(F.coalesce("structs", none), F.coalesce("ds", none)).alias("update"))


#: Structs or ranges of one update at most, well below what a reader takes.
PART = 1 << 18


def encode_in_parts(structs: DataFrame, ranges: DataFrame | str, most: int = PART, at_once: int = AT_ONCE) -> DataFrame:
    """(doc_id, update): each document as one update or, where it has more than ``most`` structs or ranges, several; readers merge them in any order."""

    def write(own: list[Struct], gone: list[tuple]) -> list[bytes]:
        return [_write_update(own[at : at + most], gone[at : at + most]) for at in range(0, max(len(own), len(gone)), most)]

    def parts(rows: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("client", "clock")) - 1
        return rows.withColumn("_part", F.floor(nth / most)).withColumn("doc_id", F.struct("doc_id", "_part")).drop("_part")

    found, rest = each_document(structs, ranges, STRUCT, write, at_once)
    if rest is None:
        return found
    whole = _updates_by_windows(parts(rest[0]), parts(compact_ranges(rest[1])))
    return found.unionByName(whole.select("doc_id.doc_id", "update"))


def encode_snapshots(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, snapshot): state vector and delete set, each with its length before it."""
    vectors = encode_state_vectors(state_vector(log))
    both = vectors.join(encode_delete_sets(compact_ranges(ranges)), "doc_id", "left")
    return both.select("doc_id", F.concat(var_bytes(F.col("sv")), var_bytes(F.coalesce("ds", F.lit(b"\0")))).alias("snapshot"))


def sync_message(kind: int, payload: Column) -> Column:
    """Protocol message: 0 a state vector that asks for what is missing, 1 the reply to it, 2 an update."""
    return F.concat(var_uint(F.lit(kind).cast("long")), var_bytes(payload))


def sync_frame(message: Column) -> Column:
    """A sync message on its channel."""
    return F.concat(byte(F.lit(0)), message)


def presence_frame(update: Column) -> Column:
    """A presence update on its channel."""
    return F.concat(byte(F.lit(1)), var_bytes(update))


def encode_presence(states: DataFrame) -> DataFrame:
    """(doc_id, update): ``states(doc_id, client, clock, state)`` as one presence update, clients ascending; no state is the text null."""
    one = F.concat(var_uint(F.col("client")), var_uint(F.col("clock")), var_string(F.coalesce("state", F.lit("null"))))
    own = F.array_sort(F.collect_list(F.struct("client", one.alias("bytes"))))
    return states.groupBy("doc_id").agg(own.alias("own")).select("doc_id", F.concat(var_uint(F.size("own").cast("long")), joined(F.col("own.bytes"))).alias("update"))


def encode_relative_position(client: Column, clock: Column, name: Column, assoc: Column) -> Column:
    """An item's id, or the name of a root type for its end, and the side."""
    item = F.concat(var_uint(F.lit(1).cast("long")), var_uint(client), var_uint(clock))
    return F.concat(F.when(client.isNotNull(), item).otherwise(F.concat(var_uint(F.lit(2).cast("long")), var_string(name))), var_int(assoc.cast("long")))
