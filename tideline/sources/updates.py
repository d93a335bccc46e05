"""Binary updates read into rows: a small sequential reader inside Spark tasks, and the joins that complete its rows."""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.operators.order import AT_ONCE, each_short, origins_of
from tideline.plans.asof import as_of
from tideline.plans.scratch import materialize
from tideline.sources.wire import HAS_KEY, HAS_ORIGIN, HAS_RIGHT, STRUCT, TAGS

# Limits that a well-formed update keeps.
MOST_STRUCTS, MOST_BYTES, MOST_DEPTH, MOST_ELEMENTS = 1 << 20, 16 << 20, 100, 100_000
KINDS = {v: k for k, v in TAGS.items()}


class Reader:
    """Reads the primitives of the format; ValueError where the bytes don't hold one."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        at = self.at
        if at >= len(self.data):
            raise ValueError("unexpected end")
        self.at = at + 1
        return self.data[at]

    def uint(self) -> int:
        value = self.byte()
        if value < 128:
            return value
        value &= 127
        for i in range(1, 8):
            b = self.byte()
            value |= (b & 127) << (7 * i)
            if b < 128:
                return value
        raise ValueError("a number is too long")

    def signed(self) -> int:
        b = self.byte()
        value, negative, shift = b & 63, b & 64, 6
        while b & 128:
            if shift > 55:
                raise ValueError("a number is too long")
            b = self.byte()
            value |= (b & 127) << shift
            shift += 7
        return -value if negative else value

    def bytes(self) -> bytes:
        n = self.uint()
        if n > MOST_BYTES or self.at + n > len(self.data):
            raise ValueError("a byte string is too long")
        self.at += n
        return self.data[self.at - n : self.at]

    def text(self) -> str:
        return self.bytes().decode()

    def count(self, most: int = MOST_STRUCTS) -> int:
        n = self.uint()
        if n > most or n > len(self.data) - self.at:
            raise ValueError("a count is too high")
        return n

    def any(self, depth: int = 0):
        tag = self.byte()
        if depth > MOST_DEPTH:
            raise ValueError("a value is nested too deep")
        if tag == 119:
            return self.text()
        if tag in (126, 127):
            return None
        if tag in (120, 121):
            return tag == 120
        if tag == 125:
            return self.signed()
        if tag in (123, 124):
            wide = 8 if tag == 123 else 4
            raw = self.data[self.at : self.at + wide]
            if len(raw) < wide:
                raise ValueError("unexpected end")
            self.at += wide
            return struct.unpack("<d" if wide == 8 else "<f", raw)[0]
        if tag == 116:
            return {"$bytes": base64.b64encode(self.bytes()).decode()}
        if tag == 117:
            return [self.any(depth + 1) for _ in range(self.count(MOST_ELEMENTS))]
        if tag == 118:
            return {self.text(): self.any(depth + 1) for _ in range(self.count(MOST_ELEMENTS))}
        raise ValueError(f"unknown tag {tag}")

    def ident(self) -> dict:
        return {"client": self.uint(), "clock": self.uint()}


def read_structs(reader: Reader) -> Iterator[dict]:
    """The structs of an update in the row format; gaps of clocks give no row."""
    for _ in range(reader.count()):
        n, client, clock = reader.count(), reader.uint(), reader.uint()
        for _ in range(n):
            info = reader.byte()
            kind = KINDS.get(info & 31)
            row = {"client": client, "clock": clock, "content_type": kind, "len": 1}
            if kind == "skip" or info == 0:
                row["len"] = reader.uint()
            else:
                if info & HAS_ORIGIN:
                    row["origin"] = reader.ident()
                if info & HAS_RIGHT:
                    row["right_origin"] = reader.ident()
                if not info & (HAS_ORIGIN | HAS_RIGHT):
                    if reader.byte():
                        row["parent_name"] = reader.text()
                    else:
                        row["parent_id"] = reader.ident()
                if info & HAS_KEY:
                    row["parent_sub"] = reader.text()
                _content(kind, reader, row)
            clock += row["len"]
            if kind != "skip":
                yield row


def _content(kind: str | None, reader: Reader, row: dict) -> None:
    if kind == "deleted":
        row["len"] = reader.uint()
    elif kind in ("json", "any"):
        row["vals"] = [json.dumps(reader.any()) for _ in range(reader.count())]
        row["len"] = len(row["vals"])
    elif kind == "binary":
        row["bin"] = reader.bytes()
    elif kind == "string":
        row["str"] = reader.text()
        row["len"] = len(row["str"].encode("utf-16-le")) // 2
    elif kind == "embed":
        row["vals"] = [json.dumps(reader.any())]
    elif kind == "format":
        row["fmt_key"], value = reader.text(), reader.text()
        row["vals"] = ["null" if value == "undefined" else value]
    elif kind == "type":
        row["type_class"] = reader.byte()
        if row["type_class"] == 3:
            row["node_name"] = reader.text()
    elif kind == "doc":
        row["str"] = reader.text()
    elif kind == "move":
        row["move_target"], row["move_len"] = reader.ident(), reader.uint()
    else:
        raise ValueError("unknown content")


def read_ranges(reader: Reader) -> Iterator[dict]:
    """The ranges of a delete set."""
    for _ in range(reader.count()):
        client = reader.uint()
        for _ in range(reader.count()):
            yield {"client": client, "clock": reader.uint(), "len": reader.uint(), "content_type": "range"}


def _rows(data: bytes) -> list[dict]:
    reader = Reader(data)
    try:
        found = [*read_structs(reader), *read_ranges(reader)]
        if reader.at != len(data):
            raise ValueError("bytes are left over")
    except (ValueError, UnicodeDecodeError) as e:
        return [{"error": str(e)}]
    return found


def _arrow(fields: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(fields))


def decode_updates(updates: DataFrame, permissive: bool = True) -> DataFrame:
    """(doc_id, STRUCT columns, error): the structs and delete ranges (content_type ``range``) of ``updates(doc_id, update)``.

    A malformed update gives one row with its ``error`` and none of its
    content; with ``permissive`` false it fails the job. A null update gives no row.
    """
    fields = f"doc_id {updates.schema['doc_id'].dataType.simpleString()}, {STRUCT}, error string"
    schema = _arrow(fields)

    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [] if data is None else _rows(data)
                if not permissive and rows and "error" in rows[0]:
                    raise ValueError(rows[0]["error"])
                for at in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_pylist([{"doc_id": key, **r} for r in rows[at : at + 4096]], schema)

    return updates.select("doc_id", "update").mapInArrow(run, fields)


def decoded(blobs: DataFrame, column: str, fields: str, read) -> DataFrame:
    """(doc_id, ``fields``, error): the rows that ``read(reader)`` yields for each binary of ``column``.

    A malformed one gives one row with its ``error`` and none of its content, a
    null one no row. Bytes that are left over are an error.
    """
    whole = f"doc_id {blobs.schema['doc_id'].dataType.simpleString()}, {fields}, error string"
    schema = _arrow(whole)

    def rows_of(data: bytes) -> list[dict]:
        reader = Reader(data)
        try:
            found = list(read(reader))
            if reader.at != len(data):
                raise ValueError("bytes are left over")
        except (ValueError, UnicodeDecodeError) as e:
            return [{"error": str(e)}]
        return found

    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [] if data is None else rows_of(data)
                for at in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_pylist([{"doc_id": key, **r} for r in rows[at : at + 4096]], schema)

    return blobs.select("doc_id", column).mapInArrow(run, whole)


def read_vector(reader: Reader) -> Iterator[dict]:
    for _ in range(reader.count()):
        yield {"client": reader.uint(), "next_clock": reader.uint()}


def decode_state_vectors(vectors: DataFrame) -> DataFrame:
    """(doc_id, client, next_clock, error) of ``vectors(doc_id, sv)``; a malformed one gives one row with its error."""
    return decoded(vectors, "sv", "client long, next_clock long", read_vector)


def decode_delete_sets(sets: DataFrame) -> DataFrame:
    """(doc_id, client, clock, len, error) of ``sets(doc_id, ds)``."""
    return decoded(sets, "ds", "client long, clock long, len long", lambda r: ({k: x[k] for k in ("client", "clock", "len")} for x in read_ranges(r)))


def resolve_parents(structs: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """``structs`` with parent and key filled in from the origin where an update leaves them out.

    A struct without a parent has that of its origin, or of its right origin.
    In documents of up to ``at_once`` runs the chains are followed in a task,
    short documents together; in longer ones by joins.
    """
    structs = structs if hasattr(structs, "scratch_path") else materialize(structs, "structs")
    schema = to_arrow_schema(structs.schema)

    def fill(table: pa.Table, sequence: np.ndarray) -> pa.Table:
        client, clock, length = (table.column(c).to_numpy() for c in ("client", "clock", "len"))
        one = lambda c: table.column(c).combine_chunks() if isinstance(table.column(c), pa.ChunkedArray) else table.column(c)
        part = lambda c, field: pc.if_else(one(c).is_valid(), pc.struct_field(one(c), field), None)
        own = pc.or_(one("parent_name").is_valid(), one("parent_id").is_valid())
        up_client, up_clock = (pc.if_else(own, None, pc.if_else(one("origin").is_valid(), part("origin", f), part("right_origin", f))) for f in ("client", "clock"))
        up = origins_of(sequence, client, clock, clock + length, up_client, up_clock, inside=True)
        root = np.where(up >= 0, up, np.arange(len(up)))
        for _ in range(64):
            further = root[root]
            if (further == root).all():
                break
            root = further
        out = table
        for c in ("parent_name", "parent_id", "parent_sub"):
            at = np.where(one(c).is_valid().to_numpy(zero_copy_only=False), np.arange(len(up)), root)
            out = out.set_column(out.schema.get_field_index(c), c, one(c).take(pa.array(at)))
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(out.columns, schema)], schema=schema)

    found, rest = each_short(structs, ["doc_id"], at_once, fill, structs.schema)
    return found if rest is None else found.unionByName(_parents_by_joins(rest))


def _parents_by_joins(structs: DataFrame) -> DataFrame:
    """The same without any document in one task.

    The run that holds the origin comes by an as-of join; pointers then double
    along the chains, so the joins grow with the logarithm of the longest one.
    """
    keys = ["doc_id", "client", "clock"]
    at = structs.withColumn("up", F.when(F.col("parent_name").isNull() & F.col("parent_id").isNull(), F.coalesce("origin", "right_origin")))
    asked = at.where("up is not null").select("doc_id", F.col("client").alias("own_client"), F.col("clock").alias("own_clock"), F.col("up.client").alias("client"), F.col("up.clock").alias("clock"))
    runs = structs.select("doc_id", "client", F.col("clock").alias("run_clock"), "len")
    found = as_of(asked, runs, ["doc_id", "client"], "clock", "run_clock", "run").where("clock < run.run_clock + run.len")
    links = found.select("doc_id", F.struct(F.col("own_client").alias("client"), F.col("own_clock").alias("clock")).alias("id"), F.struct("client", F.col("run.run_clock").alias("clock")).alias("up"))
    links = materialize(links, "links")
    for _ in range(64):
        ahead = links.select("doc_id", F.col("id").alias("up"), F.col("up").alias("next"))
        joined = materialize(links.join(ahead, ["doc_id", "up"], "left"), "links")
        links = joined.select("doc_id", "id", F.coalesce("next", "up").alias("up"))
        if joined.where("next is not null").isEmpty():
            break
    given = structs.select("doc_id", F.struct("client", "clock").alias("up"), F.struct("parent_name", "parent_id", "parent_sub").alias("given"))
    heirs = links.join(given, ["doc_id", "up"]).select("doc_id", F.col("id.client").alias("client"), F.col("id.clock").alias("clock"), "given")
    filled = {c: F.coalesce(F.col(c), F.col(f"given.{c}")) for c in ("parent_name", "parent_id", "parent_sub")}
    return structs.join(heirs, keys, "left").withColumns(filled).drop("given")
