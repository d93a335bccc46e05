"""The columnar update format: nine run-length coded columns and a rest, written document by document in tasks, long documents by windows over their values."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.order import AT_ONCE
from tideline.operators.state import compact_ranges
from tideline.sources.updates import KINDS, MOST_STRUCTS, Reader, _arrow
from tideline.sources.wire import HAS_KEY, HAS_ORIGIN, HAS_RIGHT, STRUCT, TAGS, any_values, byte, joined, no_bytes, var_bytes, var_int, var_string, var_uint
from tideline.sources.written import Struct, by_client, count, each_document, given, signed, sized, tagged

#: Columns in their order on the wire, and how each is coded.
COLUMNS = {"key": "diff", "client": "run", "left": "diff", "right": "diff", "info": "byte", "string": "text", "parent": "byte", "type": "run", "len": "run"}


def negative_zero_int(value: Column) -> Column:
    """Sign and magnitude with the sign set, for 0 as well."""
    first = F.lit(64) + value.bitwiseAND(F.lit(63).cast("long")) + F.when(F.shiftright(value, 6) > 0, 128).otherwise(0)
    return F.concat(byte(first), F.when(F.shiftright(value, 6) > 0, var_uint(F.shiftright(value, 6))).otherwise(no_bytes()))


def _emissions() -> Column:
    """What a row of STRUCT writes, in order: an array of (column, number, text, bytes)."""
    kind, long = F.col("content_type"), F.lit(None).cast("long")
    part = lambda column, number=None, text=None, raw=None: F.struct(
        F.lit(column).alias("column"), (long if number is None else number.cast("long")).alias("number"), (F.lit(None).cast("string") if text is None else text).alias("text"), (F.lit(None).cast("binary") if raw is None else raw).alias("raw")
    )
    none = F.array().cast("array<struct<column:string,number:bigint,text:string,raw:binary>>")
    when = lambda condition, *parts: F.when(condition, F.array(*parts)).otherwise(none)
    bare = kind == "gc"
    has = lambda name: F.col(name).isNotNull() & ~bare
    free = ~bare & F.col("origin").isNull() & F.col("right_origin").isNull()
    flag = lambda condition, bit: F.when(condition, bit).otherwise(0)
    tag = F.element_at(F.create_map(*[F.lit(x) for k, v in TAGS.items() for x in (k, v)]), kind)
    info = tag + flag(has("origin"), HAS_ORIGIN) + flag(has("right_origin"), HAS_RIGHT) + flag(free & has("parent_sub"), HAS_KEY)
    values = any_values(F.col("vals"))
    count = F.size("vals").cast("long")
    move = F.concat(var_uint(F.col("move_target.client")), var_uint(F.col("move_target.clock")), var_uint(F.col("move_len")))
    return F.concat(
        when(F.col("gap") > 0, part("info", F.lit(TAGS["skip"])), part("rest", raw=var_uint(F.col("gap")))),
        F.array(part("info", info)),
        when(has("origin"), part("client", F.col("origin.client")), part("left", F.col("origin.clock"))),
        when(has("right_origin"), part("client", F.col("right_origin.client")), part("right", F.col("right_origin.clock"))),
        when(free & F.col("parent_id").isNotNull(), part("parent", F.lit(0)), part("client", F.col("parent_id.client")), part("left", F.col("parent_id.clock"))),
        when(free & F.col("parent_id").isNull(), part("parent", F.lit(1)), part("string", text=F.coalesce("parent_name", F.lit("")))),
        when(free & has("parent_sub"), part("string", text=F.col("parent_sub"))),
        when(kind.isin("gc", "deleted"), part("len", F.col("len"))),
        when(kind.isin("json", "any"), part("len", count)),
        F.when(kind == "json", F.transform("vals", lambda v: part("string", text=v))).otherwise(none),
        when(kind.isin("any", "embed"), part("rest", raw=values)),
        when(kind == "binary", part("rest", raw=var_bytes(F.col("bin")))),
        when(kind.isin("string", "doc"), part("string", text=F.col("str"))),
        when(kind == "doc", part("rest", raw=F.lit(b"\x7e"))),
        when(kind == "format", part("key", text=F.col("fmt_key")), part("rest", raw=values)),
        when(kind == "type", part("type", F.col("type_class"))),
        when((kind == "type") & (F.col("type_class") == 3), part("key", text=F.col("node_name"))),
        when(kind == "move", part("rest", raw=move)),
    )


def _numbered_keys(rows: DataFrame) -> DataFrame:
    """Keys by number: the first time a key is written it takes the next number, and its text goes to the strings."""
    order = Window.partitionBy("doc_id").orderBy("at")
    keys = rows.where("column = 'key'").withColumn("first", F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("at")) == 1)
    keys = keys.withColumn("nth", F.sum(F.col("first").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    keys = keys.withColumn("number", F.min("nth").over(Window.partitionBy("doc_id", "text"))).drop("nth")
    texts = keys.where("first").withColumns({"column": F.lit("string"), "number": F.lit(None).cast("long")})
    return rows.where("column != 'key'").unionByName(keys.drop("first")).unionByName(texts.drop("first"))


def _runs(rows: DataFrame) -> DataFrame:
    """(doc_id, column, data): the numbers of each column, run-length coded in its way."""
    order = Window.partitionBy("doc_id", "column").orderBy("at")
    diff = F.col("column").isin([c for c, how in COLUMNS.items() if how == "diff"])
    rows = rows.withColumn("value", F.when(diff, F.col("number") - F.coalesce(F.lag("number").over(order), F.lit(0))).otherwise(F.col("number")))
    starts = F.when(F.lag("value").over(order) == F.col("value"), 0).otherwise(1)
    rows = rows.withColumn("run", F.sum(starts).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Differences are coded from 0, so a first difference is a run like any other.
    runs = rows.groupBy("doc_id", "column", "run").agg(F.first("value").alias("value"), F.count("*").alias("n"))
    last = F.max("run").over(Window.partitionBy("doc_id", "column")) == F.col("run")
    many, rest = F.col("n") > 1, F.when(F.col("n") > 1, var_uint(F.col("n") - 2)).otherwise(no_bytes())
    coded = (
        F.when(diff, F.concat(var_int(F.col("value") * 2 + F.when(many, 1).otherwise(0)), rest))
        .when(F.col("column").isin("info", "parent"), F.concat(byte(F.col("value")), F.when(last, no_bytes()).otherwise(var_uint(F.col("n") - 1))))
        .otherwise(F.concat(F.when(many, negative_zero_int(F.col("value"))).otherwise(var_int(F.col("value"))), rest))
    )
    own = F.array_sort(F.collect_list(F.struct("run", "data")))
    return runs.withColumn("data", coded).groupBy("doc_id", "column").agg(own.alias("own")).select("doc_id", "column", joined(F.col("own.data")).alias("data"))


class _Writer:
    """The columns of one update as they are written, and its rest."""

    def __init__(self):
        self.numbers: dict[str, list[int]] = {c: [] for c in COLUMNS}
        self.texts, self.keys, self.rest = [], {}, bytearray()

    def ident(self, ident: tuple[int, int], clock: str) -> None:
        self.numbers["client"].append(ident[0])
        self.numbers[clock].append(ident[1])

    def text(self, text: str) -> None:
        self.texts.append(given(text))
        self.numbers["string"].append(len(text) if text.isascii() else len(text.encode("utf-16-le")) // 2)

    def key(self, text: str) -> None:
        fresh = given(text) not in self.keys
        self.numbers["key"].append(self.keys.setdefault(text, len(self.keys)))
        if fresh:
            self.text(text)

    def struct(self, s: Struct) -> None:
        """What _emissions makes of a row."""
        numbers, kind = self.numbers, s.content_type
        plain = kind == "gc"
        if kind not in TAGS or kind == "skip":
            raise ValueError(f"unknown content {kind}")
        origin, right = (None, None) if plain else (s.origin, s.right_origin)
        free = not (plain or origin or right)
        numbers["info"].append(TAGS[kind] | (HAS_ORIGIN if origin else 0) | (HAS_RIGHT if right else 0) | (HAS_KEY if free and s.parent_sub is not None else 0))
        if origin:
            self.ident(origin, "left")
        if right:
            self.ident(right, "right")
        if free:
            numbers["parent"].append(0 if s.parent_id else 1)
            if s.parent_id:
                self.ident(s.parent_id, "left")
            else:
                self.text(s.parent_name or "")
            if s.parent_sub is not None:
                self.text(s.parent_sub)
        if kind in ("gc", "deleted"):
            numbers["len"].append(s.len)
        elif kind == "json":
            numbers["len"].append(len(given(s.vals)))
            for text in s.vals:
                self.text(text)
        elif kind == "any":
            numbers["len"].append(len(given(s.vals)))
            tagged(s.vals, self.rest)
        elif kind == "embed":
            tagged(s.vals, self.rest)
        elif kind == "binary":
            sized(given(s.bin), self.rest)
        elif kind in ("string", "doc"):
            self.text(s.str)
            if kind == "doc":
                self.rest.append(126)
        elif kind == "format":
            self.key(s.fmt_key)
            tagged(s.vals, self.rest)
        elif kind == "type":
            numbers["type"].append(given(s.type_class))
            if s.type_class == 3:
                self.key(s.node_name)
        else:
            for n in (*given(s.move_target), given(s.move_len)):
                count(n, self.rest)

    def column(self, name: str) -> bytes:
        """The numbers of a column, run-length coded in its way."""
        how, values, out = COLUMNS[name], self.numbers[name], bytearray()
        if how == "diff":
            values = [b - a for a, b in zip([0, *values], values)]
        runs = [(value, len(list(own))) for value, own in groupby(values)]
        for i, (value, n) in enumerate(runs):
            if how == "byte":
                out.append(value)
                if i < len(runs) - 1:
                    count(n - 1, out)
                continue
            if how == "diff":
                signed(value * 2 + (n > 1), out)
            else:
                signed(value, out, n > 1)
            if n > 1:
                count(n - 2, out)
        if how == "text":
            head = bytearray()
            sized("".join(self.texts).encode(), head)
            out = head + out
        return bytes(out)


def _write_columnar(structs: list[Struct], ranges: list[tuple]) -> bytes:
    w, clients = _Writer(), by_client(structs)
    count(len(clients), w.rest)
    for client, rows in reversed(clients):
        gaps = sum(b.clock > a.clock + a.len for a, b in zip(rows, rows[1:]))
        count(len(rows) + gaps, w.rest)
        count(rows[0].clock, w.rest)
        w.numbers["client"].append(client)
        upto = rows[0].clock
        for s in rows:
            if s.clock > upto:
                w.numbers["info"].append(TAGS["skip"])
                count(s.clock - upto, w.rest)
            w.struct(s)
            upto = s.clock + s.len
    gone = by_client([r for r in ranges if r[2] > 0])
    count(len(gone), w.rest)
    for client, own in reversed(gone):
        count(client, w.rest)
        count(len(own), w.rest)
        upto = 0
        for _, clock, length in own:
            count(clock - upto, w.rest)
            count(length - 1, w.rest)
            upto = clock + length
    out = bytearray(b"\0")
    for name in COLUMNS:
        sized(w.column(name), out)
    return bytes(out + w.rest)


def encode_columnar(structs: DataFrame, ranges: DataFrame | str, at_once: int = AT_ONCE) -> DataFrame:
    """(doc_id, update): each document's structs and delete set as one update in the columnar format, clients descending.

    Documents of up to ``at_once`` structs and ranges are each written in a
    task, short ones together; longer ones by windows. ``ranges`` may name a
    column of ``structs`` instead: those where it holds are deleted.
    """
    found, rest = each_document(structs, ranges, STRUCT, lambda own, gone: [_write_columnar(own, gone)], at_once)
    return found if rest is None else found.unionByName(_columnar_by_windows(*rest))


def _columnar_by_windows(structs: DataFrame, ranges: DataFrame) -> DataFrame:
    """The same by windows over each document's values."""
    order = Window.partitionBy("doc_id", "client").orderBy("clock")
    rows = structs.withColumn("gap", F.coalesce(F.col("clock") - F.lag(F.col("clock") + F.col("len")).over(order), F.lit(0)))
    parts = rows.select("doc_id", "client", "clock", F.posexplode(_emissions()).alias("i", "part")).select("doc_id", F.struct((-F.col("client")).alias("a"), F.lit(1).alias("b"), F.col("clock").alias("c"), F.col("i").alias("d")).alias("at"), "part.*")

    groups = rows.groupBy("doc_id", "client").agg(F.sum(F.when(F.col("gap") > 0, 2).otherwise(1)).cast("long").alias("n"), F.min("clock").alias("start"))
    place = lambda a, b, d: F.struct(a.cast("long").alias("a"), F.lit(b).alias("b"), F.lit(0).cast("long").alias("c"), F.lit(d).alias("d")).alias("at")
    empty = {"column": F.lit("rest"), "number": F.lit(None).cast("long"), "text": F.lit(None).cast("string")}
    raw = lambda df, at, data: df.select("doc_id", at, data.alias("raw")).withColumns(empty)
    heads = raw(groups, place(-F.col("client"), 0, 0), F.concat(var_uint(F.col("n")), var_uint(F.col("start"))))
    names = groups.select("doc_id", place(-F.col("client"), 0, 1), F.lit("client").alias("column"), F.col("client").alias("number"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("raw"))
    gone = compact_ranges(ranges.where("len > 0"))
    docs = groups.groupBy("doc_id").agg(F.count("*").alias("n")).join(gone.select("doc_id").distinct(), "doc_id", "full")
    first = raw(docs, place(F.lit(-(2**62)), 0, 0), var_uint(F.coalesce("n", F.lit(0)).cast("long")))

    by_clock = Window.partitionBy("doc_id", "client").orderBy("clock")
    step = F.concat(var_uint(F.col("clock") - F.coalesce(F.lag(F.col("clock") + F.col("len")).over(by_clock), F.lit(0))), var_uint(F.col("len") - 1))
    own = F.array_sort(F.collect_list(F.struct("clock", "step")))
    clients = gone.withColumn("step", step).groupBy("doc_id", "client").agg(own.alias("own"))
    clients = clients.select("doc_id", "client", F.concat(var_uint(F.col("client")), var_uint(F.size("own").cast("long")), joined(F.col("own.step"))).alias("data"))
    after = raw(clients, place(F.lit(2**62) - F.col("client"), 1, 0), F.col("data"))
    counts = docs.select("doc_id").join(clients.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    total = raw(counts, place(F.lit(1), 0, 0), var_uint(F.coalesce("n", F.lit(0)).cast("long")))

    rows = parts.unionByName(heads).unionByName(names).unionByName(first).unionByName(after).unionByName(total)
    rows = _numbered_keys(rows)
    strings = rows.where("column = 'string'")
    joined_text = strings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("own")).select("doc_id", F.lit("string").alias("column"), var_string(F.array_join(F.col("own.text"), "")).alias("data"))
    units = (F.octet_length(F.encode("text", "UTF-16BE")) / 2).cast("long")
    numbers = rows.where("number is not null").select("doc_id", "at", "column", "number").unionByName(strings.select("doc_id", "at", F.lit("lengths").alias("column"), units.alias("number")))
    rest = rows.where("column = 'rest'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("own")).select("doc_id", F.lit("rest").alias("column"), joined(F.col("own.raw")).alias("data"))
    coded = _runs(numbers).unionByName(joined_text).unionByName(rest)
    whole = coded.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("column", "data"))).alias("m"))
    held = lambda c: F.coalesce(F.col("m")[c], no_bytes())
    text = F.concat(F.coalesce(F.col("m")["string"], F.lit(b"\0")), held("lengths"))
    return whole.select("doc_id", F.concat(F.lit(b"\0"), *(var_bytes(text if c == "string" else held(c)) for c in COLUMNS), held("rest")).alias("update"))


class _Runs:
    """Reads the numbers of a column again."""

    def __init__(self, data: bytes, how: str):
        self.reader, self.how, self.left, self.value, self.diff = Reader(data), how, 0, 0, 0

    def next(self) -> int:
        r = self.reader
        if self.left == 0:
            more = r.at < len(r.data)
            if self.how == "byte":
                self.value = r.byte()
                self.left = r.uint() + 1 if r.at < len(r.data) else -1  # the last run goes on for ever
            elif not more:
                raise ValueError("a column ends too soon")
            elif self.how == "diff":
                coded = r.signed()
                self.diff, self.left = coded >> 1, 1
                if coded & 1:
                    self.left = r.uint() + 2
            else:
                negative = r.data[r.at] & 64
                self.value, self.left = abs(r.signed()), 1
                if negative:
                    self.left = r.uint() + 2
        if self.left > 0:
            self.left -= 1
        if self.how == "diff":
            self.value += self.diff
        return self.value


class _Columns:
    """The columns of an update, and its rest."""

    def __init__(self, data: bytes):
        reader = Reader(data)
        if reader.uint():
            raise ValueError("unknown features")
        self.columns, self.keys, self.place = {}, [], 0
        for name, how in COLUMNS.items():
            body = reader.bytes()
            if how == "text":
                texts = Reader(body)
                self.units = texts.text().encode("utf-16-le") if body else b""
                self.columns[name] = _Runs(body[texts.at :], "run")
            else:
                self.columns[name] = _Runs(body, how)
        self.rest = Reader(data[reader.at :])

    def number(self, name: str) -> int:
        return self.columns[name].next()

    def text(self) -> str:
        end = self.place + 2 * self.number("string")
        if end > len(self.units):
            raise ValueError("the strings end too soon")
        self.place, start = end, self.place
        return self.units[start:end].decode("utf-16-le", "replace")

    def key(self) -> str:
        n = self.number("key")
        if n < 0 or n > len(self.keys):
            raise ValueError("unknown key")
        if n == len(self.keys):
            self.keys.append(self.text())
        return self.keys[n]

    def ident(self, clock: str) -> dict:
        return {"client": self.number("client"), "clock": self.number(clock)}


def read_columnar(data: bytes) -> Iterator[dict]:
    """The structs and delete ranges of a columnar update."""
    c = _Columns(data)
    for _ in range(c.rest.count()):
        n = c.rest.uint()
        if n > MOST_STRUCTS:
            raise ValueError("a count is too high")
        client, clock = c.number("client"), c.rest.uint()
        for _ in range(n):
            info = c.number("info")
            kind = KINDS.get(info & 31)
            row = {"client": client, "clock": clock, "content_type": kind, "len": 1}
            if kind == "skip":
                row["len"] = c.rest.uint()
            elif info == 0:
                row["len"] = c.number("len")
            else:
                if info & HAS_ORIGIN:
                    row["origin"] = c.ident("left")
                if info & HAS_RIGHT:
                    row["right_origin"] = c.ident("right")
                if not info & (HAS_ORIGIN | HAS_RIGHT):
                    if c.number("parent"):
                        row["parent_name"] = c.text()
                    else:
                        row["parent_id"] = c.ident("left")
                    if info & HAS_KEY:
                        row["parent_sub"] = c.text()
                _content(kind, c, row)
            clock += row["len"]
            if kind != "skip":
                yield row
    for _ in range(c.rest.count()):
        client, at = c.rest.uint(), 0
        for _ in range(c.rest.count()):
            at += c.rest.uint()
            n = c.rest.uint() + 1
            yield {"client": client, "clock": at, "len": n, "content_type": "range"}
            at += n
    if c.rest.at != len(c.rest.data):
        raise ValueError("bytes are left over")


def _content(kind: str | None, c: _Columns, row: dict) -> None:
    if kind == "deleted":
        row["len"] = c.number("len")
    elif kind in ("json", "any"):
        n = c.number("len")
        if n > 1 << 20:
            raise ValueError("a count is too high")
        row["vals"] = [c.text() if kind == "json" else json.dumps(c.rest.any()) for _ in range(n)]
        row["len"] = n
    elif kind == "binary":
        row["bin"] = c.rest.bytes()
    elif kind == "string":
        row["str"] = c.text()
        row["len"] = len(row["str"].encode("utf-16-le")) // 2
    elif kind == "embed":
        row["vals"] = [json.dumps(c.rest.any())]
    elif kind == "format":
        row["fmt_key"], row["vals"] = c.key(), [json.dumps(c.rest.any())]
    elif kind == "type":
        row["type_class"] = c.number("type")
        if row["type_class"] == 3:
            row["node_name"] = c.key()
    elif kind == "doc":
        row["str"] = c.text()
        c.rest.any()
    elif kind == "move":
        row["move_target"], row["move_len"] = c.rest.ident(), c.rest.uint()
    else:
        raise ValueError("unknown content")


def _rows(data: bytes) -> list[dict]:
    try:
        return list(read_columnar(data))
    except (ValueError, UnicodeDecodeError) as e:
        return [{"error": str(e)}]


def decode_columnar(updates: DataFrame) -> DataFrame:
    """(doc_id, STRUCT columns, error) of ``updates(doc_id, update)``; a malformed update gives one row with its error, a null one none."""
    fields = f"doc_id {updates.schema['doc_id'].dataType.simpleString()}, {STRUCT}, error string"
    schema = _arrow(fields)

    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [] if data is None else _rows(data)
                for at in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_pylist([{"doc_id": key, **r} for r in rows[at : at + 4096]], schema)

    return updates.select("doc_id", "update").mapInArrow(run, fields)
