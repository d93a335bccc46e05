"""The binary format: golden bytes, hand-made updates, round trips, and bytes that hold nothing valid."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.sources import columnar, updates, wire


@pytest.mark.parametrize(("value", "data"), [(0, "00"), (1, "01"), (63, "3f"), (127, "7f"), (128, "8001"), (255, "ff01"), (300, "ac02"), (16383, "ff7f"), (16384, "808001"), (2**55, None)])
def test_unsigned(spark, value, data):
    out = spark.range(1).select(wire.var_uint(F.lit(value).cast("long"))).first()[0]
    assert data is None or bytes(out).hex() == data
    assert updates.Reader(bytes(out)).uint() == value


@pytest.mark.parametrize(("value", "data"), [(0, "00"), (1, "01"), (-1, "41"), (63, "3f"), (-63, "7f"), (64, "8001"), (-64, "c001"), (-(2**40), None)])
def test_signed(spark, value, data):
    out = spark.range(1).select(wire.var_int(F.lit(value).cast("long"))).first()[0]
    assert data is None or bytes(out).hex() == data
    assert updates.Reader(bytes(out)).signed() == value


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(2**54), 2**54) | st.floats(allow_nan=False) | st.text(), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(), v, max_size=4), max_leaves=12)


@given(VALUES)
@settings(max_examples=150, deadline=None)
def test_any_round_trip(value):
    out = bytearray()
    wire.write_any(value, out)
    assert updates.Reader(bytes(out)).any() == value


def test_any_byte_strings():
    out = bytearray()
    wire.write_any({"$bytes": "AQID"}, out)
    assert out == bytes([116, 3, 1, 2, 3]) and updates.Reader(bytes(out)).any() == {"$bytes": "AQID"}


@pytest.mark.parametrize(
    ("data", "root", "text"),
    [
        ("01020100000504010763 6f6e74656e7405776f726c6400", "content", "world"),
        ("010201000a050401017405 68656c6c6f00", "t", "hello"),
    ],
)
def test_hand_made_updates(spark, data, root, text):
    rows = updates.decode_updates(spark.createDataFrame([(1, bytes.fromhex(data.replace(" ", "")))], "doc_id long, update binary")).collect()
    strings = [r for r in rows if r.content_type == "string"]
    assert [(r.parent_name, r.str, r.error) for r in strings] == [(root, text, None)]


def test_parent_comes_from_another_client(spark):
    data = bytes.fromhex("0201640084c801040620776f726c6401c80100040101740568656c6c6f00")
    rows = updates.resolve_parents(updates.decode_updates(spark.createDataFrame([(1, data)], "doc_id long, update binary"))).collect()
    assert sorted((r.client, r.str, r.parent_name) for r in rows) == [(100, " world", "t"), (200, "hello", "t")]


def struct_row(**given):
    base = dict.fromkeys(["origin", "right_origin", "parent_name", "parent_id", "parent_sub", "str", "bin", "vals", "fmt_key", "type_class", "node_name", "move_target", "move_len"])
    return {"doc_id": 1, "client": 1, **base, **given}


@pytest.mark.parametrize(("encode", "decode"), [(wire.encode_updates, updates.decode_updates), (columnar.encode_columnar, columnar.decode_columnar)])
def test_every_kind_of_content_round_trips(spark, encode, decode):
    rows = [
        struct_row(clock=0, len=3, content_type="gc"),
        struct_row(clock=3, len=2, content_type="deleted", parent_name="t"),
        struct_row(clock=5, len=2, content_type="json", parent_name="t", vals=["1", '{"a": null}']),
        struct_row(clock=7, len=1, content_type="binary", parent_name="t", bin=b"\x00\xff"),
        struct_row(clock=8, len=4, content_type="string", parent_id={"client": 1, "clock": 12}, str="a👍b"),
        struct_row(clock=12, len=1, content_type="type", parent_name="x", type_class=3, node_name="div"),
        struct_row(clock=13, len=1, content_type="embed", parent_name="t", vals=['{"img": true}']),
        struct_row(clock=14, len=1, content_type="format", origin={"client": 1, "clock": 13}, fmt_key="bold", vals=["true"]),
        struct_row(clock=15, len=3, content_type="any", parent_name="m", parent_sub="key", vals=["null", "1.5", '"two"']),
        struct_row(clock=18, len=1, content_type="doc", parent_name="t", str="guid"),
        struct_row(clock=19, len=1, content_type="move", right_origin={"client": 2, "clock": 300}, move_target={"client": 1, "clock": 5}, move_len=1),
        struct_row(clock=30, len=1, content_type="string", parent_name="t", str="z"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, " + wire.STRUCT)
    gone = spark.createDataFrame([(1, 1, 3, 2), (1, 9, 0, 1), (1, 1, 5, 1)], "doc_id long, client long, clock long, len long")
    back = decode(encode(frame, gone)).collect()
    key = lambda r: (r["clock"],)
    norm = lambda r: {k: (v.asDict() if hasattr(v, "asDict") else bytes(v) if isinstance(v, bytearray) else [json.loads(x) for x in v] if k == "vals" and v is not None else v) for k, v in r.items()}
    found = sorted((norm(r.asDict()) for r in back if r.content_type != "range"), key=key)
    for r in found:
        assert r.pop("error") is None
    assert found == sorted((norm(r) for r in rows), key=key)
    assert sorted((r.client, r.clock, r.len) for r in back if r.content_type == "range") == [(1, 3, 3), (9, 0, 1)]


def test_state_vectors_snapshots_and_messages(spark):
    vectors = spark.createDataFrame([(1, 300, 5), (1, 2, 70_000)], "doc_id long, client long, next_clock long")
    coded = wire.encode_state_vectors(vectors)
    assert bytes(coded.first().sv).hex() == "0202f0a204ac0205"
    assert sorted((r.client, r.next_clock) for r in updates.decode_state_vectors(coded).collect()) == [(2, 70_000), (300, 5)]
    message = coded.select(wire.sync_message(0, F.col("sv")).alias("m")).first().m
    assert bytes(message).hex() == "00080202f0a204ac0205"
    log = spark.createDataFrame([(1, 1, 0, 4)], "doc_id long, client long, clock long, len long")
    assert bytes(wire.encode_snapshots(log, log).first().snapshot).hex() == "03010104" + "050101010004"
    states = spark.createDataFrame([(1, 2, 7, '{"a":1}'), (1, 1, 3, None)], "doc_id long, client long, clock long, state string")
    assert bytes(wire.encode_presence(states).first().update) == b"\x02\x01\x03\x04null\x02\x07\x07" + b'{"a":1}'
    at = spark.createDataFrame([(1, 5, "t", 0), (None, None, "t", -1)], "client long, clock long, name string, assoc int")
    assert [bytes(r[0]).hex() for r in at.select(wire.encode_relative_position(F.col("client"), F.col("clock"), F.col("name"), F.col("assoc"))).collect()] == ["01010500", "02017441"]


@given(st.binary(max_size=60))
@settings(max_examples=300, deadline=None)
def test_bytes_of_any_kind_give_rows_or_an_error(data):
    assert isinstance(updates._rows(data), list)
    assert isinstance(columnar._rows(data), list)


@pytest.mark.parametrize("data", [b"", b"\xff" * 12, b"\x01", b"\x01\x01\x01\x00\x04\x01\x01t\x05hel", b"\x00\x00\x00"])
def test_malformed_updates_are_told(spark, data):
    frame = spark.createDataFrame([(1, data), (2, None)], "doc_id long, update binary")
    rows = updates.decode_updates(frame).collect()
    assert len(rows) == 1 and rows[0].error
    with pytest.raises(Exception, match="PySparkRuntimeError|ValueError|PythonException"):
        updates.decode_updates(frame, permissive=False).collect()


def columns_of(values, how):
    reader = columnar._Runs(values, how)
    return lambda n: [reader.next() for _ in range(n)]


def test_columns_read_by_hand():
    assert columns_of(bytes([7, 2, 9]), "byte")(6) == [7, 7, 7, 9, 9, 9]
    assert columns_of(bytes([5, 0x40, 1, 0x43, 0]), "run")(6) == [5, 0, 0, 0, 3, 3]
    assert columns_of(bytes([6, 3, 1, 0x44]), "diff")(5) == [3, 4, 5, 6, 4]


def test_a_columnar_update_by_hand(spark):
    """One client with one string under a root: the columns hold client 1, info 4, a named parent, and two strings."""
    one = spark.createDataFrame([struct_row(clock=0, len=2, content_type="string", parent_name="t", str="hi")], "doc_id long, " + wire.STRUCT)
    none = spark.createDataFrame([], "doc_id long, client long, clock long, len long")
    data = bytes(columnar.encode_columnar(one, none).first().update)
    assert data.hex() == "00" + "00" + "0101" + "00" + "00" + "0104" + "060374686901" + "02" + "0101" + "00" + "00" + "01" + "01" + "00" + "00"


def test_repeated_keys_are_written_once(spark):
    rows = [struct_row(clock=i, len=1, content_type="format", parent_name="t", fmt_key=k, vals=["1"]) for i, k in enumerate(["bold", "italic", "bold", "bold"])]
    frame = spark.createDataFrame(rows, "doc_id long, " + wire.STRUCT)
    coded = columnar.encode_columnar(frame, spark.createDataFrame([], "doc_id long, client long, clock long, len long"))
    assert bytes(coded.first().update).count(b"bold") == 1
    assert [r.fmt_key for r in sorted(columnar.decode_columnar(coded).collect(), key=lambda r: r.clock)] == ["bold", "italic", "bold", "bold"]


@pytest.mark.parametrize("encode", [columnar.encode_columnar, wire.encode_updates, lambda *a, **k: wire.encode_in_parts(*a, most=3, **k)])
def test_documents_written_in_tasks_have_the_bytes_of_windows(spark, encode):
    """Gaps, several clients, repeated keys, ids of all kinds, ranges that overlap or touch, and documents of ranges only."""
    rng, rows, gone = random.Random(3), [], []
    ident = lambda: rng.choice([None, None, {"client": rng.choice([1, 9, 2**33]), "clock": rng.randrange(300)}])
    for doc in range(12):
        for client in rng.sample([0, 1, 9, 200, 2**33], rng.randrange(0 if doc else 1, 4)):
            clock = rng.choice([0, 0, 5])
            for _ in range(rng.randrange(1, 9)):
                kind = rng.choice(["gc", "deleted", "json", "any", "binary", "string", "embed", "format", "type", "doc", "move"])
                text = rng.choice(["a", "plain", "é👍", "x" * 200])
                n = {"gc": 70, "deleted": 3, "json": 2, "any": 2, "string": len(text.encode("utf-16-le")) // 2}.get(kind, 1)
                row = struct_row(clock=clock, len=n, content_type=kind, origin=ident(), right_origin=ident(), parent_name=rng.choice([None, "t"]), parent_id=ident(), parent_sub=rng.choice([None, "k", "ß"]), type_class=rng.choice([1, 3]), node_name=text)
                row |= {"doc_id": doc, "client": client, "str": text, "bin": text.encode(), "vals": [rng.choice(["1", "-70", "2.5", '"é"', "null", '{"b": [true], "a": 1}']) for _ in range(2 if kind in ("json", "any") else 1)], "fmt_key": rng.choice(["bold", "em"]), "move_target": {"client": 1, "clock": 130}, "move_len": 4}
                rows.append(row)
                clock += n + rng.choice([0, 0, 0, 200])
            gone += [(doc, client, rng.randrange(40), rng.randrange(1, 20)) for _ in range(rng.randrange(3))]
    gone += [(100, 1, 3, 2), (100, 1, 5, 1), (100, 7, 300, 200)]
    frame, ranges = spark.createDataFrame(rows, "doc_id long, " + wire.STRUCT), spark.createDataFrame(gone, "doc_id long, client long, clock long, len long")
    bytes_of = lambda df: sorted((r.doc_id, bytes(r.update).hex()) for r in df.collect())
    whole = encode(frame, ranges)
    assert "Window" not in whole._jdf.queryExecution().optimizedPlan().toString()
    assert bytes_of(whole) == bytes_of(encode(frame, ranges, at_once=9))


@pytest.mark.parametrize("encode", [columnar.encode_columnar, wire.encode_in_parts])
def test_deletions_named_by_a_column_are_those_of_ranges(spark, encode):
    """Structs are read once: where a column tells which are deleted, no second table of ranges is made of them."""
    rows = [struct_row(clock=i, len=1, content_type="string", parent_name="t", str="a") | {"doc_id": doc, "deletes": gone} for doc, n in ((1, 2), (2, 7)) for i, gone in enumerate([True, None, False, True, True, False, True][:n])]
    frame = spark.createDataFrame(rows, "doc_id long, deletes boolean, " + wire.STRUCT)
    bytes_of = lambda df: sorted((r.doc_id, bytes(r.update)) for r in df.collect())
    assert bytes_of(encode(frame, "deletes")) == bytes_of(encode(frame, frame.where("deletes"))) == bytes_of(encode(frame, "deletes", at_once=3))
