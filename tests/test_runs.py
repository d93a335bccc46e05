"""Runs of many units: ordered, merged, cut, deleted and restored unit by unit, and read from bytes to values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import content, edit, history, order, runs, state
from tideline.sources import messages, updates, wire

ITEMS = "doc_id long, client long, clock long, len long, origin_client long, origin_clock long, content string"
RANGES = "doc_id long, client long, clock long, len long"


def items_of(rows):
    return [(1, c, k, len(t), *(o or (None, None)), t) for c, k, t, o in rows]


def read(spark, rows, **how):
    placed = order.origin_tree_order(spark.createDataFrame(items_of(rows), ITEMS), **how).collect()
    return [r.content for r in sorted(placed, key=lambda r: r.pos)]


@pytest.mark.parametrize("at_once", [1 << 20, 0])
@pytest.mark.parametrize(
    ("rows", "wanted"),
    [
        ([(1, 0, "Hello", None), (2, 0, "X", (1, 1)), (1, 5, " world", (1, 4))], "HelloX world"),
        ([(1, 0, "Hello", None), (1, 5, " world", (1, 4)), (2, 0, "abc", (1, 10))], "Hello worldabc"),
        ([(3, 0, "Hello", None), (2, 0, "X", (3, 1)), (3, 5, " world", (3, 4))], "HeXllo world"),
        ([(1, 0, "ab", None), (2, 0, "lost", (9, 0)), (2, 4, "below", (2, 3))], "ab"),
        ([(1, 0, "ab", None), (2, 0, "lost", (1, 7))], "ab"),
    ],
)
def test_order_of_runs(spark, rows, wanted, at_once):
    if wanted == "HelloX world":  # the later client stands after the run that it lands in, and after what follows it
        wanted = "Hello worldX"
    assert "".join(read(spark, rows, at_once=at_once)) == wanted


def unit_order(rows):
    """The same unit by unit: each unit of a run stands after the one before it."""
    units = [(c, k + i, t[i], (c, k + i - 1) if i else o) for c, k, t, o in rows for i in range(len(t))]

    def below(origin):
        out = []
        for u in sorted((u for u in units if u[3] == origin), key=lambda u: (u[0], -u[1])):
            out += [u[2], *below((u[0], u[1]))]
        return out

    return "".join(below(None))


@pytest.mark.parametrize("at_once", [1 << 20, 3])
def test_order_of_random_runs_equals_that_of_their_units(spark, at_once):
    rng = random.Random(5)
    rows, clocks = [], dict.fromkeys(range(4), 0)
    for i in range(60):
        c, n = rng.randrange(4), rng.randrange(1, 5)
        o = rng.choice(rows) if rows and rng.random() < 0.9 else None
        rows.append((c, clocks[c], "".join(chr(0x4E00 + 8 * i + j) for j in range(n)), (o[0], o[1] + rng.randrange(len(o[2]))) if o else None))
        clocks[c] += n
    wanted = unit_order(rows)
    rng.shuffle(rows)
    assert "".join(read(spark, rows, at_once=at_once)) == wanted


def test_sequences_of_one_document_have_places_of_their_own(spark):
    rows = [(1, 1, 0, None, None, "a"), (1, 1, 1, 1, 0, "a"), (1, 2, 0, None, None, "b")]
    placed = order.origin_tree_order(spark.createDataFrame(rows, "doc_id long, client long, clock long, origin_client long, origin_clock long, parent string"), ["doc_id", "parent"])
    assert sorted((r.parent, r.client, r.pos) for r in placed.collect()) == [("a", 1, 0), ("a", 1, 1), ("b", 2, 0)]


def test_rings_have_no_place(spark):
    assert read(spark, [(1, 0, "a", (1, 1)), (1, 1, "b", (1, 0)), (2, 0, "c", None)]) == ["c"]


def test_an_appended_run_is_ready(spark):
    rows = items_of([(1, 0, "Hello", None), (1, 5, " world", (1, 4)), (2, 0, "abc", (1, 2)), (3, 0, "no", (9, 9)), (3, 2, "no", (3, 1))])
    assert sorted(r.content for r in state.causally_ready(spark.createDataFrame(rows, ITEMS)).collect()) == [" world", "Hello", "abc"]


def test_merging_keeps_the_longer_run(spark):
    one, two = (spark.createDataFrame([(1, 1, 0, len(t), None, None, t)], ITEMS) for t in ("abcd", "abcdef"))
    for logs in ((one, two), (two, one), (one, two, one)):
        assert "".join(r.content for r in sorted(state.merge_updates(*logs).collect(), key=lambda r: r.clock)) == "abcdef"


def test_a_diff_cuts_the_content_too(spark):
    log = spark.createDataFrame([(1, 1, 0, 4, None, None, "abcd")], ITEMS)
    rest = state.diff_since(log, spark.createDataFrame([(1, 1, 2)], "doc_id long, client long, next_clock long")).first()
    assert (rest.clock, rest.len, rest.content, rest.origin_client, rest.origin_clock) == (2, 2, "cd", 1, 1)


def test_deletions_are_exact_to_the_unit(spark):
    log = spark.createDataFrame([(1, 1, 0, 5, None, None, "abcde"), (1, 2, 0, 2, None, None, "xy")], ITEMS)
    gone = spark.createDataFrame([(1, 1, 2, 2)], RANGES)
    assert sorted((r.client, r.clock, r.content, r.deletes) for r in runs.mark_deleted(log, gone).collect()) == [(1, 0, "ab", False), (1, 2, "cd", True), (1, 4, "e", False), (2, 0, "xy", False)]
    assert [(r.clock, r.len, r.content) for r in state.in_delete_set(log, gone).collect()] == [(2, 2, "cd")]
    wide = spark.createDataFrame([(1, 1, 3, 9), (1, 7, 0, 1)], RANGES)
    assert sorted((r.client, r.clock, r.len) for r in state.unresolved_ranges(log, wide).collect()) == [(1, 5, 7), (7, 0, 1)]


def test_restoring_cuts_runs_at_the_snapshot(spark):
    log = spark.createDataFrame([(1, 1, 0, 6, None, None, "abcdef")], ITEMS)
    taken = spark.createDataFrame([(1, [(1, 5)], [(1, 1, 2)])], "doc_id long, sv array<struct<client:long,next_clock:long>>, ds array<struct<client:long,clock:long,len:long>>")
    assert sorted((r.clock, r.content, r.deletes) for r in history.restore(log, taken).collect()) == [(0, "a", False), (1, "bc", True), (3, "de", False)]


def test_squashed_runs_join_their_texts(spark):
    log = spark.createDataFrame(items_of([(1, 0, "ab", None), (1, 2, "c", None), (1, 9, "z", None)]), ITEMS)
    assert sorted((r.clock, r.len, r.content) for r in history.squash_runs(log, [F.lit(1)], "content").collect()) == [(0, 3, "abc"), (9, 1, "z")]


def test_undo_redo_and_scope(spark):
    rows = [(1, 1, i, 1, d, float(t), tag) for i, (d, t, tag) in enumerate([(False, 0, "a"), (False, 1, "a"), (True, 9, "b"), (False, 20, "a")])]
    log = spark.createDataFrame(rows, "doc_id long, client long, clock long, len long, deletes boolean, t double, origin_tag string").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    groups = history.undo_groups(log, 2)
    assert sorted((r.first_clock, r.next_clock) for r in groups.collect()) == [(0, 2), (2, 3), (3, 4)]
    assert tuple(history.stack_sizes(groups, 2).first())[2:] == (1, 2)
    assert sorted((r.clock, r.action) for r in history.undo_last(log, 2, 2).collect()) == [(2, "revive"), (3, "delete")]
    assert [(r.clock, r.action) for r in history.redo_next(log, 2, 2).collect()] == [(2, "delete")]
    assert [(r.first_clock, r.next_clock) for r in history.undo_groups(log, 2, scope=~F.col("deletes"), origins=["b", "a"]).orderBy("item").collect()] == [(0, 2), (3, 4)]
    assert history.undo_groups(log, 2, origins=["none"]).count() == 0


NAMES = "origin right_origin parent_name parent_id parent_sub str bin vals fmt_key type_class node_name move_target move_len".split()


def struct(client, clock, kind, n=1, **given):
    pair = lambda x: {"client": x[0], "clock": x[1]} if isinstance(x, tuple) else x
    return {"doc_id": 1, "client": client, "clock": clock, "len": n, "content_type": kind, **dict.fromkeys(NAMES), **{k: pair(v) for k, v in given.items()}}


def placed(spark, batches, gone=()):
    none = spark.createDataFrame(list(gone), RANGES)
    out = None
    for i, rows in enumerate(batches):
        one = wire.encode_updates(spark.createDataFrame(rows, "doc_id long, " + wire.STRUCT), none if i == 0 else none.limit(0))
        out = one if out is None else out.unionByName(one)
    return content.placed_items(updates.decode_updates(out)).cache()


def test_two_peers_converge_from_bytes(spark):
    base = [struct(2, 0, "string", 5, str="Hello", parent_name="t")]
    one = [struct(2, 5, "string", 6, str=" world", origin=(2, 4))]
    two = [struct(1, 0, "string", 1, str="X", origin=(2, 1)), struct(1, 1, "string", 1, str="👍"[:1], origin=(9, 0))]
    for batches in ((base, one, two), (two, base, one), (base + one, two, base)):
        assert [r.text for r in content.texts(placed(spark, batches)).collect()] == ["HeXllo world"]


def test_concurrent_formats_converge(spark):
    text = [struct(1, 0, "string", 5, str="Hello", parent_name="t")]
    bold = [struct(2, 0, "format", fmt_key="bold", vals=["true"], parent_name="t"), struct(2, 1, "format", fmt_key="bold", vals=["null"], origin=(1, 2))]
    cursive = [struct(3, 0, "format", fmt_key="italic", vals=["true"], origin=(1, 1)), struct(3, 1, "format", fmt_key="italic", vals=["null"], origin=(1, 4))]
    seen = set()
    for batches in ((text, bold, cursive), (cursive, bold, text)):
        got = content.rich_text(placed(spark, batches)).orderBy("step").collect()
        assert "".join(r.insert for r in got) == "Hello"
        seen.add(str([(r.insert, sorted((r.attributes or {}).items())) for r in got]))
    assert len(seen) == 1


def test_xml_maps_moves_and_lists_from_bytes(spark):
    rows = [
        struct(1, 0, "type", type_class=3, node_name="p", parent_name="x"),
        struct(1, 1, "any", vals=['"a<b"'], parent_id=(1, 0), parent_sub="class"),
        struct(1, 2, "type", type_class=6, parent_id=(1, 0)),
        struct(1, 3, "string", 5, str="1 < 2", parent_id=(1, 2)),
        struct(1, 8, "type", type_class=3, node_name="br", origin=(1, 2)),
        struct(1, 9, "any", 3, vals=["1", "2", "3"], parent_name="l"),
        struct(1, 12, "move", move_target=(1, 11), move_len=1, right_origin=(1, 9), parent_name="l"),
        struct(1, 13, "any", vals=["1"], parent_name="m", parent_sub="k"),
        struct(2, 0, "any", vals=["2"], origin=(1, 13)),
        struct(1, 14, "any", vals=["3"], parent_name="m", parent_sub="gone"),
    ]
    items = placed(spark, [rows[:5], rows[5:]], gone=[(1, 1, 14, 1)])
    assert content.xml(items, content.root("x")).first().xml == '<p class="a&lt;b">1 &lt; 2<br></br></p>'
    assert {r.parent: r.json for r in content.lists(items).collect()} == {"/l": "[3,1,2]"}
    assert [(r.parent, r.json) for r in content.maps(items).where("parent = '/m'").collect()] == [("/m", '{"k":2}')]
    assert [(r.nth, r.kind, r.name) for r in content.children(items).where("parent = '1:0'").orderBy("nth").collect()] == [(0, "text", None), (1, "element", "br")]
    assert [(r.parent, r.attributes) for r in content.attributes(items).collect()] == [("1:0", {"class": "a<b"})]
    assert {r.parent: r.n for r in content.lengths(items).collect()} == {"/x": 1, "1:0": 2, "1:2": 5, "/l": 3}
    told = content.changed_types(items, F.col("clock") >= 3, F.lit(False))
    assert {r.parent: r.n_types for r in content.deep_changes(told, items).where("parent in ('/x', '1:0', '/l')").collect()} == {"/x": 2, "1:0": 2, "/l": 1}


def test_changes_with_attributes(spark):
    rows = [struct(1, 0, "string", 6, str="abcdef", parent_name="t"), struct(1, 6, "format", fmt_key="bold", vals=["true"], origin=(1, 1)), struct(1, 7, "format", fmt_key="bold", vals=["null"], origin=(1, 3)), struct(1, 8, "string", 1, str="!", origin=(1, 5))]
    items = placed(spark, [rows], gone=[(1, 1, 4, 1)])
    told = content.changes(items, F.col("clock") >= 6, F.lit(False)).orderBy("step").collect()
    assert [(r.op, r.insert, r.n, r.attributes) for r in told] == [("retain", None, 2, None), ("retain", None, 2, {"bold": "true"}), ("delete", None, 1, None), ("retain", None, 1, None), ("insert", "!", 1, None)]


def test_messages_are_read_back(spark):
    vectors = wire.encode_state_vectors(spark.createDataFrame([(1, 300, 5), (1, 2, 70_000)], "doc_id long, client long, next_clock long"))
    asks = vectors.select("doc_id", wire.sync_message(0, F.col("sv")).alias("message"))
    inner = messages.decode_sync(asks).first()
    assert (inner.channel, inner.kind, bytes(inner.payload), inner.error) == ("sync", 0, bytes(vectors.first().sv), None)
    frames = spark.createDataFrame([(1, bytes([0]) + bytes(asks.first().message)), (1, b"\x01\x02{}"), (1, b"\x03"), (1, b"\x09"), (1, b"\x00\x07\x00"), (1, b"\x00\x00\x05a"), (1, None)], "doc_id long, message binary")
    got = [(r.channel, r.kind, r.error is None) for r in messages.decode_frames(frames).collect()]
    assert sorted(got, key=str) == sorted([("sync", 0, True), ("presence", None, True), ("query_presence", None, True), (None, None, False), (None, None, False), (None, None, False)], key=str)
    states = spark.createDataFrame([(1, 2, 7, '{"a":1}'), (1, 1, 3, None), (1, 3, 1, "{bad"), (1, 4, 1, "]]]["), (1, 5, 1, "[" * 30 + "]" * 30), (1, 6, 1, "[1]")], "doc_id long, client long, clock long, state string")
    back = messages.decode_presence(wire.encode_presence(states)).collect()
    assert sorted((r.client, r.clock, r.state) for r in back) == [(1, 3, None), (2, 7, '{"a":1}'), (3, 1, None), (4, 1, None), (5, 1, None), (6, 1, None)]
    log = spark.createDataFrame([(1, 1, 0, 4)], RANGES)
    assert sorted(tuple(r)[1:5] for r in messages.decode_snapshots(wire.encode_snapshots(log, log)).collect()) == [(0, 1, 4, None), (1, 1, 0, 4)]
    at = spark.createDataFrame([(1, 1, 5, "t", 0), (1, None, None, "t", -1)], "doc_id long, client long, clock long, name string, assoc int")
    coded = at.select("doc_id", wire.encode_relative_position(F.col("client"), F.col("clock"), F.col("name"), F.col("assoc")).alias("position"))
    assert sorted((r.client, r.clock, r.name, r.assoc) for r in messages.decode_relative_positions(coded.unionByName(spark.createDataFrame([(1, b"\x05")], "doc_id long, position binary"))).where("error is null").collect() if r.client) == [(1, 5, None, 0)]
    short = spark.createDataFrame([(1, b"\x02\x01"), (1, b"\x01\x01\x05")], "doc_id long, sv binary")
    assert sorted((r.client or 0, r.error is None) for r in updates.decode_state_vectors(short).collect()) == [(0, False), (1, True)]
    assert [tuple(r)[1:4] for r in updates.decode_delete_sets(wire.encode_delete_sets(log).withColumnRenamed("ds", "ds")).collect()] == [(1, 0, 4)]


def test_a_request_is_answered_with_what_it_lacks(spark):
    whole = wire.encode_updates(spark.createDataFrame([struct(1, 0, "string", 4, str="abcd", parent_name="t")], "doc_id long, " + wire.STRUCT), spark.createDataFrame([], RANGES))
    asks = wire.encode_state_vectors(spark.createDataFrame([(1, 1, 2)], "doc_id long, client long, next_clock long")).select("doc_id", wire.sync_message(0, F.col("sv")).alias("message"))
    reply = messages.decode_sync(messages.replies(messages.decode_sync(asks), whole))
    assert reply.first().kind == 1
    assert [(r.clock, r.str) for r in updates.decode_updates(messages.incoming(reply)).collect()] == [(2, "cd")]


def applied(spark, rows, new, gone):
    """The values after ``new`` structs and ``gone`` ranges are added to ``rows``, all by way of bytes."""
    base = wire.encode_updates(spark.createDataFrame(rows, "doc_id long, " + wire.STRUCT), spark.createDataFrame([], RANGES))
    more = wire.encode_updates(new.select("doc_id", *[c.split()[0] for c in wire.STRUCT.replace("struct<client:long,clock:long>", "x").replace("array<string>", "x").split(", ")]), gone)
    return content.placed_items(updates.decode_updates(base.unionByName(more)))


def test_maps_are_written_and_deleted(spark):
    rows = [struct(1, 0, "any", vals=["1"], parent_name="m", parent_sub="a"), struct(1, 1, "any", vals=["2"], parent_name="m", parent_sub="b")]
    items = placed(spark, [rows])
    writes = spark.createDataFrame([(1, "/m", "a", "10", 5, 0), (1, "/m", "a", "11", 5, 1), (1, "/m", "c", '"new"', 1, 2)], "doc_id long, parent string, key string, value string, client long, seq long")
    new, gone = edit.map_set(items, writes)
    assert sorted((r.client, r.clock) for r in gone.collect()) == [(1, 0), (5, 0)]
    gone = gone.unionByName(edit.map_delete(items, spark.createDataFrame([(1, "/m", "b"), (1, "/m", "none")], "doc_id long, parent string, key string")))
    assert content.maps(applied(spark, rows, new, gone)).first().json == '{"a":11,"c":"new"}'


def test_texts_are_formatted_and_lists_and_xml_edited(spark):
    """By client 0: of two runs that follow one unit that of the lower client stands first, so what a higher one puts inside a run lands after it."""
    rows = [struct(1, 0, "string", 6, str="abcdef", parent_name="t"), struct(1, 6, "type", type_class=3, node_name="p", parent_name="x"), struct(1, 7, "any", 2, vals=["1", "2"], parent_name="l")]
    items = placed(spark, [rows])
    formats = spark.createDataFrame([(1, "/t", 2, 3, "bold", "true", 0, 0)], "doc_id long, parent string, index long, n long, key string, value string, client long, seq long")
    rich = content.rich_text(applied(spark, rows, edit.format_at(items, formats), spark.createDataFrame([], RANGES))).where("parent = '/t'").orderBy("step").collect()
    assert [(r.insert, r.attributes) for r in rich] == [("ab", None), ("cde", {"bold": "true"}), ("f", None)]
    nodes = "doc_id long, parent string, index long, client long, seq long, content_type string, len long, str string, vals array<string>, type_class int, node_name string"
    inserts = [(1, "/x", 1, 0, 0, "type", 1, None, None, 3, "br"), (1, "/x", 0, 0, 1, "type", 1, None, None, 3, "h"), (1, "1:6", 0, 0, 2, "type", 1, None, None, 6, None), (1, "0:2", 0, 0, 3, "string", 2, "hi", None, None, None), (1, "/l", 1, 0, 4, "any", 1, None, ["9"], None, None), (1, "/t", 3, 0, 5, "string", 1, "X", None, None, None)]
    new = edit.insert_nodes(items, spark.createDataFrame(inserts, nodes))
    gone = edit.delete_children(items, spark.createDataFrame([(1, "/l", 0, 1), (1, "/t", 4, 9)], "doc_id long, parent string, index long, n long"))
    after = applied(spark, rows, new, gone).cache()
    assert content.xml(after, "/x").first().xml == "<h></h><p>hi</p><br></br>"
    assert {r.parent: r.json for r in content.lists(after).collect()} == {"/l": "[9,2]"}
    assert {r.parent: r.text for r in content.texts(after).collect()}["/t"] == "abcXd"


def test_the_past_is_encoded_from_a_snapshot(spark):
    from tideline.plans import scratch
    from tideline.sources import merge

    rows = [struct(1, 0, "string", 6, str="abcdef", parent_name="t"), struct(2, 0, "format", fmt_key="bold", vals=["undefined"], parent_name="t")]
    whole = wire.encode_updates(spark.createDataFrame(rows, "doc_id long, " + wire.STRUCT), spark.createDataFrame([(1, 1, 0, 6)], RANGES))
    taken = spark.createDataFrame([(1, [(1, 4)], [(1, 1, 1)])], "doc_id long, sv array<struct<client:long,next_clock:long>>, ds array<struct<client:long,clock:long,len:long>>")
    items = content.placed_items(updates.decode_updates(merge.encode_from_snapshot(whole, taken)))
    assert [r.text for r in content.texts(items).collect()] == ["acd"]
    assert [r.vals for r in updates.decode_updates(whole).where("content_type = 'format'").collect()] == [["null"]]
    path = scratch.materialize(spark.range(3), "kept").scratch_path
    assert spark.read.parquet(path).count() == 3
    scratch.discard(scratch.materialize(spark.range(1), "gone"))
    assert path in scratch._written


def test_a_long_document_is_written_in_parts(spark):
    rows = [struct(1, 2 * i, "string", 2, str=f"{i:02d}", **({"origin": (1, 2 * i - 1)} if i else {"parent_name": "t"})) for i in range(9)]
    frame, gone = spark.createDataFrame(rows, "doc_id long, " + wire.STRUCT), spark.createDataFrame([(1, 1, 0, 1), (1, 1, 3, 1), (1, 1, 9, 2)], RANGES)
    parts = wire.encode_in_parts(frame, gone, most=2)
    assert parts.count() == 5 and wire.encode_in_parts(frame, gone).count() == 1
    one, many = ({r.text for r in content.texts(content.placed_items(updates.decode_updates(p))).collect()} for p in (wire.encode_updates(frame, gone), parts))
    assert one == many == {"".join(c for i, c in enumerate("000102030405060708") if i not in (0, 3, 9, 10))}


def many_trees(seed, docs=40):
    """(doc_id, client, clock, len, origin_client, origin_clock, content) of runs of several documents whose ids coincide; some origins are missing."""
    rng, rows = np.random.default_rng(seed), []
    for doc in range(docs):
        known, next_clock = [], {}
        for _ in range(int(rng.integers(1, 30))):
            client, length = int(rng.integers(1, 4)), int(rng.integers(1, 4))
            at = known[rng.integers(len(known))] if known and rng.random() < 0.9 else None
            clock = next_clock.get(client, 0)
            next_clock[client] = clock + length
            if rng.random() < 0.95:
                rows.append((doc, client, clock, length, *(at or (None, None)), f"{doc}/{client}:{clock}"))
            known += [(client, clock + i) for i in range(length)]
    return rows


@pytest.mark.parametrize("at_once", [1 << 20, 12, 0])
def test_readiness_of_many_documents(spark, at_once):
    rows = many_trees(11)
    held = {(d, c, k + i): content for d, c, k, n, _, _, content in rows for i in range(n)}
    origin = {content: (d, oc, ok) if oc is not None else None for d, _, _, _, oc, ok, content in rows}
    ready = {c for c, o in origin.items() if o is None}
    while more := {c for c, o in origin.items() if c not in ready and held.get(o) in ready}:
        ready |= more
    assert 0 < len(ready) < len(rows)
    found = state.causally_ready(spark.createDataFrame(rows, "doc_id long, client long, clock long, len long, origin_client long, origin_clock long, content string"), at_once)
    assert sorted(r.content for r in found.collect()) == sorted(ready)


def test_readiness_moves_rows_once(spark, tmp_path):
    """Short documents take no rounds of joins: the plan reads what it has written once, and groups it once."""
    items = spark.createDataFrame([(1, 1, i, 1, 1 if i else None, i - 1 if i else None) for i in range(300)], "doc_id long, client long, clock long, len long, origin_client long, origin_clock long")
    found = state.causally_ready(items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert found.count() == 300


def test_a_ring_of_origins_raises(spark):
    items = spark.createDataFrame([(1, 1, 0, 1, 2, 0), (1, 2, 0, 1, 1, 0), (2, 1, 0, 1, None, None)], "doc_id long, client long, clock long, len long, origin_client long, origin_clock long")
    with pytest.raises(Exception, match="ring"):
        state.causally_ready(items).collect()


def test_short_sequences_are_ordered_together(spark, monkeypatch):
    """Several documents in one call, with ids that coincide, have the places they have alone."""
    rows = many_trees(5)
    fields = "doc_id long, client long, clock long, len long, origin_client long, origin_clock long, content string"
    found = {}
    for at_once in (1 << 20, 0):
        placed = order.origin_tree_order(spark.createDataFrame(rows, fields), at_once=at_once)
        if at_once:
            assert "_group" in placed._jdf.queryExecution().executedPlan().toString()
        found[at_once] = sorted((r.doc_id, r.pos, r.client, r.clock) for r in placed.collect())
    assert found[0] == found[1 << 20] and len(found[0]) > 100


@pytest.mark.parametrize("at_once", [1 << 20, 12, 0])
def test_parents_of_many_documents(spark, at_once):
    """Parents come along chains of origins within runs and of right origins, in each document its own; a missing origin gives none."""
    rows = []
    for d, c, k, n, oc, ok, _ in many_trees(23):
        ident = {"client": oc, "clock": ok} if oc is not None else None
        right = k % 3 == 0
        name = f"{d}-{c}-{k}" if ident is None else None
        rows.append((d, c, k, n, None if right else ident, ident if right else None, name, None, f"key{d}" if ident is None and k % 2 else None))
    held = {(r[0], r[1], r[2] + i): r for r in rows for i in range(r[3])}

    def root(r):
        while r is not None and (r[4] or r[5]):
            ident = r[4] or r[5]
            r = held.get((r[0], ident["client"], ident["clock"]))
        return (r[6], r[8]) if r else (None, None)

    pair = "struct<client:long,clock:long>"
    table = spark.createDataFrame(rows, f"doc_id long, client long, clock long, len long, origin {pair}, right_origin {pair}, parent_name string, parent_id {pair}, parent_sub string")
    found = updates.resolve_parents(table, at_once)
    assert found.columns == table.columns
    wanted = sorted((*r[:3], *(str(x) for x in root(r))) for r in rows)
    assert sorted((r.doc_id, r.client, r.clock, str(r.parent_name), str(r.parent_sub)) for r in found.collect()) == wanted
    assert any(w[3] == "None" for w in wanted)


def test_parents_take_no_rounds_of_joins(spark):
    pair = "struct<client:long,clock:long>"
    table = spark.createDataFrame([(1, 1, i, 1, {"client": 1, "clock": i - 1} if i else None, None, None if i else "a", None, None) for i in range(100)], f"doc_id long, client long, clock long, len long, origin {pair}, right_origin {pair}, parent_name string, parent_id {pair}, parent_sub string")
    found = updates.resolve_parents(table)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.parent_name for r in found.collect()} == {"a"}
