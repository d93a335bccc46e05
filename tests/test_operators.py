"""Operators on small hand-made logs, and laws that hold for any log."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import text as tx
from tideline.operators import history, order, positions, presence, state, values
from tideline.sources import tables

LOG = "doc_id long, client long, clock long, len long"


def ranges(df):
    return sorted((r.client, r.clock, r.len) for r in df.collect())


def test_ranges_compact_when_they_overlap_or_touch(spark):
    df = spark.createDataFrame([(1, 1, 0, 2), (1, 1, 2, 3), (1, 1, 4, 1), (1, 1, 9, 1), (1, 2, 0, 5), (1, 2, 1, 1), (1, 2, 5, 1)], LOG)
    assert ranges(state.compact_ranges(df)) == [(1, 0, 5), (1, 9, 1), (2, 0, 6)]
    assert ranges(state.merge_delete_sets(df, df)) == [(1, 0, 5), (1, 9, 1), (2, 0, 6)]


def test_units_in_a_wide_range_are_found_across_buckets(spark):
    wide = spark.createDataFrame([(1, 1, 1000, 5000)], LOG)
    units = spark.range(900, 6100, 50).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("client"), F.col("id").alias("clock"))
    assert sorted(r.clock for r in state.in_delete_set(units, wide).collect()) == list(range(1000, 6000, 50))
    assert {(r.run_clock, r.offset) for r in state.find_containing(wide, units).collect()} == {(1000, k - 1000) for k in range(1000, 6000, 50)}


def test_diff_trims_a_run_that_is_partly_known(spark):
    log = spark.createDataFrame([(1, 1, 0, 4), (1, 1, 4, 4), (1, 2, 0, 3)], LOG)
    known = spark.createDataFrame([(1, 1, 6)], "doc_id long, client long, next_clock long")
    assert ranges(state.diff_since(log, known)) == [(1, 6, 2), (2, 0, 3)]
    assert state.diff_since(log, state.state_vector(log)).count() == 0


def test_merging_is_idempotent_and_in_any_order(spark):
    log = [(1, c, k, 1) for c in range(3) for k in range(5)]
    one, two = spark.createDataFrame(log[:10], LOG), spark.createDataFrame(log[5:], LOG)
    assert ranges(state.merge_updates(one, two)) == ranges(state.merge_updates(two, one, one)) == sorted(r[1:] for r in log)


def test_runs_after_a_gap_wait(spark):
    log = spark.createDataFrame([(1, 1, 0, 2), (1, 1, 5, 1), (1, 1, 6, 1), (1, 2, 1, 1)], LOG)
    found = {(r.client, r.clock): (r.parked, r.missing_from) for r in state.park_gaps(log).collect()}
    assert found == {(1, 0): (False, None), (1, 5): (True, 2), (1, 6): (True, 2), (2, 1): (True, 0)}


ITEMS = "doc_id long, client long, clock long, origin_client long, origin_clock long, content string"


def read_order(spark, items):
    rows = order.origin_tree_order(spark.createDataFrame([(1, *i) for i in items], ITEMS)).collect()
    assert sorted(r.pos for r in rows) == list(range(len(items)))
    return "".join(r.content for r in sorted(rows, key=lambda r: r.pos))


@pytest.mark.parametrize(
    ("items", "text"),
    [
        ([(1, 0, None, None, "A"), (2, 0, None, None, "B")], "AB"),
        ([(1, 0, None, None, "A"), (1, 1, 1, 0, "C"), (2, 0, None, None, "B")], "ACB"),
        ([(2, 0, 1, 0, "b"), (1, 0, None, None, "a")], "ab"),
        ([(7, 3, None, None, "x")], "x"),
        ([(1, 5, None, None, "2"), (1, 9, None, None, "1")], "12"),
    ],
)
def test_order_of_small_sequences(spark, items, text):
    assert read_order(spark, items) == text


def plain_order(items):
    """Pre-order of the origin tree by recursion."""
    def below(origin):
        out = []
        for i in sorted((i for i in items if i[2:4] == origin), key=lambda i: (i[0], -i[1])):
            out += [i, *below((i[0], i[1]))]
        return out

    return below((None, None))


def test_order_is_the_same_for_any_delivery(spark):
    rng = random.Random(42)
    items, clocks = [], {c: 0 for c in range(4)}
    for i in range(120):
        c = rng.randrange(4)
        o = rng.choice(items) if items and rng.random() < 0.9 else None
        items.append((c, clocks[c], o[0] if o else None, o[1] if o else None, chr(0x4E00 + i)))
        clocks[c] += 1
    wanted = "".join(i[4] for i in plain_order(items))
    for _ in range(2):
        rng.shuffle(items)
        assert read_order(spark, items) == wanted


def test_a_long_chain_needs_few_rounds(spark):
    chain = [(1, i, 1 if i else None, i - 1 if i else None, chr(0x4E00 + i)) for i in range(700)]
    assert read_order(spark, chain) == "".join(i[4] for i in chain)


def test_blocked_chains_are_not_ready(spark):
    rows = [(1, 1, 0, None, None), (1, 1, 1, 1, 0), (1, 2, 5, 9, 9), (1, 2, 6, 2, 5), (1, 2, 7, 2, 6), (1, 3, 0, 1, 1)]
    ready = state.causally_ready(spark.createDataFrame(rows, "doc_id long, client long, clock long, origin_client long, origin_clock long"))
    assert sorted((r.client, r.clock) for r in ready.collect()) == [(1, 0), (1, 1), (3, 0)]


def test_lists_texts_and_moves(spark):
    items = spark.createDataFrame([(1, 1, i, c, i == 1) for i, c in enumerate("axbcd")], "doc_id long, client long, clock long, content string, deleted boolean")
    by = [F.col("clock")]
    assert values.text_value(items, by).first().text == "abcd"
    assert values.list_value(items, by).first()["items"] == list("abcd")
    assert [r.content for r in sorted(values.list_slice(items, by, 1, 99).collect(), key=lambda r: r.pos)] == list("bcd")
    moves = spark.createDataFrame([(1, 1, 4, 2, 0, 2), (1, 1, 4, 1, 7, 0), (1, 1, 4, 3, 0, 1)], "doc_id long, target_client long, target_clock long, client long, clock long, to_rank long")
    moved = sorted(values.list_move(items, moves, by).collect(), key=lambda r: r.pos)
    assert "".join(r.content for r in moved) == "dabc"


def test_last_write_of_a_key_counts(spark):
    rows = [(1, "k", 1, 0, "v1", False), (1, "k", 2, 0, "v2", False), (1, "gone", 1, 1, "x", False), (1, "gone", 1, 2, None, True)]
    for _ in range(2):
        rows.reverse()
        log = spark.createDataFrame(rows, "doc_id long, key string, client long, clock long, value string, deletes boolean")
        assert [(r.key, r.value) for r in values.map_value(log).collect()] == [("k", "v2")]
        assert json.loads(values.map_entries(log).first().json) == {"k": "v2"}


def test_formats_hold_until_a_marker_ends_them(spark):
    rows = [(1, 0, None, True, "bold"), (1, 1, "Hello", False, None), (1, 2, None, True, None), (1, 3, ", world!", False, None)]
    runs = values.attribute_runs(spark.createDataFrame(rows, "doc_id long, clock long, content string, is_marker boolean, attribute string"), [F.col("clock")])
    assert [(r.text, r.attribute) for r in sorted(runs.collect(), key=lambda r: r.run)] == [("Hello", "bold"), (", world!", None)]


def test_delta_between_two_states(spark):
    rows = [(1, 0, "Hello ", False, False, False), (1, 1, "World", True, False, False), (1, 2, "Go👍", False, True, False), (1, 3, "old", True, False, True), (1, 4, "!", False, False, False)]
    items = spark.createDataFrame(rows, "doc_id long, clock long, content string, deleted boolean, new boolean, was boolean")
    delta = values.text_delta(items, [F.col("clock")], F.col("new"), F.col("was"))
    assert [(r.op, r.insert, r.n) for r in sorted(delta.collect(), key=lambda r: r.step)] == [("retain", None, 6), ("delete", None, 5), ("insert", "Go👍", 4)]


def test_xml(spark):
    row = spark.range(1).select(
        values.xml_element("div", {"id": F.lit("main"), "class": F.lit("b<\"&>"), "no": F.lit(None)}, F.lit(None)).alias("a"),
        values.xml_element("p", {}, values.xml_text(F.lit('<em>bold</em> & "quoted"'))).alias("b"),
    ).first()
    assert row.a == '<div class="b&lt;&quot;&amp;>" id="main"></div>'
    assert row.b == '<p>&lt;em&gt;bold&lt;/em&gt; &amp; "quoted"</p>'


def test_scalars(spark):
    texts = ["A👍B", "", "abc", "👍👍", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(tx.utf16_length(F.col("t")).alias("n")).collect()] == [4, 0, 3, 4, 1]
    part = df.select(*(tx.utf16_slice(F.col("t"), a, n).alias(f"s{a}{n}") for a, n in ((0, 1), (1, 2), (0, 2), (2, 1), (1, 1)))).collect()
    assert tuple(part[0]) == ("A", "👍", "A�", "�", "�")
    assert tuple(part[1]) == ("",) * 5
    assert tuple(part[2]) == ("a", "bc", "ab", "c", "b")
    names = spark.createDataFrame([("room",), ("",), (".",), ("..",), ("a\nb",), ("é" * 128,), (None,)], "n string")
    assert [r.ok for r in names.select(tx.room_name_valid(F.col("n")).alias("ok")).collect()] == [True, False, False, False, False, False, False]
    jsons = spark.createDataFrame([("{}",), ("1",), ('{"a":[{"b":"]]]"}]}',), ('"open',), ('"\\"{"',)], "j string")
    assert [r.d for r in jsons.select(tx.json_depth(F.col("j")).alias("d")).collect()] == [1, 0, 3, None, 0]
    maps = spark.createDataFrame([({"b": "1", "i": "2"}, {"b": "0", "u": "3"})], "now map<string,string>, old map<string,string>")
    assert maps.select(tx.attribute_changes(F.col("now"), F.col("old")).alias("m")).first().m == {"b": "1", "i": "2", "u": None}


def test_snapshots_restore_the_past(spark):
    rows = [(1, 1, 0, 5, "a", False), (1, 1, 5, 1, "b", True), (1, 1, 6, 2, "c", False), (1, 2, 0, 1, "d", False)]
    log = spark.createDataFrame(rows, LOG + ", key string, deletes boolean")
    taken = history.capture_snapshot(log.where("clock < 6"))
    later = log.withColumn("deletes", F.lit(True))
    back = history.restore(later, taken)
    assert sorted((r.client, r.clock, r.len, r.key, r.deletes) for r in back.collect()) == [(1, 0, 5, "a", False), (1, 5, 1, "b", True), (2, 0, 1, "d", False)]
    cut = history.restore(log, spark.createDataFrame([(1, [(1, 3)], [])], "doc_id long, sv array<struct<client:long,next_clock:long>>, ds array<struct<client:long,clock:long,len:long>>"))
    assert ranges(cut) == [(1, 0, 3)]
    assert state.equal_states(log, log).first().equal and not state.equal_states(log, later).first().equal


def test_squash_garbage_and_undo(spark):
    rows = [(1, 1, i, 1, f"k{i}", str(i), d, t) for i, (d, t) in enumerate([(False, 0.0), (False, 0.4), (True, 0.8), (True, 5.0), (False, 5.2)])]
    log = spark.createDataFrame(rows, LOG + ", key string, value string, deletes boolean, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    assert sorted((r.clock, r.len) for r in history.squash_runs(log, [F.col("deletes")]).collect()) == [(0, 2), (2, 2), (4, 1)]
    assert sorted((r.clock, r.len, r.is_gc) for r in history.collect_garbage(log).collect()) == [(0, 1, False), (1, 1, False), (2, 2, True), (4, 1, False)]
    groups = history.undo_groups(log, 0.5).collect()
    assert sorted((r.first_clock, r.next_clock, r.n_deletes) for r in groups) == [(0, 3, 1), (3, 5, 1)]
    assert len(history.undo_groups(log, 0.5, F.col("clock") == 1).collect()) == 3
    assert sorted((r.clock, r.len, r.action) for r in history.undo_last(log, 0.5).collect()) == [(3, 1, "revive"), (4, 1, "delete")]


def test_positions_survive_edits(spark):
    runs = spark.createDataFrame([(1, 1, 0, 5, False), (1, 2, 0, 3, True), (1, 3, 0, 4, False)], LOG + ", deleted boolean")
    by = [F.col("client")]
    indices = spark.range(0, 10).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("index"))
    anchors = positions.relative_positions(runs, indices, by)
    back = positions.absolute_positions(runs, anchors.where("assoc = 0").select("doc_id", "client", "clock", "assoc"), by)
    assert sorted(r["index"] for r in back.collect()) == list(range(9))
    assert [r["index"] for r in anchors.where("assoc = -1").collect()] == [9]
    gone = positions.absolute_positions(runs.withColumn("deleted", F.col("client") != 3), spark.createDataFrame([(1, 3, 2, 0)], "doc_id long, client long, clock long, assoc int"), by)
    assert gone.first()["index"] == 2


def test_presence(spark):
    t = lambda n: f"2024-01-01 00:00:{n:02d}"
    deep = "[" * 21 + "]" * 21
    rows = [(1, 9, 5, '{"x":1}', t(1), 0), (1, 9, 3, '{"x":0}', t(2), 1), (1, 9, 6, "null", t(3), 2), (1, 9, 7, '{"y":1}', t(40), 3), (1, 8, 1, '{"z":1}', t(1), 0), (1, 7, 1, deep, t(50), 0)]
    log = spark.createDataFrame(rows, "doc_id long, client long, clock long, state string, ts string, seq long").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r.clock, r.change) for r in presence.presence_changes(log).where("client = 9").orderBy("clock").collect()] == [(5, "added"), (6, "removed"), (7, "added")]
    live = presence.presence_states(log, F.lit(t(55)).cast("timestamp"), 30)
    assert [(r.client, r.clock) for r in live.collect()] == [(9, 7)]


def test_edits_by_index(spark):
    from tideline.operators import edit

    runs = spark.createDataFrame([(1, 1, 0, 5, False), (1, 2, 0, 3, True), (1, 3, 0, 4, False)], LOG + ", deleted boolean")
    by = [F.col("client")]
    new = edit.insert_at(runs, spark.createDataFrame([(1, 0, "ab", 1), (1, 5, "👍", 1), (1, 9, "z", 8)], "doc_id long, index long, content string, client long"), by).collect()
    at = {r.content: (r.client, r.clock, r.len, tuple(r.origin or ()), tuple(r.right_origin or ())) for r in new}
    assert at == {"ab": (1, 5, 2, (), (1, 0)), "👍": (1, 7, 2, (1, 4), (3, 0)), "z": (8, 0, 1, (3, 3), ())}
    gone = edit.delete_at(runs, spark.createDataFrame([(1, 1, 2), (1, 2, 4), (1, 8, 50)], "doc_id long, index long, n long"), by)
    assert ranges(gone) == [(1, 1, 4), (3, 0, 1), (3, 3, 1)]
    steps = spark.createDataFrame([(1, 1, "retain", None, 6), (1, 2, "delete", None, 5), (1, 3, "insert", "Go", 2)], "doc_id long, step long, op string, insert string, n long")
    assert [(r.op, r["index"]) for r in sorted(edit.delta_steps(steps).collect(), key=lambda r: r.step)] == [("delete", 6), ("insert", 11)]


def test_equal_states_by_brute_force(spark):
    """Deleted runs that overlap or touch, clients and documents of one side only, and a log without deletions."""
    one = [(1, 1, 0, 4, False), (1, 1, 1, 2, True), (1, 1, 2, 2, True), (2, 1, 0, 2, True), (3, 1, 0, 1, False), (4, 1, 0, 2, False), (5, 1, 0, 2, True), (6, 1, 0, 3, False), (7, 1, 0, 1, None)]
    two = [(1, 1, 0, 4, False), (1, 1, 1, 3, True), (2, 1, 0, 1, True), (2, 1, 1, 1, False), (3, 1, 0, 1, False), (3, 2, 0, 1, False), (5, 1, 0, 1, True), (5, 1, 1, 1, True), (6, 1, 0, 2, False), (7, 1, 0, 1, False), (8, 1, 0, 1, True)]

    def facts(rows, doc):
        own = [r for r in rows if r[0] == doc]
        return {c: max(r[2] + r[3] for r in own if r[1] == c) for c in {r[1] for r in own}}, {(r[1], u) for r in own if r[4] for u in range(r[2], r[2] + r[3])}

    fields = "doc_id long, client long, clock long, len long, deletes boolean"
    found = state.equal_states(spark.createDataFrame(one, fields), spark.createDataFrame(two, fields))
    assert {r.doc_id: r.equal for r in found.collect()} == {d: facts(one, d) == facts(two, d) for d in range(1, 9)}


def windows_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Window [")


def test_equal_states_sorts_both_logs_together(spark):
    log = spark.createDataFrame([(1, 1, 0, 1, True)], "doc_id long, client long, clock long, len long, deletes boolean")
    assert windows_of(state.equal_states(log, log)) == windows_of(state.delete_set(log))


def test_tasks_of_edits_grow_in_number_not_in_rows(spark):
    events = spark.range(400_000).selectExpr("id as event_id", "timestamp_seconds(1700000000 + id) as ts", "id % 1500 as user_id", "'view' as event_type", "1.0d as value", "'k' as props")
    rows = [r["count"] for r in tables.edits(events).groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(rows) == 400_000 and max(rows) < 1.5 * tables.TASK_DOCS * tables.DOC_EVENTS


def test_undo_compacts_inserted_and_deleted_runs_in_one_sort(spark):
    log = spark.createDataFrame([(1, 1, 0, 1, "2024-01-01 00:00:00", True)], "doc_id long, client long, clock long, len long, ts string, deletes boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    groups = history.stack_state(history.undo_groups(log, 1.0), 1)
    assert windows_of(history.undo_last(log, 1.0)) == windows_of(groups) + windows_of(state.delete_set(log))
