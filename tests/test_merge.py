"""Whole updates: merged in any order, cut anywhere, carried to the other format and back."""

from pyspark.sql import functions as F

from tideline.sources import columnar, merge, updates, wire

NAMES = "origin right_origin parent_name parent_id parent_sub str bin vals fmt_key type_class node_name move_target move_len".split()


def run(clock, text, client=1, **more):
    return {"doc_id": 1, "client": client, "clock": clock, "len": len(text.encode("utf-16-le")) // 2, "content_type": "string", **dict.fromkeys(NAMES), "str": text, "parent_name": "t", **more}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, " + wire.STRUCT)


def coded(spark, *batches, gone=()):
    none = spark.createDataFrame(list(gone), "doc_id long, client long, clock long, len long")
    out = None
    for rows in batches:
        one = wire.encode_updates(frame(spark, rows), none)
        out = one if out is None else out.unionByName(one)
    return out


def texts(df, decode=updates.decode_updates):
    return sorted((r.client, r.clock, r.len, r.str, r.content_type) for r in decode(df).collect())


def test_overlapping_updates_merge_in_any_order(spark):
    one, two = [run(0, "Hello"), run(0, "x", client=2)], [run(3, "lo, world")]
    wanted = [(1, 0, 5, "Hello", "string"), (1, 3, 2, None, "range"), (1, 5, 7, ", world", "string"), (2, 0, 1, "x", "string")]
    for batches in ((two, one), (one, two, one)):
        assert texts(merge.merge_encoded(coded(spark, *batches, gone=[(1, 1, 3, 2)]))) == wanted
    cut = next(r for r in updates.decode_updates(merge.merge_encoded(coded(spark, one, two))).collect() if r.clock == 5)
    assert tuple(cut.origin) == (1, 4)


def test_a_diff_holds_what_is_missing(spark):
    known = spark.createDataFrame([(1, 1, 3)], "doc_id long, client long, next_clock long")
    vals = run(0, "", client=3) | {"len": 3, "content_type": "any", "str": None, "vals": ["1", "2", "3"]}
    log = coded(spark, [run(0, "ab👍cd"), run(0, "x", client=2), vals])
    assert texts(merge.diff_encoded(log, known)) == [(1, 3, 3, "�cd", "string"), (2, 0, 1, "x", "string"), (3, 0, 3, None, "any")]
    more = spark.createDataFrame([(1, 1, 6), (1, 2, 1), (1, 3, 1)], known.schema)
    left = updates.decode_updates(merge.diff_encoded(log, more)).collect()
    assert [(r.client, r.clock, r.vals) for r in left] == [(3, 1, ["2", "3"])]


def test_formats_carry_over(spark):
    log = coded(spark, [run(0, "Hello"), run(9, "later")], gone=[(1, 1, 0, 1)])
    there = merge.to_columnar(log)
    assert texts(there, columnar.decode_columnar) == texts(log)
    assert texts(merge.from_columnar(there)) == texts(log)
    assert merge.merge_encoded(log.where(F.lit(False))).count() == 0
