"""Streams: any order and any repetition of updates gives the same result."""

import random
import time

from pyspark.sql import functions as F

from tideline.streaming import live

LOG = "doc_id long, client long, clock long, len long"


def run(spark, tmp_path, batches, schema, apply, mode="append"):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/log/part{i}")
        for name in (tmp_path / "log" / f"part{i}").glob("*.parquet"):
            name.rename(tmp_path / "log" / f"{i:03d}.parquet")
    stream = live.read_log(spark, f"{tmp_path}/log/*.parquet", spark.createDataFrame([], schema).schema, files_per_batch=1)
    live.store_updates(apply(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out").collect()


def test_parked_runs_come_out_once_their_predecessors_arrive(spark, tmp_path):
    rng = random.Random(1)
    rows = [(1, c, k, 2) for c in (1, 2) for k in range(0, 20, 2)]
    rows += [(1, 1, 1, 4), *rng.sample(rows, 8)]
    rng.shuffle(rows)
    out = run(spark, tmp_path, [rows[i::5] for i in range(5)], LOG, live.in_causal_order)
    for client in (1, 2):
        spans = sorted((r.clock, r.len) for r in out if r.client == client)
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) == 20


def test_a_gap_is_never_crossed(spark, tmp_path):
    out = run(spark, tmp_path, [[(1, 1, 0, 1), (1, 1, 2, 1)], [(1, 1, 3, 1)]], LOG, live.in_causal_order)
    assert [(r.clock, r.len) for r in out] == [(0, 1)]


def test_presence_changes(spark, tmp_path):
    """States with timers always want another batch, so this query is stopped by hand. Updates of one batch apply in order of clock."""
    schema = "doc_id long, client long, clock long, state string"
    rows = [(1, 9, 5, '{"x":1}'), (1, 9, 3, '{"x":0}'), (1, 9, 6, '{"x":2}'), (1, 9, 7, "null"), (1, 8, 1, '{"z":1}')]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = live.presence_feed(live.read_log(spark, f"{tmp_path}/log", spark.createDataFrame([], schema).schema), 1_000)
    query = stream.writeStream.format("memory").queryName("presence").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            found = sorted((r.client, r.clock, r.change) for r in spark.table("presence").collect())
            if len(found) >= 6:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert found == [(8, 1, "added"), (8, 1, "expired"), (9, 3, "added"), (9, 5, "updated"), (9, 6, "updated"), (9, 7, "removed")]


def test_rooms_keep_the_latest_clock(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0, 2), (1, 1, 2, 1)], LOG).write.parquet(f"{tmp_path}/log")
    stream = live.read_log(spark, f"{tmp_path}/log", spark.createDataFrame([], LOG).schema)
    live.merge_into_rooms(live.distinct_units(stream), f"{tmp_path}/rooms", f"{tmp_path}/cp").awaitTermination()
    rooms = spark.read.parquet(f"{tmp_path}/rooms/*").groupBy("doc_id", "client").agg(F.max("next_clock").alias("n"))
    assert [(r.client, r.n) for r in rooms.collect()] == [(1, 3)]


def test_runs_parked_in_tables_come_out_once(spark, tmp_path):
    rng = random.Random(2)
    rows = [(d, c, k, 2) for d in (1, 2) for c in (1, 2) for k in range(0, 20, 2)]
    rows += [(1, 1, 1, 4), (1, 3, 5, 1), *rng.sample(rows, 8)]
    rng.shuffle(rows)
    for i in range(5):
        spark.createDataFrame(rows[i::5], LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = live.read_log(spark, f"{tmp_path}/log", spark.createDataFrame([], LOG).schema, files_per_batch=2)
    live.release_runs(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out/released").collect()
    for doc, client in ((1, 1), (1, 2), (2, 1), (2, 2)):
        spans = sorted((r.clock, r.len) for r in out if (r.doc_id, r.client) == (doc, client))
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) == 20
    assert not [r for r in out if r.client == 3] and len({r.batch for r in out}) > 1


def test_documents_are_stored_and_loaded_merged(spark, tmp_path):
    from tideline.sources import updates, wire

    names = "origin right_origin parent_name parent_id parent_sub str bin vals fmt_key type_class node_name move_target move_len".split()
    none = spark.createDataFrame([], LOG)
    for i, text in enumerate(("ab", "cd", "x" * 500)):
        row = {"doc_id": 1, "client": 1 + i // 2, "clock": 2 * (i % 2), "len": len(text), "content_type": "string", **dict.fromkeys(names), "str": text, "parent_name": "t"}
        wire.encode_updates(spark.createDataFrame([row], "doc_id long, " + wire.STRUCT), none).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    live.store_documents(live.read_log(spark, f"{tmp_path}/in", schema, 1), f"{tmp_path}/docs", f"{tmp_path}/cp", most_bytes=100).awaitTermination()
    live.compact_documents(spark, f"{tmp_path}/docs", f"{tmp_path}/small")
    for path in ("docs", "small"):
        merged = live.load_documents(spark, f"{tmp_path}/{path}")
        assert merged.count() == 1 and sorted((r.clock, r.str) for r in updates.decode_updates(merged).collect()) == [(0, "ab"), (2, "cd")]
