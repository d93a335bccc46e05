"""Structured Streaming over operation logs: duplicates, parked runs, state vectors and presence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.operators.presence import valid_state
from tideline.plans.scratch import discard, materialize
from tideline.sources.merge import merge_encoded


def read_log(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """The append log at ``path`` as a stream of its new files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def distinct_units(stream: DataFrame) -> DataFrame:
    """Each unit once, however often its update arrives."""
    return stream.dropDuplicates(["doc_id", "client", "clock"])


def next_clocks(stream: DataFrame) -> DataFrame:
    """(doc_id, client, next_clock), for update or complete mode."""
    return stream.groupBy("doc_id", "client").agg(F.max(F.col("clock") + F.col("len")).alias("next_clock"))


def _release(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the next clock due, and the runs parked beyond it."""
    due, clocks, lengths = state.get if state.exists else (0, [], [])
    parked = dict(zip(clocks, lengths))
    for batch in batches:
        for clock, length in zip(batch["clock"].tolist(), batch["len"].tolist()):
            parked[clock] = max(length, parked.get(clock, 0))
    out = []
    for clock in sorted(parked):
        if clock > due:
            break
        end = clock + parked.pop(clock)
        if end > due:
            out.append((*key, due, end - due))
            due = end
    state.update((due, list(parked), list(parked.values())))
    yield pd.DataFrame(out, columns=["doc_id", "client", "clock", "len"])


def in_causal_order(stream: DataFrame) -> DataFrame:
    """(doc_id, client, clock, len): runs of each client without gaps; a run whose predecessors are missing waits for them.

    Nothing is dropped for its age. Known units are left out and a run that is
    partly known is trimmed, so replayed updates change nothing. Each client's
    parked runs are one value of its state; ``release_runs`` keeps them in
    tables instead, for streams where very many wait.
    """
    kind = stream.schema["doc_id"].dataType.simpleString()
    own = stream.select("doc_id", "client", "clock", "len")
    return own.groupBy("doc_id", "client").applyInPandasWithState(_release, f"doc_id {kind}, client long, clock long, len long", "due long, clocks array<long>, lens array<long>", "append", GroupStateTimeout.NoTimeout)


def _track(timeout_ms: int) -> Callable:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock, text = state.get if state.exists else (-1, None)
        out = []
        if state.hasTimedOut:
            state.remove()
            if text is not None:
                out.append((*key, clock, "expired"))
        else:
            for batch in batches:
                for c, s in sorted(zip(batch["clock"].tolist(), batch["state"].tolist()), key=lambda x: x[0]):
                    if c <= clock:
                        continue
                    if s is not None or text is not None:
                        out.append((*key, c, "added" if text is None else "removed" if s is None else "updated"))
                    clock, text = c, s
            state.update((clock, text))
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["doc_id", "client", "clock", "change"])

    return step


def presence_feed(stream: DataFrame, timeout_ms: int = 30_000) -> DataFrame:
    """(doc_id, client, clock, change) as presence updates arrive: added, updated, removed, and expired after the timeout.

    Only a clock above the client's last one counts, and a state that isn't valid
    counts as none; updates of one batch apply in order of clock. The timers keep such a query running until it is stopped.
    """
    kind = stream.schema["doc_id"].dataType.simpleString()
    own = stream.select("doc_id", "client", "clock", valid_state(F.col("state")).alias("state"))
    return own.groupBy("doc_id", "client").applyInPandasWithState(_track(timeout_ms), f"doc_id {kind}, client long, clock long, change string", "clock long, state string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def released(runs: DataFrame, due: DataFrame) -> DataFrame:
    """``runs(doc_id, client, clock, len)`` after ``due(doc_id, client, next_clock)``: (doc_id, client, clock, len, parked).

    What follows the client's due clock without a gap is released, cut to the
    units that are new; what stands beyond a gap is parked as it is; what is
    known already is left out.
    """
    keys = ["doc_id", "client"]
    order = Window.partitionBy(*keys).orderBy("clock", "len")
    rows = runs.join(due.select(*keys, F.col("next_clock").alias("_due")), keys, "left")
    reached = F.greatest(F.coalesce("_due", F.lit(0)), F.coalesce(F.max(F.col("clock") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_reached", reached)
    rows = rows.withColumn("parked", F.max(F.col("clock") > F.col("_reached")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.col("clock") + F.col("len")
    rows = rows.where(F.col("parked") | (end > F.col("_reached")))
    return rows.select(*keys, F.when(F.col("parked"), F.col("clock")).otherwise(F.col("_reached")).alias("clock"), F.when(F.col("parked"), F.col("len")).otherwise(end - F.col("_reached")).alias("len"), "parked")


def release_runs(stream: DataFrame, folder: str, checkpoint: str):
    """The same as ``in_causal_order``, written to ``folder/released`` batch by batch; returns the running query.

    Due clocks and parked runs are logs beside it, to which each batch appends
    what it learned; a batch looks up only the clients that it holds, and the
    windows that decide run in the JVM. A batch that runs again overwrites its
    own part of each log, so every unit comes out once.
    """
    keys = ["doc_id", "client"]
    schema = "doc_id {}, client long, clock long, len long, batch long".format(stream.schema["doc_id"].dataType.simpleString())

    def log(spark: SparkSession, name: str, batch_id: int) -> DataFrame:
        # Logs of batches before this one only.
        return spark.read.schema(schema).parquet(f"{folder}/{name}").where(F.col("batch") < batch_id)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        put = lambda rows, name: rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        fresh = batch.select(*keys, "clock", "len").persist()
        if batch_id:
            touched = fresh.select(*keys).distinct()
            due = log(spark, "due", batch_id).join(touched, keys, "left_semi").groupBy(keys).agg(F.max("clock").alias("next_clock"))
            waiting = log(spark, "parked", batch_id).join(touched, keys, "left_semi").drop("batch").distinct()
        else:
            due, waiting = fresh.limit(0).select(*keys, F.col("clock").alias("next_clock")), fresh.limit(0)
        found = materialize(released(fresh.unionByName(waiting), due), "released")
        out = found.where("not parked").drop("parked")
        put(out, "released")
        put(out.groupBy(keys).agg(F.max(F.col("clock") + F.col("len")).alias("clock"), F.lit(0).cast("long").alias("len")), "due")
        put(found.where("parked").drop("parked"), "parked")
        fresh.unpersist()
        discard(found)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_documents(stream: DataFrame, path: str, checkpoint: str, most_bytes: int = 64 << 20):
    """Append the updates of ``stream(doc_id, update)`` to the log of each document at ``path``, but for those over ``most_bytes``; returns the running query.

    The batch is part of the path, so a batch that runs again overwrites itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.where(F.octet_length("update") <= most_bytes).select("doc_id", "update")
        own.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_documents(spark: SparkSession, path: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, update): each stored document as one merged update; of ``doc_ids(doc_id)`` alone if given."""
    updates = spark.read.parquet(path).select("doc_id", "update")
    return merge_encoded(updates if doc_ids is None else updates.join(doc_ids, "doc_id", "left_semi"))


def compact_documents(spark: SparkSession, path: str, target: str) -> None:
    """Write the merged documents of the log at ``path`` as a new log at ``target``, one update each."""
    load_documents(spark, path).write.mode("overwrite").parquet(f"{target}/batch=-1")


def store_updates(stream: DataFrame, table_path: str, checkpoint: str):
    """Append the stream to the log at ``table_path``, each batch exactly once; returns the running query."""
    return stream.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_into_rooms(stream: DataFrame, rooms_path: str, checkpoint: str):
    """Keep (doc_id, client, next_clock) per batch under ``rooms_path``; the latest row of each client is its state.

    The batch id is part of the path, so a batch that runs again overwrites itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        next_clocks(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{rooms_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
