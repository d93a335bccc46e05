"""Protocol messages read into rows: sync steps, presence, snapshots and relative positions, and the replies that they ask for."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.presence import valid_state
from tideline.sources.merge import diff_encoded
from tideline.sources.updates import Reader, decode_state_vectors, decoded, read_ranges, read_vector
from tideline.sources.wire import sync_message

# Channels of a message, and limits that are checked before one is read.
CHANNELS = {0: "sync", 1: "presence", 2: "auth", 3: "query_presence"}
STEPS = {0: "asks", 1: "replies", 2: "update"}
MOST_CLIENTS, STATE_BYTES, FRAME_BYTES, VECTOR_BYTES = 100_000, 1 << 20, 64 << 20, 64 << 10


def within(data: Column, most: int) -> Column:
    """Whether a binary is there and no larger than ``most`` bytes."""
    return F.coalesce(F.octet_length(data) <= most, F.lit(False))


def _sync(reader: Reader) -> Iterator[dict]:
    kind = reader.uint()
    if kind not in STEPS:
        raise ValueError("unknown message")
    yield {"channel": "sync", "kind": kind, "payload": reader.bytes()}


def _frame(reader: Reader) -> Iterator[dict]:
    if len(reader.data) > FRAME_BYTES:
        raise ValueError("a message is too long")
    channel = CHANNELS.get(reader.uint())
    if channel == "sync":
        yield from _sync(reader)
    elif channel == "presence":
        yield {"channel": channel, "payload": reader.bytes()}
    elif channel:
        reader.at = len(reader.data)  # nothing of these is used
        yield {"channel": channel}
    else:
        raise ValueError("unknown channel")


_MESSAGE = "channel string, kind int, payload binary"


def decode_sync(messages: DataFrame) -> DataFrame:
    """(doc_id, channel, kind, payload, error) of sync ``messages(doc_id, message)`` by kind: 0 asks with a state vector, 1 replies, 2 is an update."""
    return decoded(messages, "message", _MESSAGE, _sync)


def decode_frames(frames: DataFrame) -> DataFrame:
    """The same of ``frames(doc_id, message)``, which name their channel first: sync messages, presence updates, and others without a payload."""
    return decoded(frames, "message", _MESSAGE, _frame)


def replies(read: DataFrame, updates: DataFrame) -> DataFrame:
    """(doc_id, message): the answer to each document's requests among ``read``, rows of decode_sync or decode_frames, from its ``updates(doc_id, update)``.

    A request holds a state vector; the answer is the part of the document that
    it lacks. Of several requests for one document the answer is to their least.
    """
    asked = decode_state_vectors(read.where("channel = 'sync' and kind = 0").select("doc_id", F.col("payload").alias("sv")).where(within(F.col("sv"), VECTOR_BYTES)))
    known = asked.where("error is null").groupBy("doc_id", "client").agg(F.min("next_clock").alias("next_clock"))
    docs = read.where("channel = 'sync' and kind = 0").select("doc_id").distinct()
    return diff_encoded(updates.join(docs, "doc_id", "left_semi"), known).select("doc_id", sync_message(1, F.col("update")).alias("message"))


def incoming(read: DataFrame, most: int = FRAME_BYTES) -> DataFrame:
    """(doc_id, update): the replies and updates among ``read`` that are to be merged, those of up to ``most`` bytes."""
    return read.where("channel = 'sync' and kind in (1, 2)").where(within(F.col("payload"), most)).select("doc_id", F.col("payload").alias("update"))


def _presence(reader: Reader) -> Iterator[dict]:
    n = reader.uint()
    if n > MOST_CLIENTS:
        raise ValueError("too many clients")
    for _ in range(n):
        client, clock, text = reader.uint(), reader.uint(), reader.bytes()
        if len(text) > STATE_BYTES:
            raise ValueError("a state is too large")
        yield {"client": client, "clock": clock, "state": text.decode()}


def decode_presence(updates: DataFrame, raw: bool = False) -> DataFrame:
    """(doc_id, client, clock, state, error) of ``updates(doc_id, update)``; a state that is no valid JSON object is null, or as it came if ``raw``."""
    found = decoded(updates, "update", "client long, clock long, state string", _presence)
    return found if raw else found.withColumn("state", valid_state(F.col("state")))


def _snapshot(reader: Reader) -> Iterator[dict]:
    for kind, part in enumerate((reader.bytes(), reader.bytes())):
        own = Reader(part)
        for row in read_vector(own) if kind == 0 else read_ranges(own):
            yield {"kind": kind, "client": row["client"], "clock": row.get("next_clock", row.get("clock")), "len": row.get("len")}
        if own.at != len(part):
            raise ValueError("bytes are left over")


def decode_snapshots(snapshots: DataFrame) -> DataFrame:
    """(doc_id, kind, client, clock, len, error) of ``snapshots(doc_id, snapshot)``: kind 0 the state vector, 1 the deleted ranges."""
    return decoded(snapshots, "snapshot", "kind int, client long, clock long, len long", _snapshot)


def _position(reader: Reader) -> Iterator[dict]:
    kind = reader.uint()
    row: dict = {}
    if kind == 1:
        row["client"], row["clock"] = reader.uint(), reader.uint()
    elif kind == 2:
        row["name"] = reader.text()
    else:
        raise ValueError("unknown position")
    row["assoc"] = reader.signed()
    yield row


def decode_relative_positions(positions: DataFrame) -> DataFrame:
    """(doc_id, client, clock, name, assoc, error) of ``positions(doc_id, position)``: an item's id, or the name of a root type for its end, and the side."""
    return decoded(positions, "position", "client long, clock long, name string, assoc int", _position)
