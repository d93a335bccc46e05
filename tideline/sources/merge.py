"""Whole binary updates merged, cut against state vectors, and carried from one format to the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.runs import cut, cut_front, without_overlaps
from tideline.plans.scratch import materialize
from tideline.sources.columnar import decode_columnar, encode_columnar
from tideline.sources.updates import decode_updates
from tideline.sources.wire import encode_updates


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = rows.where("error is null").drop("error")
    return good.where("content_type != 'range'"), good.where("content_type = 'range'").select("doc_id", "client", "clock", "len")


def merge_encoded(updates: DataFrame, decode: Callable = decode_updates, encode: Callable = encode_updates) -> DataFrame:
    """(doc_id, update): all ``updates(doc_id, update)`` of each document as one, parked runs included; malformed ones are left out."""
    structs, ranges = _parts(materialize(decode(updates), "merge"))
    return encode(without_overlaps(structs), ranges)


def diff_encoded(updates: DataFrame, known: DataFrame, decode: Callable = decode_updates, encode: Callable = encode_updates) -> DataFrame:
    """(doc_id, update): what ``updates`` hold at or after ``known(doc_id, client, next_clock)``, with the whole delete set."""
    structs, ranges = _parts(materialize(decode(updates), "diff"))
    joined = without_overlaps(structs).join(known, ["doc_id", "client"], "left")
    offset = F.greatest(F.lit(0), F.coalesce("next_clock", F.lit(0)) - F.col("clock"))
    return encode(cut_front(joined, offset).drop("next_clock"), ranges)


def encode_from_snapshot(updates: DataFrame, snapshots: DataFrame, decode: Callable = decode_updates, encode: Callable = encode_updates) -> DataFrame:
    """(doc_id, update): each document of ``updates`` as it was at ``snapshots(doc_id, sv, ds)``: units below the state vector, deleted as the snapshot says.

    Documents without a snapshot are left out; runs are cut at the border.
    """
    structs, _ = _parts(materialize(decode(updates), "past"))
    vector = snapshots.select("doc_id", F.inline("sv")).withColumnRenamed("next_clock", "_upto")
    below = without_overlaps(structs).join(vector, ["doc_id", "client"])
    below = cut(below, F.lit(0), F.least(F.col("len"), F.col("_upto") - F.col("clock"))).drop("_upto")
    return encode(below, snapshots.select("doc_id", F.inline("ds")))


def to_columnar(updates: DataFrame) -> DataFrame:
    """Updates in the row format as updates in the columnar one, one for each document."""
    return merge_encoded(updates, decode_updates, encode_columnar)


def from_columnar(updates: DataFrame) -> DataFrame:
    """Updates in the columnar format as updates in the row one, one for each document."""
    return merge_encoded(updates, decode_columnar, encode_updates)
