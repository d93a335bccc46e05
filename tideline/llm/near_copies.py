"""Near copies by their shared word shingles: all texts whose sets of shingles are alike, confirmed on the sets.

Fingerprints nominate texts, by the search that the caller gives, and MinHash
bands those whose fingerprints lie too far apart. Nominated texts are joined into
blocks, and within a block every text meets every other on its exact set of
shingles, so no link is false. With 40 bands of 6 a pair at similarity 0.8 misses
all of them once in 190,000 times, one above it less often.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.text import bounded_batches
from tideline.plans.components import connected_components
from tideline.plans.keyset import may_hold
from tideline.plans.scratch import discard, materialize

SEED = 42
SHINGLE = 5
#: Least share of common shingles (intersection by union) of near copies.
SIMILAR = 0.8
BANDS, ROWS = 40, 6
#: Texts and shingles that one tile of a block holds, about.
TILE, TILE_SHINGLES = 512, 1 << 19

_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


_SPREAD = np.array([sum(((v >> i) & 1) << (8 * i) for i in range(8)) for v in range(256)], dtype=np.uint64)


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit ``hashes`` have each bit set."""
    lanes = _SPREAD[hashes.view(np.uint8)].reshape(-1, 8)
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def majority_bits(counts: np.ndarray, n: int) -> int:
    """The fingerprint of ``n`` hashes of which ``counts`` have each bit set."""
    return int(((2 * counts > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit hashes of a whole text's shingles, repeats included; a text of fewer words is one shingle, without words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=n)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, shingle))


def set_key(shingles: np.ndarray) -> int:
    """One signed long for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def band_keys(shingles: np.ndarray, piece: int = 512) -> np.ndarray:
    """[BANDS]: keys that two sets share with probability similarity ** ROWS each."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(short), piece):
        np.minimum(least, ((short[i : i + piece, None] ^ _FLIP) * _ODD).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def block_links(nodes: np.ndarray, flat: np.ndarray, counts: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """[links, 2]: a spanning forest of all pairs of ``nodes`` whose sets, one after another in ``flat``, are alike."""
    codes = np.unique(flat, return_inverse=True)[1]
    starts = np.cumsum(counts) - counts
    inside = np.zeros(len(flat), dtype=np.uint8)
    rest, rest_codes = np.arange(len(nodes)), codes
    queue, found = [], []

    def leave(keep: np.ndarray) -> None:
        nonlocal rest, rest_codes
        rest, rest_codes = rest[keep], rest_codes[np.repeat(keep, counts[rest])]

    while len(rest):
        if queue:
            at = queue.pop()
        else:
            at = rest[0]
            leave(np.arange(len(rest)) > 0)
            if not len(rest):
                break
        own = codes[starts[at] : starts[at] + counts[at]]
        inside[own] = 1
        shared = np.add.reduceat(inside[rest_codes], np.cumsum(counts[rest]) - counts[rest], dtype=np.int64)
        inside[own] = 0
        near = shared >= similar * (counts[at] + counts[rest] - shared) - 1e-9
        if near.any():
            found.append(np.stack([nodes[rest[near]], np.full(int(near.sum()), nodes[at])], axis=1))
            queue += rest[near].tolist()
            leave(~near)
    return np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)


def first_rows(docs: DataFrame, near_prints: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Two tables of (doc_id, text_key). First the first row of each component of near copies, which is that of the least doc_id, then text_key.

    ``text_key`` is the hash of the text, 42 for a null one; ``repeats`` tells whether several rows have both. Texts of equal sets
    of shingles are copies; those of similarity ``similar`` or more are linked. ``near_prints`` links distinct SimHash fingerprints
    (fp) that lie near each other as (u, v). The second table has the ids and texts of all rows but those that stand alone for their
    component.
    """
    own = bounded_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key")))
    kind = own.schema["doc_id"].dataType.simpleString()

    def sketch(batches):
        for batch in batches:
            keys, prints, bands = np.empty(batch.num_rows, dtype=np.int64), np.empty(batch.num_rows, dtype=np.uint64), np.empty((batch.num_rows, BANDS), dtype=np.int64)
            for i, text in enumerate(batch.column(1)):
                hashes = shingle_hashes(text.as_py(), shingle)
                shingles = np.unique(hashes)
                keys[i], bands[i] = set_key(shingles), band_keys(shingles)
                prints[i] = majority_bits(set_bits(hashes), len(hashes)) if len(hashes) else 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys), pa.array(prints.view(np.int64)), lists], ["doc_id", "text_key", "node", "fp", "bands"])

    def to_sets(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(text.as_py(), shingle) for text in part.column(2)]
                counts = np.array([len(s) for s in sets], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts), lists], ["node", "block", "n", "shingles"])

    def links(key, table):
        table = table.filter(pc.greater(table.column("n"), 0)).combine_chunks()
        lists = table.column("shingles")
        flat = np.concatenate([c.flatten().to_numpy() for c in lists.chunks]) if lists.num_chunks else np.empty(0, dtype=np.int64)
        found = block_links(table.column("node").to_numpy(), flat, table.column("n").to_numpy().astype(np.int64), similar)
        return pa.table({"u": found[:, 0], "v": found[:, 1]})

    sketched = materialize(own.mapInArrow(sketch, f"doc_id {kind}, text_key long, node long, fp long, bands array<long>"), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_key")).alias("first")
    distinct = materialize(sketched.groupBy("node").agg(first, F.min("text_key").alias("text_key"), F.min("fp").alias("fp")), "distinct")

    # The trees' links, and sets of one fingerprint: each stands for itself by its least set.
    prints = materialize(distinct.groupBy("fp").agg(F.min("node").alias("hub")), "prints")
    by_print = distinct.join(prints, "fp").where("node != hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    hub = lambda c: prints.select(F.col("fp").alias(c), F.col("hub").alias(f"{c}_hub"))
    by_tree = near_prints(prints.select("fp")).join(hub("u"), "u").join(hub("v"), "v").select(F.col("u_hub").alias("u"), F.col("v_hub").alias("v"))

    # One row of each set speaks for its copies.
    reps = distinct.select(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"))
    speaks = sketched["doc_id"].eqNullSafe(reps["_id"]) & (sketched["text_key"] == reps["_key"])
    rows = sketched.join(reps, speaks, "left_semi").select("node", F.explode("bands").alias("band"))
    by_band = rows.withColumn("hub", F.min("node").over(Window.partitionBy("band"))).where("node != hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    nominated = materialize(by_band.unionByName(by_tree).unionByName(by_print).distinct(), "nominated")
    blocks = materialize(connected_components(nominated).join(distinct, "node").select("node", F.col("root").alias("block"), "text_key"), "blocks")

    # Only texts that stand for a set of some block move.
    wanted = may_hold(blocks.select(F.col("text_key").alias("key")))
    texts = own.where(wanted(F.col("text_key"))).select("text_key", "text").join(blocks, "text_key").select("node", "block", "text").dropDuplicates(["node"])
    sets = materialize(texts.mapInArrow(to_sets, "node long, block long, n int, shingles array<long>"), "sets")
    sizes = materialize(sets.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles")), "sizes")
    # A block of several tiles is compared tile against tile: each text goes to one group for every tile of its block.
    tiled = sets.join(sizes, "block").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles").cast("long")).cast("int"))
    dealt = tiled.select("node", "block", "n", "shingles", "own", F.explode(F.sequence(F.lit(0), F.greatest("tiles", F.lit(1)) - 1)).alias("other"))
    groups = dealt.select("node", "block", "n", "shingles", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    # Dealt by tile, not by block, so that the tiles of a large block are the work of many tasks.
    linked = materialize(groups.repartition("block", "a", "b").groupBy("block", "a", "b").applyInArrow(links, "u long, v long").distinct(), "links")

    # Of the sets of a component all go but that of its first row.
    members = materialize(connected_components(linked).join(distinct, "node").select("root", "node", F.struct("first.lost", "first.doc_id", "first.text_key", "node").alias("at")), "members")
    later = materialize(members.select("node").join(members.groupBy("root").agg(F.min("at").alias("least")).select("least.node"), "node", "left_anti"), "later")
    discard(sets, sizes, nominated, blocks, prints, linked, members)
    firsts = distinct.join(later, "node", "left_anti").select("first.doc_id", "first.text_key")
    often = sketched.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    often = often.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), (F.col("n") > 1).alias("repeats"))
    same = often["_id"].eqNullSafe(firsts["doc_id"]) & (often["_key"] == firsts["text_key"])
    rows = materialize(often.join(firsts.withColumn("stays", F.lit(True)), same, "left").select(F.col("_id").alias("doc_id"), F.col("_key").alias("text_key"), "repeats", F.coalesce("stays", F.lit(False)).alias("stays")), "rows")
    discard(sketched, later)
    return rows.where("stays").drop("stays"), rows.where("repeats or not stays").select("doc_id", "text_key")
