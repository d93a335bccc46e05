"""SimHash near-duplicates by vantage-point trees over the fingerprints.

A node of a tree has a vantage point and a radius: fingerprints within the
radius lie inside, the others outside. The leaves are shards. Every fingerprint
has its home in one leaf. One that lies so near a node's border that the
triangle bound can't rule out neighbours on the other side also probes that
side, and there every branch that the bound leaves open; so shards overlap at
their borders, all other branches are pruned, and each linked pair meets in a
shard. There both are compared over all 64 bits: no link is lost, none false.

Distances among 64-bit fingerprints crowd around 32, so at a radius of 4 a level
prunes no more than a third of the branches that a probe could take, and probes
grow by about 1.68 a level. One tree therefore serves up to TREE_POINTS
fingerprints. Of more, each tree holds those that agree on some bit ranges:
``radius`` differing bits touch at most ``radius`` parts of the 64 bits, so any
linked pair agrees in full on a choice of the other parts and meets in the tree
of that choice, which stays small.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import near_copies
from tideline.llm.text import bounded_batches
from tideline.plans.components import connected_components
from tideline.plans.keyset import may_hold
from tideline.plans.scratch import materialize

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Points that one shard is home to, about; larger leaves are compared tile by tile.
SHARD = 2048
#: Fingerprints that one tree holds, about.
TREE_POINTS = 1 << 15
#: Fingerprints from which the trees' thresholds are taken. Any trees give exact pairs; the sample only balances them.
FIT_SAMPLE = 1 << 16
#: Levels of a tree at most.
DEPTH = 10

def fingerprint(text: str | None, shingle: int = SHINGLE, piece: int = 1 << 15) -> int:
    """The 64-bit SimHash of a whole text; 0 for a text without words.

    Words are runs of anything but ASCII white space, A-Z in lower case; repeated
    shingles count again. Long texts are hashed ``piece`` shingles at a time.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for i in range(0, n, piece):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[i : i + piece], ends[i : i + piece])]
        counts += near_copies.set_bits(np.array(hashes, dtype="<u8"))
    return near_copies.majority_bits(counts, n)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""

    def run(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, f"doc_id {kind}, fp long")


def tree_keys(radius: int, whole: int) -> list[list[tuple[int, int]]]:
    """The (first bit, bits) ranges that each tree is over: all choices of ``whole`` of radius + whole even parts of the 64 bits.

    ``radius`` differing bits touch at most so many parts, so any linked pair
    agrees in full on one of the choices.
    """
    parts = radius + whole
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    return [list(key) for key in combinations([(a, b - a) for a, b in zip(edges, edges[1:])], whole)]


def code_of(prints: np.ndarray, key: list[tuple[int, int]]) -> np.ndarray:
    """The bits of a key, side by side; 0 for a key without ranges."""
    out = np.zeros(len(prints), dtype=np.uint64)
    for first, bits in key:
        out = out << np.uint64(bits) | (prints >> np.uint64(first)) & np.uint64((1 << bits) - 1)
    return out


def rest_of(key: list[tuple[int, int]]) -> np.uint64:
    """A mask of the bits outside a key: fingerprints that agree on the key differ there alone."""
    held = sum(((1 << bits) - 1) << first for first, bits in key)
    return np.uint64((1 << 64) - 1 - held)


def grow_tree(sample: np.ndarray, mask: np.uint64, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A complete vantage-point tree of ``depth`` levels over the bits of ``mask``: (vantage, radius) by heap index.

    Each node takes a random vantage point among its fingerprints and the radius
    that parts them most evenly.
    """
    rng = np.random.default_rng(seed)
    vantage = rng.integers(0, 1 << 64, 1 << depth, dtype=np.uint64, endpoint=False)
    radius = np.full(1 << depth, int(mask).bit_count() // 2, dtype=np.int64)
    node = np.ones(len(sample), dtype=np.int64)
    for _ in range(depth):
        by = np.argsort(node, kind="stable")
        cuts = np.flatnonzero(np.diff(node[by])) + 1
        for own in np.split(by, cuts) if len(by) else ():
            at = node[own[0]]
            vantage[at] = sample[own[rng.integers(len(own))]]
            share = np.cumsum(np.bincount(np.bitwise_count((sample[own] ^ vantage[at]) & mask), minlength=65)) / len(own)
            radius[at] = int(np.argmin(np.abs(share - 0.5)))
        node = 2 * node + (np.bitwise_count((sample ^ vantage[node]) & mask) > radius[node])
    return vantage, radius


def route(prints: np.ndarray, tree: tuple[np.ndarray, np.ndarray], mask: np.uint64, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, leaf, probes) of every visit of the fingerprints to a leaf: each point's home, and the leaves that it probes.

    A pair is met once: where a node parts it, the point inside probes the
    outside. A probe follows every branch that may hold a point within ``near``.
    """
    vantage, radius = tree
    point, node, probes = np.arange(len(prints)), np.ones(len(prints), dtype=np.int64), np.zeros(len(prints), dtype=bool)
    for _ in range(len(vantage).bit_length() - 1):
        d = np.bitwise_count((prints[point] ^ vantage[node]) & mask).astype(np.int64) - radius[node]
        inside = np.where(probes, d <= near, d <= 0)
        outside = np.where(probes, d > -near, d > 0)
        across = ~probes & (d <= 0) & (d > -near)
        parts = [(inside, 0, probes), (outside, 1, probes), (across, 1, np.ones(len(probes), dtype=bool))]
        point, node, probes = (np.concatenate(x) for x in zip(*((point[m], 2 * node[m] + side, p[m]) for m, side, p in parts)))
    return point, node, probes


def shard_links(prints: np.ndarray, radius: int) -> np.ndarray:
    """[links, 2]: each linked fingerprint with the least of its component within the shard."""
    n, near = len(prints), np.zeros(len(prints), dtype=bool)
    close = lambda one, all_: np.bitwise_count(one[:, None] ^ all_[None, :]) <= radius
    for i in range(0, n, 256):
        near[i : i + 256] = close(prints[i : i + 256], prints).sum(axis=1) > 1
    linked = np.sort(prints[near].view(np.int64)).view(np.uint64)
    label = np.arange(len(linked))
    if not len(linked):
        return np.empty((0, 2), dtype=np.int64)
    while True:
        least = np.concatenate([np.where(close(linked[i : i + 256], linked), label[None, :], len(label)).min(axis=1) for i in range(0, len(label), 256)])
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    keep = label != np.arange(len(label))
    return np.stack([linked.view(np.int64)[keep], linked.view(np.int64)[label[keep]]], axis=1)


def across_links(homes: np.ndarray, probes: np.ndarray, radius: int) -> np.ndarray:
    """Links that join every probe with the homes within ``radius`` of it."""
    home, probe = np.zeros(len(homes), dtype=bool), np.zeros(len(probes), dtype=bool)
    for i in range(0, len(probes), 256):
        close = np.bitwise_count(probes[i : i + 256, None] ^ homes[None, :]) <= radius
        probe[i : i + 256] = close.any(axis=1)
        home |= close.any(axis=0)
    return shard_links(np.union1d(homes[home], probes[probe]), radius)


def near_pairs(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD, whole: int | None = None) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``prints(fp)`` that join all within ``radius`` bits.

    Each shard returns a spanning forest of its links, not all of them, so the
    rows stay in proportion to the fingerprints however large a group is.
    ``whole`` is how many bit ranges the fingerprints of one tree agree on; by
    default as few as keep a tree to about TREE_POINTS. Any choice gives the
    same links.
    """
    total = prints.count()
    if whole is None:
        whole = next((k for k in range(5) if total <= TREE_POINTS << (64 * k // (radius + k))), 5)
    keys = tree_keys(radius, whole)
    share = min(1.0, FIT_SAMPLE / max(1, total))
    sample = prints.sample(share, seed=7).limit(2 * FIT_SAMPLE).toArrow().column("fp").to_numpy().view(np.uint64)
    in_tree = max(1, total >> (64 * whole // (radius + whole)))
    depth = min(DEPTH, max(0, math.ceil(math.log2(in_tree / shard)))) if in_tree > shard else 0
    masks = [rest_of(key) for key in keys]
    trees = [grow_tree(sample, mask, depth, seed=i) for i, mask in enumerate(masks)]

    def to_leaves(batches):
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for i, (key, mask, tree) in enumerate(zip(keys, masks, trees)):
                point, leaf, probes = route(own, tree, mask, radius)
                fps = own[point]
                yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(np.full(len(fps), i, dtype=np.int32)), pa.array(code_of(fps, key).view(np.int64)), pa.array(leaf.astype(np.int32)), pa.array(probes)], ["fp", "tree", "code", "leaf", "probes"])

    def links(key, table):
        fps, probes = (table.column(c).to_numpy() for c in ("fp", "probes"))
        fps = fps.view(np.uint64)
        found = across_links(np.unique(fps[~probes]), np.unique(fps[probes]), radius) if key[3].as_py() else shard_links(np.unique(fps), radius)
        return pa.table({"u": found[:, 0], "v": found[:, 1]})

    place = ["tree", "code", "leaf"]
    routed = materialize(prints.select("fp").mapInArrow(to_leaves, "fp long, tree int, code long, leaf int, probes boolean"), "leaves")
    tiles = lambda probes, size: F.ceil(F.sum((F.col("probes") == probes).cast("long")) / size).cast("int")
    sizes = materialize(routed.groupBy(place).agg(tiles(False, shard).alias("homes"), tiles(True, 4 * shard).alias("visits")), "sizes")
    # A leaf's home tiles meet each other (across 0), and each of them each tile of its probes (across 1).
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("probes"), F.col("visits")).otherwise(F.col("homes")).cast("long")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    meet = lambda across, a, b: F.struct(F.lit(across).alias("across"), a.alias("a"), b.alias("b"))
    with_homes = F.transform(upto("homes"), lambda t: meet(0, F.least("own", t), F.greatest("own", t)))
    with_probes = F.when(F.col("visits") > 0, F.transform(upto("visits"), lambda t: meet(1, F.col("own"), t)))
    as_probe = F.transform(upto("homes"), lambda t: meet(1, t, F.col("own")))
    groups = F.when(F.col("probes"), as_probe).when(F.col("visits") > 0, F.concat(with_homes, with_probes)).otherwise(with_homes)
    dealt = routed.join(sizes, place).where("homes > 0").withColumn("own", own).select("fp", "probes", *place, F.inline(groups))
    # Dealt by tile, not by leaf, so that the tiles of a large leaf are the work of many tasks.
    group = [*place, "across", "a", "b"]
    return dealt.repartition(*group).groupBy(*group).applyInArrow(links, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Fingerprints within ``radius`` bits are linked; component_id is the least
    doc_id that links reach, the document's own included. A null or wordless
    text has fingerprint zero and is linked like any other. Repeated rows come
    back as often as they went in; a null doc_id counts only where no other
    doc_id is reachable (component_id is then null). Other columns of ``docs``
    are ignored, long texts hashed whole. An empty table gives an empty result.
    """
    prints = materialize(with_fingerprints(docs, id_col, text_col, shingle), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    links = materialize(near_pairs(distinct, radius).distinct(), "links")
    # A fingerprint stands as its least document, so that the root of a component is the component's least document.
    node = distinct.select("fp", F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "fp").alias("node"))
    edges = links.join(node.withColumnsRenamed({"fp": "u", "node": "a"}), "u").join(node.withColumnsRenamed({"fp": "v", "node": "b"}), "v")
    roots = connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    moved = roots.select(F.col("node.fp").alias("fp"), F.col("root.doc_id").alias("least"), F.lit(True).alias("linked"))
    by_print = distinct.join(moved, "fp", "left").select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
    # Written, so that the join of all copies is alone in its stage, where adaptive execution splits a fingerprint of very many.
    by_print = materialize(by_print, "components")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = near_copies.SHINGLE, similar: float = near_copies.SIMILAR) -> DataFrame:
    """One row of ``docs`` for each component of near-duplicates: that of the least doc_id, all columns kept.

    Near-duplicates share ``similar`` of their ``shingle``-word shingles or
    more. The trees nominate texts whose fingerprints lie within RADIUS bits;
    most near-duplicates are further apart, so bands of MinHash nominate too, and
    the sets of shingles decide. Of one id the
    text of least hash stays, of equal rows one; rows without an id stay only
    where their component has none with an id. Null, empty and wordless texts
    are one component; long texts are compared whole; an empty table stays
    empty; columns of any name pass through.
    """
    firsts, others = near_copies.first_rows(docs, near_pairs, id_col, text_col, shingle, similar)
    # Rows that surely stand alone for their component stay where they are; only the others' texts move, to meet the exact keys.
    key = lambda ident, text: F.xxhash64(ident, text)
    unsure = may_hold(others.select(key(F.col("doc_id"), F.col("text_key")).alias("key")))
    text_key = F.xxhash64(docs[text_col])
    held = unsure(key(docs[id_col], text_key))
    some = docs.where(held)

    def rows_of(which: DataFrame) -> DataFrame:
        which = which.select(F.col("doc_id").alias("_first_id"), F.col("text_key").alias("_first_text"))
        return some.join(which, docs[id_col].eqNullSafe(which["_first_id"]) & (text_key == which["_first_text"]))

    # Of the few rows that repeat an id and text one is picked; all others are there once.
    nth = F.row_number().over(Window.partitionBy("_first_id", "_first_text").orderBy("_first_id"))
    picked = rows_of(firsts.where("repeats")).withColumn("_nth_of_row", nth).where("_nth_of_row = 1")
    return docs.where(~held).unionByName(rows_of(firsts.where("not repeats")).select(docs.columns)).unionByName(picked.select(docs.columns))
