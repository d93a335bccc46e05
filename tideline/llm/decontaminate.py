"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from tideline.llm.text import bounded_batches, word_lists
from tideline.plans.scratch import materialize

#: Words of a seed; an item of fewer words is one seed.
SEED_WORDS = 3
#: A seed's weight is its number of places in the corpus times that in the benchmark: the windows it would open.
#: It is rare for an item up to RARE times the median weight of the item's seeds, or up to FLOOR. The seeds of a passage that
#: very many documents share are alike in weight, and stay; a phrase that many texts or many items share stands out, and goes.
RARE, FLOOR = 4, 200
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's best possible alignment score from which a document counts as contaminated.
THRESHOLD = 0.5
#: Code points of benchmark text that one pass over the documents looks for. A larger benchmark takes several passes.
PASS_CHARS = 16_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of the n ids from each place on."""
    return reduce(lambda acc, i: (acc ^ ids[i : len(ids) - n + 1 + i].astype(np.uint64)) * _STEP, range(n), np.uint64(n))


@dataclass
class Items:
    """Benchmark items as word ids, with the places of their seeds in order of key."""

    ids: pa.Array
    vocabulary: pa.Array
    words: list[np.ndarray]
    keys: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    grams: list[int]

    @classmethod
    def of(cls, ids: pa.Array, texts: pa.Array, n: int) -> Items:
        flat, counts = word_lists(texts)
        coded = flat.dictionary_encode()
        words = np.split(coded.indices.to_numpy(zero_copy_only=False), np.cumsum(counts)[:-1]) if len(texts) else []
        places = [(min(n, len(w)), i, gram_keys(w, min(n, len(w)))) for i, w in enumerate(words) if len(w)]
        keys = np.concatenate([k for _, _, k in places]) if places else np.empty(0, np.uint64)
        item = np.concatenate([np.full(len(k), i) for _, i, k in places]) if places else np.empty(0, np.int64)
        offset = np.concatenate([np.arange(len(k)) for _, _, k in places]) if places else np.empty(0, np.int64)
        order = np.argsort(keys, kind="stable")
        return cls(ids, coded.dictionary, words, keys[order], item[order], offset[order], sorted({g for g, _, _ in places}))

    def rare(self, seen: np.ndarray) -> Items:
        """The items with their rare seeds only; ``seen`` is how often the corpus holds the key of each place."""
        if not len(self.keys):
            return self
        fresh = np.concatenate(([True], self.keys[1:] != self.keys[:-1]))
        shared = np.diff(np.append(np.flatnonzero(fresh), len(self.keys)))
        weight = seen * np.repeat(shared, shared)
        by = np.lexsort((weight, self.item))
        sizes = np.bincount(self.item, minlength=len(self.words))
        middle = np.minimum(np.cumsum(sizes) - sizes + sizes // 2, len(by) - 1)
        limit = np.maximum(RARE * weight[by][middle], FLOOR)
        kept = (weight <= limit[self.item]) & (seen > 0)
        return Items(self.ids, self.vocabulary, self.words, self.keys[kept], self.item[kept], self.offset[kept], self.grams)


def seeds_of(texts: pa.Array, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word ids of all texts, -1 for a word of no item; words of each text; then place, text and key of every gram of known words)."""
    flat, counts = word_lists(texts)
    ids = pc.fill_null(pc.index_in(flat, value_set=items.vocabulary), -1).to_numpy(zero_copy_only=False)
    ends, known = np.cumsum(counts), ids >= 0
    found = []
    for n in items.grams:
        if len(ids) < n:
            continue
        at = np.flatnonzero(reduce(np.logical_and, (known[i : len(known) - n + 1 + i] for i in range(n))))
        doc = np.searchsorted(ends, at, side="right")
        inside = at + n <= ends[doc]
        at, doc = at[inside], doc[inside]
        found.append((at, doc, reduce(lambda acc, i, at=at: (acc ^ ids[at + i].astype(np.uint64)) * _STEP, range(n), np.full(len(at), n, dtype=np.uint64))))
    at, doc = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
    return ids, counts, at, doc, np.concatenate([f[2] for f in found]) if found else np.empty(0, np.uint64)


def find_windows(batch: pa.RecordBatch, items: Items, n: int) -> pa.RecordBatch:
    """Where documents hold seeds of items: one row for each document, item and band of diagonals, with the window around it as word ids."""
    ids, counts, at, doc, keys = seeds_of(batch.column(1), items)
    starts = np.cumsum(counts) - counts
    low, high = np.searchsorted(items.keys, keys, "left"), np.searchsorted(items.keys, keys, "right")
    times = high - low
    place = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
    at, doc = np.repeat(at, times), np.repeat(doc, times)
    item, diagonal = items.item[place], at - starts[doc] - items.offset[place]
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = (x[order] for x in (doc, item, diagonal))
    sizes = np.array([len(w) for w in items.words], dtype=np.int64)
    slack = np.maximum(n, sizes[item] // 2) if len(item) else np.empty(0, np.int64)
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    doc, item = doc[first], item[first]
    lo = np.maximum(0, diagonal[first] - slack[first])
    hi = np.minimum(counts[doc], diagonal[last] + sizes[item] + slack[first]) if len(first) else lo
    windows = [ids[starts[d] + a : starts[d] + b].astype(np.int32) for d, a, b in zip(doc, lo, hi)]
    take = pa.array(doc)
    columns = [c.take(take) for c in (batch.column(0), batch.column(2))] + [pa.array(item), pa.array(lo), pa.array(windows, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "item", "start", "words"])


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """The Smith-Waterman score of each item within its window, all pairs side by side."""
    height, width = max(map(len, items)), max(map(len, windows))
    a = np.full((len(items), height), -2, dtype=np.int32)
    b = np.full((len(windows), width), -1, dtype=np.int32)
    for i, (x, y) in enumerate(zip(items, windows)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    steps = -GAP * np.arange(width + 1, dtype=np.int32)
    row, best = np.zeros((len(items), width + 1), dtype=np.int32), np.zeros(len(items), dtype=np.int32)
    for j in range(height):
        fresh = np.zeros_like(row)
        fresh[:, 1:] = row[:, :-1] + np.where(b == a[:, j : j + 1], np.int32(MATCH), np.int32(MISMATCH))
        np.maximum(fresh, row + GAP, out=fresh)
        np.maximum(fresh, 0, out=fresh)
        # Gaps along the window: the best earlier cell less its distance.
        row = np.maximum.accumulate(fresh + steps, axis=1) - steps
        best = np.maximum(best, row.max(axis=1))
    return best


def align_all(items: list[np.ndarray], windows: list[np.ndarray], cells: int = 1 << 19) -> np.ndarray:
    """``align`` of any number of pairs, those of about one width together, at most ``cells`` cells (or one pair) at a time."""
    out = np.zeros(len(items), dtype=np.int64)
    width = np.array([len(w) for w in windows], dtype=np.int64)
    order, at = np.argsort(width, kind="stable"), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * width[order[end]] <= cells:
            end += 1
        own = order[at:end]
        out[own] = align([items[i] for i in own], [windows[i] for i in own])
        at = end
    return out


def _leaks_of(docs: DataFrame, items: Items, n: int, threshold: float) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = from_arrow_type(items.ids.type).simpleString()
    keys = np.unique(items.keys)

    def count(batches):
        total = np.zeros(len(keys) + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = seeds_of(batch.column(0).slice(at, 512), items)[4]
                place = np.minimum(np.searchsorted(keys, found), max(len(keys) - 1, 0))
                total += np.bincount(place[keys[place] == found], minlength=len(total)) if len(keys) else 0
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["seed", "n"])

    # How often the corpus holds each seed is known before any seed meets an item.
    counted = bounded_batches(docs.select("text")).mapInArrow(count, "seed int, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()  # at most the seeds of the pass
    seen = np.zeros(len(keys), dtype=np.int64)
    seen[counted.column("seed").to_numpy()] = counted.column("n").to_numpy()
    rare = items.rare(seen[np.searchsorted(keys, items.keys)])

    def score(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = find_windows(batch.slice(at, 512), rare, n)
                item = found.column(2).to_numpy()
                texts = [rare.words[i] for i in item]
                share = align_all(texts, [w.values.to_numpy() for w in found.column(4)]) / np.array([MATCH * len(t) for t in texts])
                hit = np.flatnonzero(share >= threshold)
                kept = found.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), rare.ids.take(kept.column(2)), kept.column(3), pa.array(share[hit])], ["doc_id", "row_key", "item_id", "start", "score"])

    return bounded_batches(docs.select("doc_id", "text", "row_key")).mapInArrow(score, f"doc_id {kind}, row_key long, item_id {item_kind}, start long, score double")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed_words: int = SEED_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, row_key, item_id, start, score): where rows of ``docs`` hold a copy of a benchmark item.

    Words are lower-cased runs of letters and digits. A document that shares a
    rare seed with an item is aligned to it around that place; score is the
    alignment's share of the item's best, and rows from ``threshold`` on
    return, one for each separate place. ``row_key`` is a hash of the row's id
    and text, for rows whose id is null. The benchmark is read in passes of
    bounded size, each against all documents twice: to count its seeds, and to
    align what holds a rare one. Null and empty texts, and items without words
    or without an id, match nothing; an item of fewer than ``seed_words`` words
    matches where all of it stands. Whole texts are searched, however long, and
    aligned a bounded number of cells at a time. Items that tie all return.
    Repeated rows match alike; ids may be of any type; other columns are
    ignored; an empty table of either kind gives an empty result.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    items = benchmark.where(F.col(item_text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    passes = 1 + 2 * chars // PASS_CHARS if chars > PASS_CHARS else 1
    found = []
    for i in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).orderBy("item_id", "text").toArrow().combine_chunks()
        ids, texts = (rows.column(c).combine_chunks() for c in ("item_id", "text"))
        found.append(_leaks_of(own, Items.of(ids, texts, seed_words), seed_words, threshold))
    return reduce(DataFrame.unionByName, found)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` that hold no benchmark item, all columns kept.

    Null and empty texts hold none; long texts are searched whole; repeated
    rows share one fate; an empty table stays empty; columns of any name pass
    through.
    """
    # Written, so that its size is known before the documents would be shuffled to it.
    leaks = materialize(find_leaks(docs, benchmark).select(F.col("row_key").alias("_leaking_row")).distinct(), "leaks")
    return docs.join(leaks, F.xxhash64(docs["doc_id"], docs["text"]) == leaks["_leaking_row"], "left_anti")
