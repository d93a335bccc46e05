"""Masked pseudo-likelihood: a window network predicts every word from the words on both its sides.

The network reads the embeddings of the words around a masked place and
predicts the word there in two steps, both from that context: the class of the
word, then the word among those of its class. A document's score is the sum of
the log probabilities of all its words.

Documents are dealt into shards by their content, and a shard trains in one
order, so the model and all scores are the same however the input is split
into files.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.text import bounded_batches, word_lists
from tideline.plans.scratch import discard, materialize

WORDS, CLASSES, SIDE, WIDTH, HIDDEN = 4095, 64, 2, 12, 24
#: Each round of training masks every ROUNDS-th place of each document, the next round the places after them: all places once.
ROUNDS = 2
#: Words of a shard, about: what one trainer sees in a round. Shards grow in number with the corpus.
SHARD_WORDS = 1 << 21
#: A word outside the vocabulary is spelled, each letter one of so many.
ALPHABET = 64


@dataclass
class WindowModel:
    """The vocabulary with each word's class and log frequency within it, and the network."""

    vocabulary: list[str]
    word_class: np.ndarray
    params: list[np.ndarray]

    def __post_init__(self):
        # Words stand by class, so those of one class are a slice.
        self.bounds = np.searchsorted(self.word_class, np.arange(CLASSES + 1))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all whole texts; each task sums its own words first."""

    def run(batches):
        for batch in batches:
            found = pc.value_counts(word_lists(batch.column(0))[0])
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])

    return bounded_batches(docs.select("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def classes_of(counts: np.ndarray, classes: int) -> np.ndarray:
    """The class of words by falling count, the last being all unknown ones, which are the last class.

    Classes hold about equal shares of the corpus, so a frequent word has one to itself.
    """
    share = counts[:-1] / max(counts[:-1].sum(), 1e-12)
    known = np.minimum(((np.cumsum(share) - share / 2) * (classes - 1)).astype(np.int64), classes - 2)
    return np.append(known, classes - 1)


def start_params(counts: np.ndarray, seed: int = 3) -> list[np.ndarray]:
    """Embeddings of the words, the unknown word and the outside of a text; the hidden layer; weights and constants of the classes, then of the words.

    Constants start at the log frequencies, so that training begins from the
    corpus' own distribution.
    """
    words = len(counts) - 1
    rng = np.random.default_rng(seed)
    share = np.log(np.maximum(counts, 1e-3) / counts.sum())
    mass = np.log(np.maximum(np.bincount(classes_of(counts, CLASSES), np.exp(share), minlength=CLASSES), 1e-6))
    normal = lambda scale, *size: rng.normal(0, scale, size)
    made = [normal(0.3, words + 2, WIDTH), normal((2 * SIDE * WIDTH) ** -0.5, 2 * SIDE * WIDTH, HIDDEN), np.zeros(HIDDEN), normal(0.1, HIDDEN, CLASSES), mass, normal(0.05, words + 1, HIDDEN), share]
    return [p.astype(np.float32) for p in made]


def contexts(flat: np.ndarray, places: np.ndarray) -> np.ndarray:
    """[places, 2 * SIDE]: the words around each place."""
    return flat[places[:, None] + np.array([o for o in range(-SIDE, SIDE + 1) if o])]


def padded(ids: np.ndarray, counts: np.ndarray, outside: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' ids in one array with SIDE places of ``outside`` around each, and the place of each id."""
    places = np.arange(len(ids)) + SIDE * (1 + np.repeat(np.arange(len(counts)), counts))
    flat = np.full(len(ids) + SIDE * (len(counts) + 1), outside, dtype=np.int32)
    flat[places] = ids
    return flat, places


def hidden(params: list[np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = params[0][context].reshape(len(context), -1)
    return x, np.tanh(x @ params[1] + params[2])


def soften(z: np.ndarray) -> np.ndarray:
    """Exponentials of logits, held to where a float stays finite."""
    return np.exp(np.clip(z, -30, 30, out=z), out=z)


def by_class(model: WindowModel, wanted: np.ndarray):
    """(class, its first word, the word after its last, the places that want a word of it), for classes of several words."""
    kinds = model.word_class[wanted].astype(np.uint16)
    order = np.argsort(kinds, kind="stable")  # 16 bits sort by counting
    cuts = np.searchsorted(kinds[order], np.arange(CLASSES + 1))
    for c in np.flatnonzero(np.diff(cuts)):
        low, high = model.bounds[c], model.bounds[c + 1]
        if high - low > 1:
            yield c, low, high, order[cuts[c] : cuts[c + 1]]


def word_log_probs(model: WindowModel, context: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The log probability of the word ``wanted`` at each place: that of its class, and its own within the class."""
    _, _, _, w2, b2, w3, b3 = model.params
    h = hidden(model.params, context)[1]
    p = soften(h @ w2 + b2)
    out = np.log(p[np.arange(len(p)), model.word_class[wanted]] / p.sum(axis=1)).astype(np.float64)
    for _, low, high, at in by_class(model, wanted):
        p = soften(h[at] @ w3[low:high].T + b3[low:high])
        out[at] += np.log(p[np.arange(len(p)), wanted[at] - low] / p.sum(axis=1))
    return out


class Trainer:
    """Adagrad steps on one shard's masked places."""

    def __init__(self, model: WindowModel, rate: float = 0.1):
        self.model = WindowModel(model.vocabulary, model.word_class, [p.copy() for p in model.params])
        self.seen = [np.full_like(p, 1e-3) for p in model.params]
        self.uses = np.zeros(len(model.params[0]))
        self.told = np.zeros(len(model.params[5]))
        self.rate, self.examples = rate, 0

    def _move(self, i: int, rows, gradient: np.ndarray) -> None:
        self.seen[i][rows] += gradient * gradient
        self.model.params[i][rows] -= self.rate * gradient / np.sqrt(self.seen[i][rows])

    def step(self, context: np.ndarray, wanted: np.ndarray) -> None:
        n, (_, w1, _, w2, b2, w3, b3) = len(context), self.model.params
        x, h = hidden(self.model.params, context)
        p = soften(h @ w2 + b2)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), self.model.word_class[wanted]] -= 1
        p /= n
        dh = p @ w2.T
        for _, low, high, at in by_class(self.model, wanted):
            own = h[at]
            q = soften(own @ w3[low:high].T + b3[low:high])
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(q)), wanted[at] - low] -= 1
            q /= n
            dh[at] += q @ w3[low:high]
            self._move(5, slice(low, high), q.T @ own)
            self._move(6, slice(low, high), q.sum(axis=0))
            self.told[low:high] += len(at)
        dh *= 1 - h * h
        dx = (dh @ w1.T).reshape(-1, WIDTH)
        words = context.reshape(-1).astype(np.uint16)
        order = np.argsort(words, kind="stable")
        sorted_words = words[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_words[1:] != sorted_words[:-1])))
        rows = sorted_words[first]
        self.uses[rows] += np.diff(np.append(first, len(words)))
        self.examples += n
        self._move(0, rows, np.add.reduceat(dx[order], first, axis=0))
        for i, g in ((1, x.T @ dh), (2, dh.sum(axis=0)), (3, h.T @ p), (4, p.sum(axis=0))):
            self._move(i, slice(None), g)

    def weights(self) -> np.ndarray:
        """How much each parameter has been trained, side by side: words by their use as context, those of a class by the places that wanted one of it."""
        whole = lambda i: np.full(self.model.params[i].size, float(self.examples))
        return np.concatenate([np.repeat(self.uses, WIDTH), *(whole(i) for i in (1, 2, 3, 4)), np.repeat(self.told, HIDDEN), self.told])


def _encode(docs: DataFrame, vocabulary: list[str], kind: str) -> DataFrame:
    """(doc_id, ids, spelled): word ids of whole texts, and the letters of words outside the vocabulary."""
    known = pa.array(vocabulary, pa.string())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                words, counts = word_lists(part.column(1))
                found = pc.index_in(words, value_set=known)
                letters = np.where(found.is_null().to_numpy(zero_copy_only=False), pc.utf8_length(words).to_numpy(zero_copy_only=False), 0)
                total = np.concatenate(([0], np.cumsum(letters)))
                ends = np.cumsum(counts)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pc.fill_null(found, len(vocabulary)).cast(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(total[ends] - total[ends - counts])], ["doc_id", "ids", "spelled"])

    return docs.mapInArrow(run, f"doc_id {kind}, ids array<int>, spelled long")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def masked_places(counts: np.ndarray, phase: int) -> np.ndarray:
    """The places of round ``phase`` in documents of ``counts`` words that lie one after another, by their place within the document."""
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.flatnonzero(within % ROUNDS == phase)


def train_round(sharded: DataFrame, model: WindowModel, phase: int, batch_size: int = 8192) -> list[np.ndarray]:
    """Each shard trains from the model's parameters on its documents in their order; the result is the shards' mean, weighted by use."""
    outside = len(model.vocabulary) + 1

    def run(key, table):
        trainer = Trainer(model)
        table = table.sort_by([("place", "ascending")])
        for at in range(0, table.num_rows, 1024):
            ids, counts = _lists(table.column("ids").slice(at, 1024).combine_chunks())
            flat, places = padded(ids, counts, outside)
            masked = masked_places(counts, phase)
            context, wanted = contexts(flat, places[masked]), ids[masked]
            for i in range(0, len(masked), batch_size):
                trainer.step(context[i : i + batch_size], wanted[i : i + batch_size])
        values, weight = np.concatenate([p.reshape(-1) for p in trainer.model.params]).astype(np.float64), trainer.weights()
        own = np.flatnonzero(weight)
        return pa.table({"i": own.astype(np.int32), "v": values[own] * weight[own], "w": weight[own]})

    summed = sharded.groupBy("shard").applyInArrow(run, "i int, v double, w double").groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v")).toArrow()  # the parameters
    flat = np.concatenate([p.reshape(-1) for p in model.params]).astype(np.float64)
    flat[summed.column("i").to_numpy()] = summed.column("v").to_numpy()
    cuts = np.cumsum([p.size for p in model.params])[:-1]
    return [part.reshape(p.shape).astype(np.float32) for part, p in zip(np.split(flat, cuts), model.params)]


def fit(encoded: DataFrame, vocabulary: list[str], counts: np.ndarray, total: int) -> WindowModel:
    """The model of ``encoded(doc_id, ids, ...)``; ``counts`` are those of the vocabulary, then of all other words."""
    model = WindowModel(vocabulary, classes_of(counts, CLASSES), start_params(counts))
    # By content and id: repeated documents train as often as they occur, spread over the shards; rows without an id by a number of their own.
    place = F.xxhash64("ids", F.coalesce(F.col("doc_id").cast("string"), F.monotonically_increasing_id().cast("string")))
    shards = max(1, -(-total // SHARD_WORDS))
    sharded = encoded.where(F.size("ids") > 0).select("ids", place.alias("place")).withColumn("shard", F.pmod("place", F.lit(shards)))
    for phase in range(ROUNDS):
        model.params = train_round(sharded, model, phase)
    return model


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob) of every row of ``docs`` under a model trained on all of them.

    Words are lower-cased runs of letters and digits of the whole text. The
    vocabulary is the corpus' WORDS most frequent words, ties by the words
    themselves; counts and scores come from every document, and every word is a
    training target once. A text without words, or null, has 0 words, log_prob
    0 and no mean. Long texts are trained on and scored whole. Repeated rows
    get equal scores to single precision, however the rows are partitioned;
    other columns are ignored; an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    counted = materialize(count_words(own), "words")
    top = counted.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    total = counted.agg(F.sum("n")).first()[0] or 0
    discard(counted)
    counts = np.array([r["n"] for r in top], dtype=np.float64)
    vocabulary = [r["word"] for r in top]
    encoded = materialize(_encode(own, vocabulary, kind), "ids")
    model = fit(encoded, vocabulary, np.append(counts, max(total - counts.sum(), 1.0)), total)

    def score(batches):
        outside = len(model.vocabulary) + 1
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, counts = _lists(part.column(1))
                flat, places = padded(ids, counts, outside)
                logs = np.zeros(len(ids))
                for i in range(0, len(ids), 16384):
                    s = slice(i, i + 16384)
                    logs[s] = word_log_probs(model, contexts(flat, places[s]), ids[s])
                sums = np.zeros(len(counts))
                held = counts > 0
                sums[held] = np.add.reduceat(logs, (np.cumsum(counts) - counts)[held]) - part.column(2).to_numpy()[held] * np.log(ALPHABET)
                mean = pa.array(sums / np.maximum(counts, 1), mask=~held)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.array(sums), mean], ["doc_id", "n_words", "log_prob", "mean_log_prob"])

    return encoded.mapInArrow(score, f"doc_id {kind}, n_words long, log_prob double, mean_log_prob double")
