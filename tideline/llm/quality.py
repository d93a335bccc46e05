"""Quality scores by positive-unlabelled learning.

Trusted positives and all unlabelled web text train a logistic model on the
non-negative unbiased risk: with class prior p, logistic loss l and log-odds g,

    p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)]).

The prior is estimated from positives and unlabelled text as well. No negative
label is ever seen. The logistic loss is proper, so the model's output is the
log-odds of label 1 as it stands and needs no calibration.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.text import map_texts
from tideline.plans.scratch import discard, materialize

#: Byte shares, then length, word length, repeated bytes, repeated words, distinct words.
FEATURES = 256 + 5
#: Bound of the labelled rows of a fit: about so many positives, taken by a hash of the id. Unlabelled text has no bound.
FIT_LABELLED = 12_000
THRESHOLD = 0.3
RIDGE = 1e-2
BEND = 100.0
#: Bins of the log-odds when the class prior is estimated.
BINS, BIN_RANGE = 2048, 16.0
#: Tasks of one pass over the unlabelled text at most.
PASS_TASKS = 4096

def features(texts: pa.Array) -> np.ndarray:
    """[texts, FEATURES] of whole texts, to half precision; zeros for null and empty ones."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    words = pc.split_pattern_regex(pc.utf8_trim_whitespace(texts), r"\s+") if len(texts) else None
    codes = pc.list_flatten(words).dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(texts) else np.empty(0, np.int32)
    ends = np.cumsum(pc.list_value_length(words).to_numpy()) if len(texts) else np.empty(0, np.int64)
    for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
        if a == b:
            continue
        own, said = data[a:b], codes[ends[i - 1] if i else 0 : ends[i]]
        out[i, :256] = np.sqrt(np.bincount(own, minlength=256) / len(own))
        out[i, 256:] = np.log1p(len(own)), len(own) / len(said), np.mean(own[1:] == own[:-1]) if len(own) > 1 else 0, np.mean(said[1:] == said[:-1]) if len(said) > 1 else 0, len(np.unique(said)) / len(said)
    return out.astype(np.float16).astype(np.float32)


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, held to 5 deviations so that a rare byte decides nothing alone."""
    return np.clip((x - mean) / scale, -5, 5)


@dataclass
class QualityModel:
    """Weights over standardised features; the last weight is the constant. Without weights every score is 0.5."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    prior: float = 0.5

    def outputs(self, x: np.ndarray) -> np.ndarray:
        return standard(x, self.mean, self.scale) @ self.weights[:-1] + self.weights[-1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.outputs(x), -30, 30)))


def with_constant(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.column_stack([standard(x, mean, scale), np.ones(len(x), dtype=np.float32)])


def loss_sums(z: np.ndarray, weights: np.ndarray, sign: int) -> np.ndarray:
    """[rows, summed loss l(sign * g), its gradient...] of rows ``z``."""
    g = sign * (z @ weights)
    slope = -sign / (1 + np.exp(np.clip(g, -30, 30)))
    return np.concatenate([[len(z), np.logaddexp(0, -g).sum()], slope @ z])


def minimise(positive: np.ndarray, unlabelled: Callable[[np.ndarray], np.ndarray], prior: float, start: np.ndarray, metric: np.ndarray, passes: int) -> np.ndarray:
    """The weights of least risk, by limited-memory quasi-Newton steps with at most so many ``passes`` over the unlabelled rows.

    ``unlabelled(w)`` is loss_sums with sign -1 over all unlabelled rows and
    ``metric`` the inverse of their second moments. The negatives' part of the
    risk counts as zero where it falls below, which marks overfitting; the bend
    there is rounded by about 1 / BEND. A step to where the risk rises is halved.
    """

    def risk(w: np.ndarray) -> tuple[float, np.ndarray]:
        pos, neg, unl = loss_sums(positive, w, 1), loss_sums(positive, w, -1), unlabelled(w)
        pos, neg, unl = pos[1:] / pos[0], neg[1:] / neg[0], unl[1:] / unl[0]
        shrink = np.append(w[:-1], 0.0)
        negatives = unl - prior * neg
        held = 1 / (1 + np.exp(-np.clip(BEND * negatives[0], -30, 30)))
        value = prior * pos[0] + np.logaddexp(0, BEND * negatives[0]) / BEND + RIDGE / 2 * shrink @ shrink
        return value, prior * pos[1:] + held * negatives[1:] + RIDGE * shrink

    w, (value, slope) = start, risk(start)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    used = 1
    while used < passes and np.abs(slope).max() > 1e-5:
        q, marks = slope.copy(), []
        for s, y in reversed(past):
            a = s @ q / (y @ s)
            marks.append(a)
            q -= a * y
        q = metric @ q
        for (s, y), a in zip(past, reversed(marks)):
            q += s * (a - y @ q / (y @ s))
        step = 1.0
        while used < passes:
            fresh = w - step * q
            new_value, new_slope = risk(fresh)
            used += 1
            if new_value <= value - 1e-4 * step * (slope @ q):
                break
            step /= 2
        else:
            break
        s, y = fresh - w, new_slope - slope
        if s @ y > 1e-12:
            past = [*past[-7:], (s, y)]
        w, value, slope = fresh, new_value, new_slope
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from counts of both by falling bin of a score.

    Above any threshold lie at least the positives' share of them, so each
    ratio of the two tails bounds the prior from above; the threshold with the
    least ratio, plus what chance may add to it, decides.
    """
    q_pos, q_unl = np.cumsum(positive) / positive.sum(), np.cumsum(unlabelled) / unlabelled.sum()
    slack = np.sqrt(np.log(4 / 0.1) / 2) * (positive.sum() ** -0.5 + unlabelled.sum() ** -0.5)
    held = q_pos > 0
    bound = (q_unl[held] + 1.01 * slack) / q_pos[held]
    best = int(np.argmin(bound))
    return float(np.clip(q_unl[held][best] / q_pos[held][best], 0.01, 0.98))


def bins_of(g: np.ndarray) -> np.ndarray:
    """The bin of each log-odds, highest first."""
    return np.clip((BIN_RANGE - g) / (2 * BIN_RANGE) * BINS, 0, BINS - 1).astype(np.int64)


def _share(id_col: str, salt: str) -> Column:
    """A fixed number in [0, 1) for each id."""
    return F.pmod(F.xxhash64(id_col, F.lit(salt)), F.lit(1_000_003)) / F.lit(1_000_003.0)


def _as_features(docs: DataFrame, *keep: str) -> DataFrame:
    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([row.tobytes() for row in features(texts).astype(np.float16)], pa.binary())]

    return map_texts(docs, "text", compute, ["binary"], list(keep), names=["x"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float16).reshape(-1, FEATURES).astype(np.float32)


def _summed(rows: DataFrame, width: int, compute: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all feature rows of what ``compute`` gives for blocks of them, ``width`` numbers; each task sums its own first."""

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                total += compute(_matrix(batch.column(0).slice(at, 1024)))
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["i", "v"])

    found = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(width)
    out[found.column("i").to_numpy()] = found.column("v").to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = FIT_LABELLED, passes: int = 10) -> QualityModel:
    """Learn from the rows of ``labels(id, label)`` with label 1 and from all texts of ``docs``.

    About ``labelled`` positives, chosen by a hash of the id, are held on the
    driver; rows of other labels are not used. Everything about unlabelled text
    (means, moments, the class prior, and the risk and its slope at each of at
    most twice ``passes`` steps) is summed by Spark over all documents that
    have a text, so the result doesn't depend on how they are partitioned.
    Without positives, or without texts, the model scores 0.5 throughout. An id
    labelled twice, or of several documents, counts once.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    marks = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).where("id is not null").distinct()
    n = marks.count()
    marks = marks.where(_share("id", "labelled") < labelled / max(n, 1)).limit(2 * labelled)
    known = own.join(F.broadcast(marks), "id")  # at most 2 * labelled ids
    known = _as_features(known, "id").groupBy("id").agg(F.min("x").alias("x")).orderBy("id").toArrow()
    bare = QualityModel(np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32))
    if not known.num_rows:
        return bare
    positive = _matrix(known.column("x"))
    stored = materialize(_as_features(own.select("text")), "features")
    rows = stored.coalesce(PASS_TASKS)

    sums = _summed(rows, 1 + 2 * FEATURES, lambda x: np.concatenate([[len(x)], x.sum(axis=0, dtype=np.float64), np.square(x, dtype=np.float64).sum(axis=0)]))
    count, mean = sums[0], sums[1 : FEATURES + 1] / sums[0]
    scale = np.sqrt(np.maximum(sums[FEATURES + 1 :] / count - mean**2, 0)) + 0.01
    mean, scale = mean.astype(np.float32), scale.astype(np.float32)
    width = FEATURES + 1
    upper = np.triu_indices(width)

    def moments(x: np.ndarray) -> np.ndarray:
        z = with_constant(x, mean, scale)
        return (z.T @ z)[upper].astype(np.float64)

    second = np.zeros((width, width))
    second[upper] = _summed(rows, len(upper[0]), moments) / count
    second = second + np.triu(second, 1).T
    # A logistic loss bends by a quarter of the second moments at most.
    metric = np.linalg.inv(second / 4 + 10 * RIDGE * np.eye(width))

    z = with_constant(positive, mean, scale).astype(np.float64)
    unlabelled = lambda w: _summed(rows, width + 2, lambda x: loss_sums(with_constant(x, mean, scale), w, -1))
    # A first model ranks the texts; the half of the positives that it has not seen and all unlabelled texts give the prior.
    half = np.arange(len(z)) % 2 == 0
    first = minimise(z[half], unlabelled, 0.5, np.zeros(width), metric, passes)
    held = z[~half] if len(z) > 1 else z
    counted = _summed(rows, BINS, lambda x: np.bincount(bins_of(with_constant(x, mean, scale) @ first), minlength=BINS).astype(float))
    prior = class_prior(np.bincount(bins_of(held @ first), minlength=BINS), counted)
    weights = minimise(z, unlabelled, prior, np.zeros(width), metric, passes)
    discard(stored)
    return QualityModel(mean, scale, weights, prior)


def _scorer(model: QualityModel):
    def compute(texts: pa.Array) -> list[pa.Array]:
        marks = model.scores(features(texts))
        return [pa.array(marks), pa.array((marks >= THRESHOLD).astype(np.int32))]

    return compute


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``.

    Higher scores are likelier to be labelled 1; predicted is 1 from 0.3 on. A
    null or empty text has all features zero and a score like any other.
    Repeated rows get equal scores, also where scores tie; long texts are read
    whole; other columns are ignored; an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(own, "text", _scorer(model), ["double", "int"], ["doc_id"], names=["score", "predicted"])


def accepted(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text is predicted 1.

    Null and empty texts are judged by their features, all zero; very long ones
    are read whole; repeated rows share one fate; an empty table stays empty;
    columns of any name pass through.
    """
    return map_texts(docs, text_col, _scorer(model), ["double", "int"], docs.columns, where="r1 = 1")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are kept from learning: crc32 of the id as text is a multiple of 5. A null id counts as its empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
