"""Language identification by unigram piece models, with all segmentations summed out.

The vocabulary is a public tokenizer's, taken as it is. For each language the
model has a probability for every piece; a word's probability is the sum over
all its segmentations into pieces, by the forward algorithm, and a text's is the
product over its words. Probabilities are fitted by expectation maximisation
with the matching forward-backward counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.text import bounded_batches, map_texts, word_lists

UNKNOWN = "und"
#: Probability of a character that no piece covers, in every language.
STRAY = 1e-7
#: Code points of words whose probabilities a double holds as they are; longer words are summed in logarithms.
PLAIN = 40
#: Runs of letters and the marks that belong to them.
LETTERS = r"\p{L}\p{M}"
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces of a sentencepiece model, lower-case ones of letters only; ▁ begins a word.

    ``path`` defaults to the 32,000-piece model of the public_tokenizers package.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p.strip("▁") == p.lstrip("▁") and (p == "▁" or p.lstrip("▁").isalpha()) and p == p.lower() and p.count("▁") <= 1})


def _hash_steps(codes: np.ndarray, acc: np.ndarray) -> np.ndarray:
    """Roll one more column of code points into the running hashes."""
    mixed = (acc ^ codes) * _PRIME
    return mixed ^ (mixed >> np.uint64(29))


class PieceTable:
    """Finds the pieces that stand at each place of many words, by hash of the code points.

    A cuckoo table: each piece lies in one of two slots.
    """

    def __init__(self, pieces: list[str]):
        self.longest, self.size = max(map(len, pieces)), len(pieces)
        self.shift = np.uint64(64 - (8 * self.size).bit_length())
        hashes = np.array([self._one(p) for p in pieces], dtype=np.uint64)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces have one hash")
        slots = [list(map(int, s)) for s in self._slots(hashes)]
        self.ids = np.full(1 << (64 - int(self.shift)), self.size, dtype=np.int32)
        for i in range(self.size):
            moving, which = i, 0
            for _ in range(1000):
                at = slots[which][moving]
                moving, self.ids[at] = int(self.ids[at]), moving
                if moving == self.size:
                    break
                which = 1 if slots[0][moving] == at else 0
            else:
                raise ValueError("the pieces don't fit their table")
        self.keys = np.append(hashes, np.uint64(0))[self.ids]

    def _slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return hashes >> self.shift, (hashes * _PRIME) >> self.shift

    @staticmethod
    def _one(piece: str) -> np.uint64:
        acc = np.zeros(1, dtype=np.uint64)
        for c in piece:
            acc = _hash_steps(np.array([ord(c)], dtype=np.uint64), acc)
        return acc[0]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices of the hashes that are a piece's, their pieces)."""
        one, two = self._slots(hashes)
        at = np.where(self.keys[one] == hashes, one, two)
        hit = np.flatnonzero(self.keys[at] == hashes)
        return hit, self.ids[at[hit]]

    def at_ends(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words with a piece there, those pieces) for every span of the words ``codes[length, n]``."""
        length = len(codes)
        for start in range(length):
            acc = np.zeros(codes.shape[1], dtype=np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                acc = _hash_steps(codes[end - 1], acc)
                yield start, end, *self.find(acc)


def by_length(words: list[str], languages: int = 1, block: int = 1 << 12) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, code points) of words of one length up to PLAIN, ▁ put first, in blocks."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for n in np.unique(lengths[lengths <= PLAIN]):
        at = np.flatnonzero(lengths == n)
        step = max(64, block * 4 // (languages + 3))
        for i in range(0, len(at), step):
            own = at[i : i + step]
            codes = np.frombuffer(("▁" + "▁".join([words[j] for j in own])).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(own), n + 1)
            yield own, np.ascontiguousarray(codes.T.astype(np.uint64))


def forward(codes: np.ndarray, table: PieceTable, probs: np.ndarray) -> np.ndarray:
    """[length + 1, words, languages]: the probability of each prefix of the words, over all segmentations."""
    length, n = codes.shape
    alpha = np.zeros((length + 1, n, probs.shape[1]))
    alpha[0] = 1.0
    for start, end, hit, piece in table.at_ends(codes):
        if end == start + 1:
            # A stray character keeps a word possible that the pieces cannot spell.
            alpha[end] += alpha[start] * STRAY
        if len(hit):
            alpha[end, hit] += alpha[start, hit] * probs[piece]
    return alpha


class LongWord:
    """All spans of one long word that a piece covers, and the recursions over them in logarithms."""

    def __init__(self, word: str, table: PieceTable):
        codes = np.frombuffer(("▁" + word).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        self.length, acc = len(codes), np.zeros(len(codes), dtype=np.uint64)
        at = np.arange(self.length)
        starts, ends, pieces = [at], [at + 1], [np.full(self.length, table.size)]
        for n in range(1, min(self.length, table.longest) + 1):
            acc = _hash_steps(codes[n - 1 :], acc[: self.length - n + 1])
            hit, piece = table.find(acc)
            starts.append(hit), ends.append(hit + n), pieces.append(piece)
        self.start, self.end, self.piece = (np.concatenate(x) for x in (starts, ends, pieces))

    def _sweep(self, own: np.ndarray, other: np.ndarray, logs: np.ndarray, order: np.ndarray) -> np.ndarray:
        """[length + 1, languages]: log sums over the spans that end at each place, ``own`` being where they lead to."""
        out = np.zeros((self.length + 1, logs.shape[1]))
        by = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[by], np.arange(self.length + 2))
        for place in order:
            spans = by[cuts[place] : cuts[place + 1]]
            terms = out[other[spans]] + logs[self.piece[spans]]
            most = terms.max(axis=0)
            out[place] = most + np.log(np.exp(terms - most).sum(axis=0))
        return out

    def alpha(self, logs: np.ndarray) -> np.ndarray:
        return self._sweep(self.end, self.start, logs, np.arange(1, self.length + 1))

    def beta(self, logs: np.ndarray) -> np.ndarray:
        return self._sweep(self.start, self.end, logs, np.arange(self.length - 1, -1, -1))


def log_table(probs: np.ndarray) -> np.ndarray:
    """Log probabilities of the pieces, then of a stray character."""
    return np.log(np.vstack([probs, np.full((1, probs.shape[1]), STRAY)]))


def word_scores(words: list[str], table: PieceTable, probs: np.ndarray) -> np.ndarray:
    """[words, languages]: the log probability of each whole word under each language."""
    out = np.zeros((len(words), probs.shape[1]))
    for own, codes in by_length(words, probs.shape[1]):
        out[own] = np.log(forward(codes, table, probs)[-1])
    logs = None
    for i, word in enumerate(words):
        if len(word) > PLAIN:
            logs = log_table(probs) if logs is None else logs
            out[i] = LongWord(word, table).alpha(logs)[-1]
    return out


def expected_counts(words: list[str], weights: np.ndarray, table: PieceTable, probs: np.ndarray) -> np.ndarray:
    """[pieces]: how often each piece is used, in expectation over the segmentations of the weighted words."""
    counts, weights = np.zeros(table.size + 1), np.asarray(weights, dtype=float)
    for own, codes in by_length(words):
        length, n = codes.shape
        spans = list(table.at_ends(codes))
        alpha = forward(codes, table, probs[:, None])[:, :, 0]
        beta = np.zeros((length + 1, n))
        beta[length] = 1.0
        for start, end, hit, piece in sorted(spans, key=lambda s: -s[0]):
            if end == start + 1:
                beta[start] += beta[end] * STRAY
            beta[start, hit] += probs[piece] * beta[end, hit]
        share = weights[own] / alpha[length]
        used = [(piece, alpha[start, hit] * probs[piece] * beta[end, hit] * share[hit]) for start, end, hit, piece in spans if len(hit)]
        counts += np.bincount(np.concatenate([p for p, _ in used]), np.concatenate([c for _, c in used]), minlength=table.size + 1) if used else 0
    logs = None
    for word, weight in zip(words, weights):
        if len(word) > PLAIN:
            logs = log_table(probs[:, None]) if logs is None else logs
            w = LongWord(word, table)
            alpha, beta = w.alpha(logs)[:, 0], w.beta(logs)[:, 0]
            counts += weight * np.bincount(w.piece, np.exp(alpha[w.start] + logs[w.piece, 0] + beta[w.end] - alpha[-1]), minlength=table.size + 1)
    return counts[: table.size]


@dataclass
class LanguageModel:
    """Piece probabilities [pieces, languages] and the languages' names in order."""

    pieces: list[str]
    languages: list[str]
    probs: np.ndarray


def fit(labelled: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 600, rounds: int = 2, smoothing: float = 0.05) -> LanguageModel:
    """Learn piece probabilities from the rows of ``labelled`` with a language and a text.

    The fit takes about ``docs_per_language`` rows of each language, chosen by
    a hash of the id (all rows of rarer languages). Words are counted and the
    expected piece counts summed by Spark; the driver holds only the table of
    pieces by languages, which grows with the number of distinct labels. Rows
    without a language or text teach nothing. Without any labelled row the
    model has no language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    pieces, languages = vocabulary(path), sorted(sizes)
    table = PieceTable(pieces)
    probs = np.full((table.size, len(languages)), 1.0 / table.size)
    if not languages:
        return LanguageModel(pieces, languages, probs)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, docs_per_language / n))])[F.col("lang")]
    chosen = rows.where((F.abs(F.xxhash64("doc_id", F.lit("fit")) % 1_000_003) / 1_000_003.0) <= share)

    def words(batches):
        for batch in batches:
            found, counts = word_lists(batch.column(1), LETTERS)
            yield pa.RecordBatch.from_arrays([pc.take(batch.column(0), pa.array(np.repeat(np.arange(batch.num_rows), counts))), found], ["lang", "word"])

    counted = bounded_batches(chosen.select("lang", "text")).mapInArrow(words, "lang string, word string").groupBy("lang", "word").agg(F.count("*").cast("double").alias("n")).persist()
    for _ in range(rounds):

        def count(batches, probs=probs):
            totals = np.zeros_like(probs)
            for batch in batches:
                lang, word, n = (batch.column(i) for i in range(3))
                for j, name in enumerate(languages):
                    own = pc.equal(lang, name)
                    totals[:, j] += expected_counts(word.filter(own).to_pylist(), n.filter(own).to_numpy(), table, probs[:, j])
            piece, language = np.nonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(language), pa.array(totals[piece, language])], ["piece", "language", "n"])

        summed = counted.mapInArrow(count, "piece long, language long, n double").groupBy("piece", "language").agg(F.sum("n").alias("n"))
        fresh = np.full_like(probs, smoothing)
        found = summed.toArrow()  # at most pieces times languages
        fresh[found.column("piece").to_numpy(), found.column("language").to_numpy()] += found.column("n").to_numpy()
        probs = fresh / fresh.sum(axis=0)
    counted.unpersist()
    return LanguageModel(pieces, languages, probs)


def _identifier(model: LanguageModel, remembered: int):
    """A function from texts to their languages and scores, which remembers the words that it has seen."""
    table, languages = PieceTable(model.pieces), model.languages
    known: dict[str, int] = {}
    held = [np.empty((0, len(languages)))]

    def compute(texts: pa.Array) -> list[pa.Array]:
        found, counts = word_lists(texts, LETTERS)
        lettered = pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}").to_numpy(zero_copy_only=False)
        if not languages or not lettered.any():
            return [pa.array([UNKNOWN] * len(texts)), pa.array(np.zeros(len(texts)))]
        coded = found.dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in known]
        if len(known) + len(new) > remembered:
            known.clear()
            held[0], new = held[0][:0], words
        known.update(zip(new, range(len(known), len(known) + len(new))))
        held[0] = np.concatenate([held[0], word_scores(new, table, model.probs)])
        own = held[0][np.fromiter((known[w] for w in words), dtype=np.int64, count=len(words))]
        per_word = own[coded.indices.to_numpy(zero_copy_only=False)]
        total, any_word = np.zeros((len(counts), len(languages))), counts > 0
        total[any_word] = np.add.reduceat(per_word, (np.cumsum(counts) - counts)[any_word], axis=0)
        scaled = total / np.sqrt(np.maximum(counts, 1))[:, None]
        share = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        names = np.array([*languages, UNKNOWN], dtype=object)[np.where(lettered, share.argmax(axis=1), -1)]
        return [pa.array(names, pa.string()), pa.array(np.where(lettered, share.max(axis=1), 0.0))]

    return compute


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", remembered: int = 200_000) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``.

    A text's score is the probability of its language given the whole text, with
    equal priors, softened by the root of its number of words: the words of a
    text aren't independent. ``und`` with score 0 where the text is null, has no
    letter, or the model knows no language. Words are whole runs of letters and
    marks, however long. Of languages that tie, the first in order of name
    counts. A task remembers the scores of up to ``remembered`` words. Repeated
    rows get equal results; other columns are ignored; an empty table gives an
    empty result.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(own, "text", _identifier(model, remembered), ["string", "double"], ["doc_id"], names=["lang_pred", "score"], block=512)


def accepted(docs: DataFrame, model: LanguageModel, sure: float, text_col: str = "text", remembered: int = 200_000) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose language is known with a score of at least ``sure``.

    A model without languages can judge none, and keeps all rows. Null, empty
    and letterless texts have no language and go; long texts are read whole;
    repeated rows share one fate; an empty table stays empty; columns of any
    name pass through.
    """
    if not model.languages:
        return docs
    return map_texts(docs, text_col, _identifier(model, remembered), ["string", "double"], docs.columns, where=f"r0 != '{UNKNOWN}' and r1 >= {sure}", block=512)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 modulo 4. A null id counts as its empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
