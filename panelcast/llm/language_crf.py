"""Language of documents by a linear-chain conditional random field over their words.

Each word has the features: the word itself if it is in the lexicon (frequent words of the training sample), its
affixes of one to four letters, its letter n-grams of two and three, and its letters outside ASCII. Features and
transitions between the languages of neighbouring words have learned weights; forward-backward gives each word's
probability of each language, and a document's score is the mean over its words. Code-switched text thus gets each
word's own label, and short words that several languages share are decided by their neighbours.

A text is one chain, however long. It is computed in stretches of `STRETCH` words side by side: each stretch's product
of transitions first, then the messages from stretch to stretch, then forward-backward within each from the messages
at its ends. That equals unbroken forward-backward.

The model is fitted on a bounded sample of labelled rows, whole texts: about `per_language` documents of each language,
chosen by a hash of doc_id. Everything else runs over all rows and whole texts: counts of languages, and the prediction.

Null text, or text without a letter, is `und` with score 0. Rows with null lang train nothing. Without any labelled
row everything is `und`. Repeated rows get the same prediction. Ties go to the language that sorts first. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

STRETCH = 64
#: Feature weights are kept in a table of this many places, by hash.
PLACES = 1 << 16
#: Characters that are labelled at once, and words that a worker remembers.
BATCH_CHARS = 300_000
MEMO = 80_000
UNDETERMINED = "und"
#: Documents whose words have a lower probability of the best language, on average, are rejected by determined().
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Training:
    per_language: int = 100
    lexicon: int = 2_000
    rounds: int = 40
    rate: float = 0.15
    penalty: float = 1e-5


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    lexicon: frozenset[str]
    weights: np.ndarray  # places x languages
    transitions: np.ndarray  # languages x languages
    number: str = field(default_factory=lambda: uuid4().hex)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def words_of(text: str | None) -> list[str]:
    import regex

    return regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower()) if text else []


def _start(kind: bytes) -> int:
    """The hash of a feature's kind, which that of its letters goes on from."""
    return crc32(kind)


WORD, PREFIX, SUFFIX, TWO, THREE, LETTER = map(_start, (b"w", b"p", b"s", b"2", b"3", b"c"))


def features(word: str, lexicon: frozenset[str]) -> list[int]:
    """Hashes of the word (if the lexicon has it), of up to four letters at either end, of each two and three letters in a
    row, and of letters beyond ASCII."""
    raw, n = word.encode(), len(word)
    at = range(n + 1) if len(raw) == n else [0, *accumulate(len(c.encode()) for c in word)]
    ends = range(1, min(n, 4) + 1)
    out = [crc32(raw, WORD)] if word in lexicon else []
    out += [crc32(raw[: at[k]], PREFIX) for k in ends]
    out += [crc32(raw[at[n - k] :], SUFFIX) for k in ends]
    out += [crc32(raw[at[i] : at[i + 2]], TWO) for i in range(n - 1)]
    out += [crc32(raw[at[i] : at[i + 3]], THREE) for i in range(n - 2)]
    if len(raw) != n:
        out += [crc32(c.encode(), LETTER) for c in sorted(set(word)) if c > "\x7f"]
    return out


def _flat(words: list[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all features of the words, one after another, and where each word's begin."""
    each = [features(w, lexicon) for w in words]
    starts = np.cumsum([0, *map(len, each)])[:-1]
    return np.fromiter(chain.from_iterable(each), np.int64) % PLACES, starts


@dataclass(frozen=True)
class Stretches:
    """Texts of so many words, cut into stretches of STRETCH words: each word's stretch and place in it, each stretch's
    length, text and number within its text."""

    of_word: np.ndarray
    place: np.ndarray
    lengths: np.ndarray
    number: np.ndarray

    @staticmethod
    def of(words: np.ndarray) -> Stretches:
        text = np.repeat(np.arange(len(words)), words)
        place = np.arange(len(text)) - np.repeat(np.cumsum(words) - words, words)
        counts = -(-words // STRETCH)
        first = np.cumsum(counts) - counts
        of_word = first[text] + place // STRETCH
        total = int(counts.sum())
        return Stretches(of_word, place % STRETCH, np.bincount(of_word, minlength=total), np.arange(total) - np.repeat(first, counts))

    def padded(self, scores: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.lengths), STRETCH, scores.shape[1]), scores.dtype)
        out[self.of_word, self.place] = scores
        return out


def _messages(local: np.ndarray, live: np.ndarray, move: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each stretch gets from the one before (the forward message at its end) and from the one after (the backward
    message, after the transition), up to a factor; ones where there is none."""
    n, size, k = local.shape
    into, back = np.ones((n, k), local.dtype), np.ones((n, k), local.dtype)
    if not number.any():
        return into, back
    # From each state at a stretch's first word to each at its last.
    through = np.eye(k, dtype=local.dtype)[None] * local[:, 0, None, :]
    for t in range(1, size):
        step = (through @ move) * local[:, t, None, :]
        through = np.where(live[:, t, None, None], step / step.sum(axis=(1, 2), keepdims=True), through)
    for c in range(1, int(number.max()) + 1):
        here = np.flatnonzero(number == c)
        first = np.ones((len(here), k), local.dtype) if c == 1 else into[here - 1] @ move
        message = np.einsum("ni,nij->nj", first, through[here - 1])
        into[here] = message / message.sum(axis=1, keepdims=True)
    for c in range(int(number.max()), 0, -1):
        here = np.flatnonzero(number == c)
        message = np.einsum("nij,nj->ni", through[here], back[here]) @ move.T
        back[here - 1] = message / message.sum(axis=1, keepdims=True)
    return into, back


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, number: np.ndarray | None = None, pairs: bool = False):
    """Scaled forward-backward over padded stretches (stretch, place, language): the words' probabilities; with pairs
    also the expected transition counts. number tells a stretch's place in its text (it follows on the one before it
    unless that is 0); by default each is a text of its own."""
    n, size, _ = scores.shape
    number = np.zeros(n, np.int64) if number is None else number
    local, move = np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(transitions)
    live = np.arange(size)[None, :] < lengths[:, None]
    into, back = _messages(local, live, move, number)
    goes_on = number > 0
    alpha, norm = np.empty_like(local), np.ones((n, size), scores.dtype)
    for t in range(size):
        now = np.where(goes_on[:, None], into @ move, 1.0) * local[:, 0] if t == 0 else (alpha[:, t - 1] @ move) * local[:, t]
        norm[:, t] = now.sum(axis=1)
        alpha[:, t] = now / norm[:, t, None]
    last = lengths - 1
    back /= (alpha[np.arange(n), last] * back).sum(axis=1, keepdims=True)
    beta = np.ones_like(local)
    beta[np.arange(n), last] = back
    for t in range(size - 2, -1, -1):
        further = (local[:, t + 1] * beta[:, t + 1]) @ move.T / norm[:, t + 1, None]
        beta[:, t] = np.where(live[:, t + 1, None], further, beta[:, t])
    marginal = alpha * beta
    marginal /= marginal.sum(axis=2, keepdims=True)
    marginal[~live] = 0
    if not pairs:
        return marginal
    after = local * beta / norm[:, :, None]
    after[~live] = 0
    expected = np.einsum("nti,ntj->ij", alpha[:, :-1], after[:, 1:]) + into[goes_on].T @ after[goes_on, 0]
    return marginal, expected * move


#: Penalty of a transition weight.
MOVES_PENALTY = 1e-3


class Objective:
    """The penalised mean negative log likelihood of labelled texts (lists of words, each with one label), by its
    gradients."""

    def __init__(self, sample: list[tuple[list[str], str]], how: Training = Training()):
        self.how, self.languages = how, tuple(sorted({y for _, y in sample}))
        number = {y: k for k, y in enumerate(self.languages)}
        words = [w for ws, _ in sample for w in ws]
        distinct, self.index, counts = np.unique(np.array(words, object), return_inverse=True, return_counts=True)
        self.lexicon = frozenset(distinct[i] for i in np.lexsort((np.arange(len(distinct)), -counts))[: how.lexicon])
        self.flat, self.starts = _flat(list(distinct), self.lexicon)
        self.owner = np.repeat(np.arange(len(distinct)), np.diff([*self.starts, len(self.flat)]))
        lengths = np.array([len(ws) for ws, _ in sample])
        self.cut, self.total, self.n_distinct = Stretches.of(lengths), len(words), len(distinct)
        self.truth = np.repeat([number[y] for _, y in sample], lengths)
        self.seen = np.diag([float(sum(n - 1 for (_, y), n in zip(sample, lengths) if y == language)) for language in self.languages])

    def gradients(self, weights: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By feature weights (PLACES, languages) and by transitions (languages, languages)."""
        cut, k = self.cut, len(self.languages)
        of_word = np.add.reduceat(weights[self.flat], self.starts, axis=0)
        marginal, expected = forward_backward(cut.padded(of_word[self.index]), cut.lengths, moves, cut.number, pairs=True)
        error = marginal[cut.of_word, cut.place]
        error[np.arange(self.total), self.truth] -= 1
        by_word = np.stack([np.bincount(self.index, error[:, j], self.n_distinct) for j in range(k)], 1)
        by_place = np.stack([np.bincount(self.flat, by_word[self.owner, j], PLACES) for j in range(k)], 1)
        return by_place / self.total + self.how.penalty * weights, (expected - self.seen) / self.total + MOVES_PENALTY * moves


def fit(texts: list[str], labels: list[str], how: Training = Training()) -> Model | None:
    """Maximum likelihood with a small penalty, by full-batch Adam."""
    sample = [(words_of(t), y) for t, y in zip(texts, labels)]
    sample = [(w, y) for w, y in sample if w]
    if not sample:
        return None
    goal = Objective(sample, how)
    k = len(goal.languages)
    weights, moves = np.zeros((PLACES, k)), np.zeros((k, k))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, moves)]
    for r in range(1, how.rounds + 1):
        for x, grad, (m, v) in zip((weights, moves), goal.gradients(weights, moves), state):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            x -= how.rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Model(goal.languages, goal.lexicon, weights.astype(np.float32), moves.astype(np.float32))


class Labeller:
    """Scores of words under a model, remembered by word: those of the last MEMO or so new words, and of as many before
    them, so that words which come again and again stay known."""

    def __init__(self, model: Model):
        self.model, self.place_of, self.scores, self.used = model, {}, np.zeros((1024, len(model.languages)), np.float32), 0
        self.older, self.older_scores = {}, self.scores

    def _add(self, new: list[str], rows: np.ndarray) -> None:
        while self.used + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[self.used : self.used + len(new)] = rows
        self.place_of.update(zip(new, range(self.used, self.used + len(new))))
        self.used += len(new)

    def _learn(self, new: list[str]) -> None:
        known = [w for w in new if w in self.older]
        if known:
            self._add(known, self.older_scores[[self.older[w] for w in known]])
        fresh = [w for w in new if w not in self.older]
        if fresh:
            flat, starts = _flat(fresh, self.model.lexicon)
            self._add(fresh, np.add.reduceat(self.model.weights[flat], starts, axis=0))

    def words(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all words, one after another, and the words of each text."""
        if self.used > MEMO:
            self.older, self.older_scores = self.place_of, self.scores
            self.place_of, self.scores, self.used = {}, np.zeros_like(self.scores), 0
        words = [w for ws in texts for w in ws]
        new = list(set(words).difference(self.place_of))
        if new:
            self._learn(new)
        lengths = np.array([len(ws) for ws in texts], np.int64)
        if not words:
            return np.zeros((0, len(self.model.languages)), np.float32), lengths
        index = np.fromiter(map(self.place_of.__getitem__, words), np.int64, len(words))
        cut = Stretches.of(lengths)
        marginal = forward_backward(cut.padded(self.scores[index]), cut.lengths, self.model.transitions, cut.number)
        return marginal[cut.of_word, cut.place], lengths

    def texts(self, texts: list[list[str]]) -> tuple[list[str], list[float], np.ndarray, np.ndarray]:
        """Language and score of each text, its number of words, and how many of them have another label."""
        each, lengths = self.words(texts)
        ends = np.cumsum(lengths)
        total = np.zeros((len(texts), len(self.model.languages)))
        some = np.flatnonzero(lengths)
        if len(some):
            total[some] = np.add.reduceat(each, (ends - lengths)[some], axis=0, dtype=np.float64)
        best = total.argmax(axis=1)
        score = np.clip(total[np.arange(len(texts)), best] / np.maximum(lengths, 1), 0, 1)
        row = np.repeat(np.arange(len(texts)), lengths)
        switched = np.bincount(row[each.argmax(axis=1) != best[row]], minlength=len(texts)) if len(some) else np.zeros(len(texts), np.int64)
        return [self.model.languages[b] if n else UNDETERMINED for b, n in zip(best, lengths)], score.tolist(), lengths, switched


_LABELLERS: dict[str, Labeller] = {}


def _labeller(shared) -> Labeller:
    """The worker's labeller of a broadcast model: words stay remembered from task to task, one model at a time."""
    if shared.value.number not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[shared.value.number] = Labeller(shared.value)
    return _LABELLERS[shared.value.number]


def train(docs: DataFrame, how: Training = Training()) -> Model | None:
    """Fit on the sample of the rows of docs (doc_id, text, lang) that are not held out. The counts of languages are
    taken over all rows; the driver gets the counts and the sample."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("train:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rate = F.lit(0.0)
    for language, n in counts.items():
        rate = F.when(F.col("lang") == F.lit(language), F.lit(min(1.0, how.per_language / n))).otherwise(rate)
    sample = sorted(known.where(draw < rate).select("doc_id", "text", "lang").collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["text"] or ""))
    return fit([r["text"] for r in sample], [r["lang"] for r in sample], how)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, n_words and n_switched (words with another label than lang_pred) of each row, from text
    alone; other columns of docs don't pass through."""
    columns = docs.select("doc_id", "text")
    if model is None:
        return columns.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), *(F.lit(0).cast("long").alias(c) for c in ("n_words", "n_switched")))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("n_switched", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _labeller(shared)
        for batch in batches:
            for part, languages, scores, lengths, switched in _labelled(batch, 1, labeller):
                counts = (pa.array(c, pa.int64()) for c in (lengths, switched))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64()), *counts], names=schema.names)

    return columns.mapInArrow(work, schema)


def _labelled(batch: pa.RecordBatch, text_at: int, labeller: Labeller) -> Iterator[tuple]:
    """Slices of about BATCH_CHARS of text, with what Labeller.texts tells of their rows."""
    texts = batch.column(text_at)
    start, chars, words = 0, 0, []
    for i in range(len(texts)):
        text = texts[i].as_py()
        chars += len(text or "")
        words.append(words_of(text))
        if chars >= BATCH_CHARS or i + 1 == len(texts):
            yield batch.slice(start, i + 1 - start), *labeller.texts(words)
            start, chars, words = i + 1, 0, []


def identify(docs: DataFrame, how: Training = Training()) -> DataFrame:
    """Train on docs and predict each of its rows: doc_id, held_out, lang_pred, score, n_words, n_switched."""
    out = predict(docs, train(docs, how))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words", "n_switched")


def determined(docs: DataFrame, how: Training = Training(), least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose language the model can tell, with the columns of docs. A row goes if its text is `und` or
    its score is below least_score; where lang is null, the predicted language takes its place. Without any labelled
    row there is no model: then only rows without a letter go."""
    model = train(docs, how)
    if model is None:
        return docs.where(F.regexp_like(F.coalesce(F.col("text"), F.lit("")), F.lit(r"\p{L}")))
    small_batches(docs.sparkSession)
    shared, text_at, lang_at, schema = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), docs.columns.index("lang"), docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _labeller(shared)
        for batch in batches:
            for part, languages, scores, *_ in _labelled(batch, text_at, labeller):
                lang = pc.coalesce(part.column(lang_at), pa.array(languages, part.column(lang_at).type))
                columns = [lang if k == lang_at else c for k, c in enumerate(part.columns)]
                keep = [x != UNDETERMINED and y >= least_score for x, y in zip(languages, scores)]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, schema)
