"""Toxic documents by multiple-instance learning over their sentences."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.common import keep_one

# The model is fitted in one task; this many labelled documents at most are drawn for it, by a hash of doc_id.
MAX_LABELLED = 12_000
PREFIXES = (4, 5, 6)  # beside the word itself, its first letters are features
STEPS, RATE, DECAY = 200, 0.1, 5e-5
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_PIECE = 1 << 18  # words that are counted at a time
_REMEMBERED = 300_000  # words whose weight a task remembers


def _features(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


def _sentences(text: str | None) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and distinct words of each sentence that has words."""
    for m in _SENTENCE.finditer((text or "").lower()):
        if own := set(_WORD.findall(m.group())):
            yield m.start(), m.end(), own


def fit(rows: Iterable[tuple[str | None, float]]) -> dict[str, float]:
    """Weight of each feature, and of the bias under the empty string.

    A sentence's score is the logistic function of bias plus the weights of its distinct words' features; a document's is
    the noisy-or of its sentences. Of all features those that tell the labels apart are used (_telling). Full-batch
    gradient steps (Adam) on the documents' log-likelihood with weight decay. ``rows`` gives (text, label); a text is let
    go once its words are numbered.
    """
    vocabulary: dict[str, int] = {}
    words, sentence, document, toxic, n = array("i"), array("i"), array("i"), array("d"), 0
    for d, (text, label) in enumerate(rows):
        toxic.append(label)
        for _, _, own in _sentences(text):
            words.extend(vocabulary.setdefault(w, len(vocabulary)) for w in own)
            sentence.extend([n] * len(own))
            document.append(d)
            n += 1
    words, sentence, document = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (words, sentence, document))
    names: dict[str, int] = {}
    size_of, right = array("i"), array("i")
    for w in vocabulary:
        own = _features(w)
        size_of.append(len(own))
        right.extend(names.setdefault(f, len(names)) for f in own)
    n_words = len(vocabulary)
    left = np.repeat(np.arange(n_words, dtype=np.int32), np.array(size_of, np.int64))
    right = np.array(right, np.int32)
    y = np.array(toxic, np.float64)
    keep = _telling(document[sentence], words, left, right, n_words, len(names), y)
    kept = [f for f, k in zip(names, keep) if k]
    del names, vocabulary
    new = np.cumsum(keep) - 1
    left, right = left[keep[right]], new[right[keep[right]]]
    # words without any feature that is used add nothing to their sentence
    used = np.zeros(n_words, bool)
    used[left] = True
    words, sentence = words[used[words]], sentence[used[words]]
    size = int(keep.sum())
    rate = min(max(y.mean() if len(y) else 0.0, 1e-3), 0.5)
    theta = np.zeros(size + 1)
    theta[size] = np.log(rate / max(1.0, n / max(1, len(y))))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        if not n:
            break
        by_word = np.bincount(left, theta[right], n_words)
        s = 1 / (1 + np.exp(-np.clip(np.bincount(sentence, by_word[words], n) + theta[size], -30, 30)))
        p = 1 - np.exp(np.bincount(document, np.log1p(-s * (1 - 1e-9)), len(y)))
        pull = s * ((p - y) / np.maximum(p, 1e-9))[document]
        grad = np.zeros_like(theta)
        grad[:size] = np.bincount(right, np.bincount(words, pull[sentence], n_words)[left], size) / len(y) + DECAY * theta[:size]
        grad[size] = pull.sum() / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {"": float(theta[size])} | {f: float(w) for f, w in zip(kept, theta) if abs(w) > 1e-3}


def _telling(document: np.ndarray, words: np.ndarray, left: np.ndarray, right: np.ndarray, n_words: int, n: int, y: np.ndarray) -> np.ndarray:
    """Which features toxic documents have more often than chance allows.

    The log-likelihood ratio of (feature, label) over documents has to be above 2 ln n, so that of n features without any
    relation to the label about one is kept.
    """
    if not n or not 0 < y.sum() < len(y):
        return np.zeros(n, bool)
    order = np.argsort(left, kind="stable")
    starts, right = np.searchsorted(left[order], np.arange(n_words + 1)), right[order]
    both, some, begin = np.zeros(n), np.zeros(n), 0
    while begin < len(document):
        # whole documents, about _PIECE words at a time; ``document`` never falls
        end = max(np.searchsorted(document, document[min(begin + _PIECE, len(document)) - 1]), np.searchsorted(document, document[begin], "right"))
        end = len(document) if begin + _PIECE >= len(document) else end
        seen = np.unique(document[begin:end].astype(np.int64) * n_words + words[begin:end])
        own = seen % n_words
        count = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        docs, feature = np.divmod(np.unique(np.repeat(seen // n_words, count) * n + right[at]), n)
        both += np.bincount(feature, y[docs], n)
        some += np.bincount(feature, minlength=n)
        begin = end
    share, ratio = y.mean(), np.zeros(n)
    for k, of, rate in ((both, some, share), (some - both, some, 1 - share), (y.sum() - both, len(y) - some, share), (len(y) - some - y.sum() + both, len(y) - some, 1 - share)):
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio += np.where(k > 0, 2 * k * np.log(k / (of * rate)), 0)
    return (ratio > 2 * np.log(n)) & (both > some * share)


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_one("toxicity", dict)  # the fit needs the room of what an earlier operator left in this worker
    model = fit((text.as_py(), label.as_py()) for b in batches for text, label in zip(b.column("text"), b.column("toxic")))
    yield pa.RecordBatch.from_arrays([pa.array(list(model)), pa.array(list(model.values()), pa.float64())], ["feature", "weight"])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: remainder 2 of the id's CRC-32 modulo 4 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> dict[str, float]:
    """Fit on the labelled documents that are not held out, on a draw of ``most`` by a hash of doc_id if there are more.

    Null labels and ids are left out; of several labels for one id the largest counts. Without labelled documents, or with
    labels of one kind, the scores are near that kind's share.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")))
    total = known.count()
    cut = 1_000_000 * most // max(total, most)
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < cut)
    # at most ``most`` rows of (id, label), up to chance, so the join's broadcast side and the fitting task are bounded
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    rows = rows.repartition(1).sortWithinPartitions("doc_id", "text")  # in one order, so that the fit is the same each time
    fitted = rows.mapInArrow(_fit_batches, "feature string, weight double").collect()
    return {r[0]: r[1] for r in fitted} or {"": -30.0}


class Scorer:
    def __init__(self, model: dict[str, float]):
        self.model, self.bias, self.known = model, model[""], {}

    def _weight(self, word: str) -> float:
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        out = self.known[word] = sum(self.model.get(f, 0.0) for f in _features(word))
        return out

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        known, out = self.known, []
        for start, end, own in _sentences(text):
            x = self.bias
            for w in own:
                x += known[w] if w in known else self._weight(w)
            out.append((start, end, 1 / (1 + np.exp(-min(max(x, -30.0), 30.0)))))
        return out

    def document(self, text: str | None) -> float:
        """Noisy-or of the sentences; a text without words scores 0."""
        return float(1 - np.prod([1 - s for _, _, s in self.sentences(text)]))


def scorer(spark, model: dict[str, float]) -> Callable[[Column | str], Column]:
    """A column function from text to its score. The model is as large as the bounded draw's vocabulary."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keep_one("toxicity", dict)
        own = Scorer(sent.value)
        for texts in batches:
            yield texts.map(own.document, na_action=None).astype("float64")

    return score


def score_documents(docs: DataFrame, model: dict[str, float]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null and empty texts score 0, other columns are not read."""
    score = scorer(docs.sparkSession, model)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), score(F.col("text")).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def offending_sentences(docs: DataFrame, model: dict[str, float], least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, score) of the sentences that score ``least`` or more, by character offsets."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(sent.value)
        for batch in batches:
            found = [(i, a, b, float(s)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, b, s in own.sentences(t) if s >= least]
            cols = [*zip(*found)] or [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "end", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, start int, end int, score double")


def drop_toxic(docs: DataFrame, model: dict[str, float], least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``least``; all columns stay. Null and empty texts score 0 and stay."""
    score = scorer(docs.sparkSession, model)
    rows = docs.select(F.struct("*").alias("d"), score(F.col("text")).alias("s"))
    return rows.filter(F.col("s") < least).select("d.*")
