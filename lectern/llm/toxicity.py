"""Toxicity by multiple-instance learning.

A document is toxic if one of its sentences is. Sentence scores come from a
logistic model over the sentence's words and word beginnings and are combined by noisy-or; the
model is trained from document labels alone and then points at the sentences
that made a document toxic. Training runs in numpy, in one task, on a bounded sample of
labelled documents, scoring over every whole text.
"""

from __future__ import annotations

from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches, labelled_sample, learned, map_texts, remainder, table

#: Labelled documents to learn from, at most.
SAMPLE_DOCS = 8000
#: Features to learn weights for, at most; those in fewer documents are left out.
VOCABULARY, MIN_DOCS = 60_000, 3
ROUNDS, RATE, PENALTY = 160, 0.15, 2e-4
START_BIAS = -7.0
#: How far the classes weigh alike in training: 0 by their numbers, 1 fully. Lifts the rarer class's scores.
BALANCE = 0.3
#: Documents whose gradient is computed at a time: bounds the memory of training.
DOCS_AT_ONCE = 250
#: Sentences at or above this score are reported.
OFFENDING = 0.5

_ADDED = "score double, n_sentences int, offending array<struct<start:int,end:int,score:double>>"
#: Sentence ends become line ends, other ASCII marks become spaces; offsets stay.
_CUT = bytes(10 if c in b".!?\n\r" else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


@dataclass
class ToxicityModel:
    weights: dict[bytes, float]
    bias: float


def sentences(raw: bytes) -> list[tuple[int, int, set[bytes]]]:
    """(start, end, features) of each sentence with a word; offsets in UTF-8 bytes.

    Features are the words and, for inflected forms, their first 4 and 5 bytes.
    """
    out, at = [], 0
    for part in raw.lower().translate(_CUT).split(b"\n"):
        if words := part.split():
            kinds = set(words)
            kinds.update([w[:4] + b"*" for w in kinds], [w[:5] + b"*" for w in kinds])
            out.append((at, at + len(part), kinds))
        at += len(part) + 1
    return out


def noisy_or(raw: bytes, model: ToxicityModel) -> tuple[float, int, list[dict]]:
    """Document score, sentence count and offending sentences; no sentence: 0."""
    weights, found, n, log_clean = model.weights, [], 0, 0.0
    base = float(np.logaddexp(0.0, model.bias))
    for start, end, words in sentences(raw):
        n += 1
        if weights.keys().isdisjoint(words):
            log_clean -= base
            continue
        z = model.bias + sum(sorted(weights[w] for w in words if w in weights))
        log_clean -= float(np.logaddexp(0.0, z))
        if (p := float(1 / (1 + np.exp(-z)))) >= OFFENDING:
            found.append({"start": start, "end": end, "score": p})
    return float(-np.expm1(log_clean)), n, found


def train(texts: list[bytes], labels: list[int], share: float | None = None) -> ToxicityModel:
    """Proximal Adam on the noisy-or likelihood. One class only: a constant model.

    ``share`` is that of label 1 where the texts were drawn from, if by class.
    """
    worded = [bool(t.translate(_CUT).split()) for t in texts]
    labels = [y for y, w in zip(labels, worded, strict=True) if w]
    texts = [t for t, w in zip(texts, worded, strict=True) if w]
    y = np.array(labels, float)
    if not texts or y.min() == y.max():
        return ToxicityModel({}, 20.0 if texts and y.min() == 1 else -40.0)
    features = lambda t: set().union(*(s[2] for s in sentences(t)))
    # most features are rare: hashed counts, never too low, keep them out of the exact ones
    rough, mask = np.zeros(1 << 21, np.int32), (1 << 21) - 1
    for t in texts:
        rough[np.fromiter((hash(w) & mask for w in features(t)), np.int64)] += 1
    docs: Counter = Counter()
    for t in texts:
        docs.update(w for w in features(t) if rough[hash(w) & mask] >= MIN_DOCS)
    known = sorted((w for w, n in docs.items() if n >= MIN_DOCS), key=lambda w: (-docs[w], w))[:VOCABULARY]
    del docs
    number = {w: i for i, w in enumerate(known)}
    words, lengths, doc_of = array("i"), array("i"), array("i")
    for d, t in enumerate(texts):
        for _, _, s in sentences(t):
            ids = sorted(number[w] for w in s if w in number)
            words.extend(ids)
            lengths.append(len(ids))
            doc_of.append(d)
    n_docs = len(texts)
    words, lengths, doc_of = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (words, lengths, doc_of))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    first_of = np.searchsorted(doc_of, np.arange(0, n_docs + DOCS_AT_ONCE, DOCS_AT_ONCE))
    n = len(known)
    w, b = np.zeros(n + 1), START_BIAS  # the last weight is unused: keeps shapes when nothing is known
    first, second = np.zeros(n + 2), np.zeros(n + 2)
    ones = (1 - BALANCE) * (y.mean() if share is None else min(max(share, 0.001), 0.999)) + BALANCE / 2
    weight = np.where(y == 1, ones / y.mean(), (1 - ones) / (1 - y.mean())) / n_docs
    for step in range(1, ROUNDS + 1):
        grad = np.zeros(n + 2)
        for low, high in zip(first_of, first_of[1:], strict=False):
            if low == high:
                continue
            own, doc = words[ends[low] : ends[high]], doc_of[low:high] - doc_of[low]
            sentence = np.repeat(np.arange(high - low, dtype=np.int32), lengths[low:high])
            z = b + np.bincount(sentence, w[own], high - low)
            p = 1 / (1 + np.exp(-z))
            log_clean = np.bincount(doc, -np.logaddexp(0, z))
            toxic = np.maximum(-np.expm1(log_clean), 1e-9)
            # gradient of the negative log-likelihood for each sentence's logit
            g = np.where(y[doc_of[low:high]] == 1, -p * (np.exp(log_clean) / toxic)[doc], p) * weight[doc_of[low:high]]
            grad[:-1] += np.bincount(own, g[sentence], n + 1)
            grad[-1] += g.sum()
        first += 0.1 * (grad - first)
        second += 0.01 * (grad**2 - second)
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
        w, b = w - move[:-1], b - move[-1]
        scale = RATE / (np.sqrt(second[:-1] / (1 - 0.99**step)) + 1e-7)
        w = np.sign(w) * np.maximum(np.abs(w) - scale * PENALTY, 0)
    return ToxicityModel({known[i]: float(w[i]) for i in np.flatnonzero(w[:n])}, float(b))


def fit(docs: DataFrame, labels: DataFrame, learn, bound: int = SAMPLE_DOCS) -> ToxicityModel:
    """Learn from at most ``bound`` documents that have a label where ``learn`` holds."""
    drawn, share = labelled_sample(docs, labels, "toxic", learn, bound)
    return learned(drawn, lambda texts, found: train(texts, found, share))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with score, n_sentences and the offending sentences' spans and scores.

    One output row for each input row, repeated ones included; an empty table has
    none. Null and empty texts, and texts without a word, have no sentence and
    score 0. Long texts are scored sentence by sentence as a whole; one without a
    sentence end is one sentence. Spans are offsets in UTF-8 bytes, and sentences
    of equal score stand in the order of the text. Columns of docs with these names
    are replaced.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY weights

    def start():
        own = shared.value

        def work(texts):
            rows = [noisy_or(t, own) for t in texts]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            return [pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], kind)]

        return work

    return map_texts(docs, _ADDED, start)


def fit_for_contract(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return fit(docs, labels, remainder(F.col("doc_id"), 5) != 0)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels of rows not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_for_contract(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences",
        F.size("offending").alias("n_offending"),
        "offending",
    )
