"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's potentials come from binned features of
itself and of the lines before and after it, and from the label before it.
Documents carry the only labels, so lines start with their document's label,
and after a first training those that the model is sure about change sides.
Forward-backward marginals, weighted by line length, give a document's share of
good text; a logistic curve fitted on the sample turns it into a probability.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches, labelled_sample, learned, map_texts, remainder, table

#: Labelled documents to learn from, at most; those with more lines are learned from in pieces of so many.
SAMPLE_DOCS, SAMPLE_LINES = 5000, 400
#: Frequent words of good documents that count as common.
COMMON = 300
STEPS, RATE, PENALTY = 120, 0.1, 1e-3
SURE = 0.95
#: Cells of a padded block of documents and lines.
CELLS = 100_000

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_MARK = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_RARE_MARK = bytes(c for c in _MARK if c not in b".,;:'\"!?()-")
#: Upper ends of the bins of each feature.
_BINS = (
    ("words", (0, 1, 3, 7, 15, 31)),
    ("word_length", (2, 4, 5, 6, 8, 12)),
    ("upper", (0.0, 0.02, 0.06, 0.2, 0.6)),
    ("digits", (0.0, 0.05, 0.2, 0.5)),
    ("marks", (0.0, 0.02, 0.04, 0.08, 0.16, 0.32)),
    ("rare_marks", (0.0, 0.01, 0.05, 0.15)),
    ("ends", (0, 1)),
    ("distinct", (0.3, 0.6, 0.8, 0.95)),
    ("common", (0.0, 0.1, 0.2, 0.3, 0.4, 0.6)),
    ("copies", (1, 2, 4)),
    ("longest", (4, 8, 12, 16, 24, 48)),
    ("repeats", (0.0, 0.05, 0.2, 0.5)),
)
_EDGES = [np.array(edges, float) for _, edges in _BINS]
_STARTS = np.cumsum([0] + [len(e) + 1 for e in _EDGES])
WIDTH = int(_STARTS[-1])


@dataclass
class Field:
    """Weights for good against bad; turns[a, b]: from label a to b."""

    common: frozenset[bytes]
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    turns: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None


def lines_of(raw: bytes) -> list[bytes]:
    """Lines with a word; one empty line where there is none."""
    return [x for x in raw.split(b"\n") if x.strip()] or [b""]


def line_values(lines: list[bytes], common: frozenset[bytes]) -> np.ndarray:
    """Feature values (lines, features)."""
    seen = Counter(lines)
    out = []
    for line in lines:
        words = line.split()
        n, size = len(words), max(1, len(line))
        lower = [w.lower().strip(b".,;:!?") for w in words]
        kinds = Counter(lower)
        bare = len(line) - len(line.translate(None, b" \t\r\x0b\x0c"))
        out.append((
            n,
            (len(line) - bare) / max(1, n),
            (len(line) - len(line.translate(None, _UPPER))) / size,
            (len(line) - len(line.translate(None, _DIGIT))) / size,
            (len(line) - len(line.translate(None, _MARK))) / size,
            (len(line) - len(line.translate(None, _RARE_MARK))) / size,
            line.rstrip()[-1:] in (b".", b"!", b"?"),
            len(kinds) / max(1, n),
            sum(c for w, c in kinds.items() if w in common) / max(1, n),
            seen[line],
            max(map(len, words), default=0),
            sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / max(1, n),
        ))
    return np.array(out, float)


def binned(values: np.ndarray) -> np.ndarray:
    """Numbers (lines, features) of the active bins."""
    return np.stack([start + np.searchsorted(edges, values[:, k], "left") for k, (start, edges) in enumerate(zip(_STARTS, _EDGES, strict=False))], axis=1)


def _scores(active: np.ndarray, doc: np.ndarray, model: Field) -> np.ndarray:
    """Good-against-bad score of each line; doc numbers the lines' documents."""
    z = model.bias + model.own[active].sum(axis=1)
    same = doc[1:] == doc[:-1]
    z[1:] += same * model.before[active[:-1]].sum(axis=1)
    z[:-1] += same * model.after[active[1:]].sum(axis=1)
    return z


def forward_backward(z: np.ndarray, real: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of good (documents, lines) and pair sums (2, 2) of padded blocks.

    Padding is at the end. Messages are normalised at each line.
    """
    docs, length = z.shape
    top = np.maximum(z, 0)
    e = np.stack([np.exp(-top), np.exp(z - top)], axis=2)
    e[~real] = 1.0
    t = np.exp(turns - turns.max())
    ahead = np.empty((docs, length, 2))
    ahead[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for k in range(1, length):
        m = (ahead[:, k - 1] @ t) * e[:, k]
        m /= m.sum(axis=1, keepdims=True)
        ahead[:, k] = np.where(real[:, k : k + 1], m, ahead[:, k - 1])
    back, pairs = np.ones((docs, length, 2)), np.zeros((2, 2))
    for k in range(length - 1, 0, -1):
        m = back[:, k] * e[:, k]
        both = ahead[:, k - 1, :, None] * t * m[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        pairs += both[real[:, k]].sum(axis=0)
        m = m @ t.T
        m /= m.sum(axis=1, keepdims=True)
        back[:, k - 1] = np.where(real[:, k : k + 1], m, 1.0)
    both = ahead * back
    return both[:, :, 1] / both.sum(axis=2), pairs


def _blocks(lengths: np.ndarray):
    """Documents of similar length, as blocks of bounded size."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * lengths[order[stop]] <= CELLS:
            stop += 1
        yield order[at:stop]
        at = stop


def marginals(z: np.ndarray, lengths: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all lines in order, and pair sums."""
    starts = np.cumsum(lengths) - lengths
    out, pairs = np.empty(len(z)), np.zeros((2, 2))
    for block in _blocks(lengths):
        width = int(lengths[block].max())
        real = np.arange(width) < lengths[block, None]
        at = np.where(real, starts[block, None] + np.arange(width), 0)
        p, both = forward_backward(np.where(real, z[at], 0.0), real, turns)
        out[at[real]] = p[real]
        pairs += both
    return out, pairs


def _fit_field(active, doc, lengths, good, common) -> Field:
    """Adam on the field's conditional likelihood."""
    size = 3 * WIDTH + 1 + 4
    w, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    same = doc[1:] == doc[:-1]
    was = np.zeros((2, 2))
    np.add.at(was, (good[:-1][same], good[1:][same]), 1)
    make = lambda w: Field(common, w[:WIDTH], w[WIDTH : 2 * WIDTH], w[2 * WIDTH : 3 * WIDTH], float(w[3 * WIDTH]), w[3 * WIDTH + 1 :].reshape(2, 2))
    for step in range(1, STEPS + 1):
        model = make(w)
        p, pairs = marginals(_scores(active, doc, model), lengths, model.turns)
        g = good - p
        parts = [np.zeros(WIDTH) for _ in range(3)]
        np.add.at(parts[0], active, g[:, None])
        np.add.at(parts[1], active[:-1], (same * g[1:])[:, None])
        np.add.at(parts[2], active[1:], (same * g[:-1])[:, None])
        grad = np.concatenate([*parts, [g.sum()], (was - pairs).ravel()]) / len(good) - PENALTY * w
        first += 0.1 * (grad - first)
        second += 0.01 * (grad**2 - second)
        w = w + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return make(w)


def _shares(p: np.ndarray, weights: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted mean marginal of each document, as a logit."""
    share = np.bincount(doc, p * weights, n) / np.bincount(doc, weights, n)
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def train(texts: list[bytes], labels: list[int], share: float | None = None) -> Field:
    """The field and its curve; ``share`` is that of label 1 where the texts were drawn from, if by class."""
    empty = Field(frozenset(), *(np.zeros(WIDTH) for _ in range(3)), 0.0, np.zeros((2, 2)))
    pieces = [(b[k : k + SAMPLE_LINES], v) for b, v in zip(map(lines_of, texts), labels, strict=True) for k in range(0, len(b), SAMPLE_LINES)]
    bags, y = [b for b, _ in pieces], np.array([v for _, v in pieces], np.int64)
    if not len(y) or y.min() == y.max():
        empty.constant = float(y.mean()) if len(y) else 0.5
        return empty
    words: Counter = Counter()
    for bag, good in zip(bags, y, strict=True):
        if good:
            words.update({w for line in bag for w in line.lower().split()})
    common = frozenset(w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:COMMON])
    active = np.concatenate([binned(line_values(b, common)) for b in bags])
    lengths = np.array([len(b) for b in bags])
    doc = np.repeat(np.arange(len(bags)), lengths)
    weights = np.array([max(1, len(x)) for b in bags for x in b], float)
    good = y[doc]
    model = _fit_field(active, doc, lengths, good, common)
    p, _ = marginals(_scores(active, doc, model), lengths, model.turns)
    moved = np.where(p > SURE, 1, np.where(p < 1 - SURE, 0, good))
    # a document keeps at least one line with its own label
    agree = np.bincount(doc, moved == y[doc], len(y)) > 0
    model = _fit_field(active, doc, lengths, np.where(agree[doc], moved, good), common)
    p, _ = marginals(_scores(active, doc, model), lengths, model.turns)
    x = _shares(p, weights, doc, len(y))
    slope, shift = 1.0, 0.0
    ones = y.mean() if share is None else min(max(share, 0.001), 0.999)
    by_class = np.where(y == 1, ones / y.mean(), (1 - ones) / (1 - y.mean()))
    for _ in range(50):  # Newton steps for the logistic curve
        q = 1 / (1 + np.exp(-(slope * x + shift)))
        r, v = by_class * (y - q), by_class * np.maximum(q * (1 - q), 1e-6)
        h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-2]])
        move = np.linalg.solve(h, [(r * x).sum() - 1e-2 * slope, r.sum() - 1e-2 * shift])
        slope, shift = slope + float(np.clip(move[0], -1, 1)), shift + float(np.clip(move[1], -1, 1))
    model.slope, model.shift = slope, shift
    return model


def judge(texts: list[bytes], model: Field) -> tuple[list[float], list[int], list[int]]:
    """Scores, line counts and counts of lines more likely bad than good."""
    bags = [lines_of(t) for t in texts]
    lengths = np.array([len(b) for b in bags], np.int64)
    if model.constant is not None or not bags:
        return [model.constant or 0.0] * len(bags), lengths.tolist(), [0] * len(bags)
    active = np.concatenate([binned(line_values(b, model.common)) for b in bags])
    doc = np.repeat(np.arange(len(bags)), lengths)
    weights = np.array([max(1, len(x)) for b in bags for x in b], float)
    p, _ = marginals(_scores(active, doc, model), lengths, model.turns)
    x = _shares(p, weights, doc, len(bags))
    score = 1 / (1 + np.exp(-np.clip(model.slope * x + model.shift, -500, 500)))
    return score.tolist(), lengths.tolist(), np.bincount(doc, p < 0.5, len(bags)).astype(int).tolist()


def fit(docs: DataFrame, labels: DataFrame, learn, bound: int = SAMPLE_DOCS) -> Field:
    """Learn from about ``bound`` documents that have a label where ``learn`` holds."""
    drawn, share = labelled_sample(docs, labels, "quality", learn, bound)
    return learned(drawn, lambda texts, found: train(texts, found, share))


def score(docs: DataFrame, model: Field) -> DataFrame:
    """docs with score, n_lines and n_bad_lines, one row for each row.

    Null, empty and blank texts count as one empty line; one without line ends, of
    whatever length, as one line. Long texts are scored as a whole. Repeated rows
    keep a row each; an empty table has none. Labels of one class only give that
    class's score to all, no labels give 0.5. A line that is as likely good as bad
    counts as good. Columns with these names are replaced.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own = shared.value

        def work(texts):
            scores, lines, bad = judge(texts, own)
            return [pa.array(scores, pa.float64()), pa.array(lines, pa.int32()), pa.array(bad, pa.int32())]

        return work

    return map_texts(docs, "score double, n_lines int, n_bad_lines int", start)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from the labels of rows not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    return score(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "n_bad_lines"
    )
