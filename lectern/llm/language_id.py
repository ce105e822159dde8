"""Language identification by hierarchical discrimination.

Character n-grams of the whole text are hashed into a count vector. A first
layer of linear support vector machines picks the language family; within it,
one machine for each pair of languages votes. All are L2 machines trained in
numpy on a bounded sample with the same number of documents a language, by one
task on an executor that gets count vectors and no texts.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches, byte_lists, map_texts, remainder, table

# Families by ISO 639-1 code. Other codes form the family "other".
_FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk",
    "indic": "hi bn ur mr pa gu ne",
    "semitic": "ar he mt am",
    "celtic": "ga cy br gd",
    "baltic": "lt lv",
    "cjk": "zh ja ko",
}
_FAMILY = {code: family for family, codes in _FAMILIES.items() for code in codes.split()}

#: Distinct texts to learn from: for each language and in all; a language has LEAST at least, however many there are.
PER_LANGUAGE, IN_ALL, LEAST = 400, 3000, 4
DIMENSIONS = 1 << 13
PENALTY, STEPS = 1e-4, 250
UNDETERMINED = "und"
#: ASCII that is no letter becomes a space.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], "other")


def features(raw: bytes) -> np.ndarray | None:
    """Unit vector of hashed 1- to 3-grams of bytes; None if the text has no letter."""
    text = raw.decode("utf-8", "replace")
    if not any(map(str.isalpha, text)):
        return None
    own = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    pairs = own[:-1] * np.uint32(257) + own[1:]
    triples = pairs[:-1] * np.uint32(263) + own[2:]
    total = np.zeros(DIMENSIONS)
    for k, gram in enumerate((own, pairs, triples)):
        slot = ((gram + np.uint32(k * 7919)) * np.uint32(2654435761)) >> np.uint32(32 - 13)
        total += np.bincount(slot, minlength=DIMENSIONS)
    total = np.sqrt(total)
    return (total / np.linalg.norm(total)).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of an L2 support vector machine; y is +1 or -1.

    Classes weigh alike. Nesterov's accelerated gradient on the squared hinge.
    """
    x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x1.shape[1], np.float32)
    rate = np.float32(1 / (2 * 2.0 + PENALTY))  # rows have a norm of at most sqrt(2)
    for k in range(STEPS):
        slack = np.maximum(0, 1 - y * (x1 @ ahead))
        new = ahead - rate * (np.float32(PENALTY) * ahead - 2 * ((weight * y * slack) @ x1))
        ahead = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


@dataclass
class LanguageModel:
    """Family machines (one against the rest) and pair machines within a family."""

    languages: dict[str, list[str]] = field(default_factory=dict)  # by family
    families: list[tuple[str, np.ndarray]] = field(default_factory=list)
    pairs: dict[str, list[tuple[str, str, np.ndarray]]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """Of each row the language, and its family's share times its share of the pair votes.

        Of families of equal odds the first by name counts; of languages of equal
        votes the one with more odds, then the first by name.
        """
        if not self.languages:
            return [(UNDETERMINED, 0.0)] * len(x)
        names = list(self.languages)
        family, share = np.zeros(len(x), int), np.ones(len(x))
        if len(self.families) > 1:
            odds = _odds(x, [w for _, w in self.families])
            family = odds.argmax(axis=1)
            share = odds.max(axis=1) / np.maximum(odds.sum(axis=1), 1e-12)
        out: list = [None] * len(x)
        for k in np.unique(family):
            rows, own = np.flatnonzero(family == k), self.languages[names[k]]
            votes, votes_for = np.zeros((2, len(rows), len(own)))
            pairs = self.pairs.get(names[k], [])
            odds = _odds(x[rows], [w for _, _, w in pairs])
            for (a, b, _), p in zip(pairs, odds.T, strict=True):
                i, j = own.index(a), own.index(b)
                votes[np.arange(len(rows)), np.where(p >= 0.5, i, j)] += 1
                votes_for[:, i] += p
                votes_for[:, j] += 1 - p
            best = np.lexsort((np.broadcast_to(np.arange(len(own)), votes.shape), -votes_for, -votes), axis=1)[:, 0]
            within = votes_for[np.arange(len(rows)), best] / (len(own) - 1) if len(own) > 1 else np.ones(len(rows))
            for r, c, p in zip(rows, best, np.minimum(1.0, share[rows] * within), strict=True):
                out[r] = own[c], float(p)
        return out


def _odds(x: np.ndarray, machines: list[np.ndarray]) -> np.ndarray:
    """How sure each machine is of each row: one matrix product."""
    if not machines:
        return np.zeros((len(x), 0))
    w = np.stack(machines)
    return 1 / (1 + np.exp(-4 * np.clip((x @ w[:, :-1].T + w[:, -1]).astype(float), -20, 20)))


def train(x: np.ndarray, langs: list[str]) -> LanguageModel:
    """From count vectors, a row a text."""
    model = LanguageModel()
    if not len(x):
        return model
    c = np.array(langs)
    f = np.array([family_of(k) for k in c])
    for family in sorted(set(f)):
        model.languages[family] = sorted(set(c[f == family]))
    for family, own in model.languages.items():
        if len(model.languages) > 1:
            model.families.append((family, machine(x, np.where(f == family, 1.0, -1.0))))
        model.pairs[family] = [(a, b, machine(x[(c == a) | (c == b)], np.where(c[(c == a) | (c == b)] == a, 1.0, -1.0))) for a, b in combinations(own, 2)]
    return model


def _vectors(batches):
    for batch in batches:
        found = [features(t) for t in byte_lists(batch.column("text"))]
        there = [i for i, x in enumerate(found) if x is not None]
        own = [batch.column(c).take(pa.array(there, pa.int64())) for c in ("lang", "place")]
        yield pa.RecordBatch.from_arrays([*own, pa.array([found[i].tobytes() for i in there], pa.binary())], names=["lang", "place", "x"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> LanguageModel:
    """Learn from text and lang of docs: at most ``per_language`` distinct texts of each language.

    Of each language the texts with the least hashes are drawn, so the sample is
    the same at every run, copies count once and no language goes without. A
    threshold on the hash, wide enough for ten times the texts wanted, comes first,
    so that no language's texts are sorted as a whole. Texts are read as a whole,
    where they lie: what is gathered is a vector of DIMENSIONS numbers for each text
    of the sample, and the driver gets the model. Texts without a letter teach nothing.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30))
    distinct = known.groupBy("lang", place.alias("place")).agg(F.lit(1))
    sizes = distinct.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least")).collect()  # a row a language
    if not sizes:
        return LanguageModel()
    each = min(per_language, max(LEAST, in_all // len(sizes)))
    shares = [(r["lang"], float(min(1.0, 10 * (each + 3) / r["n"])), r["least"]) for r in sizes]
    chosen = docs.sparkSession.createDataFrame(shares, "lang string, share double, least bigint")
    draw = (F.col("place") < F.col("share") * (1 << 30)) | (F.col("place") == F.col("least"))
    kept = known.select("lang", "text", place.alias("place")).join(F.broadcast(chosen), "lang").where(draw)
    first = Window.partitionBy("lang").orderBy("place")
    places = kept.select("lang", "place").distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= each).drop("_n")
    # copies share a place: one is kept
    rows = kept.join(F.broadcast(places), ["lang", "place"]).mapInArrow(_vectors, "lang string, place bigint, x binary")
    rows = rows.groupBy("lang", "place").agg(F.min("x").alias("x"))

    def learn(batches):
        langs, found = [], []
        for batch in batches:
            langs += batch.column("lang").to_pylist()
            found += [np.frombuffer(x, np.float32) for x in batch.column("x").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(np.stack(found) if found else np.zeros((0, DIMENSIONS), np.float32), langs))], pa.binary())], names=["model"])

    bounded_batches(docs.sparkSession)
    return pickle.loads(rows.repartition(1).sortWithinPartitions("lang", "place").mapInArrow(learn, "model binary").first()["model"])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score, one row for each row.

    Null texts and texts without a letter give ``und`` and 0, as does a model
    that has learned nothing. Long texts are read as a whole. Repeated rows keep a
    row each; an empty table has none. Ties are broken as ``predict`` says. Columns
    of docs with these names are replaced.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own = shared.value

        def work(texts):
            rows, found = [(UNDETERMINED, 0.0)] * len(texts), [features(t) for t in texts]
            lettered = [i for i, x in enumerate(found) if x is not None]
            if lettered:
                for i, row in zip(lettered, own.predict(np.stack([found[i] for i in lettered])), strict=True):
                    rows[i] = row
            return [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())]

        return work

    return map_texts(docs, "lang_pred string, score double", start)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the rows not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = fit(docs.where(~held_out).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
