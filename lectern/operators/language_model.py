"""Languages of texts by three-letter runs, learned from texts whose language is known.

One aggregation counts the runs of each language. Of each language the most
frequent are kept, so that the table can be broadcast however many texts it was
learned from; a text's runs meet it where they are, as numbers, many texts of a
batch at once, and nothing is shuffled. Scores are whole numbers, so equal texts
score alike wherever they are added up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.operators.language import FALLBACK, _let
from lectern.storage import bounded_batches, checkpointed

#: Runs of letters that are kept of each language.
KEEP = 2_000


#: Characters whose runs are looked up at a time.
AT_ONCE = 1 << 16


def _letters(text: Column) -> Column:
    """Words in lower case with a space before and after each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), F.lit(" "))


def _coded(letters: pa.Array):
    """(text, run) arrays of the runs that ``runs`` has of these texts, some at a time: a run's three characters as one number.

    Texts begin and end with a space, so no run with a letter in the middle lies in two.
    """
    texts = letters.to_pylist()
    codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t or "") for t in texts])
    for k in range(0, len(codes) - 2, AT_ONCE):
        c = codes[k : k + AT_ONCE + 2]
        own = c[1:-1] != 32
        yield owner[k + 1 : k + len(c) - 1][own], (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[own]


def _coded_one(run: str) -> int:
    a, b, c = map(ord, run)
    return a << 42 | b << 21 | c


def _counted(batches):
    """(language, run, n) of batches (language, letters); a run may come several times."""
    for batch in batches:
        names, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        for owner, code in _coded(batch.column(1)):
            spoken = at[owner]
            for k in np.unique(spoken):
                found, n = np.unique(code[spoken == k], return_counts=True)
                text = np.stack([found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
                said = [text[i : i + 3] for i in range(0, len(text), 3)]
                yield pa.RecordBatch.from_arrays([pa.array([str(names[k])] * len(said), pa.string()), pa.array(said, pa.string()), pa.array(n, pa.int64())], names=["language", "run", "n"])


def runs(text: Column) -> Column:
    """All runs of three characters with a letter in the middle: words in lower case, a space before and after each."""
    def of(chars: Column) -> Column:
        n = F.size(chars)
        three = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.when(chars[i + 1] != " ", F.concat(chars[i], chars[i + 1], chars[i + 2])))
        return F.when(n > 2, F.filter(three, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))

    return _let(F.split(_letters(text), ""), of)


@dataclass
class LanguageModel:
    """(language, least) by language, and the table (run, own): what a run adds to each language that keeps it, over ``least``."""

    languages: list[tuple[str, int]]
    table: DataFrame


def learn(rows: DataFrame, language: str = "language", text: str = "text", keep: int = KEEP) -> LanguageModel:
    """A model of rows with a language and a text; others teach nothing.

    A run with count n of a language's N, of V different ones in all, scores
    floor(1000 ln((n + 0.5) / (N + 0.5 V))). Of equal counts the first run in order
    is kept.
    """
    bounded_batches(rows.sparkSession)
    said = rows.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(language).cast("string"), _letters(F.col(text)))
    counted = checkpointed(said.mapInArrow(_counted, "language string, run string, n bigint").groupBy("language", "run").agg(F.sum("n").alias("n")))
    distinct = counted.select("run").distinct().count()
    totals = counted.groupBy("language").agg(F.sum("n").alias("total"))
    score = lambda n: F.floor(1000.0 * F.ln((n + 0.5) / (F.col("total") + 0.5 * distinct))).cast("bigint")
    least = [(r["language"], r["least"]) for r in totals.select("language", score(F.lit(0)).alias("least")).orderBy("language").collect()]
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "run"))
    kept = counted.withColumn("_place", place).where(F.col("_place") <= keep).join(totals, "language")
    own = F.sort_array(F.collect_list(F.struct("language", (score(F.col("n")) - score(F.lit(0))).alias("over"))))
    return LanguageModel(least, checkpointed(kept.groupBy("run").agg(own.alias("own"))))


def identify(rows: DataFrame, model: LanguageModel, keys: list[str], text: str = "text", among: str | None = None) -> DataFrame:
    """rows with ``found``: the language with the best score; null without a run that the model knows.

    ``keys`` tell rows apart. With ``among``, a column of candidates, the answer is
    kept if it is one of them and else is the first of them. Of equal scores the
    first language in order counts.
    """
    bounded_batches(rows.sparkSession)
    names, least = [name for name, _ in model.languages], np.array([least for _, least in model.languages], np.int64)
    kept = model.table.select("run", F.inline("own")).collect()  # KEEP rows a language at most
    known = np.unique(np.array([_coded_one(r["run"]) for r in kept], np.int64))
    over = np.zeros((len(known), len(names)), np.int64)
    place = {name: k for k, name in enumerate(names)}
    for r in kept:
        over[np.searchsorted(known, _coded_one(r["run"])), place[r["language"]]] = r["over"]

    @F.arrow_udf("string")
    def best(letters: pa.Array) -> pa.Array:
        n, sums = np.zeros(len(letters), np.int64), np.zeros((len(letters), len(names)), np.int64)
        for owner, code in _coded(letters) if len(known) else ():
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            hit = known[at] == code
            owner, at = owner[hit], at[hit]
            if len(owner):
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                n[owner[first]] += np.diff(np.append(first, len(owner)))
                sums[owner[first]] += np.add.reduceat(over[at], first, axis=0)
        found = (n[:, None] * least + sums).argmax(axis=1) if names else n  # of equal scores the first
        return pa.array([names[k] if m else None for k, m in zip(found.tolist(), n.tolist(), strict=True)], pa.string())

    out = rows.withColumn("found", best(_letters(F.col(text))))
    if among is None:
        return out
    return out.withColumn("found", F.when(F.array_contains(among, F.col("found")), F.col("found")).otherwise(F.element_at(among, 1)))


def language_of_text(pages: DataFrame, model: LanguageModel, keys: list[str], text: str = "text") -> DataFrame:
    """pages with language (fallback English), confidence 1 and error_kind for empty text."""
    empty = F.coalesce(F.col(text), F.lit("")) == ""
    out = identify(pages, model, keys, text)
    return out.withColumns({
        "language": F.when(~empty, F.coalesce("found", F.lit(FALLBACK))), "confidence": F.when(~empty, F.lit(1.0)), "error_kind": F.when(empty, F.lit("InferenceError")),
    }).drop("found")
