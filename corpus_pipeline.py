"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, secrets, encoding.

Each stage works on all that the one before it kept. The first three drop
documents, the fourth masks secrets in the text, the last adds the text's
pieces. A stage's rows are written to the shared checkpoint folder and read
again by the next, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontamination, near_duplicates, secret_scan, sentencepiece_codec, toxicity
from lectern.llm.common import checkpointed, removed, shared_folder, table, unused


#: So many keys of dropped rows are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 50_000
_KEY = ["doc_id", "text"]


def _apart(docs: DataFrame, also: str | None = None) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(rows, again): doc_id, text and one column with all others, out of the operators' way; ``again(rows)`` undoes it.

    Users' columns may have the names that operators give to theirs, and any type.
    ``also`` names a column that the operator reads; null where docs has none.
    """
    others, name = [c for c in docs.columns if c not in _KEY], unused(docs, "own")
    packed = [F.struct(*(F.col(f"`{c}`") for c in others)).alias(name)] if others else []

    def again(rows: DataFrame, *more: Column, n_chars: Column | None = None) -> DataFrame:
        own = {c: F.col(c) if c in _KEY else F.col(name)[c].alias(c) for c in docs.columns}
        if n_chars is not None and "n_chars" in others:
            own["n_chars"] = F.when(n_chars.isNotNull(), n_chars.cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"]).alias("n_chars")
        return rows.select(*own.values(), *more)

    read = [(F.col(f"`{also}`") if also in others else F.lit(None)).cast("string").alias(also)] if also else []
    return docs.select(*_KEY, *read, *packed), again


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.5.

    Null, empty and blank texts have no sentence and stay, as do rows without an id;
    long texts are scored as a whole, rows that repeat alike. An empty table stays
    empty, and without labels all documents stay. All columns keep their values.
    """
    model = toxicity.fit_for_contract(docs, table(spark, sf_dir, "labels"))
    rows, again = _apart(docs)
    return again(toxicity.score(rows, model).where(F.col("score") < 0.5))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the least by id and text hash; rows without an id and texts without a word stay.

    Of rows that repeat an id and a text one stays, the least by its other columns
    as JSON. Rows that share an id but not the text are documents of their own, so no
    text goes with another. Long texts are compared as a whole; an empty table stays
    empty. All columns keep their values, whatever their names and types.
    """
    rows, again = _apart(docs)
    keys, own = ["doc_id", unused(docs, "text_hash")], [c for c in rows.columns if c not in _KEY]
    found = near_duplicates.near_duplicates(docs.select(*_KEY)).where(F.col("doc_id").isNotNull())
    found = checkpointed(found.select("doc_id", F.col("text_hash").alias(keys[1]), "chosen"))
    rows = rows.withColumn(keys[1], F.xxhash64(F.col("text").cast("string")))
    dropped = found.where(~F.col("chosen")).select(*keys).distinct()
    few = dropped.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    kept = rows.join(F.broadcast(dropped) if few else dropped, keys, "left_anti")
    repeated = found.where("chosen").groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(*keys)
    if not repeated.isEmpty():
        row = F.struct(*_KEY, *own)
        once = kept.join(repeated, keys, "left_semi").groupBy(*keys).agg(F.min_by(row, F.to_json(F.struct(F.lit(0), *own))).alias("row"))
        kept = kept.join(repeated, keys, "left_anti").select(*_KEY, *own).unionByName(once.select("row.*"))
    return again(kept)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, but for items too short to be evidence.

    Null and empty texts hold none and stay; long texts are searched as a whole, and
    rows that repeat have one verdict. An empty table stays empty, and with an empty
    benchmark all documents stay. All columns keep their values.
    """
    rows, again = _apart(docs)
    found = decontamination.find_leaks(rows, table(spark, sf_dir, "benchmark"))
    return again(found.where(~F.exists("leaks", lambda x: x["item_words"] >= decontamination.MIN_ITEM_WORDS)))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars, if there is such a column, follows a text that changed.

    Null, empty and clean texts stay as they are; long texts are scanned as a whole,
    rows that repeat change alike, an empty table stays empty. All other columns keep
    their values.
    """
    rows, again = _apart(docs, "source")
    masked = secret_scan.redact(rows, secret_scan.default_forest(spark))
    return again(masked, n_chars=F.when(F.col("n_secrets") > 0, F.char_length("text")))


def add_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``pieces``, and with ``round_trip``: whether these decode to the text.

    Null and empty texts have no pieces and decode to the empty text; long texts are
    coded as a whole, rows that repeat alike, an empty table stays empty. Columns of
    docs with these names keep theirs and their values: the new ones get a _ then.
    """
    rows, again = _apart(docs)
    pieces, whole = unused(docs, "pieces"), unused(docs, "round_trip")
    decoded = F.col("decoded") == F.coalesce("text", F.lit(""))
    return again(sentencepiece_codec.coded(rows), F.col("pieces").alias(pieces), decoded.alias(whole))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("sentencepiece", add_pieces),
]

#: Learned models and sketches have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table. A stage's table goes once the next one's is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(path := f"{folder}/{k}-{name}")
        if last is not None:
            removed(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
