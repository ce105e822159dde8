"""What several corpus operators share."""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.storage import checkpointed, removed, shared_folder  # noqa: F401  for the operators

#: Of longer texts a part of this length is learned from (they are scored like all others).
SAMPLE_CHARS = 200_000
#: Bytes that part words: what ``bytes.split()`` splits at, space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys with more rows may be broadcast instead of shuffled, so many keys at most.
HOT_ROWS, MOST_HOT = 500, 20_000
#: Tables of so many rows are joined as they are: one task may hold all of them.
SMALL = 20_000
#: What an Arrow batch may hold.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, where the session leaves that open, since single texts may be very long.

    The bounds are the same for all operators, so that it does not matter which ran last.
    """
    for name, default, bound in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(bound))


def byte_lists(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def settled(df: DataFrame, rows_each: int = 50_000) -> tuple[DataFrame, int]:
    """df checkpointed, and its rows; in no more partitions than these fill.

    Small results of wide shuffles would otherwise pass hundreds of nearly
    empty partitions on to every shuffle that follows.
    """
    kept = checkpointed(df)
    n = kept.count()
    return kept.coalesce(max(1, -(-n // rows_each))), n


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """left joined to right, in which ``members`` bounds how many of left's ``total`` rows have a key; one row a key.

    Keys with very many rows are broadcast, so that these rows stay where they
    are: by their number of members there are MOST_HOT such keys at most, however
    large the tables.
    """
    if total <= SMALL:
        return left.join(right, keys, how)
    limit = max(HOT_ROWS, total // MOST_HOT)
    hot = right.where(F.col("members") > limit)
    spread = left.join(F.broadcast(hot), keys)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col("members") <= limit), keys, how)
    return spread.unionByName(rest)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo divisor; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int) -> tuple[DataFrame, float]:
    """((doc_id, text, label) of about ``bound`` labelled documents, the share of label 1 among all of them).

    The same ones at every run. Each class gets half of the bound, and what the
    other leaves, so that few documents of one class are not drawn thinner still.
    The ids come first, ordered by hash, so that only ``bound`` ids are broadcast
    and only their texts leave the executors. Rows that repeat an id count once
    for each of their texts; of several labels of an id the largest counts. Of a
    text over SAMPLE_CHARS characters that many are learned from, from a place
    that a hash draws.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label")).where(learn)
    there = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones = min(there.get(1, 0), max(bound // 2, bound - there.get(0, 0)))
    ids = None
    for value, wanted in ((1, ones), (0, min(there.get(0, 0), bound - ones))):
        # a threshold on the hash first: only about twice the bound is sorted
        share = min(1.0, 2 * wanted / max(1, there.get(value, 0)))
        drawn = known.where((F.col("label") == value) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * share)))
        drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(wanted)
        ids = drawn if ids is None else ids.unionByName(drawn)
    text, n = F.coalesce(F.col("text").cast("string"), F.lit("")), F.char_length("text")
    place = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.greatest(n - SAMPLE_CHARS, F.lit(1))).cast("int") + 1
    part = F.when(n > SAMPLE_CHARS, F.substring(text, place, F.lit(SAMPLE_CHARS))).otherwise(text)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), part.alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id", "text_hash").agg(F.min("text").alias("text"), F.max("label").cast("int").alias("label"))
    return rows.select("doc_id", "text", "label"), there.get(1, 0) / max(1, sum(there.values()))


def learned(sample: DataFrame, train):
    """``train(texts, labels)`` of a bounded sample (doc_id, text, label), run by one task on an executor.

    Texts come in the order of id and text. The driver holds the model only, and
    a lost executor costs one attempt. Labels of no row: ``train([], [])``.
    """
    bounded_batches(sample.sparkSession)

    def run(batches):
        texts, labels = [], []
        for batch in batches:
            texts.extend(byte_lists(batch.column("text")))
            labels.extend(batch.column("label").to_pylist())
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, labels))], pa.binary())], names=["model"])

    found = sample.repartition(1).sortWithinPartitions("doc_id", "text").mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([], [])


def map_texts(docs: DataFrame, added: str, start, text: str = "text") -> DataFrame:
    """docs with columns computed from whole texts, Arrow batch by batch.

    ``added`` names the new columns (DDL); columns of docs with such a name are
    replaced. ``start`` is called once for each task and returns a function of a
    list of UTF-8 texts (null: empty) that gives one Arrow array for each column.
    """
    fields = T.StructType.fromDDL(added)
    kept = [f for f in docs.schema.fields if f.name not in fields.names]
    own = [f.name for f in kept]
    extra = [] if text in own else [text]

    def run(batches):
        work = start()
        for batch in batches:
            new = work(byte_lists(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *new], names=[*own, *fields.names])

    source = docs.select(*(F.col(f"`{c}`") for c in [*own, *extra]))
    return source.mapInArrow(run, T.StructType([*kept, *fields.fields]))
