"""Importance resampling towards a target distribution over hashed word pairs.

Identical texts are collapsed by grouping on the full text, so that features
and weight of a text are computed once, however many documents have it; bucket
counts are multiplied by the number of copies. Weights are joined back to the
documents before each document's own noise is added, and the highest scores are
drawn. Ranks come from the counts of each score and the order within one score,
so no task sorts all documents.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches, byte_lists, checkpointed, removed, shared_folder, spread_join, table

BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
#: Percent of the documents with enough words that are drawn.
PERCENT = 25
#: Words of texts whose A-Z are lower-cased: digits, a-z and all beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _key():
    """A text's digest: it tells texts apart as they do themselves, in 32 bytes."""
    return F.unhex(F.sha2(_text(), 256))


def buckets_of(raw: bytes, buckets: int) -> tuple[int, np.ndarray]:
    """Words of a text, and the buckets of its features, sorted, with repeats."""
    words = WORD.findall(raw.lower())
    ones = list(map(zlib.crc32, words))
    # the checksum of "a b" goes on from that of "a "
    pairs = map(zlib.crc32, words[1:], [zlib.crc32(b" ", x) for x in ones])
    found = np.fromiter((*ones, *pairs), np.int64, max(0, 2 * len(words) - 1)) % buckets
    found.sort()
    return len(words), found


def features(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(key, copies, n_words, n_features, packed) of each distinct text; null is the empty text.

    ``packed`` has the sorted buckets as differences, which compress well.
    """
    bounded_batches(docs.sparkSession)
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        for batch in batches:
            rows = [buckets_of(raw, buckets) for raw in byte_lists(batch.column("text"))]
            packed = [np.diff(found, prepend=0).astype(kind).tobytes() for _, found in rows]
            columns = [pa.array([n for n, _ in rows], pa.int64()), pa.array([len(x) for _, x in rows], pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), *columns], names=["key", "copies", "n_words", "n_features", "packed"])

    texts = docs.select(_text().alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    return texts.select(_key().alias("key"), "copies", "text").mapInArrow(run, "key binary, copies bigint, n_words bigint, n_features bigint, packed binary")


def _unpacked(raw: bytes, buckets: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u2" if buckets <= 1 << 16 else "<u4"), dtype=np.int64)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all documents in each bucket, copies counted each."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw, copies in zip(batch.column("packed").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                total += copies * np.bincount(_unpacked(raw, buckets), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["bucket", "n"])

    return texts.select("copies", "packed").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """A bucket's gain: 1000 times the log of its share in the target over that in the source, one added to each bucket, rounded down.

    At most ``buckets`` numbers come to the driver.
    """
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").fillna(0, ["s", "t"])
    totals = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("S"), F.coalesce(F.sum("t"), F.lit(0)).alias("T")).first()
    s_all, t_all = (F.lit(float(totals[x] + buckets)) for x in ("S", "T"))
    ratio = ((F.col("t") + 1).cast("double") * s_all) / ((F.col("s") + 1).cast("double") * t_all)
    out = np.zeros(buckets, np.int64)
    for row in both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain")).collect():
        out[row["bucket"]] = row["gain"]
    return out


def weights(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(key, members, n_words, n_features, weight): the floored mean gain of a text's features, 0 without any."""
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            found = [int(gain[_unpacked(raw, buckets)].sum()) // max(1, n) for raw, n in zip(batch.column("packed").to_pylist(), batch.column("n_features").to_pylist(), strict=True)]
            own = [batch.column(c) for c in ("key", "copies", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.int64())], names=["key", "members", "n_words", "n_features", "weight"])

    return texts.mapInArrow(run, "key binary, members bigint, n_words bigint, n_features bigint, weight bigint")


def _noise(seed: int):
    """A document's Gumbel noise, in thousandths, from a hash of its id; a null id is hashed as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def ranked(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """scored with ``rank``: 1, 2, 3... of the ``percent`` highest scores of documents with ``min_words`` words, ties to the smaller id.

    Scores are whole thousandths of logarithms, so there are at most some hundred
    thousand different ones, however many documents; their counts give each
    score's first rank. Rows within a score are ordered by id, null last, then by
    weight and features, so that rows in one place are equal in all columns.
    """
    fit = F.col("n_words") >= min_words
    counts = scored.where(fit).groupBy("score").agg(F.count("*").alias("n"))
    down = Window.orderBy(F.desc("score"))
    counts = counts.select(
        "score", (F.sum("n").over(down) - F.col("n")).alias("before"), F.floor(F.sum("n").over(Window.partitionBy()) * percent / F.lit(100)).cast("bigint").alias("drawn"),
    )
    reached = F.broadcast(counts.where(F.col("before") < F.col("drawn")))
    within = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features"))
    place = F.col("before") + F.row_number().over(within)
    high = scored.where(fit).join(reached, "score").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))
    rest = scored.where(fit).join(reached, "score", "left_anti").unionByName(scored.where(~fit)).withColumn("rank", F.lit(None).cast("bigint"))
    return high.select(*scored.columns, "rank").unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every row's (doc_id, n_words, n_features, weight, score, rank); rank is null where a row is not drawn.

    ``docs`` has doc_id and text, ``target`` text; other columns do not matter,
    whatever their names. Null and empty texts have no features, weight 0 and are
    never drawn, if ``min_words`` is over 0; a null id is hashed as an empty text
    and comes last among ties. Long texts are taken as a whole. Repeated rows each
    have their place; equal ids have equal noise. An empty target weighs all
    buckets by the source alone; an empty table has no rows.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/importance-{uuid.uuid4().hex}"
    features(docs, buckets).write.option("compression", "zstd").parquet(folder)
    texts = spark.read.parquet(folder)
    gain = gains(bucket_counts(texts, buckets), bucket_counts(features(target, buckets), buckets), buckets)
    weighed = checkpointed(weights(texts, gain))
    removed(spark, folder)
    total = weighed.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    scored = spread_join(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _key().alias("key")), weighed, ["key"], total)
    scored = scored.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + _noise(seed)).alias("score"))
    return ranked(checkpointed(scored), percent, min_words)


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Every document's weight, score and rank among those drawn towards the benchmark's texts."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH crc_table AS (
  SELECT list(value ORDER BY n) AS crcs FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS value FROM range(256) t(n)
  )
), rows AS (
  SELECT doc_id, row_number() OVER () AS row, 's' AS side, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT item_id, row_number() OVER (), 't', coalesce(text, '') FROM benchmark
), worded AS (
  SELECT side, row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM rows
), grams AS (
  SELECT side, row, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS gram FROM worded
), bytes AS (
  SELECT gram, hex(encode(gram)) AS digits FROM (SELECT DISTINCT gram FROM grams)
), hashed AS (
  SELECT gram, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(0, len(digits) // 2), lambda i: (strpos('0123456789ABCDEF', digits[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', digits[2 * i + 2]) - 1)),
           lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM bytes, crc_table
), counts AS (
  SELECT bucket, count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 't') AS t FROM grams JOIN hashed USING (gram) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts
), sums AS (
  SELECT row, sum(gain)::BIGINT AS gain, count(*) AS n FROM grams JOIN hashed USING (gram) JOIN gains USING (bucket) WHERE side = 's' GROUP BY row
), weighed AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce((gain - ((gain % n) + n) % n) // n, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM worded LEFT JOIN sums USING (row) WHERE side = 's'
), scored AS (
  SELECT doc_id, n_words, n_features, weight, (weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM weighed
), placed AS (
  SELECT doc_id, n_words, n_features, weight, score, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
         (25 * count(*) FILTER (WHERE n_words >= 20) OVER ()) // 100 AS drawn
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM placed
"""
