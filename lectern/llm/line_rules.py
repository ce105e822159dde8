"""Quality rules: counts within a text and line frequency across documents.

Normalised lines are hashed; a line's distinct documents are counted for each
host (the ``source`` column). Lines above the limit are removed, and a document
is rejected when too little of it is left. Frequencies come from one
aggregation keyed by host, line and document, so that a line or host that holds
a third of all rows is spread before it is summed. Texts are read once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches, byte_lists, checkpointed, settled, spread_join, table

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is removed when more than this many documents of its host have it ...
MAX_DOCS = 10
#: ... and more than this share of the host's documents, or more than MANY_DOCS of them however large the host is.
MAX_SHARE, MANY_DOCS = 0.01, 500
#: Of a document's words, what must be left after the removal.
MIN_LEFT = 0.5
#: Up to this many hosts are broadcast; of more, each host's lines are joined in SALTS parts.
BROADCAST_HOSTS, SALTS = 200_000, 32
#: Up to this many frequent lines are broadcast; more are joined, the most frequent of them still broadcast.
BROADCAST_LINES = 200_000
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_DIGITS = bytes.maketrans(b"123456789", b"000000000")

_COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def line_key(line: bytes) -> int | None:
    """Hash of a line, lower-cased (A-Z), digits as 0 and spaces as one; None without a word."""
    words = line.lower().translate(_DIGITS).split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else None


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of words which occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    if len(number) == len(words):
        return 0
    ids = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    ids ^= ids >> np.uint64(29)
    keys = np.zeros(n, np.uint64)
    for k in range(window):
        keys = keys * np.uint64(0xD6E8FEB86659FD93) + ids[k : k + n]
    _, where, count = np.unique(keys, return_inverse=True, return_counts=True)
    hit = count[where] > 1
    if not hit.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    words = raw.split()
    solid = raw.translate(None, _SPACE)
    seen, again = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return len(words), len(solid.decode("utf-8", "replace")), len(raw) - len(raw.translate(None, _SYMBOLS)), again, repeated_words(words)


def _count_batches(batches):
    for batch in batches:
        counts, keys, words = [], [], []
        for raw in byte_lists(batch.column("text")):
            counts.append(text_counts(raw))
            own: dict[int, int] = {}
            for line in raw.split(b"\n"):
                if (key := line_key(line)) is not None:
                    own[key] = own.get(key, 0) + len(line.split())
            keys.append(list(own))
            words.append(list(own.values()))
        columns = list(zip(*counts, strict=True)) or [()] * 5
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, words)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "host")), *(pa.array(c, pa.int64()) for c in columns), *lists],
            names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"],
        )


def parsed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, host, counts, lines, line_words) of each row, by one pass over the texts.

    ``lines`` has a text's distinct lines and ``line_words`` their words, repeats
    included. Written to the shared folder: what follows reads no text.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        F.col("text").cast("string").alias("text"),
    )
    counted = rows.mapInArrow(_count_batches, f"doc_id bigint, host string, {_COUNTS}, lines array<bigint>, line_words array<bigint>")
    return checkpointed(counted.withColumn("row", F.monotonically_increasing_id()))


def _with_size(lines: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """lines with their host's documents; where hosts are too many to be broadcast, a host's lines are spread over SALTS tasks."""
    if n <= BROADCAST_HOSTS:
        return lines.join(F.broadcast(sizes), "host")
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("line"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"]).drop("salt")


def frequent_lines(rows: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, many_docs: int = MANY_DOCS) -> DataFrame:
    """(host, line, members) of the lines above the limits; members counts their documents."""
    sizes = rows.groupBy("host", "doc_id").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("host_docs"))
    lines = rows.select("host", "doc_id", F.explode("lines").alias("line"))
    counted = lines.groupBy("host", "line", "doc_id").agg(F.lit(1)).groupBy("host", "line").agg(F.count("*").alias("members"))
    return (
        _with_size(counted.where(F.col("members") > max_docs), *settled(sizes))
        .where((F.col("members") > max_share * F.col("host_docs")) | (F.col("members") > many_docs))
        .select("host", "line", "members")
    )


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, many_docs: int = MANY_DOCS) -> DataFrame:
    """One row per input row: doc_id, host, the counts, removed_words, base_failed and kept.

    Null texts have no words and fail the base rule; null ids and hosts are
    values like others, a null host counts as ''. Long texts are counted as a
    whole. Rows that repeat an id count once towards a line's frequency, and each
    keep their row; an empty table has none. A line that has exactly the limit's
    number of documents stays. A document is kept if it passes the base rule and,
    with its frequent lines removed, keeps MIN_WORDS words and ``min_left`` of them.
    """
    rows = parsed(docs)
    frequent, n = settled(frequent_lines(rows, max_docs, max_share, many_docs))
    lines = rows.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    lines = lines.select("row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    if n <= BROADCAST_LINES:
        hits = lines.join(F.broadcast(frequent), ["host", "line"])
    else:
        total = rows.agg(F.sum(F.size("lines"))).first()[0]
        hits = spread_join(lines, frequent, ["host", "line"], total)
    removed = hits.groupBy("row").agg(F.sum("words").alias("removed_words"))
    out = rows.drop("lines", "line_words").join(removed, "row", "left").drop("row")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rest = F.col("n_words") - F.col("removed_words")
    return (
        out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("bigint"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (rest >= MIN_WORDS) & (rest >= min_left * F.col("n_words")))
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d
), grams AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER ahead AS gram, count(*) OVER ahead AS n
  FROM w WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
), twice AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS m FROM grams WHERE n = 8) WHERE m > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM twice, range(8) t(k) GROUP BY doc_id
), raw_lines AS (
  SELECT doc_id, host, unnest(lines) AS line FROM d
), lines AS (
  SELECT doc_id, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS norm
  FROM raw_lines
), dup AS (
  SELECT doc_id, sum(c - 1) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS c FROM lines WHERE n > 0 GROUP BY doc_id, line) GROUP BY doc_id
), hosts AS (
  SELECT coalesce(source, '') AS host, count(DISTINCT doc_id) AS host_docs FROM documents GROUP BY 1
), frequent AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT doc_id) AS n_docs FROM lines WHERE n > 0 GROUP BY host, norm) JOIN hosts USING (host)
  WHERE n_docs > 10 AND (n_docs > 0.01 * host_docs OR n_docs > 500)
), removed AS (
  SELECT doc_id, sum(n) AS removed_words FROM lines JOIN frequent USING (host, norm) WHERE n > 0 GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND n_words - removed_words >= 20 AND n_words - removed_words >= 0.5 * n_words AS kept
FROM counts
"""
