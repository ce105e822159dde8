"""Ranked lexical search over inverted treaps.

Each shard of documents has, for every term, a treap of its postings: documents
are in search order and impacts in heap order, so a subtree's greatest impact is
at its root. A query goes through the treaps of its terms together. It starts
with all of the shard's documents; the sum of the terms' greatest weighted
impacts within a range of documents bounds every score there. A range whose
bound cannot enter the best k is left, the others are split at the document of
the greatest root, and ranges with few postings are scored whole.

Documents are read once: the postings of the queries' terms go to the shared
folder, statistics of all documents are gathered from them, and each task builds
the treaps of its part and keeps the best k of each query.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches, byte_lists, checkpointed, removed, shared_folder, table

K = 50
#: Score constants: an impact is IMPACT * tf div (1000 * tf + LENGTH * m), m the length's share in percent, SHARE of it fixed.
IMPACT, LENGTH, SHARE = 1_000_000_000, 20, 50
#: Terms of texts whose A-Z are lower-cased.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Queries are searched in blocks of about so many rows and characters, each with one pass over the documents.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 20_000_000
#: A shard has so many postings at most, but for its last document's.
SHARD_POSTINGS = 4_000_000
#: Ranges with at most so many postings are scored whole; so many ranges are split at a time.
LEAF, AT_ONCE = 2_000, 128


class Treaps:
    """The treaps of all terms of a shard, built from postings in the order of term and document.

    Nodes of one term stand in document order behind a node that is no posting;
    node 0 is such a one and means none. Equal impacts are ordered by a hash of
    the document, so that equal documents in a row do not make a chain.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int):
        sizes = np.bincount(term, minlength=n_terms)
        self.start = np.concatenate([[0], np.cumsum(sizes + 1)]) + 1  # a term's first node; the one before is the mark
        n = len(term) + n_terms + 1
        at = np.arange(len(term)) + term + 1
        self.doc, self.impact = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.doc[at], self.impact[at] = doc, impact
        self.order = np.zeros(n, np.int64)  # sorted: term, then document, the marks first
        self.order[at] = (term.astype(np.int64) << 32) + doc + 1
        self.order[self.start - 1] = np.arange(n_terms + 1) << 32
        key = np.full(n, np.iinfo(np.int64).max)
        key[at] = (impact << 31) + ((doc * 2654435761 + 12345) & 0x7FFFFFFF)
        left, right = self._greater(key, -1), self._greater(key, 1)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        up = np.where(key[left] < key[right], left, right)[at]
        inner = key[up] < np.iinfo(np.int64).max
        node, up = at[inner], up[inner]
        self.left[up[up > node]], self.right[up[up < node]] = node[up > node], node[up < node]
        self.root = np.zeros(n_terms, np.int64)
        self.root[term[~inner]] = at[~inner]

    @staticmethod
    def _greater(key: np.ndarray, step: int) -> np.ndarray:
        """For each node the nearest one with a greater key before (step -1; or an equal one) or after it (1), by pointer jumping."""
        n, mark = len(key), key == np.iinfo(np.int64).max
        to = np.clip(np.arange(n) + step, 0, n - 1)
        to[mark] = np.flatnonzero(mark)
        open_ = np.flatnonzero(~mark)
        while len(open_):
            there = key[to[open_]]
            open_ = open_[there < key[open_] if step < 0 else there <= key[open_]]
            to[open_] = to[to[open_]]
        return to

    def tops(self, node: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The highest node within first..end of the subtrees of nodes; 0 for none."""
        node = np.where(first < end, node, 0)
        low, high = node < first, node >= end
        open_ = np.nonzero((node > 0) & (low | high))
        while len(open_[0]):
            at = node[open_]
            at = node[open_] = np.where(at < first[open_], self.right[at], self.left[at])
            going = (at > 0) & ((at < first[open_]) | (at >= end[open_]))
            open_ = tuple(x[going] for x in open_)
        return node

    def best(self, terms: np.ndarray, weight: np.ndarray, k: int, n_docs: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best above 0, highest first, ties to the smaller document; scores under ``least`` may be left out."""
        there = self.root[terms] > 0
        terms, weight = terms[there], weight[there]
        best_doc, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return best_doc, best
        first, end, top = self.start[terms][None], (self.start[terms + 1] - 1)[None], self.root[terms][None]
        lowest = np.zeros(1, np.int64)
        while len(first):
            bound = (self.impact[top] * weight).sum(1)
            full = len(best) >= k
            floor = max(least, int(best[-1]) if full else 0)
            open_ = (bound > 0) & (bound >= floor)
            if full:
                open_ &= (bound > best[-1]) | (lowest < best_doc[-1])
            now = np.flatnonzero(open_)
            if len(now) > AT_ONCE:
                now = now[np.argpartition(-bound[now], AT_ONCE)[:AT_ONCE]]
            open_[now] = False  # those that wait
            waiting = [x[open_] for x in (first, end, top, lowest)]
            first, end, top, lowest = (x[now] for x in (first, end, top, lowest))
            small = (end - first).sum(1) <= LEAF
            docs, scores = self._whole(first[small], end[small], weight, n_docs)
            first, end, top, lowest = (x[~small] for x in (first, end, top, lowest))
            if len(first):
                lead = (self.impact[top] * weight).argmax(1)
                at = self.doc[np.take_along_axis(top, lead[:, None], 1)[:, 0]]
                cut = np.searchsorted(self.order, (terms << 32)[None] + at[:, None] + 1)
                cut = np.clip(cut, first, end)
                hit = (cut < end) & (self.doc[np.minimum(cut, len(self.doc) - 1)] == at[:, None])
                found = np.where(hit, self.impact[np.minimum(cut, len(self.doc) - 1)] * weight, 0).sum(1)
                docs, scores = np.concatenate([docs, at]), np.concatenate([scores, found])
                after = cut + hit
                parts = [first, cut, self.tops(top, first, cut), lowest], [after, end, self.tops(top, after, end), at + 1]
                first, end, top, lowest = (np.concatenate(x) for x in zip(*parts, strict=True))
            first, end, top, lowest = (np.concatenate(x) for x in zip((first, end, top, lowest), waiting, strict=True))
            best_doc, best = np.concatenate([best_doc, docs]), np.concatenate([best, scores])
            order = np.lexsort((best_doc, -best))[:k]
            best_doc, best = best_doc[order], best[order]
        return best_doc, best

    def _whole(self, first: np.ndarray, end: np.ndarray, weight: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """All documents of ranges with their scores; the ranges have no document in common."""
        size = (end - first).ravel()
        each = np.repeat((first.ravel() - np.cumsum(size) + size), size) + np.arange(size.sum())
        score = np.zeros(n_docs, np.int64)
        np.add.at(score, self.doc[each], self.impact[each] * np.repeat(np.broadcast_to(weight, first.shape).ravel(), size))
        found = np.unique(self.doc[each])
        return found[score[found] > 0], score[found][score[found] > 0]


def postings(docs: DataFrame, number) -> DataFrame:
    """(doc_id, n, terms, counts) of documents with a term: all its terms counted in n, those of ``number`` (a broadcast) listed."""

    def run(batches):
        get = number.value.get
        for batch in batches:
            ids, sizes, terms, counts = [], [], [], []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), byte_lists(batch.column("text")), strict=True):
                words = TERM.findall(raw.lower())
                if words:
                    own, n = np.unique(np.fromiter((x for x in map(get, words) if x is not None), np.int64), return_counts=True)
                    ids.append(doc_id)
                    sizes.append(len(words))
                    terms.append(own.astype("<u4").tobytes())
                    counts.append(n.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n", "terms", "counts"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n bigint, terms binary, counts binary")


def document_counts(rows: DataFrame, n_terms: int) -> DataFrame:
    """(term, df): documents that hold a term."""

    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for raw in batch.column("terms").to_pylist():
                total[np.frombuffer(raw, "<u4")] += 1
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["term", "df"])

    return rows.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def _shards(batches):
    """(doc_ids, null flags, lengths, number of postings by document, terms, counts) of SHARD_POSTINGS postings each."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "counts")), strict=True):
            if held and size + len(row[2]) // 4 > SHARD_POSTINGS:
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[2]) // 4
    if held:
        yield held


def _shard(rows: list, n_docs: int, n_words: int, n_terms: int) -> tuple[list, Treaps]:
    """The shard's ids in order, null last, and its treaps; documents are numbered in that order."""
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    terms = np.frombuffer(b"".join(r[2] for r in rows), "<u4").astype(np.int64)
    tf = np.frombuffer(b"".join(r[3] for r in rows), "<u4").astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r[2]) // 4 for r in rows])
    m = np.array([100 - SHARE + SHARE * r[1] * n_docs // n_words for r in rows], np.int64)
    impact = IMPACT * tf // (1000 * tf + LENGTH * m[doc])
    order = np.argsort(terms, kind="stable")
    return [r[0] for r in rows], Treaps(terms[order], doc[order], impact[order], n_terms)


def _search_block(spark, docs: DataFrame, items: list, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) for the given (item_id, text) rows."""
    number: dict[bytes, int] = {}
    queries = [np.array(sorted({number.setdefault(x, len(number)) for x in TERM.findall((text or "").encode().lower())}), np.int64) for _, text in items]
    folder = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    postings(docs, spark.sparkContext.broadcast(number)).write.option("compression", "zstd").parquet(folder)
    rows, n_terms = spark.read.parquet(folder), len(number)
    n_docs, n_words = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = document_counts(rows, n_terms).select("term", F.floor(F.lit(1000.0) * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).alias("weight"))
    weight = np.zeros(n_terms, np.int64)
    for row in held.collect():
        weight[row["term"]] = row["weight"]
    asked = spark.sparkContext.broadcast((queries, weight))

    def run(batches):
        queries, weight = asked.value
        best = [[] for _ in queries]
        for held in _shards(batches):
            ids, treaps = _shard(held, n_docs, n_words, n_terms)
            for own, terms in zip(best, queries, strict=True):
                found = treaps.best(terms, weight[terms], k, len(ids), own[-1][0] if len(own) >= k else 0)
                own.extend((score, ids[d]) for d, score in zip(*(x.tolist() for x in found), strict=True))
                own.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
                del own[k:]
        out = [(i, doc, score) for i, own in enumerate(best) for score, doc in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], names=["item", "doc_id", "score"])

    found = rows.mapInArrow(run, "item bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item bigint, item_id bigint")
    found = checkpointed(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    removed(spark, folder)
    return found


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 for each row of items, highest first.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns do not
    matter, whatever their names. Equal scores are ranked by id, null last; a row
    that repeats another has a rank of its own, rows of items with one id are
    items of their own. Null and empty texts have no term: such items find
    nothing, such documents are never found and count in no statistic. Texts are
    read as a whole, however long. Empty tables give no rows. Items come to the
    driver block by block, so many at a time as BLOCK_ITEMS and BLOCK_CHARS say.
    """
    spark = docs.sparkSession
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    out = None
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        found = _search_block(spark, docs, sorted(((r["item_id"], r["text"]) for r in block), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), k)
        out = found if out is None else out.unionByName(found)
    return out


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH doc_terms AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), sizes AS (
  SELECT row, doc_id, len(terms)::BIGINT AS n FROM doc_terms WHERE len(terms) > 0
), totals AS (
  SELECT count(*)::BIGINT AS N_all, sum(n)::BIGINT AS L_all FROM sizes
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), tfs AS (
  SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM doc_terms) SEMI JOIN asked USING (term) GROUP BY row, term
), dfs AS (
  SELECT term, floor(1000.0::DOUBLE * ln((2 * N_all + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, totals GROUP BY term, N_all
), scores AS (
  SELECT item_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * N_all) // L_all))))::BIGINT AS score
  FROM asked JOIN dfs USING (term) JOIN tfs USING (term) JOIN sizes USING (row), totals GROUP BY item_id, row
), ranks AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scores JOIN sizes USING (row) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 50
"""
