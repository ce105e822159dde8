"""Near-duplicates by bottom-k sketches from one hash function.

1. Every text becomes its set of hashed 5-word shingles; texts with the same
   set form a class, represented by the row with the smallest id, so exact
   copies cost one row each from here on.
2. A class keeps the SKETCH smallest hashes. Inverted lists are made of the
   INDEX smallest of them. Two sets with a Jaccard of T share at least
   SHARED of these (exactly so for small sets, with odds of 4 in a thousand
   million against at the threshold for large ones, less above it), so a class
   only enters the lists of its rarest values, as many as that bound requires.
   Values that a common passage puts into very many documents are thereby
   left out, except where the passage makes up most of a document.
3. Lists link their members to one centre, first the one with the fewest rare
   values, so a large group of copies costs one pair for each member. The
   sketch of the union estimates the Jaccard, and pairs that pass are confirmed
   on their full sets.
4. What is left are lists whose members are in several components. Short ones
   compare every member outside their main component with all others. Members
   of long ones are indexed anew by their full sets, each in the order of
   rarity and as far as the threshold requires; a pair is compared only if the
   places of the value they share leave room for enough common ones. That is
   exact, and it leaves few pairs: a copy changed too much to be linked has
   many rare shingles, which come first. Nothing is capped.

With ``exact`` step 4 indexes all classes by their full sets and estimates
nothing, so that no link depends on odds; that costs about a quarter of all
shingles as rows to shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches, byte_lists, checkpointed, settled, spread_join, table
from lectern.llm.components import components

SHINGLE = 5
#: Link where PERCENT * union <= 100 * intersection.
PERCENT = 75
SKETCH, INDEX = 64, 32
#: Values that two sets at the threshold share of their INDEX smallest, at least (odds against: 4.2e-9).
SHARED = 9
#: Pairs whose estimate is below this are not confirmed: 6.5 deviations under the threshold (odds: 1.3e-9).
ESTIMATE = 0.4
#: Rounds with one centre a list, before remaining members are compared.
CENTRE_ROUNDS = 2
#: Longer lists are indexed anew by full sets.
SHORT_LIST = 24
#: Members of a list, or pairs of a node, that one task compares.
GROUP = 2000
#: Up to this many pairs are broadcast, so that only the sketches and texts of their members move; more are shuffled.
BROADCAST_PAIRS = 500_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000 and len(word) < 64:
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(raw: bytes, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; none without a word."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    take = min(size, len(words))
    keys = np.full(len(words) - take + 1, take, np.uint64)
    for k in range(take):
        keys = keys * _A + ids[k : k + len(keys)]
        keys ^= keys >> np.uint64(32)
    return np.unique(_mix(keys))


def _sketch_batches(batches):
    hashes = WordHashes()
    for batch in batches:
        sizes, high, low, sketches = [], [], [], []
        for raw in byte_lists(batch.column("text")):
            own = shingle_set(raw, hashes)
            whole = xxhash.xxh3_128_digest(own.tobytes())
            sizes.append(len(own))
            high.append(int.from_bytes(whole[:8], "big", signed=True))
            low.append(int.from_bytes(whole[8:], "big", signed=True))
            # signed order would differ: halve, so that sketches are the smallest in both
            sketches.append((own[:SKETCH] >> np.uint64(1)).astype(np.int64))
        new = [pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), *new], names=["doc_id", "text_hash", "n_shingles", "high", "low", "sketch"]
        )


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text); id and hash tell the rows of different texts apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, high, low, sketch) of each row; high and low identify the set."""
    bounded_batches(docs.sparkSession)
    return _rows(docs).mapInArrow(
        _sketch_batches, "doc_id bigint, text_hash bigint, n_shingles bigint, high bigint, low bigint, sketch array<bigint>"
    )


def _lists(classes: DataFrame, n_classes: int) -> DataFrame:
    """(value, id, n_shingles, enter): the inverted lists that a class has to enter.

    ``enter`` counts a class's lists; the fewer rare values it has, the more.
    """
    postings = classes.select("id", "n_shingles", F.explode(F.slice("sketch", 1, INDEX)).alias("value"))
    counts = postings.groupBy("value").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    held = F.least("n_shingles", F.lit(INDEX))
    # a set that is small enough is listed as a whole, as is every set that it may be linked with
    small = F.col("n_shingles") <= INDEX * PERCENT // 100
    need = F.when(small, F.ceil(F.col("n_shingles") * PERCENT / 100)).otherwise(SHARED)
    enter = held - need + 1  # lists to enter, the rarest first; lists of one count as entered
    return (
        spread_join(postings, counts, ["value"], n_classes * INDEX)
        .groupBy("id", "n_shingles")
        .agg(F.sort_array(F.collect_list(F.struct("members", "value"))).alias("own"))
        .withColumn("enter", (enter - (held - F.size("own"))).cast("int"))
        .where(F.col("enter") > 0)
        .select("id", "n_shingles", "enter", F.explode(F.expr("slice(own, 1, enter)")).alias("x"))
        .select(F.col("x.value").alias("value"), "id", "n_shingles", "enter")
    )


def _with_members(pairs: DataFrame, n: int, rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """``n`` pairs (a, b, ...) with columns of rows (id, ...), as name_a and name_b.

    Few pairs go to the rows; what then moves is the rows of b once a pair, and
    those of a once. A node a with very many pairs is parted: its row is repeated
    for each part, so that no task has all of its pairs.
    """
    a = rows.select(F.col("id").alias("a"), *(F.col(c).alias(f"{name}_a") for c, name in names.items()))
    b = rows.select(F.col("id").alias("b"), *(F.col(c).alias(f"{name}_b") for c, name in names.items()))
    # so many nodes at most have parts: few enough to broadcast
    each = max(GROUP, n // 10_000)
    parts = pairs.groupBy("a").agg(F.count("*").alias("parts")).where(F.col("parts") > each)
    parts = F.broadcast(parts.select("a", F.ceil(F.col("parts") / each).alias("parts")))
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0).cast("bigint"))
    pairs = pairs.join(parts, "a", "left").withColumn("part", part).drop("parts")
    few = n <= BROADCAST_PAIRS
    if few:
        a = a.join(F.broadcast(pairs.select("a").distinct()), "a", "left_semi")
    a = a.join(parts, "a", "left").withColumn("part", F.explode(F.expr("sequence(0L, coalesce(parts, 1L) - 1)"))).drop("parts")
    if few:
        return b.join(F.broadcast(pairs), "b").join(a.hint("shuffle_merge"), ["a", "part"])
    return pairs.join(b, "b").join(a, ["a", "part"])


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and union sketches leave, with the estimate."""
    pairs, n = settled(pairs)
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
    return (
        _with_members(pairs, n, classes, {"n_shingles": "size", "sketch": "sketch"})
        .where((100 * F.col("size_a") >= PERCENT * F.col("size_b")) & (100 * F.col("size_b") >= PERCENT * F.col("size_a")))
        .withColumn("union", union)
        .withColumn("estimate", F.size(F.array_intersect("union", F.array_intersect("sketch_a", "sketch_b"))) / F.size("union"))
        .where(F.col("estimate") >= ESTIMATE)
        .select("a", "b", "estimate")
    )


def _confirm_batches(batches):
    hashes, last = WordHashes(), (None, None)
    for batch in batches:
        ids, keep = batch.column("a").to_pylist(), []
        for one, x, y in zip(ids, byte_lists(batch.column("text_a")), byte_lists(batch.column("text_b")), strict=True):
            if last[0] != one:
                last = (one, shingle_set(x, hashes))
            p, q = last[1], shingle_set(y, hashes)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(p) + len(q) - both) and both > 0)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


@dataclass
class Texts:
    """The texts of classes: the documents, and the row that represents each class."""

    docs: DataFrame
    classes: DataFrame  # id, doc_id, text_hash, n_shingles, sketch
    repeats: bool  # some row that represents a class has equals

    def of(self, ids: DataFrame, n: int) -> DataFrame:
        """(id, ..., text) for at most ``n`` distinct ids (id, ...)."""
        keys = self.classes.select("id", "doc_id", "text_hash")
        keys = (F.broadcast(ids) if n <= BROADCAST_PAIRS else ids).join(keys, "id")
        found = _rows(self.docs).join(F.broadcast(keys) if n <= BROADCAST_PAIRS else keys, ["doc_id", "text_hash"]).drop("doc_id", "text_hash")
        return found.dropDuplicates(["id"]) if self.repeats else found


def _confirmed(pairs: DataFrame, texts: Texts) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as PERCENT."""
    pairs, n = settled(pairs.select("a", "b"))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    rows = _with_members(pairs, n, texts.of(ids, 2 * n), {"text": "text"})
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(_confirm_batches, "a bigint, b bigint")


def _labelled(lists: DataFrame, found: DataFrame) -> DataFrame:
    """lists with each member's component."""
    out = lists.join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    return out.withColumn("component", F.coalesce("component", "id"))


def _open(lists: DataFrame, n: int) -> DataFrame:
    """Of ``n`` entries, the lists with members of several components; each with its size and main component."""
    parts = lists.groupBy("value", "component").agg(F.count("*").alias("n"))
    main = F.max_by("component", F.struct("n", "component")).alias("main")
    state = parts.groupBy("value").agg(F.count("*").alias("parts"), F.sum("n").alias("members"), main)
    return spread_join(lists.drop("members", "main"), state.where(F.col("parts") > 1).drop("parts"), ["value"], n)


def links_to_centres(lists: DataFrame, turn: int, n: int) -> DataFrame:
    """One pair for each list and member outside the centre's component: linear in the lists' ``n`` entries."""
    order = F.struct(-F.col("enter"), "id") if turn == 0 else F.struct(F.xxhash64("id", F.lit(turn)), "id")
    centres = lists.groupBy("value").agg(F.min_by(F.struct("id", "component"), order).alias("centre"), F.count("*").alias("members"))
    return (
        spread_join(lists.drop("members"), centres, ["value"], n)
        .where(F.col("component") != F.col("centre.component"))
        .select(F.col("id").alias("b"), F.col("centre.id").alias("a"))
        .distinct()
    )


def links_across(lists: DataFrame) -> DataFrame:
    """Pairs of a list's members, one of them outside its main component, in different components.

    ``place`` is where a member's own order has the value: what comes after it
    bounds how much a pair that shares it first can have in common. A long list's
    members are parted, and those outside the main component go to every part.
    """
    columns = ["value", "id", "component", "n_shingles", "place"]
    parts = F.ceil(F.col("members") / GROUP).cast("bigint")
    other = lists.where(F.col("component") != F.col("main")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    other = other.select(*columns, "part").toDF("value", "a", "part_a", "size_a", "place_a", "part")
    member = lists.select(*columns, F.pmod(F.xxhash64("id"), parts).alias("part")).toDF("value", "b", "part_b", "size_b", "place_b", "part")
    need = F.ceil(PERCENT * (F.col("size_a") + F.col("size_b")) / (100 + PERCENT))
    room = (F.col("size_a") - F.col("place_a") >= need) & (F.col("size_b") - F.col("place_b") >= need)
    pairs = other.join(member, (other["value"] == member["value"]) & (other["part"] == member["part"]) & (F.col("part_a") != F.col("part_b")) & room)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _set_batches(batches):
    hashes = WordHashes()
    for batch in batches:
        sets = [(shingle_set(raw, hashes) >> np.uint64(1)).astype(np.int64) for raw in byte_lists(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("component"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "component", "values"]
        )


def _full_lists(members: DataFrame, texts: Texts) -> DataFrame:
    """Lists by full sets of (id, component): the rarest values first, as many as the threshold needs."""
    members, n = settled(members)
    sets = texts.of(members, n).select("id", "component", "text").mapInArrow(_set_batches, "id bigint, component bigint, values array<bigint>")
    postings = sets.select("id", "component", F.size("values").cast("bigint").alias("n_shingles"), F.explode("values").alias("value")).distinct()
    postings, total = settled(postings)
    counts = postings.groupBy("value").agg(F.count("*").alias("members"))
    first = (F.col("n_shingles") - F.ceil(F.col("n_shingles") * PERCENT / 100) + 1).cast("int")
    return (
        spread_join(postings, counts, ["value"], total)
        .groupBy("id", "component", "n_shingles")
        .agg(F.sort_array(F.collect_list(F.struct("members", "value"))).alias("own"))
        .withColumn("first", first)
        .select("id", "component", "n_shingles", F.posexplode(F.expr("slice(own, 1, first)")).alias("place", "x"))
        .where(F.col("x.members") > 1)
        .select(F.col("x.value").alias("value"), "id", "component", "n_shingles", "place")
    )


def _classes(found: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame, bool, bool]:
    """(sets, classes, whether a class's id is its doc_id, whether a row that represents one has equals).

    sets has n_shingles, high, low, id and members, the rows of the set. Two
    different sets may be represented by rows of the same doc_id; then ids are
    numbers of their own.
    """
    rows = found.groupBy("n_shingles", "high", "low", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = F.min(F.struct("doc_id", "text_hash", "n")).alias("first")
    sets = checkpointed(rows.groupBy("n_shingles", "high", "low").agg(first, F.sum("n").alias("members")))
    ids = sets.groupBy("first.doc_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    repeats = sets.agg(F.coalesce(F.max("first.n"), F.lit(0))).first()[0] > 1
    own = F.col("first.doc_id") if ids <= 1 else F.monotonically_increasing_id()
    sets = sets.select("n_shingles", "high", "low", own.alias("id"), "first.doc_id", "first.text_hash", "members")
    if ids > 1:
        sets = checkpointed(sets)
    named, keys = sets.select("doc_id", "text_hash", "id", "members"), ["doc_id", "text_hash"]
    sketch = spread_join(found, named, keys, n_rows).dropDuplicates(["id"]) if repeats else found.join(named, keys)
    return sets, checkpointed(sketch.select("id", "doc_id", "text_hash", "n_shingles", "sketch")), ids <= 1, repeats


def near_duplicates(docs: DataFrame, exact: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, chosen), one row for each row of docs.

    A null, empty or blank text has no shingle and is linked with nothing; a
    text of fewer than SHINGLE words is one shingle. Long texts count as a whole.
    Rows that repeat an id with different texts are linked by their own texts
    each, and named by the id. component_id is the smallest id of a component and
    kept says that a row has it; chosen is true for the rows of one id and text of
    each component, the least, and for texts without a shingle: it leaves no text
    behind where ids repeat. Rows without an id are linked with nothing: their
    component_id is null, they are kept and chosen. An empty table gives none.

    With ``exact`` every link is found for certain, at a higher cost.
    """
    rows = checkpointed(sketches(docs))
    n_rows, linkable = rows.count(), (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    sets, classes, named, repeats = _classes(rows.where(linkable), n_rows)
    n_classes = classes.count()
    texts = Texts(docs, classes, repeats)

    lists, _ = settled(_lists(classes, n_classes))
    left = lists.withColumn("component", F.col("id"))
    known = None  # links confirmed so far, as stars

    def extended(links: DataFrame) -> DataFrame:
        if known is not None:
            links = links.unionByName(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return components(links)

    n = n_classes * INDEX
    for turn in range(CENTRE_ROUNDS):
        passed = _estimated(links_to_centres(left, turn, n), classes)
        # the most similar centre is enough for now
        passed = passed.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a"))
        known = extended(_confirmed(passed, texts))
        left, n = settled(_open(_labelled(left.drop("component"), known), n))
    if exact:
        full, total = settled(_full_lists(_labelled(classes.select("id"), known), texts))
        pairs = links_across(_open(full, total))
    else:
        short = left.where(F.col("members") <= SHORT_LIST).withColumn("place", F.lit(0))
        long = left.where(F.col("members") > SHORT_LIST).select("id", "component").distinct()
        pairs = links_across(short)
        if not long.isEmpty():
            full, total = settled(_full_lists(long, texts))
            pairs = pairs.unionByName(links_across(_open(full, total))).distinct()
        pairs = _estimated(pairs, classes)
    known = extended(_confirmed(pairs, texts))

    label = known.select(F.col("node").alias("id"), "component")
    if named:
        sets = sets.join(label, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
        sets = sets.withColumns({"least_id": F.col("component_id"), "least_hash": F.lit(None).cast("bigint")})
    else:
        marked = sets.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
        marked, n = settled(marked)
        least = marked.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.count("*").alias("members"))
        sets = spread_join(marked.withColumnRenamed("members", "rows"), least, ["component"], n)
        sets = sets.withColumns({"component_id": F.col("least.doc_id"), "least_id": F.col("least.doc_id"), "least_hash": F.col("least.text_hash"), "members": F.col("rows")})
    # the row that represents a component; where ids name classes it represents its class, too
    first = (F.col("doc_id") == F.col("least_id")) & F.coalesce(F.col("text_hash") == F.col("least_hash"), F.lit(True))
    sets = sets.select("n_shingles", "high", "low", "members", "component_id", F.when(first, F.col("text_hash")).alias("chosen_hash"))
    member = spread_join(rows.where(linkable).drop("sketch"), sets, ["n_shingles", "high", "low"], n_rows)
    chosen = (F.col("doc_id") == F.col("component_id")) & F.coalesce(F.col("text_hash") == F.col("chosen_hash"), F.lit(False))
    member = member.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "text_hash", chosen.alias("chosen"))
    alone = rows.where(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "text_hash", F.lit(True).alias("chosen"))
    return member.unionByName(alone)


def op9_minhash_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Every document's shingle count, component and whether it is kept."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)
), ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS root, doc_id AS node FROM documents UNION SELECT root, y FROM reach JOIN ways ON node = x
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node) USING (doc_id)
"""
