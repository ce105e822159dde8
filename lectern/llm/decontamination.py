"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts become word symbols. Every window as long as a benchmark item is walked
by CGK random walks, which map edit distance to Hamming distance: at each step
the current symbol is written out and a random bit of (step, symbol) decides
whether to move on. Each table has a walk of its own, with its own random bits
and its own place in the window where it begins, and samples a few of the walk's
first steps as the window's key: two walks part for good after a few edits, so
steps far from where a walk began would agree by chance only. Windows and items
that share a key in any table are candidates, and the edit distance of each
candidate is then computed exactly.

The number of tables follows from what they find, measured on the items with
seeded random edits at the distance limit: words replaced, inserted, deleted and
all three, the kind that is found least deciding. Where more than MAX_TABLES were
needed, no table is built, and every window that may match by the filter below
goes straight to the exact distance.

Windows that cannot match are not walked: an item's rarer half has to be in a
window but for as many words as may be edited, so windows with fewer of such
words (over all items of their length) are left out without loss.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches, checkpointed, map_texts, table

#: Edits per word of the item that still count as a copy.
EDIT_SHARE = 0.2
#: Items with fewer words are found where they stand word by word, but are too common to be evidence for dropping a document.
MIN_ITEM_WORDS = 5
#: Share of copies at the distance limit that the tables have to find.
RECALL = 0.99
#: Steps of a walk that may be sampled, those sampled for a key, and the most tables that are built.
SPAN, KEY_STEPS, MAX_TABLES = 6, 3, 64
#: Copies of each kind at the limit that the tables are measured with.
KINDS, PILOT_COPIES = ("replace", "insert", "delete", "mixed"), 128
#: Benchmark words that are broadcast at a time; larger sets take several passes.
BLOCK_WORDS = 200_000
#: Windows times tables that are walked at a time.
WALK_CELLS = 400_000
#: Rare words times classes of lengths that are counted at a time.
MARK_CELLS = 4_000_000

_LEAK = "struct<item_id:bigint,distance:int,item_words:int,start_word:int,end_word:int>"
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_P, _Q, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x94D049BB133111EB)


def words_of(raw: bytes) -> list[bytes]:
    """Words, A-Z lower-cased, without ASCII punctuation; offsets count these words."""
    return raw.lower().translate(None, _PUNCTUATION).split()


def edit_limit(n_words: int, share: float = EDIT_SHARE) -> int:
    return int(share * n_words)


@dataclass
class LengthClass:
    """The items of one length, their tables and the filter for windows."""

    length: int
    limit: int  # edits that still make a copy
    items: list[int]
    starts: np.ndarray | None = None  # (tables, 1): where in a window each table's walk begins
    seeds: np.ndarray | None = None  # (steps, tables, 1): what makes a symbol's random bit
    samples: list = field(default_factory=list)  # by step: the tables that sample it
    keys: list = field(default_factory=list)  # by table: sorted keys and the items in that order
    rare: np.ndarray | None = None  # by symbol
    need: int = 0  # rare words that a window must hold
    exact: bool = False  # no tables: items are found by their own rare words
    own_rare: dict[int, np.ndarray] = field(default_factory=dict)  # by item: its rare symbols
    having: dict[int, np.ndarray] = field(default_factory=dict)  # if exact, by rare symbol: its items

    @property
    def tables(self) -> int:
        return 0 if self.starts is None else len(self.starts)


@dataclass
class BenchmarkIndex:
    """Item symbols and one class for each item length. Symbol 0 is any other word."""

    ids: list[int]
    symbols: dict[bytes, int]
    texts: list[np.ndarray]
    classes: list[LengthClass]


def _walk(text: np.ndarray, starts: np.ndarray, cls: LengthClass) -> np.ndarray:
    """Keys (tables, starts) of the text's windows at these starts, which may lie up to ``limit`` outside."""
    padded = np.concatenate([np.zeros(cls.limit, np.int64), text, np.zeros(cls.length + cls.limit + 1, np.int64)])
    flat = (padded.astype(np.uint64) + np.uint64(3)) * _P
    flat ^= flat >> np.uint64(32)
    keys = np.zeros((cls.tables, len(starts)), np.uint64)
    chunk = max(1, WALK_CELLS // max(1, cls.tables))
    for k in range(0, len(starts), chunk):
        first = (starts[k : k + chunk] + cls.limit).astype(np.int64)
        at, last, own = first + cls.starts, first + cls.length, keys[:, k : k + chunk]
        for step, sampled in enumerate(cls.samples):
            symbol = np.where(at < last, flat[np.minimum(at, len(flat) - 1)], _END)
            if sampled.size:
                own[sampled] = (own[sampled] ^ symbol[sampled]) * _P
                own[sampled] ^= own[sampled] >> np.uint64(31)
            bits = (symbol ^ cls.seeds[step]) * _Q
            at += (bits >> np.uint64(63)).view(np.int64)
    return keys


def _draw_tables(cls: LengthClass, rng: np.random.Generator) -> None:
    """MAX_TABLES walks: where each begins, its random bits and the steps that its key samples."""
    steps = SPAN if cls.length > SPAN else max(KEY_STEPS, 2 * cls.length - 2)
    cls.starts = rng.integers(0, max(1, cls.length - SPAN // 2), (MAX_TABLES, 1))
    cls.seeds = rng.integers(0, 1 << 63, (steps, MAX_TABLES, 1)).astype(np.uint64)
    chosen = np.stack([rng.choice(steps, KEY_STEPS, replace=False) for _ in range(MAX_TABLES)])
    cls.samples = [np.flatnonzero((chosen == k).any(axis=1)) for k in range(steps)]


def _keep_tables(cls: LengthClass, tables: int) -> None:
    cls.starts, cls.seeds = cls.starts[:tables], cls.seeds[:, :tables]
    cls.samples = [s[s < tables] for s in cls.samples]


def edited(item: np.ndarray, edits: int, kind: str, rng: np.random.Generator, other: int = 0) -> np.ndarray:
    """The item with so many random edits of a kind; new words are ``other``."""
    out = item.tolist()
    for _ in range(edits):
        now = KINDS[int(rng.integers(3))] if kind == "mixed" else kind
        at = int(rng.integers(len(out)))
        if now == "replace":
            out[at] = other
        elif now == "insert":
            out.insert(at, other)
        elif len(out) > 1:
            del out[at]
    return np.array(out)


def _tables_needed(cls: LengthClass, local: np.ndarray, recall: float, rng: np.random.Generator) -> int | None:
    """Tables that find ``recall`` of the copies of the kind that is found least; None: more than there are.

    Trial copies stand between other words, and every window that touches them is
    looked at, as in a search. The mean is over copies, not over their chances:
    copies differ, and those that agree least are the ones that are missed.
    """
    most = 1
    for kind in KINDS:
        hits = np.empty((PILOT_COPIES, MAX_TABLES))
        for k in range(PILOT_COPIES):
            item = local[rng.integers(len(local))]
            copy = edited(item, cls.limit, kind, rng)
            wanted = _walk(item, np.zeros(1, np.int64), cls)
            hits[k] = (_walk(copy, np.arange(-cls.limit, cls.limit + 1), cls) == wanted).any(axis=1)
        missed = [((1 - hits.mean(axis=1)) ** t).mean() for t in range(1, MAX_TABLES + 1)]
        enough = np.flatnonzero(np.array(missed) <= 1 - recall)
        if not enough.size:
            return None
        most = max(most, int(enough[0]) + 1)
    return most


def build_index(rows: list[tuple[int, bytes]], share: float = EDIT_SHARE, recall: float = RECALL) -> BenchmarkIndex:
    """Index of (item_id, text); items without a word are left out. ``share`` is under a half."""
    if not 0 <= share < 0.5:
        raise ValueError("the share of edits has to be from 0 to under 0.5")
    parsed = [(i, w) for i, w in ((i, words_of(t)) for i, t in rows) if w]
    counts: dict[bytes, int] = {}
    for _, w in parsed:
        for x in set(w):
            counts[x] = counts.get(x, 0) + 1
    symbols = {w: k + 1 for k, w in enumerate(sorted(counts))}
    texts = [np.array([symbols[x] for x in w]) for _, w in parsed]
    classes: dict[int, LengthClass] = {}
    for k, t in enumerate(texts):
        classes.setdefault(len(t), LengthClass(len(t), edit_limit(len(t), share), [])).items.append(k)
    for length, cls in classes.items():
        rng = np.random.default_rng([17, length])
        local = np.stack([texts[i] for i in cls.items])
        _draw_tables(cls, rng)
        tables = _tables_needed(cls, local, recall, rng) if cls.limit else 1
        cls.exact = tables is None
        _keep_tables(cls, tables or 0)
        if not cls.exact:
            keys = np.concatenate([_walk(t, np.zeros(1, np.int64), cls) for t in local], axis=1)
            for own in keys:
                order = np.argsort(own, kind="stable")
                cls.keys.append((own[order], np.array(cls.items)[order]))
        # the rarer half of each item: fewest items with the word, longer words first
        cls.rare, half = np.zeros(len(symbols) + 1, bool), (length + 1) // 2
        having: dict[int, list[int]] = {}
        for k in cls.items:
            words = sorted(parsed[k][1], key=lambda w: (counts[w], -len(w), w))[:half]
            own = cls.own_rare[k] = np.unique([symbols[w] for w in words])
            cls.rare[own] = True
            if cls.exact:
                for symbol in own.tolist():
                    having.setdefault(symbol, []).append(k)
        cls.having = {symbol: np.array(items) for symbol, items in having.items()}
        cls.need = half - cls.limit  # 1 at least, as share is under a half
    return BenchmarkIndex([i for i, _ in parsed], symbols, texts, sorted(classes.values(), key=lambda c: c.length))


def edit_row(item: np.ndarray, text: np.ndarray, free_start: bool) -> np.ndarray:
    """Edit distance of the item to text[:j] by j; with ``free_start``, to the best text[i:j]."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64) if free_start else steps.copy()
    for symbol in item:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != symbol))
        row = np.minimum.accumulate(new - steps) + steps
    return row


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the substring nearest to the item: first end, then longest start."""
    row = edit_row(item, text, True)
    end = int(row.argmin())
    back = edit_row(item[::-1], text[:end][::-1], False)
    return int(row[end]), end - int(back.argmin()), end


class Searcher:
    """Finds an index's items in texts."""

    def __init__(self, index: BenchmarkIndex):
        self.index = index
        rare = np.array([c.rare for c in index.classes]) if index.classes else np.zeros((0, 1), bool)
        self.any_rare = rare.any(axis=0) if len(rare) else np.zeros(1, bool)
        self.rare = rare.T.copy()
        self.need = np.array([c.need for c in index.classes])

    def _starts(self, doc: np.ndarray):
        """(class, starts of windows with enough rare words), class by class; some starts lie a little outside.

        Words are counted for all classes a slice at a time, so that a very long text
        takes no more memory than its own windows.
        """
        hits = np.flatnonzero(self.any_rare[doc])
        if not hits.size:
            return
        rows = max(1, MARK_CELLS // len(self.need))
        there = sum(self.rare[doc[hits[k : k + rows]]].sum(axis=0) for k in range(0, len(hits), rows))
        for c in np.flatnonzero(there >= self.need):
            cls = self.index.classes[c]
            starts = np.arange(-cls.limit, len(doc) - cls.length + cls.limit + 1)
            total = np.concatenate([[0], np.cumsum(cls.rare[doc])])
            held = total[np.clip(starts + cls.length, 0, len(doc))] - total[np.clip(starts, 0, len(doc))]
            starts = starts[held >= cls.need]
            if starts.size:
                yield cls, starts

    def _by_rare_words(self, doc: np.ndarray, cls: LengthClass, starts: np.ndarray):
        """(item, starts) of all windows that hold enough of the item's own rare words: no copy is lost."""
        mark = np.zeros(len(cls.rare), bool)
        for group in _runs(starts, cls.length):
            low = max(0, int(group[0]))
            part = doc[low : int(group[-1]) + cls.length]
            symbols = part[cls.rare[part]]
            items, hits = np.unique(np.concatenate([cls.having[s] for s in symbols.tolist()]), return_counts=True)
            for item in items[hits >= cls.need].tolist():
                mark[cls.own_rare[item]] = True
                total = np.concatenate([[0], np.cumsum(mark[part])])
                mark[cls.own_rare[item]] = False
                held = total[np.clip(group - low + cls.length, 0, len(part))] - total[np.clip(group - low, 0, len(part))]
                kept = group[held >= cls.need]
                if kept.size:
                    yield item, kept

    def _by_tables(self, doc: np.ndarray, cls: LengthClass, starts: np.ndarray):
        """(item, starts) of the windows that share a key with the item in some table."""
        near: dict[int, list[int]] = {}
        for own, (sorted_keys, items) in zip(_walk(doc, starts, cls), cls.keys, strict=True):
            low, high = np.searchsorted(sorted_keys, own, "left"), np.searchsorted(sorted_keys, own, "right")
            for k in np.flatnonzero(high > low):
                for item in items[low[k] : high[k]].tolist():
                    near.setdefault(item, []).append(int(starts[k]))
        for item, places in near.items():
            yield item, np.unique(places)

    def _nearest(self, doc: np.ndarray, item: int, cls: LengthClass, starts: np.ndarray):
        """(distance, start, end, words) of the nearest match about these starts; None beyond the limit."""
        best = None
        for group in _runs(starts, cls.length):
            low, high = max(0, int(group[0]) - cls.limit), int(group[-1]) + cls.length + cls.limit
            part = doc[low:high]
            if np.isin(part, cls.own_rare[item]).sum() < cls.need:
                continue
            distance, start, end = best_match(self.index.texts[item], part)
            if distance <= cls.limit:
                row = (distance, low + start, low + end, cls.length)
                best = row if best is None else min(best, row)
        return best

    def find(self, raw: bytes) -> list[dict]:
        """The nearest match of each item within the limit, by id."""
        index, get, best = self.index, self.index.symbols.get, {}
        words = words_of(raw) if index.classes else []
        doc = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        for cls, starts in self._starts(doc):
            for item, kept in (self._by_rare_words if cls.exact else self._by_tables)(doc, cls, starts):
                row, own = self._nearest(doc, item, cls, kept), index.ids[item]
                if row is not None:
                    best[own] = min(best.get(own, row), row)
        return [
            {"item_id": i, "distance": r[0], "item_words": r[3], "start_word": r[1], "end_word": r[2]} for i, r in sorted(best.items())
        ]

    def search(self, texts: list[bytes]) -> list[list[dict]]:
        return [self.find(raw) for raw in texts]


def _runs(starts: np.ndarray, gap: int) -> list[np.ndarray]:
    """Sorted starts in groups; between groups lies more than ``gap``."""
    return np.split(starts, np.flatnonzero(np.diff(starts) > gap) + 1)


def _leaks_of(docs: DataFrame, rows: list, share: float, recall: float) -> DataFrame:
    """docs with the leaks of one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(build_index(rows, share, recall))

    def start():
        searcher = Searcher(shared.value)
        numbers = ((n, pa.int32()) for n in ("distance", "item_words", "start_word", "end_word"))
        kind = pa.list_(pa.struct([("item_id", pa.int64()), *numbers]))
        return lambda texts: [pa.array(searcher.search(texts), kind)]

    return map_texts(docs, f"leaks array<{_LEAK}>", start)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, recall: float = RECALL, block_words: int | None = None
) -> DataFrame:
    """docs with ``leaks``: the benchmark items found in each text, nearest match each, in order of item_id.

    Distances are word edits; offsets count words. Items of fewer than
    MIN_ITEM_WORDS words allow no edit; ``item_words`` tells them apart. Null and
    empty texts, and texts without a word of an item, have no leak; an empty
    benchmark finds none. Long texts are searched as a whole, a bounded number of
    windows at a time. Rows that repeat keep a row each. Items that share an id
    count as one, the nearest of their texts; of equal distances the first in the
    text. Items with a null id are left out. A column of docs named leaks is
    replaced.

    A benchmark of over ``block_words`` words (BLOCK_WORDS) is searched block by block: each is
    a pass over the texts, whose findings are written to the shared folder before
    the next block's index is built.
    """
    bounded_batches(docs.sparkSession)
    block_words = block_words or BLOCK_WORDS
    items = benchmark.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))

    def rows_of(b: int) -> list:
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        return sorted((r["item_id"], r["text"].encode("utf-8", "replace")) for r in block.collect())  # about block_words words

    docs = docs.drop("leaks")
    if blocks == 1:
        return _leaks_of(docs, rows_of(0), share, recall)
    # a text's leaks follow from the text alone, so findings are kept by its hashes
    hashes = [F.xxhash64("text"), F.xxhash64("text", F.lit(1))]
    texts = docs.select(F.col("text").cast("string").alias("text"))
    found = None
    for b in range(blocks):
        part = _leaks_of(texts, rows_of(b), share, recall).where(F.size("leaks") > 0)
        part = checkpointed(part.select(hashes[0].alias("_h1"), hashes[1].alias("_h2"), F.explode("leaks").alias("x")).distinct())
        found = part if found is None else found.unionByName(part)
    nearest = F.min(F.struct("x.distance", "x.start_word", "x.end_word", "x.item_words")).alias("n")
    leak = F.struct("item_id", "n.distance", "n.item_words", "n.start_word", "n.end_word")
    by_text = (
        found.groupBy("_h1", "_h2", F.col("x.item_id").alias("item_id")).agg(nearest)
        .groupBy("_h1", "_h2").agg(F.sort_array(F.collect_list(leak)).alias("_found"))
    )
    own = [docs[c] for c in docs.columns]
    own_hashes = [F.xxhash64(docs["text"].cast("string")), F.xxhash64(docs["text"].cast("string"), F.lit(1))]
    joined = docs.join(by_text, (own_hashes[0] == by_text["_h1"]) & (own_hashes[1] == by_text["_h2"]), "left")
    return joined.select(*own, F.coalesce(by_text["_found"], F.array().cast(f"array<{_LEAK}>")).alias("leaks"))


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, distance, ...): every benchmark item found in a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
