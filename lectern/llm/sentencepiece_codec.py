"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces runs through the text once. At each
position its output links give every piece that ends there, longest first, and
each relaxes the best score at its end: a single-pass Viterbi for the
segmentation with the largest sum of scores (ties: the longer last piece).
Characters without a piece become byte pieces. In a long run without a space the
pieces are settled as soon as all best paths share them, so memory does not grow
with the run.

Viterbi wants log-probabilities. A unigram model's file has them; a byte-pair
model's has merge ranks, whose sum means nothing. Its pieces get the logarithm of
the Zipf-Mandelbrot law of their rank instead: a rule, nothing is trained.

No piece holds a space after another character, nor a line end, so words are
segmented on their own and repeated words are remembered, up to a bound.
Decoding joins the pieces and gives back the text exactly, U+2581 included,
which is always written as bytes so that it is not read as a space.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import bounded_batches, map_texts, table

#: Where the default model lies; a parameter of everything below.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Below the least score of a piece, for a character that has none.
UNKNOWN_PENALTY = 10.0
#: The law's shift for files of merge ranks: a piece of rank r weighs 1 / (r + ZIPF_SHIFT).
ZIPF_SHIFT = 100.0
#: Longer words are segmented piece by piece; and the characters after which pieces are settled.
LONG_WORD, SETTLE = 2048, 8192
#: Words remembered by a task, and the longest that is.
REMEMBER, REMEMBER_LENGTH = 400_000, 48


@dataclass
class Vocabulary:
    """Pieces by id; kinds: n normal, b byte, c control, u unknown."""

    pieces: list[str]
    scores: list[float]
    kinds: str


def load_vocabulary(model_file: str = MODEL_FILE) -> Vocabulary:
    """Read on the driver and broadcast, so executors need not have the file."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    scores = [model.get_score(i) for i in ids]
    if all(x <= 0 and x == int(x) for x in scores):  # merge ranks
        scores = [-math.log(ZIPF_SHIFT - x) for x in scores]
    kind = lambda i: "u" if model.is_unknown(i) else "c" if model.is_control(i) else "b" if model.is_byte(i) else "x" if model.is_unused(i) else "n"
    return Vocabulary([model.id_to_piece(i) for i in ids], scores, "".join(map(kind, ids)))


class Encoder(dict):
    """Ids of a word (spaces as SPACE); as a mapping it remembers words, their ids as 32-bit bytes."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        normal = [i for i, k in enumerate(vocabulary.kinds) if k == "n"]
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(vocabulary.pieces[i], (len(vocabulary.pieces[i]), i, vocabulary.scores[i]))
        self.automaton.make_automaton()
        self.bytes = {int(vocabulary.pieces[i][3:5], 16): i for i, k in enumerate(vocabulary.kinds) if k == "b"}
        self.unknown = next((i for i, k in enumerate(vocabulary.kinds) if k == "u"), 0)
        self.unknown_score = min((vocabulary.scores[i] for i in normal), default=0.0) - UNKNOWN_PENALTY
        self.lengths = [len(p) for p in vocabulary.pieces]
        self.longest = max((self.lengths[i] for i in normal), default=1)
        self.single = {vocabulary.pieces[i] for i in normal if len(vocabulary.pieces[i]) == 1}
        inner = [p for p in (vocabulary.pieces[i] for i in normal) if SPACE in p.lstrip(SPACE) or "\n" in p]
        self.by_word = not inner  # else a text is one word

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.segment(word)).tobytes()
        if len(word) <= REMEMBER_LENGTH:
            if len(self) >= REMEMBER:
                self.clear()
            self[word] = ids
        return ids

    def segment(self, word: str) -> list[int]:
        """The best ids of a word; SPACE stands for a space."""
        n = len(word)
        if n > LONG_WORD:
            return self._segment_long(word)
        best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        if self.single.issuperset(word):
            for end, (length, i, score) in self.automaton.iter(word):
                if (total := best[end + 1 - length] + score) > best[end + 1]:
                    best[end + 1], back[end + 1] = total, (end + 1 - length, i)
        else:
            ending: list[list] = [[] for _ in range(n + 1)]
            for end, found in self.automaton.iter(word):
                ending[end + 1].append(found)
            for end in range(1, n + 1):
                for length, i, score in ending[end]:
                    if (total := best[end - length] + score) > best[end]:
                        best[end], back[end] = total, (end - length, i)
                if word[end - 1] not in self.single and (total := best[end - 1] + self.unknown_score) > best[end]:
                    best[end], back[end] = total, (end - 1, -1)
        out, at = [], n
        while at:
            start, i = back[at]
            out += [i] if i >= 0 else self._as_bytes(word[start])[::-1]
            at = start
        return out[::-1]

    def _segment_long(self, word: str) -> list[int]:
        """The same; scores and pieces of places are kept only back to the last that all best paths share."""
        best, back, first, due = array("d", [0.0]), array("i", [0]), 0, SETTLE
        out: array = array("i")
        length_of = lambda i: 1 if i < 0 else self.lengths[i]

        def settle(to: int) -> None:
            path, at = [], to
            while at > first:
                i = back[at - first]
                path += [i] if i >= 0 else self._as_bytes(word[at - 1])[::-1]
                at -= length_of(i)
            out.extend(path[::-1])

        found = self.automaton.iter(word)
        match = next(found, None)
        for end in range(1, len(word) + 1):
            value, piece = -math.inf, -1
            while match is not None and match[0] == end - 1:
                length, i, score = match[1]
                if (total := best[end - length - first] + score) > value:
                    value, piece = total, i
                match = next(found, None)
            if word[end - 1] not in self.single and (total := best[end - 1 - first] + self.unknown_score) > value:
                value, piece = total, -1
            best.append(value)
            back.append(piece)
            if end - first >= due:
                alive = set(range(max(first, end + 1 - self.longest), end + 1))  # where a piece still to come may begin
                while len(alive) > 1:
                    last = max(alive)
                    alive.remove(last)
                    alive.add(last - length_of(back[last - first]))
                (shared,) = alive
                settle(shared)
                best, back, due = best[shared - first :], back[shared - first :], end - shared + SETTLE
                first = shared
        settle(len(word))
        return out.tolist()

    def _as_bytes(self, character: str) -> list[int]:
        raw = character.encode("utf-8", "surrogateescape")
        return [self.bytes[b] for b in raw] if self.bytes else [self.unknown]

    def _words(self, text: str):
        """Words of a text with a real U+2581, which is a word of its own: None."""
        for k, part in enumerate(re.split(f"({SPACE})", text)):
            if k % 2:
                yield None
            elif part or not k:
                yield from self._plain(part, not k)

    def _plain(self, text: str, first: bool):
        if not self.by_word:
            yield (SPACE if first else "") + text.replace(" ", SPACE)
            return
        for k, line in enumerate(text.split("\n")):
            if k:
                yield "\n"
            if not k and first:
                line = f" {line}"
            if "  " in line or line.endswith(" "):
                yield from re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", line.replace(" ", SPACE))
            elif line:
                head, *rest = line.split(" ")
                if head:
                    yield head
                for word in rest:
                    yield SPACE + word

    def packed(self, raw: bytes) -> bytes:
        """Ids of a UTF-8 text as 32-bit bytes; none for an empty one."""
        if not raw:
            return b""
        text = raw.decode("utf-8", "surrogateescape")
        if SPACE in text:
            real = array("i", self._as_bytes(SPACE)).tobytes()
            return b"".join(real if word is None else self[word] for word in self._words(text))
        return b"".join(map(self.__getitem__, self._plain(text, True)))

    def encode(self, raw: bytes) -> list[int]:
        """Ids of a UTF-8 text."""
        return array("i", self.packed(raw)).tolist()


def id_lists(parts: list[bytes]) -> pa.ListArray:
    """Lists of ids from their 32-bit bytes."""
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """docs with ``pieces``, the ids of each whole text. Null and empty texts have none.

    Every input row has one output row, repeated ones included; an empty table has
    none. Long texts are encoded as a whole. Of segmentations of equal score the one
    with the longer last piece counts. A column named pieces is replaced.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def start():
        encoder = Encoder(shared.value)
        return lambda texts: [id_lists([encoder.packed(t) for t in texts])]

    return map_texts(docs, "pieces array<int>", start, text)


def piece_bytes(vocabulary: Vocabulary) -> list[bytes]:
    """What each id adds to a text. Control pieces add nothing."""
    by_kind = {"b": lambda p: bytes([int(p[3:5], 16)]), "c": lambda p: b"", "u": lambda p: " ⁇ ".encode()}
    return [by_kind.get(k, lambda p: p.replace(SPACE, " ").encode())(p) for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)]


def join_pieces(ids: pa.ListArray, table_: pa.Array) -> pa.Array:
    """Texts of lists of ids; the first space, which encoding adds, goes. Unknown ids fail."""
    flat = table_.take(ids.flatten())
    ends = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8) if len(flat) else np.zeros(1, np.int64)
    data = flat.buffers()[2].to_pybytes() if len(flat) and flat.buffers()[2] else b""
    lengths = np.array([0 if x is None else x for x in ids.value_lengths().to_pylist()], np.int64)
    stops = np.cumsum(lengths)
    out = []
    for start, stop in zip(stops - lengths, stops, strict=True):
        raw = data[ends[start] : ends[stop]]
        out.append(raw[1:] if raw[:1] == b" " else raw)
    return pa.array(out, pa.large_binary())


def decode(rows: DataFrame, vocabulary: Vocabulary, pieces: str = "pieces") -> DataFrame:
    """rows with ``decoded``, the text of the ids; null and empty lists give ''. A column of that name is replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    names = [c for c in rows.columns if c != "decoded"]

    def run(batches):
        by_id = pa.array(piece_bytes(shared.value), pa.large_binary())
        for batch in batches:
            texts = join_pieces(batch.column(pieces), by_id).cast(pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), texts], names=[*names, "decoded"])

    source = rows.select(*names)
    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("decoded", T.StringType())]))


def coded(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """docs with pieces and decoded, as ``encode`` and ``decode`` give them, by one pass of one worker."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_file))

    def start():
        encoder, by_id = Encoder(shared.value), pa.array(piece_bytes(shared.value), pa.large_binary())

        def work(texts):
            pieces = id_lists([encoder.packed(t) for t in texts])
            return [pieces, join_pieces(pieces, by_id).cast(pa.binary()).view(pa.string())]

        return work

    return map_texts(docs, "pieces array<int>, decoded string", start)


def op1_sentencepiece(spark, sf_dir: str, model_file: str = MODEL_FILE) -> DataFrame:
    """Every document's pieces, their count, a hash of them, and whether decoding gives the text."""
    rows = coded(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), model_file)
    return rows.select(
        "doc_id",
        F.size("pieces").cast("bigint").alias("n_pieces"),
        F.xxhash64("pieces").alias("pieces_hash"),
        F.slice("pieces", 1, 8).alias("first_pieces"),
        "pieces",
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )
