"""License scan: short notices in whole texts, with a bounded number of edits.

Texts are compared as their words joined by single spaces. A notice of which k
edits are allowed is cut into k + 1 pieces: whatever matches it holds one of the
pieces unchanged, so an automaton over all pieces finds every place that can
match, and the regular expressions' bounded-error matching verifies only these
and reports the words they span.
"""

from __future__ import annotations

import bisect
import re

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lectern.llm.common import bounded_batches, map_texts, table

# Phrases that are counted word for word, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Notices that are found with edits as well, and their labels.
NOTICES = (
    ("gnu general public license", "gpl"), ("gnu lesser general public license", "lgpl"), ("gnu affero general public license", "agpl"),
    ("gnu free documentation license", "gfdl"), ("apache license version 2 0", "apache"), ("licensed under the apache license", "apache"),
    ("released under the mit license", "mit"), ("licensed under the mit license", "mit"), ("permission is hereby granted free of charge to any person", "mit"),
    ("redistribution and use in source and binary forms", "bsd"), ("licensed under the bsd license", "bsd"), ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"), ("boost software license", "bsl"), ("creative commons attribution", "cc-by"), ("licensed under cc by", "cc-by"),
    ("cc by sa", "cc-by-sa"), ("cc by nc", "cc-by-nc"), ("cc by nd", "cc-by-nd"), ("creative commons zero", "cc0"),
    ("released into the public domain", "public-domain"), ("dedicated to the public domain", "public-domain"),
)
#: A notice may have one edit (a character put in, left out or replaced) for so many of its characters.
CHARS_AN_EDIT = 12
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

SPANS = "array<struct<label: string, notice: string, first_word: bigint, last_word: bigint, edits: int>>"
ADDED = f"n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {SPANS}"
_SPAN_TYPE = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))


def allowed(notice: str) -> int:
    return len(notice) // CHARS_AN_EDIT


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(place, piece): the notice in edits + 1 parts, as equal in length as can be."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Finds phrases exactly and notices with edits; built once for each task."""

    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.phrases, self.notices = list(phrases), [(notice, label, allowed(notice)) for notice, label in notices]
        seeds: dict[str, list] = {}
        for i, (phrase, _) in enumerate(self.phrases):
            seeds.setdefault(phrase, []).append((True, i, 0))
        for i, (notice, _, edits) in enumerate(self.notices):
            for place, piece in pieces(notice, edits):
                seeds.setdefault(piece, []).append((False, i, place))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        if seeds:
            self.seeds.make_automaton()
        # without edits whole words have to match; of the matches at one place the closest counts
        exact, near = r"(?<![^ ]){0}(?![^ ])", r"(?e)(?:{0}){{e<={1}}}"
        self.match = [regex.compile((near if edits else exact).format(regex.escape(notice, literal_spaces=True), edits)) for notice, _, edits in self.notices]

    def scan(self, text: str) -> tuple[list, list]:
        """((start, end, label) of phrases, (start, end, label, notice, edits) of notices) in words joined by spaces; places are characters."""
        exact, windows = [], {}
        if not len(self.seeds):
            return [], []
        for last, (size, uses) in self.seeds.iter(text):
            start = last + 1 - size
            for whole, i, place in uses:
                if whole:
                    if (start == 0 or text[start - 1] == " ") and (last + 1 == len(text) or text[last + 1] == " "):
                        exact.append((start, last + 1, self.phrases[i][1]))
                    continue
                notice, _, edits = self.notices[i]
                low, high = max(0, start - place - edits), start - place + len(notice) + edits
                own = windows.setdefault(i, [])
                if own and low <= own[-1][1]:
                    own[-1][1], own[-1][0] = max(own[-1][1], high), min(own[-1][0], low)
                else:
                    own.append([low, high])
        found = []
        for i, own in windows.items():
            notice, label, edits = self.notices[i]
            for low, high in own:
                for m in self.match[i].finditer(text, low, min(len(text), high + 1)):
                    found.append((m.start(), m.end(), label, notice, sum(m.fuzzy_counts)))
        return exact, sorted(set(found))

    def row(self, raw: bytes) -> tuple:
        """Values of the ADDED columns for one text."""
        words = _WORD.findall(raw.lower())
        text = b" ".join(words).decode("utf-8", "replace")
        exact, found = self.scan(text)
        if not exact and not found:
            return len(words), 0, None, None, "", "", 0.0, []
        starts = [0, *(m.end() for m in re.finditer(" ", text))]
        word = lambda at: bisect.bisect_right(starts, at) - 1
        base, places = {x[2] for x in exact}, [word(x[0]) for x in exact]
        labels = base | {x[2] for x in found}
        spans = [{"label": label, "notice": notice, "first_word": word(a), "last_word": word(b - 1), "edits": edits} for a, b, label, notice, edits in found]
        score = 1.0 if exact else max(1 - edits / (allowed(notice) + 1) for *_, notice, edits in found)
        return len(words), len(exact), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """docs with the columns of ADDED; columns of docs with such a name are replaced.

    Null and empty texts have no words: counts 0, places null, no label, score 0.
    Texts are scanned as a whole, however long; rows that repeat each have their
    result, an empty table has none. Where several notices match one place all
    are reported, and of one notice matches that do not overlap, each with all words
    that it touches. A notice too short for an edit has to stand in whole words, of
    longer ones any run of characters counts. ``score`` is 1
    where a phrase stands word for word; else 1 less the share of the allowed
    edits, and one more, that the closest match takes; 0 without a match.
    """
    bounded_batches(docs.sparkSession)

    def start():
        scanner = Scanner(phrases, notices)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPAN_TYPE)

        def work(texts):
            columns = list(zip(*map(scanner.row, texts), strict=True)) or [()] * len(kinds)
            return [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]

        return work

    return map_texts(docs, ADDED, start)


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's license labels and the places of its notices."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
