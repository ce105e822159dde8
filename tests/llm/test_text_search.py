"""Importance resampling, lexical search and license scans against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import importance_sampling, lexical_search, license_scan

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text):
    return WORD.findall((text or "").encode().lower())


def features_of(text):
    words = words_of(text)
    return words + [a + b" " + b for a, b in zip(words, words[1:], strict=False)]


def resampled(docs, target, percent, min_words, buckets, seed=7):
    """(doc_id, n_features, weight, score, rank) by plain loops; docs are (doc_id, text)."""
    count = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in features_of(t))
    s, t = count([x for _, x in docs]), count(target)
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for doc_id, text in docs:
        own = features_of(text)
        gains = [math.floor(1000.0 * math.log((float(t[b] + 1) * s_all) / (float(s[b] + 1) * t_all))) for b in (zlib.crc32(f) % buckets for f in own)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(own), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0))), len(words_of(text)) >= min_words))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    drawn = [(*r[:4], k + 1 if k < percent * len(fit) // 100 else None) for k, r in enumerate(fit)]
    return Counter(drawn + [(*r[:4], None) for r in rows if not r[4]])


def prose(r, n, letters="abcdef"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.mark.parametrize(("percent", "min_words", "buckets"), [(25, 20, 10_000), (50, 0, 7), (100, 3, 70_000)])
def test_resampling_by_brute_force(spark, odd, percent, min_words, buckets):
    r = random.Random(4)
    rows = [(i, prose(r, r.randint(0, 60))) for i in range(150)] + [(i, "The Same Text, again and again. " * 5) for i in range(300, 400)] + [(7, "an id twice " * 9), (None, "é ü 12 " * 10), (8, None)]
    rows += [(x["doc_id"], x["text"]) for x in odd.select("doc_id", "text").collect()]
    docs = odd.select("doc_id", "text", *odd.columns[5:]).selectExpr("doc_id", "text", "score", "leaks AS weight", "pieces AS rank", "decoded AS key", "n_secrets AS copies")
    docs = docs.unionByName(spark.createDataFrame(rows[: len(rows) - 8], "doc_id bigint, text string"), allowMissingColumns=True)
    target = [prose(r, 20, "ab") for _ in range(9)] + [None, ""]
    found = importance_sampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), percent, min_words, buckets)
    assert Counter((x["doc_id"], x["n_features"], x["weight"], x["score"], x["rank"]) for x in found.collect()) == resampled(rows, target, percent, min_words, buckets)


def test_resampling_of_empty_tables(spark, odd, none):
    assert importance_sampling.resample(none, odd).count() == 0
    found = importance_sampling.resample(odd, none).collect()
    assert len(found) == 8 and sum(x["rank"] is not None for x in found) == 0
    assert {x["weight"] for x in found if x["n_features"] == 0} == {0}


def test_a_text_of_a_third_of_all_rows_is_weighed_once(spark, documents, monkeypatch):
    monkeypatch.setattr("lectern.llm.common.SMALL", 0)
    monkeypatch.setattr("lectern.llm.common.HOT_ROWS", 5)
    docs = documents([(i, "copied words " * 15 if i % 3 else f"own words {i} " * 10, "s") for i in range(300)])
    texts = importance_sampling.features(docs)
    assert texts.where("copies = 200").count() == 1 and texts.count() == 101
    target = documents([(1, "own words and others", "s")])
    found = Counter((x["doc_id"], x["n_features"], x["weight"], x["score"], x["rank"]) for x in importance_sampling.resample(docs, target).collect())
    assert found == resampled([(x["doc_id"], x["text"]) for x in docs.collect()], ["own words and others"], 25, 20, 10_000)


def test_features_are_packed_without_loss():
    n, found = importance_sampling.buckets_of("A b, a B! é".encode(), 100)
    assert n == 5 and sorted(zlib.crc32(x) % 100 for x in features_of("A b, a B! é")) == found.tolist()
    assert importance_sampling.buckets_of(b"", 100)[1].tolist() == [] and importance_sampling.buckets_of(b" x ", 100)[0] == 1


def ranking(docs, items, k):
    """(item_id, rank, doc_id, score) with every document scored for every item."""
    held = [(doc_id, Counter(words_of(text))) for doc_id, text in docs]
    held = [(doc_id, c, sum(c.values())) for doc_id, c in held if c]
    n_docs, n_words, df = len(held), sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        terms, rows = set(words_of(text)), []
        for doc_id, c, n in held:
            m = 50 + 50 * n * n_docs // n_words
            score = sum(math.floor(1000.0 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k2 + 1, x[3], -x[0]) for k2, x in enumerate(sorted(rows, key=lambda x: x[:3])[:k])]
    return Counter(out)


@pytest.mark.parametrize(("leaf", "at_once", "shard"), [(2_000, 128, 4_000_000), (1, 1, 4_000_000), (8, 3, 400)])
def test_search_by_brute_force(spark, odd, monkeypatch, leaf, at_once, shard):
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    monkeypatch.setattr(lexical_search, "AT_ONCE", at_once)
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", shard)
    r = random.Random(9)
    rows = [(i, prose(r, r.randint(0, 50))) for i in range(400)] + [(i, "The same, same text. A b c d.") for i in range(500, 560)] + [(3, "a b"), (3, "a b"), (None, "a b c"), (None, None)]
    items = [(i, prose(r, 6)) for i in range(12)] + [(20, "the same text"), (21, None), (22, "... !"), (20, "a A a"), (None, "a b"), (23, "wordsthatnodocumenthas")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS score", "1 AS rank", "2 AS item_id", "3 AS n", "4 AS terms").repartition(3)
    found = lexical_search.search(docs, spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS doc_id", "2 AS item"), 10)
    expected = ranking(rows, items, 10)
    assert Counter(tuple(x) for x in found.collect()) == expected


def test_search_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 2)
    docs, items = [(i, f"w{i % 5} w{i % 3} x") for i in range(40)], [(i, f"w{i} x") for i in range(7)]
    found = lexical_search.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), 4)
    assert Counter(tuple(x) for x in found.collect()) == ranking(docs, items, 4)


def test_search_of_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "same text")], "item_id bigint, text string")
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(odd, items.limit(0)).count() == 0
    assert sorted((x["rank"], x["doc_id"]) for x in lexical_search.search(odd, items).collect()) == [(1, 5), (2, 5)]


def test_treaps_are_heaps_in_document_order():
    r = np.random.default_rng(3)
    term = np.sort(r.integers(0, 6, 900))
    doc = np.concatenate([np.sort(r.choice(500, n, replace=False)) for n in np.bincount(term, minlength=8)])
    impact = r.integers(1, 5, 900)
    t = lexical_search.Treaps(term, doc, impact, 8)
    for k in range(8):
        seen = []

        def walk(node):
            if node:
                for child in (t.left[node], t.right[node]):
                    assert not child or t.impact[child] <= t.impact[node]
                walk(t.left[node])
                seen.append(t.doc[node])
                walk(t.right[node])

        walk(t.root[k])
        assert seen == doc[term == k].tolist()


def test_equal_documents_do_not_make_a_chain():
    n = 20_000
    t = lexical_search.Treaps(np.zeros(n, np.int64), np.arange(n), np.full(n, 7), 1)
    level, depth = np.array([t.root[0]]), 0
    while len(level):
        level, depth = np.concatenate([t.left[level], t.right[level]]), depth + 1
        level = level[level > 0]
    assert depth < 60


def test_subtrees_that_cannot_enter_are_left(monkeypatch):
    r = np.random.default_rng(5)
    n = 50_000
    doc, impact = np.arange(n), r.integers(1, 1000, n)
    impact[:60] = 50_000
    t = lexical_search.Treaps(np.zeros(n, np.int64), doc, impact, 1)
    scored = []
    whole = lexical_search.Treaps._whole
    monkeypatch.setattr(lexical_search.Treaps, "_whole", lambda self, first, end, *a: (scored.append(int((end - first).sum())), whole(self, first, end, *a))[1])
    found, score = t.best(np.array([0]), np.array([1]), 50, n)
    assert found.tolist() == list(range(50)) and set(score.tolist()) == {50_000} and sum(scored) < n // 4


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[-1] + 1, last[j + 1] + 1, last[j] + (x != y)))
    return row[-1]


def nearest(text, notice):
    """The least edits that turn some run of characters into the notice."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(notice):
        row, last = [i + 1], row
        for j, y in enumerate(text):
            row.append(min(row[-1] + 1, last[j + 1] + 1, last[j] + (x != y)))
    return min(row)


def stands(text, notice):
    return f" {notice} " in f" {text} "


def edited(r, text, n):
    for _ in range(n):
        at, kind = r.randrange(len(text)), r.randrange(3)
        text = text[:at] + ("" if kind == 0 else r.choice("abcdefgh ")) + text[at + (kind < 2) :]
    return " ".join(text.split())


def test_licenses_by_brute_force():
    r, scanner, met = random.Random(8), license_scan.Scanner(), 0
    for _ in range(400):
        notice, _, edits = r.choice(scanner.notices)
        text = " ".join([prose(r, r.randint(0, 4)), edited(r, notice, r.randint(0, edits + 1)), prose(r, r.randint(0, 4))]).strip()
        exact, found = scanner.scan(text)
        expected = {n for n, _, k in scanner.notices if (nearest(text, n) <= k if k else stands(text, n))}
        assert {x[3] for x in found} == expected
        for a, b, label, n, k in found:
            assert distance(text[a:b], n) <= k <= license_scan.allowed(n) and (n, label) in license_scan.NOTICES
            assert 0 <= a < b <= len(text)
        met += bool(expected)
    assert met > 100


def base(text):
    """(n_words, n_base, first_word, last_word, base_labels) by comparing words."""
    words, places, labels = words_of(text), [], set()
    for phrase, label in license_scan.PHRASES:
        own = phrase.encode().split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_phrases_by_brute_force(spark, odd):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "apache\nlicense... MIT -- License; cc-by cc by CC  BY", "apachelicense mit licenses cc byte", "This work is licensed under the GNU General Public License, version 3.",
        "GNU Genral Public License", "licensed under cc by nc 4 0 ", "cc by", "by cc by cc", "émit license", "mit license\x00mit license", "x " * 5000 + "MIT license", "", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 AS labels", "'s' AS spans", "2 AS notice")
    for row in license_scan.scan(docs).collect():
        text = texts[row["doc_id"]]
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == base(text)
        assert set(filter(None, row["base_labels"].split(","))) <= set(filter(None, row["labels"].split(",")))
        assert 0 <= row["score"] <= 1 and (row["score"] > 0) == bool(row["labels"])
        assert row["notice"] == 2
    found = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert (found[4]["labels"], found[4]["n_base"], found[4]["spans"][0]["edits"], found[4]["spans"][0]["last_word"]) == ("gpl", 0, 1, 3)
    assert found[5]["labels"] == "cc-by,cc-by-nc" and found[2]["labels"] == ""
    assert license_scan.scan(odd).count() == 8 and license_scan.scan(odd.limit(0)).count() == 0


def test_license_query_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in license_scan.op13_license_scan(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r = rows[d["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(d["text"])


def test_pieces_cover_the_notice():
    for notice, _ in license_scan.NOTICES:
        k = license_scan.allowed(notice)
        cut = license_scan.pieces(notice, k)
        assert len(cut) == k + 1 and "".join(p for _, p in cut) == notice and all(notice[a : a + len(p)] == p for a, p in cut)
