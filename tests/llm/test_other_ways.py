"""The ways beyond what is broadcast give the same rows."""

import random

from lectern.llm import common, decontamination, near_duplicates, url_filter


def _texts(n, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(50)]
    return [" ".join(word() if r.random() < 0.02 * (k % 6) else w for w in base) for k in range(n)]


def test_pairs_that_are_shuffled(documents, monkeypatch):
    docs = documents([(k, t, "s") for k, t in enumerate(_texts(60))])
    few = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs).collect()}
    monkeypatch.setattr(near_duplicates, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(near_duplicates, "SHORT_LIST", 4)
    monkeypatch.setattr(near_duplicates, "GROUP", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "SMALL", 5)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs).collect()} == few
    assert 1 < len(set(few.values())) < 60


def test_rules_that_are_shuffled(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.example.net/{'en' if k % 2 else 'de'}/{k}") for k in range(40)], "page_id int, url string")
    rules = spark.createDataFrame([("example.net", "/en/", "block"), ("h3.example.net", "/", "allow"), ("net", "/de/1", "block")], url_filter.RULE_SCHEMA)
    few = sorted(url_filter.filter_urls(pages, rules).collect())
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert sorted(url_filter.filter_urls(pages, rules).collect()) == few


def test_benchmarks_in_blocks(spark, documents, monkeypatch):
    texts = _texts(12, seed=9)
    items = spark.createDataFrame([(k, " ".join(t.split()[:20])) for k, t in enumerate(texts)], "item_id bigint, text string")
    docs = documents([(k, t, "s") for k, t in enumerate(texts)])
    rows = lambda n=None: sorted((r["doc_id"], x["item_id"], x["distance"]) for r in decontamination.find_leaks(docs, items, block_words=n).collect() for x in r["leaks"])
    one = rows()
    assert len(one) >= 12
    for words in (60, 20):
        # tables are drawn for each block, so only copies within the limit but far from exact may differ
        assert [x for x in rows(words) if x[2] == 0] == [x for x in one if x[2] == 0]


def test_items_that_share_an_id_in_blocks(spark, documents):
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (1, "a b c d e f g h i x"), (2, "k l m n")], "item_id bigint, text string")
    docs = documents([(1, "z a b c d e f g h i x y k l m n", "s"), (2, None, "s"), (1, "z a b c d e f g h i x y k l m n", "s")])
    for words in (None, 1):
        found = decontamination.find_leaks(docs.withColumn("_h1", docs["doc_id"]), items, block_words=words)
        assert found.columns == [*docs.columns, "_h1", "leaks"]
        assert sorted([[(x["item_id"], x["distance"], x["start_word"]) for x in r["leaks"]] for r in found.collect()]) == [[], [(1, 0, 1), (2, 0, 12)], [(1, 0, 1), (2, 0, 12)]]
