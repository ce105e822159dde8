"""Odd and empty tables through every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import (
    decontamination, language_id, line_rules, lm_scoring, near_duplicates, quality_crf, secret_scan, sentencepiece_codec, toxicity, url_filter,
)


def labels(spark, rows=((2, 1, 0), (4, 0, 1), (5, 1, 0), (5, 1, 0), (None, 0, 0), (9, None, None))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def benchmark(spark, rows=((1, "same text twice in a row here"), (2, None), (None, "x"), (3, ""), (1, "same text twice in a row here"))):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


def test_sentencepiece(odd, none):
    rows = sentencepiece_codec.coded(odd)
    found = rows.select("text", "decoded", "pieces").collect()
    assert len(found) == 8 and all(r["decoded"] == (r["text"] or "") for r in found)
    assert sum(r["pieces"] == [] for r in found) == 2
    assert sentencepiece_codec.coded(none).count() == 0


def test_toxicity(spark, odd, none):
    for rows in (labels(spark), labels(spark, [])):
        found = toxicity.score(odd, toxicity.fit(odd, rows, F.lit(True))).select("doc_id", "score", "n_sentences").collect()
        assert len(found) == 8 and all(0 <= r["score"] <= 1 for r in found)
        assert all(r["score"] == 0 for r in found if not r["n_sentences"])
    assert toxicity.score(none, toxicity.fit(none, labels(spark), F.lit(True))).count() == 0


def test_decontamination(spark, odd, none):
    found = decontamination.find_leaks(odd, benchmark(spark)).select("doc_id", "leaks").collect()
    assert [(r["doc_id"], [x["item_id"] for x in r["leaks"]]) for r in found if r["leaks"]] == [(5, [1]), (5, [1])]
    assert decontamination.find_leaks(odd, benchmark(spark, [])).where("size(leaks) > 0").count() == 0
    assert decontamination.find_leaks(none, benchmark(spark)).count() == 0


def test_secrets(spark, odd, none):
    forest = secret_scan.default_forest(spark)
    found = secret_scan.redact(odd, forest)
    assert found.count() == 8 and set(found.columns) == set(odd.columns)
    assert found.select("text").exceptAll(odd.select("text")).count() == 0
    assert secret_scan.findings(none, forest).count() == 0


def test_quality(spark, odd, none):
    for rows in (labels(spark), labels(spark, [])):
        found = quality_crf.score(odd, quality_crf.fit(odd, rows, F.lit(True))).collect()
        assert len(found) == 8 and all(0 <= r["score"] <= 1 for r in found)
    assert quality_crf.score(none, quality_crf.fit(none, labels(spark), F.lit(True))).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (4, "http://X.example.NET/en/a?b#c"), (4, "http://X.example.NET/en/a?b#c"), (None, "https://a.org"), (5, "x://" + "a." * 3000 + "net/" + "p/" * 3000)], "page_id bigint, url string")
    pages = pages.selectExpr("*", "'x' AS host", "'y' AS rule")
    rules = spark.createDataFrame(url_filter.DEFAULT_RULES, url_filter.RULE_SCHEMA)
    found = {r["page_id"]: (r["host"][-11:], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect()}
    assert url_filter.filter_urls(pages, rules).count() == 7
    assert found[1] == found[2] == found[3] == ("", None, "allow") and found[4] == ("example.net", "example.net/en/", "allow") and found[5][1:] == ("net/", "block")
    assert url_filter.filter_urls(pages, rules.limit(0)).where("verdict = 'block'").count() == 0
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_lm(odd, none):
    found = lm_scoring.score(odd, odd).collect()
    assert len(found) == 8 and all(r["n_known"] == r["n_tokens"] and r["score"] <= 0 for r in found)
    assert {r["n_tokens"] for r in found if r["doc_id"] in (1, 2, 3)} == {1}
    found = lm_scoring.score(odd, none).collect()
    assert len(found) == 8 and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in found)
    assert lm_scoring.score(none, odd).count() == 0


def test_language(odd, none):
    found = language_id.identify(odd, language_id.fit(odd)).select("doc_id", "lang_pred", "score").collect()
    assert len(found) == 8
    assert {r["lang_pred"] for r in found if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.fit(none)).collect()} == {"und"}
    assert language_id.identify(none, language_id.fit(odd)).count() == 0


def test_near_duplicates(odd, none):
    found = near_duplicates.near_duplicates(odd).collect()
    assert len(found) == 8
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in found)
    assert {r["doc_id"]: r["n_shingles"] for r in found if r["doc_id"] in (1, 2, 3)} == {1: 0, 2: 0, 3: 0}
    assert near_duplicates.near_duplicates(none).count() == 0


def test_line_rules(odd, none):
    found = line_rules.judge(odd).collect()
    assert len(found) == 8 and all(r["base_failed"] for r in found if r["doc_id"] in (1, 2, 3))
    assert line_rules.judge(none).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, odd, none, empty, tmp_path):
    """All five keep every column of the documents with its values, whatever their names."""
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    mine = odd.selectExpr("*", "array(doc_id) AS round_trip", "map('k', n_chars) AS text_hash", "'o' AS own", "named_struct('a', source) AS n_sentences", "map('m', map(1, text)) AS nested", "'y' AS chosen", "'z' AS `a.b`")
    docs = none if empty else mine
    before = {(r["doc_id"], r["text"]): r.asDict() for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = out.collect()
        assert len(rows) <= docs.count()
        for r in rows:
            own = r.asDict()
            assert {c: own[c] for c in docs.columns} == before[r["doc_id"], r["text"]]
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            before = {(r["doc_id"], r["text"]): r.asDict() for r in docs.collect()}
    added = docs.columns[-2:]
    assert added == (["pieces", "round_trip"] if empty else ["pieces_", "round_trip_"])
    assert all(r[added[1]] for r in docs.collect())
    if not empty:  # the first row that stands twice goes once, the benchmark's item goes with both
        assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "3", "4", "6", "None"]


def test_masking_changes_only_the_text(spark):
    secret = "password = " + "Ab3xK9pQ7rT2" * 3
    docs = spark.createDataFrame([(1, f"key {secret} end", 5, "mine"), (2, "no secret here", 6, "yours")], "doc_id bigint, text string, n_chars int, n_secrets string").withColumn("found", F.create_map(F.lit(1), F.lit(2)))
    out = corpus_pipeline.mask_secrets(spark, docs, "")
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.dtypes == docs.dtypes and rows[1]["text"].startswith("key ") and secret not in rows[1]["text"]
    assert rows[1]["n_chars"] == len(rows[1]["text"]) and rows[2]["n_chars"] == 6
    assert [rows[k]["n_secrets"] for k in (1, 2)] == ["mine", "yours"] and rows[1]["found"] == {1: 2}


def test_repeated_rows_of_any_type(spark, monkeypatch):
    """Of rows that repeat an id and a text one stays, by the others as JSON; more dropped keys than are broadcast are joined."""
    text = "one two three four five six seven"
    rows = [(1, text, {"b": 1}, 2), (1, text, {"a": 9}, 1), (2, text, None, 3), (3, None, {"x": 0}, 4), (3, None, {"w": 0}, 5), (4, "other words altogether in this text", {}, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, chosen map<string,int>, component int")
    first = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_KEYS", 0)
    second = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    key = lambda found: sorted((r["doc_id"], r["component"], str(r["chosen"])) for r in found)
    assert key(first) == key(second) == [(1, 1, "{'a': 9}"), (3, 5, "{'w': 0}"), (4, 6, "{}")]
