"""Operators against brute force, exact round trips and held-out accuracy."""

import math
import random
import string
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import (
    catalog, common, components, decontamination, language_id, line_rules, lm_scoring, near_duplicates, quality_crf, secret_scan, sentencepiece_codec, toxicity, url_filter,
)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece_codec.load_vocabulary()


def _best(word, pieces, unknown, single):
    """Best segmentation by trying all last pieces, the longest first."""
    best = [(0.0, [])] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            found = pieces.get(word[start:end])
            options = [(best[start][0] + found[1], [*best[start][1], found[0]])] if found else []
            if end - start == 1 and word[start] not in single:
                options.append((best[start][0] + unknown, [*best[start][1], word[start]]))
            for o in options:
                if best[end] is None or o[0] > best[end][0]:
                    best[end] = o
    return best[-1]


def test_pieces_by_brute_force(vocabulary):
    encoder = sentencepiece_codec.Encoder(vocabulary)
    pieces = {p: (i, s) for i, (p, s, k) in enumerate(zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds, strict=True)) if k == "n"}
    r = random.Random(2)
    for _ in range(300):
        word = "".join(r.choice("theanrsió▁日\n") for _ in range(r.randint(1, 12)))
        expected = [x for y in _best(word, pieces, encoder.unknown_score, encoder.single)[1] for x in ([y] if isinstance(y, int) else encoder._as_bytes(y))]
        assert encoder.segment(word) == expected


def test_pieces_as_the_library_has_them(vocabulary):
    """The same scores read as a unigram model by the public library, on words without unknown characters."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(sentencepiece_codec.MODEL_FILE, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for piece, score in zip(model.pieces, vocabulary.scores, strict=True):
        piece.score = score
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    encoder = sentencepiece_codec.Encoder(vocabulary)
    r = random.Random(4)
    for _ in range(500):
        text = " ".join("".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(1, 9))) for _ in range(6))
        score = lambda ids: sum(vocabulary.scores[i] for i in ids)
        ours, theirs = encoder.encode(text.encode()), library.encode(text)
        assert ours == theirs or score(ours) == score(theirs)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_pieces_round_trip(text):
    import pyarrow as pa

    v = test_pieces_round_trip.v = getattr(test_pieces_round_trip, "v", None) or sentencepiece_codec.load_vocabulary()
    e = test_pieces_round_trip.e = getattr(test_pieces_round_trip, "e", None) or sentencepiece_codec.Encoder(v)
    raw = text.encode("utf-8", "surrogatepass")
    table = pa.array(sentencepiece_codec.piece_bytes(v), pa.large_binary())
    assert sentencepiece_codec.join_pieces(pa.array([e.encode(raw)], pa.list_(pa.int32())), table).to_pylist() == [raw]


def test_query_returns_all_pieces(spark, vocabulary):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    encoder = sentencepiece_codec.Encoder(vocabulary)
    for r in catalog.queries()["op1_sentencepiece"](spark, SF).collect():
        assert r["pieces"] == encoder.encode(texts[r["doc_id"]].encode()) and r["n_pieces"] == len(r["pieces"]) and r["round_trip"]


def test_noisy_or_locates_the_sentence():
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeioubcdf") for _ in range(4))
    sentence = lambda bad: " ".join([*(word() for _ in range(6)), *(["vile"] if bad else [])])
    texts, y = [], []
    for k in range(300):
        bad = r.randrange(5) if k % 3 == 0 else -1
        texts.append(". ".join(sentence(i == bad) for i in range(5)).encode())
        y.append(int(bad >= 0))
    model = toxicity.train(texts[:200], y[:200])
    scores = [toxicity.noisy_or(t, model) for t in texts[200:]]
    assert [int(s[0] >= 0.5) for s in scores] == y[200:]
    for text, (_, _, found) in zip(texts[200:], scores, strict=True):
        assert all(b"vile" in text[f["start"] : f["end"]] for f in found) and len(found) == text.count(b"vile")


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_best_match_by_brute_force():
    r = random.Random(3)
    for _ in range(150):
        item, text = [np.array([r.randrange(4) for _ in range(n)]) for n in (r.randint(1, 6), r.randint(1, 9))]
        distance, start, end = decontamination.best_match(item, text)
        assert distance == min(_edit(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1)) == _edit(item, text[start:end])


def test_decontamination_of_exact_copies_and_clean_texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(r.randint(15, 45)))) for i in range(60)]
    searcher = decontamination.Searcher(decontamination.build_index([(i, t.encode()) for i, t in items]))
    for i, text in items:
        host = [word() for _ in range(40)] + text.split() + [word() for _ in range(30)]
        hits = [x for x in searcher.find(" ".join(host).encode()) if x["item_id"] == i]
        assert (hits[0]["start_word"], hits[0]["distance"]) == (40, 0)
    clean = [" ".join(word() for _ in range(200)).encode() for _ in range(50)]
    assert not any(searcher.search(clean))
    assert not searcher.find(" ".join(items[0][1].split()[: len(items[0][1].split()) // 2]).encode())


@pytest.mark.parametrize("kind", decontamination.KINDS)
@pytest.mark.parametrize("lengths", [(6, 14), (15, 45), (60, 60), (200, 200), (400, 400)])
def test_decontamination_recall_by_kind_of_edit(kind, lengths):
    """Copies at the distance limit between words of the same vocabulary, one kind of edit each."""
    r, rng = random.Random(lengths[0]), np.random.default_rng(lengths[1])
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(2000)]
    word = lambda: r.choice(vocabulary)
    items = [(i, [word() for _ in range(r.randint(*lengths))]) for i in range(60 if lengths[1] < 100 else 25)]
    index = decontamination.build_index([(i, " ".join(w).encode()) for i, w in items])
    assert not any(c.exact for c in index.classes)
    searcher, found = decontamination.Searcher(index), 0
    for i, words in items:
        places = decontamination.edited(np.arange(len(words)), decontamination.edit_limit(len(words)), kind, rng, -1)
        copy = [words[k] if k >= 0 else word() for k in places]
        host = [word() for _ in range(50)] + copy + [word() for _ in range(40)]
        found += i in [x["item_id"] for x in searcher.find(" ".join(host).encode())]
    assert found >= 0.95 * len(items)


def test_decontamination_where_tables_do_not_suffice(monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_TABLES", 1)
    r, rng = random.Random(2), np.random.default_rng(2)
    items = [(i, [f"w{r.randrange(500)}" for _ in range(30)]) for i in range(20)]
    index = decontamination.build_index([(i, " ".join(w).encode()) for i, w in items])
    assert all(c.exact for c in index.classes)
    for i, words in items:
        places = decontamination.edited(np.arange(30), 6, "mixed", rng, -1)
        text = " ".join(words[k] if k >= 0 else "other" for k in places)
        assert i in [x["item_id"] for x in decontamination.Searcher(index).find(text.encode())]


def test_copies_at_the_ends_of_a_text():
    words = [f"w{k}" for k in range(20)]
    searcher = decontamination.Searcher(decontamination.build_index([(7, " ".join(words).encode())]))
    for kept in (words[4:], words[:16], words[2:18]):
        assert [x["distance"] for x in searcher.find(" ".join(kept).encode())] == [4]


def test_rare_words_are_counted_in_slices(monkeypatch):
    """The same leaks however many words are counted at a time."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(n)).encode()) for k, n in enumerate((6, 9, 15, 30, 30, 44))]
    searcher = decontamination.Searcher(decontamination.build_index(items, decontamination.EDIT_SHARE, decontamination.RECALL))
    texts = [" ".join([*(word() for _ in range(r.randrange(400))), items[k % 6][1].decode(), *(word() for _ in range(300))]).encode() for k in range(12)]
    whole = searcher.search(texts)
    monkeypatch.setattr(decontamination, "MARK_CELLS", 12)
    assert searcher.search(texts) == whole and all(any(x["item_id"] == k % 6 and x["distance"] == 0 for x in found) for k, found in enumerate(whole))


def test_short_benchmark_items():
    searcher = decontamination.Searcher(decontamination.build_index([(1, b"alpha"), (2, b"beta Gamma"), (3, b"one two three four"), (4, b" ... ")]))
    rows = searcher.search([b"zero one two three four beta, gamma", b"one two three five gamma beta", b"ALPHA", b""])
    assert [[(x["item_id"], x["distance"], x["start_word"], x["end_word"]) for x in r] for r in rows] == [[(2, 0, 5, 7), (3, 0, 1, 5)], [], [(1, 0, 0, 1)], []]


def test_secret_spans_and_masks(spark, documents):
    key, password, commit = "AKIA" + "QX3V" * 4, "9f2c41d07ab35e86c1", "3f786850e387550fdab836ed7e6dc881de23001b"
    text = f"one {key} two password={password} three commit {commit} four https://www.example.org/a/b/c/d/e/f/page1.html"
    docs = documents([(1, text, "src1"), (2, "no secret in this text", "src1"), (3, None, None)])
    forest = secret_scan.default_forest(spark)
    rows = secret_scan.findings(docs, forest).where("secret").orderBy("start").collect()
    assert [text[r["start"] : r["start"] + r["length"]] for r in rows] == [key, f"password={password}"]
    masked = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs, forest).collect()}
    assert masked == {1: text.replace(key, secret_scan.MASK).replace(password, secret_scan.MASK), 2: "no secret in this text", 3: None}


def _judged(spark, forest, rows):
    total = " + ".join(secret_scan._tree_sql(t, "f") for t in forest)
    scored = spark.createDataFrame(rows, secret_scan.FINDINGS).selectExpr(f"{secret_scan._features('found', 'before', 'after', 'path')} AS f", "label", "family")
    return scored.selectExpr("f", f"({total}) / {len(forest)} AS score", "label", "family").collect()


def test_forest_on_findings_it_has_not_seen(spark):
    scored = _judged(spark, secret_scan.default_forest(spark), secret_scan.labelled_findings(600, seed=77))
    assert sum(int(r["score"] >= 0.5) == r["label"] for r in scored) >= 0.95 * len(scored)


def test_forest_on_families_it_has_not_seen(spark):
    """Whole templates held out, half of them at a time."""
    rows, fresh = secret_scan.labelled_findings(2000, seed=7), secret_scan.labelled_findings(800, seed=8)
    families = sorted({r[5] for r in rows})
    right = named = there = 0
    for out in (families[::3], families[1::3], families[2::3]):
        forest = secret_scan.train_forest(spark.createDataFrame([r for r in rows if r[5] not in out], secret_scan.FINDINGS))
        for r in _judged(spark, forest, [x for x in fresh if x[5] in out]):
            right += r["score"] >= 0.5 and r["label"] == 1
            named += r["score"] >= 0.5
            there += r["label"]
    assert right / named >= 0.85 and right / there >= 0.7


def test_forest_scores_by_brute_force(spark):
    """The SQL of the trees against a walk through them, and features against plain Python."""
    forest = secret_scan.default_forest(spark)

    def walk(tree, x):
        while not isinstance(tree, float):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    rows = secret_scan.labelled_findings(200, seed=3)
    found = {}
    for r, s in zip(rows, _judged(spark, forest, rows), strict=True):
        assert s["score"] == pytest.approx(sum(walk(t, list(s["f"])) for t in forest) / len(forest), abs=1e-5)
        found[r[5]] = s["f"]
        if r[5] == "checksum":
            runs = "".join("a" if c.isalpha() else "0" for c in r[0])
            assert s["f"]["length"] == len(r[0]) and s["f"]["hexadecimal"] == 1
            assert s["f"]["digits"] == pytest.approx(sum(c.isdigit() for c in r[0]) / len(r[0]))
            assert s["f"]["transitions"] == pytest.approx(sum(a != b for a, b in zip(" " + runs, runs, strict=False)) / len(r[0]))
            assert s["f"]["distinct"] == pytest.approx(len(set(r[0])) / len(r[0]))


def test_many_secrets_of_one_text(spark):
    r = random.Random(1)
    text = "".join(f"é x password={''.join(r.choice('abcdef0123456789') for _ in range(20))} AKIA{'QX3V' * 4} " for _ in range(400))
    docs = spark.createDataFrame([(1, text, "a", "b")], "doc_id int, text string, found string, gaps string")  # clashing names stay
    forest = secret_scan.default_forest(spark)
    rows = secret_scan.findings(docs, forest).orderBy("start").collect()
    assert len(rows) == 800 and all(text[x["start"] : x["start"] + x["length"]] == x["found"] for x in rows)
    masked = secret_scan.redact(docs, forest).first()
    assert (masked["found"], masked["gaps"], masked["n_secrets"]) == ("a", "b", 800)


def test_forward_backward_by_brute_force():
    r = np.random.default_rng(0)
    for n in (1, 2, 5):
        z, turns = r.normal(size=n), r.normal(size=(2, 2))
        weights = {}
        for m in range(2**n):
            y = [(m >> k) & 1 for k in range(n)]
            weights[tuple(y)] = math.exp(sum(z[k] for k in range(n) if y[k]) + sum(turns[a, b] for a, b in zip(y, y[1:], strict=False)))
        total = sum(weights.values())
        p, pairs = quality_crf.marginals(z, np.array([n]), turns)
        assert p == pytest.approx([sum(w for y, w in weights.items() if y[k]) / total for k in range(n)])
        assert pairs == pytest.approx(np.array([[sum(w * sum(a == i and b == j for a, b in zip(y, y[1:], strict=False)) for y, w in weights.items()) / total for j in (0, 1)] for i in (0, 1)]))


def test_document_quality_by_brute_force():
    """Scores of whole documents: marginals by all label sequences, weighted by length."""
    r = np.random.default_rng(2)
    W = quality_crf.WIDTH
    model = quality_crf.Field(frozenset({b"the", b"and"}), *r.normal(size=(3, W)), 0.3, r.normal(size=(2, 2)), 1.7, -0.2)
    texts = [b"the cat and dog.\n12 34 !!\nMORE words here, and so on", b"", b"one line", b"a\na\n\nb 1 2 3 the the"]
    for text, score in zip(texts, quality_crf.judge(texts, model)[0], strict=True):
        lines = quality_crf.lines_of(text)
        active = quality_crf.binned(quality_crf.line_values(lines, model.common))
        z = [
            model.bias + model.own[a].sum() + (model.before[active[k - 1]].sum() if k else 0) + (model.after[active[k + 1]].sum() if k + 1 < len(lines) else 0)
            for k, a in enumerate(active)
        ]
        mass, total = np.zeros(len(lines)), 0.0
        for y in np.ndindex(*[2] * len(lines)):
            w = np.exp(sum(z[k] for k in range(len(y)) if y[k]) + sum(model.turns[a, b] for a, b in zip(y, y[1:], strict=False)))
            mass += w * np.array(y)
            total += w
        size = np.array([max(1, len(x)) for x in lines])
        share = np.clip((mass / total * size).sum() / size.sum(), 1e-4, 1 - 1e-4)
        assert score == pytest.approx(1 / (1 + np.exp(-(1.7 * np.log(share / (1 - share)) - 0.2))))


def test_long_documents_are_learned_from_in_pieces(monkeypatch):
    good, bad = b"a good line of words stands here.\n" * 900, b"12 !! ##\n" * 900
    model = quality_crf.train([good, bad, good[:300], bad[:60]], [1, 0, 1, 0])
    assert quality_crf.judge([good], model)[0][0] > 0.5 > quality_crf.judge([bad], model)[0][0]


def test_toxicity_scores_by_brute_force():
    r = random.Random(3)
    vocabulary = [b"vile", b"vil*", b"calm", b"dog", b"dogs*", b"h\xc3\xa9*"]
    model = toxicity.ToxicityModel({w: r.uniform(-3, 3) for w in vocabulary}, -1.5)
    for _ in range(100):
        text = "".join(r.choice(["vile ", "calm ", "dog ", "dogs1 ", "hé ", ". ", "!\n", "other "]) for _ in range(r.randrange(12)))
        clean, offending, n = 1.0, [], 0
        for part in text.replace("!", ".").replace("\n", ".").split("."):
            words = part.encode().split()
            if not words:
                continue
            n += 1
            kinds = {k for w in words for k in (w, w[:4] + b"*", w[:5] + b"*")}
            p = 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(k, 0) for k in kinds))))
            clean *= 1 - p
            offending += [p] if p >= 0.5 else []
        score, sentences, found = toxicity.noisy_or(text.encode(), model)
        assert (score, sentences) == (pytest.approx(1 - clean), n) and [f["score"] for f in found] == pytest.approx(offending)


def test_labelled_sample(spark, monkeypatch):
    """All of the rare class, ids that repeat with each of their texts, parts of long texts."""
    monkeypatch.setattr(common, "SAMPLE_CHARS", 50)
    rows = [(k, f"text {k}") for k in range(1000)] + [(3, "another text"), (3, "another text"), (5, "0123456789" * 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k < 6)) for k in range(1000)] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    drawn, share = common.labelled_sample(docs, labels, "toxic", F.col("doc_id") != 4, 40)
    found = drawn.collect()
    assert share == pytest.approx(5 / 999) and len({r["doc_id"] for r in found}) == 40
    assert sorted((r["doc_id"], len(r["text"])) for r in found if r["label"]) == [(0, 6), (1, 6), (2, 6), (3, 6), (3, 12), (5, 6), (5, 50)]


def test_languages_by_brute_force():
    """Family odds, pair votes and ties against a plain loop over rows and machines."""
    r = np.random.default_rng(8)
    own = {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"], "uralic": ["fi"]}
    machine = lambda: r.normal(size=9).astype(np.float32)
    pairs = {f: [(a, b, machine()) for i, a in enumerate(c) for b in c[i + 1 :]] for f, c in own.items()}
    model = language_id.LanguageModel(own, [(f, machine()) for f in own], pairs)
    x = r.normal(size=(60, 8)).astype(np.float32)
    sure = lambda row, w: 1 / (1 + math.exp(-4 * max(-20, min(20, float(row @ w[:-1] + w[-1])))))
    for row, (lang, score) in zip(x, model.predict(x), strict=True):
        odds = {f: sure(row, w) for f, w in model.families}
        family = max(odds, key=odds.get)
        votes = {c: [0, 0.0] for c in own[family]}
        for a, b, w in pairs[family]:
            p = sure(row, w)
            votes[a if p >= 0.5 else b][0] += 1
            votes[a][1] += p
            votes[b][1] += 1 - p
        best = max(own[family], key=lambda c: votes[c])
        within = votes[best][1] / (len(votes) - 1) if len(votes) > 1 else 1.0
        assert lang == best and score == pytest.approx(min(1.0, odds[family] / sum(odds.values()) * within), abs=1e-5)


def test_language_model_scores_by_brute_force(documents, monkeypatch):
    """Whole scores against a plain sum: own classes, endings, words beyond the head, unknown words."""
    for name, value in (("HEAD", 6), ("CLASSES", 3), ("ENDINGS", 4)):
        monkeypatch.setattr(lm_scoring, name, value)
    kept = []
    monkeypatch.setattr(lm_scoring, "normalised", lambda *a, real=lm_scoring.normalised: kept.append(real(*a)) or kept[-1])
    r = random.Random(4)
    text = lambda n: " ".join(r.choice(["the", "a", "of", "House", "tree", "sea", "run", "gone", f"w{r.randrange(30)}"]) for _ in range(n))
    docs = documents([(k, text(r.randrange(40)), "s") for k in range(40)])
    found = {x["doc_id"]: x for x in lm_scoring.score(docs, docs.where("doc_id < 30")).collect()}
    texts = {x["doc_id"]: lm_scoring.tokens_of(x["text"].encode()) for x in docs.collect()}
    counts = Counter(w for k, t in texts.items() if k < 30 for w in t)
    own = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:3]
    class_of = lambda w: 5 + own.index(w) if w in own else 1 + zlib.crc32(w[-2:]) % 4
    mass = {k: sum(n + 0.5 for w, n in counts.items() if w not in own and class_of(w) == k) + 0.5 for k in range(1, 5)}
    for k, words in texts.items():
        classes = np.array([*map(class_of, words), 0])
        expected = kept[-1].log_probabilities(classes).sum(dtype=float) / math.log(10)
        expected += sum(math.log10((counts[w] + 0.5) / mass[class_of(w)]) for w in words if w not in own)
        assert found[k]["score"] == pytest.approx(expected, abs=1e-3)


def test_every_token_is_learned_from_once(documents, monkeypatch):
    """Pairs and tokens cover all texts in whatever parts they lie; tasks' parameters are averaged by their tokens."""
    docs = documents([(1, "a b a b " * 500, "s"), (2, "b a", "s"), (3, None, "s")])
    counts = np.zeros(3 + lm_scoring.ENDINGS, np.int64)
    counts[[0, -2, -1]] = 3, 1001, 1001
    pairs, learned = lm_scoring.contrasted(docs.coalesce(1), [b"a", b"b"], counts)
    a, b = 1 + lm_scoring.ENDINGS, 2 + lm_scoring.ENDINGS
    assert pairs[0].sum() == pairs[1].sum() == 2000 + 1 + 2 + 1 + 1 and pairs[0][a, b] == 1000 and pairs[0][b, a] == 999 + 1
    texts = [np.array([*([a, b] * 1000), 0]), np.array([b, a, 0]), np.array([0])]
    whole = lm_scoring.Contrast(counts)
    whole.learn(*(np.concatenate(x) for x in zip(*((*lm_scoring.before(t), t) for t in texts), strict=True)))
    assert whole.tokens == 2005 and all(np.allclose(x, y, atol=1e-5) for x, y in zip(learned, whole.own, strict=True))
    parts = [lm_scoring.Contrast(counts) for _ in range(3)]
    for part, t in zip(parts, texts, strict=True):
        part.learn(*lm_scoring.before(t), t)
    mean = sum(p.flat() * p.tokens for p in parts) / 2005
    again, spread = lm_scoring.contrasted(docs.repartitionByRange(3, "doc_id"), [b"a", b"b"], counts)
    assert (again == pairs).all() and np.allclose(np.concatenate([x.ravel() for x in spread]), mean, atol=1e-5)


def test_contrast_gradient_by_brute_force(monkeypatch):
    """One step goes up the contrast's own likelihood in every parameter."""
    monkeypatch.setattr(lm_scoring, "WIDTH", 3)
    monkeypatch.setattr(lm_scoring, "NOISE", 2)
    r = np.random.default_rng(7)
    one, two, now = r.integers(0, 5, (3, 12))
    model = lm_scoring.Contrast(np.array([5, 3, 2, 1, 4]), seed=1)
    start = [x.copy() for x in model.own]
    noise = np.minimum(np.searchsorted(model.up_to, np.random.default_rng(9).random(2)), 4)
    model.random = np.random.default_rng(9)

    def likelihood(own):
        context, target, turn, bias = (x.astype(np.float64) for x in own)
        q = context[one] @ turn[0] + context[two] @ turn[1]
        over = lambda v, s: s + bias[v] - model.log_noise[v]
        sigmoid = lambda x: 1 / (1 + np.exp(-x))
        good = np.log(sigmoid(over(now, (q * target[now]).sum(1)))).sum()
        return good + sum(np.log(1 - sigmoid(over(k, q @ target[k]))).sum() for k in noise)

    model.learn(one, two, now)
    checked = 0
    for k, x in enumerate(start):
        for at in np.ndindex(x.shape):
            slope = []
            for way in (1e-3, -1e-3):
                other = [v.astype(np.float64).copy() for v in start]
                other[k][at] += way
                slope.append(likelihood(other))
            if abs(slope[0] - slope[1]) > 1e-4:
                checked += 1
                assert np.sign(model.own[k][at] - x[at]) == np.sign(slope[0] - slope[1])
    assert checked > 20


def test_normaliser_by_brute_force():
    r = np.random.default_rng(1)
    context, target, turn, bias = r.normal(size=(6, 4)), r.normal(size=(6, 4)), r.normal(size=(2, 4, 4)), r.normal(size=6)
    model = lm_scoring.normalised(context, target, turn, bias)
    classes = r.integers(0, 6, 20)
    expected = []
    for k, c in enumerate(classes):
        a, b = (classes[k - 1] if k else 0), (classes[k - 2] if k > 1 else 0)
        scores = (context[a] @ turn[0] + context[b] @ turn[1]) @ target.T + bias
        expected.append(scores[c] - np.log(np.exp(scores).sum()))
    assert model.log_probabilities(classes) == pytest.approx(expected, abs=1e-4)


def test_language_model_learns_order():
    r = random.Random(1)
    rows = [np.array([*(2 + (k + s) % 8 for k in range(30)), 0]) for s in (r.randrange(8) for _ in range(150))]
    model = lm_scoring.train(rows, 10, passes=30, batch=256)
    assert model.log_probabilities(rows[0])[1:30].mean() > math.log(0.5)


def test_gradient_of_pair_counts_by_brute_force(monkeypatch):
    r = np.random.default_rng(4)
    texts = [np.append(r.integers(1, 5, n), 0) for n in (0, 1, 2, 9)]
    start = tuple(r.normal(size=s).astype(np.float32) for s in ((5, 3), (5, 3), (2, 3, 3), (5,)))
    pairs = np.zeros((2, 5, 5), np.int64)
    for t in texts:
        for d, before in enumerate(lm_scoring.before(t)):
            np.add.at(pairs[d], (before, t), 1)
    likelihood = lambda x: sum(lm_scoring.normalised(*x).log_probabilities(t).sum(dtype=float) for t in texts)
    monkeypatch.setattr(lm_scoring, "STEPS", 1)
    monkeypatch.setattr(lm_scoring, "PENALTY", 0)
    moved = lm_scoring.fitted(start, pairs)  # Adam's first step has the gradient's signs
    for k, x in enumerate(start):
        for at in np.ndindex(x.shape):
            slope = []
            for way in (1e-2, -1e-2):
                other = [v.copy() for v in start]
                other[k][at] += way
                slope.append(likelihood(other))
            if abs(slope[0] - slope[1]) > 1e-3:
                assert np.sign(moved[k][at] - x[at]) == np.sign(slope[0] - slope[1])


def test_language_model_learns_from_all_texts(documents):
    cycle = "a b c d e f g h "
    docs = documents([(1, cycle * 15_000, "s"), (2, cycle * 30, "s")])  # the first is longer than any text of the sample
    found = {r["doc_id"]: r for r in lm_scoring.score(docs, docs.where("doc_id = 1")).collect()}
    assert found[2]["score"] / found[2]["n_tokens"] > math.log10(0.5)


@pytest.mark.parametrize(("shapes", "hot"), [(99, 2000), (0, 2000), (0, 20)])
def test_url_rules_by_brute_force(spark, monkeypatch, shapes, hot):
    monkeypatch.setattr(url_filter, "FEW_SHAPES", shapes)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "SMALL", hot)
    r = random.Random(6)
    rules = [(h, p, r.choice(("allow", "block"))) for h in ("net", "a.net", "b.a.net", "org") for p in ("/", "/x", "/x/y/", "") if r.random() < 0.7]
    urls = ["http://" + r.choice(("", "c.", "b.", "xa.")) + r.choice(("net", "a.net", "org", "anet")) + r.choice(("", "/", "/x", "/xz/y", "/x/y/z", "/X")) + r.choice(("", "?q", "#f")) for _ in range(300)]
    found = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), spark.createDataFrame(rules, url_filter.RULE_SCHEMA)).collect()
    for row in found:
        fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (row["host"] == h or row["host"].endswith("." + h)) and row["path"].startswith(p)]
        best = max(fits, default=(0, False, None, "allow"))
        assert (row["rule"], row["verdict"]) == best[2:]


def test_an_expression_of_very_many_urls(spark, monkeypatch):
    """A third of all pages below one suffix: the expression meets the rules once, and all its pages get the verdict."""
    monkeypatch.setattr(url_filter, "FEW_SHAPES", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "SMALL", 20)
    urls = [f"http://h{k}.{'com' if k % 3 == 0 else 'net' if k % 3 == 1 else f'x{k}.org'}/p{k % 7}" for k in range(900)]
    rules = [("com", "/", "block"), ("h3.com", "/p3", "allow"), ("net", "/p1", "block"), *((f"x{k}.org", "/", "block") for k in range(2, 90, 3))]
    found = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), spark.createDataFrame(rules, url_filter.RULE_SCHEMA))
    for row in found.collect():
        fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (row["host"] == h or row["host"].endswith("." + h)) and row["path"].startswith(p)]
        assert (row["rule"], row["verdict"]) == max(fits, default=(0, False, None, "allow"))[2:]
    assert found.count() == 900


def test_components_by_union_find(spark):
    r = random.Random(8)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2060)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    found = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {x: find(x) for x in parent if find(x) != x}


def _copies(seed, groups, size, template=60, most=12):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(template)]
        for _ in range(size):
            own = list(base)
            for _ in range(r.randrange(most)):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize(("groups", "size", "short"), [(8, 12, near_duplicates.SHORT_LIST), (2, 70, near_duplicates.SHORT_LIST), (3, 40, 4)])
def test_near_duplicates_by_brute_force(spark, documents, monkeypatch, groups, size, short):
    monkeypatch.setattr(near_duplicates, "SHORT_LIST", short)
    texts = _copies(groups, groups, size) + ["alone in the world of words here"] * 3
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    found = near_duplicates.near_duplicates(documents([(k, t, "s") for k, t in enumerate(texts)]).repartition(5)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {k: find(k) for k in range(len(texts))}
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (find(r["doc_id"]) == r["doc_id"]) for r in found)


def _classes_of(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["component_id"], set()).add(r["doc_id"])
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("share", [0.0, 0.05])
def test_links_at_the_threshold(documents, share):
    """Pairs of random sets whose similarity is 0.75 or just above: all are found, as by the exact way."""
    r = random.Random(9)
    rows, expected = [], 0
    for k in range(150):
        n = r.choice((20, 60, 200))
        same = math.ceil((0.75 + share) * 2 * n / 1.75)
        words = [f"p{k}w{i}" for i in range(n + 4)]
        # texts share their first shingles and go on with words of their own
        cut = same + 4
        rows += [(2 * k, " ".join(words[:cut] + [f"x{k}y{i}" for i in range(n + 4 - cut)]), "s"), (2 * k + 1, " ".join(words[:cut] + [f"z{k}y{i}" for i in range(n + 4 - cut)]), "s")]
        expected += 100 * same >= 75 * (2 * n - same)
    docs = documents(rows)
    found = near_duplicates.near_duplicates(docs).collect()
    assert sum(not r["kept"] for r in found) == expected == 150
    assert _classes_of(near_duplicates.near_duplicates(docs, exact=True).collect()) == _classes_of(found)


def test_rows_that_share_an_id(spark):
    a, b, c = ("one two three four five six seven", "other words stand here in this row now", "and a third text with words of its own")
    rows = [(1, a), (1, b), (3, b), (3, b), (4, c), (4, None), (4, None), (None, b)]
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    seen = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"], r["chosen"]) for r in found.collect()), key=str)
    assert seen == sorted([(1, 3, 1, True, True), (1, 4, 1, True, True), *[(3, 4, 1, False, False)] * 2, (4, 5, 4, True, True), *[(4, 0, 4, True, True)] * 2, (None, 4, None, True, True)], key=str)


def test_pipeline_keeps_a_row_of_every_text(spark):
    import corpus_pipeline

    a, b = "one two three four five six seven", "other words stand here in this row now"
    docs = spark.createDataFrame([(1, a, "x"), (1, b, "y"), (3, b, "z"), (1, a, "w"), (5, None, None), (5, None, None)], "doc_id bigint, text string, text_hash string")
    rows = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert rows.columns == docs.columns and sorted(map(str, rows.collect())) == sorted(map(str, [r for r in docs.collect() if r["text_hash"] in ("w", "y")] + docs.where("doc_id = 5").limit(1).collect()))


def test_shingles_of_fewer_words(documents):
    rows = {r["doc_id"]: r for r in near_duplicates.near_duplicates(documents([(1, "One two", "s"), (2, "one  TWO\n", "s"), (3, "one two three", "s"), (4, "é", "s"), (5, "É", "s")])).collect()}
    assert [rows[k]["component_id"] for k in range(1, 6)] == [1, 1, 3, 4, 5] and rows[1]["n_shingles"] == 1


def _repeated(words):
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    return len({k + i for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for i in range(8)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_words(words):
    assert line_rules.repeated_words(words) == _repeated(words)


def test_text_counts():
    raw = "a é #$ b\nx y\n\nx y\n \n<z>".encode()
    assert line_rules.text_counts(raw) == (9, 12, 4, 1, 0)


def test_line_frequency(documents):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(k, f"Common  LINE number {k % 7} here\n{words(k, 30)}", "h1") for k in range(20)] + [(100, f"{words(100, 12)}\n" + "common line number 3 here\n" * 30, "h1"), (101, "common line number 3 here\n" + words(101, 25), "h2")]
    found = {r["doc_id"]: r for r in line_rules.judge(documents(rows)).collect()}
    assert all(found[k]["removed_words"] == 5 and found[k]["kept"] for k in range(20))
    assert found[100]["removed_words"] == 150 and not found[100]["kept"] and found[101]["removed_words"] == 0


def test_lines_of_a_large_host(documents, monkeypatch):
    """A line in many documents goes, though it is in a small share of its host's; whichever way lines are joined."""
    letters = lambda k: "".join(chr(97 + int(c)) for c in str(k))  # noqa: E731  digits count alike
    rows = [(k, " ".join(f"{letters(k)}x{letters(i)}" for i in range(30)) + ("\nshared line" if k < 16 else "\nrare line" if k < 30 else ""), "big") for k in range(3000)]
    docs = documents(rows)
    found = {r["doc_id"]: r["removed_words"] for r in line_rules.judge(docs, many_docs=15).collect()}
    assert {k for k, n in found.items() if n == 2} == set(range(16)) and sum(found.values()) == 32
    monkeypatch.setattr(line_rules, "BROADCAST_LINES", 0)
    monkeypatch.setattr(line_rules, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 12)
    monkeypatch.setattr(common, "SMALL", 12)
    assert {r["doc_id"]: r["removed_words"] for r in line_rules.judge(docs, many_docs=15).collect()} == found


def _auc(y, s):
    order = np.argsort(np.argsort(s))
    y = np.asarray(y)
    ones = (y == 1).sum()
    return (order[y == 1].sum() - ones * (ones - 1) / 2) / max(1, ones * (len(y) - ones))


@pytest.mark.parametrize(("name", "label", "least"), [("op2_toxicity", "toxic", 0.8), ("op5_quality_classifier", "quality", 0.95)])
def test_classifiers_on_held_out_rows(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    rows = catalog.queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert _auc([r[label] for r in rows], [r["score"] for r in rows]) >= least
    remainder = {"op2_toxicity": (5, 0), "op5_quality_classifier": (3, 1)}[name]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % remainder[0] == remainder[1] for r in rows)


def test_language_sample_counts_copies_once(spark, monkeypatch):
    rows = [(f"teksti numero {k % 25} on juuri", "fi") for k in range(5000)] + [(f"text number {k} is here", "en") for k in range(60)]
    monkeypatch.setattr(language_id, "train", lambda x, langs: (len(x), Counter(langs))[1])
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert language_id.fit(docs) == {"fi": 25, "en": 60}
    assert all(language_id.fit(docs.where(F.abs(F.hash("text")) % 7 == k), per_language=1).keys() == {"fi", "en"} for k in range(3))


def test_languages_on_held_out_rows(spark):
    rows = catalog.queries()["op8_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_scores_beat_the_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: r for r in catalog.queries()["op7_lm_scoring"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    counts: Counter = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*lm_scoring.tokens_of(t), b" "])
    total, distinct = sum(counts.values()), len(counts)
    for i, t in texts.items():
        tokens = [*lm_scoring.tokens_of(t), b" "]
        assert rows[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens))
        assert (rows[i]["n_tokens"], rows[i]["n_known"], rows[i]["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_tail_words_are_joined(spark, documents, monkeypatch):
    """The same scores whether counts are broadcast or joined."""
    docs = documents([(k, t, "s") for k, t in enumerate(_copies(3, 2, 5))])
    whole = {r["doc_id"]: r for r in lm_scoring.score(docs, docs).collect()}
    monkeypatch.setattr(lm_scoring, "HEAD", 3)
    part = {r["doc_id"]: r for r in lm_scoring.score(docs, docs).collect()}
    assert all(part[k]["base_score"] == pytest.approx(whole[k]["base_score"]) and part[k]["n_known"] == whole[k]["n_known"] for k in whole)


def test_remainder(spark):
    rows = spark.range(50).select("id", common.remainder(F.col("id"), 5).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)
    assert language_id.family_of("pt-BR") == "romance" and language_id.family_of("zz") == "other"


def test_pipeline_by_its_stages(spark):
    """Rows of the pipeline at the smallest size against plain set operations."""
    import corpus_pipeline

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    toxic = {r["doc_id"] for r in catalog.queries()["op2_toxicity"](spark, SF).where("predicted = 1").collect()}
    left = {k: v for k, v in docs.items() if k not in toxic}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in ((k, t.encode().lower().split()) for k, t in left.items()) if w}
    parent = {k: k for k in left}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    left = {k: v for k, v in left.items() if find(k) == k}
    items = [decontamination.words_of(r["text"].encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        words = decontamination.words_of(text.encode())
        return any(decontamination.edit_row(*(np.array([hash(x) for x in v]) for v in (item, words)), True).min() <= decontamination.edit_limit(len(item)) for item in items)

    assert set(out) == {k for k, v in left.items() if not leaks(v)}
    assert all(r["round_trip"] and (r["text"] == docs[k] or secret_scan.MASK in r["text"]) and r["n_chars"] == len(r["text"]) for k, r in out.items())


def test_coded_in_one_pass(spark, odd, vocabulary):
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(odd, vocabulary), vocabulary)
    one = sentencepiece_codec.coded(odd)
    assert one.columns == both.columns and sorted(map(str, one.collect())) == sorted(map(str, both.collect()))
