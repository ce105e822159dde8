"""Secret scan: patterns find candidates, a random forest removes false alarms.

One regular expression finds candidates: well-known key formats, private key
blocks, values assigned to names like ``password``, and other long tokens that
mix letters and digits. The forest judges each by its length, its transitions
between kinds of characters, the share that dictionary fragments cover, the
path it was found in and the words around it. Trees are grown in numpy on the
driver from labelled findings and compiled to SQL, so scanning and redaction
are DataFrame expressions from end to end.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import table

# Public key formats and the names that secrets are assigned to.
_FORMATS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    r"gh[pousr]_[0-9A-Za-z]{36,}+",
    r"xox[abprs]-[0-9A-Za-z-]{10,}+",
    r"sk-[0-9A-Za-z_-]{20,}+",
    r"AIza[0-9A-Za-z_-]{35}",
    r"eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+",
)
_PEM = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
_NAMES = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key)"
_ASSIGNED = _NAMES + r"""["']?[ \t]{0,4}[=:][ \t]{0,4}["']?[^\s"'<>]{6,}+"""
_TOKEN = r"(?<![0-9A-Za-z+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[0-9A-Za-z+/_-]{20,}+={0,2}"
PATTERN = "|".join([_PEM, *(r"(?<![0-9A-Za-z])" + f for f in _FORMATS), _ASSIGNED, _TOKEN])
_KNOWN = "^(?:" + "|".join([_PEM, *_FORMATS]) + ")$"
_HEAD = "^" + _NAMES + r"""["']?[ \t]{0,4}[=:][ \t]{0,4}["']?"""

# Fragments of common English words, for the dictionary coverage.
_DICTIONARY = (
    "the and for with that this from have not are was you all can has will one about out time there year when them some people than other "
    "work first well way even new want any give day most down over think also back after use two how our come its look only know into good "
    "user name test example sample value string number data file path index type size list key code page line text word home main item "
    "change place holder your here default null none true false secret password token admin login http www com org net html image version"
).split()
_AROUND = 48
MASK = "[SECRET]"
#: A candidate at or above this is a secret.
THRESHOLD = 0.5

FINDINGS = "found string, before string, after string, path string, label int, family string"
FEATURES = ("length", "transitions", "digits", "distinct", "coverage", "hexadecimal", "known", "assigned", "slashes", "path_test", "near_secret", "near_harmless")
TREES, DEPTH, LEAST_LEAF = 15, 6, 5
#: Labelled findings to learn from, at most.
SAMPLE_FINDINGS = 20_000
#: Candidates whose places are added up at a time.
CHUNK = 256


def _q(text: str) -> str:
    return "r'" + text.replace("'", r"\x27") + "'"


def _share(value: str, pattern: str) -> str:
    return f"(1 - char_length(regexp_replace({value}, {_q(pattern)}, '')) / greatest(char_length({value}), 1))"


def _classes(value: str) -> str:
    """value with each character replaced by its kind, runs shortened to one."""
    kinds = f"translate({value}, '{string.ascii_lowercase}{string.ascii_uppercase}{string.digits}', '{'a' * 26}{'A' * 26}{'0' * 10}')"
    return f"regexp_replace({kinds}, {_q(r'(.)\1+')}, '$1')"


def _features(found: str, before: str, after: str, path: str) -> str:
    """SQL struct of FEATURES for a candidate and its neighbourhood."""
    value = f"regexp_replace({found}, {_q(_HEAD)}, '')"
    near = f"lower(concat({before}, ' ', {after}))"
    parts = {
        "length": f"char_length({value})",
        "transitions": f"char_length({_classes(value)}) / greatest(char_length({value}), 1)",
        "digits": _share(value, "[0-9]"),
        "distinct": f"size(array_distinct(split(substring({value}, 1, 64), ''))) / greatest(least(char_length({value}), 64), 1)",
        "coverage": _share(f"lower({value})", "(?:" + "|".join(sorted(set(_DICTIONARY), key=lambda w: (-len(w), w))) + ")"),
        "hexadecimal": f"if({value} rlike '^[0-9a-f]+$', 1, 0)",
        "known": f"if({found} rlike {_q(_KNOWN)}, 1, 0)",
        "assigned": f"if({found} rlike {_q(_HEAD)}, 1, 0)",
        "slashes": f"char_length({value}) - char_length(replace({value}, '/', ''))",
        "path_test": f"if(lower({path}) rlike '(test|example|sample|fixture|mock|doc)', 1, 0)",
        "near_secret": f"if({near} rlike '(secret|token|password|credential|api.?key|private|auth|bearer|login)', 1, 0)",
        "near_harmless": f"if({near} rlike '(commit|sha|md5|checksum|digest|hash|uuid|revision|build|etag|https?:|www[.]|[.]html)', 1, 0)",
    }
    return "named_struct(" + ", ".join(f"'{n}', double({parts[n]})" for n in FEATURES) + ")"


def labelled_findings(n: int = 3000, seed: int = 5) -> list[tuple[str, str, str, str, int, str]]:
    """(found, before, after, path, label, family): drawn from public formats and usual false alarms.

    A family is a template; tests hold whole families out.
    """
    r = random.Random(seed)
    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    hexa, alnum, lower = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_lowercase
    words = lambda k, sep="": sep.join(r.choice(_DICTIONARY) for _ in range(k))
    syllables = lambda k: "".join(r.choice("bcdfghlmnprst") + r.choice("aeiou") for _ in range(k))
    prose = lambda: " ".join(syllables(r.randint(1, 4)) for _ in range(r.randint(3, 9))) + " "
    name = lambda: r.choice(("password", "passwd", "secret", "token", "api_key", "access_key", "API_KEY", "Password"))
    head = lambda: name() + r.choice(("=", " = ", ": ", ' = "', "='", '": "'))
    paths = ("", "app/config.py", "site/settings.env", "deploy.yml", "notes", "server/auth.go")
    quiet = ("tests/fixtures/a.py", "docs/example.md", "sample/mock.json")
    real = {
        "cloud_key": lambda: ("AKIA" + pick(string.ascii_uppercase + "234567", 16), prose()),
        "forge_token": lambda: ("ghp_" + pick(alnum, 36), prose()),
        "service_key": lambda: ("sk-" + pick(alnum, 40), prose()),
        "chat_token": lambda: ("xoxb-" + pick(alnum + "-", 30), prose()),
        "web_token": lambda: ("eyJ" + pick(alnum, 30) + "." + pick(alnum, 60) + "." + pick(alnum, 40), prose() + "bearer "),
        "assigned_hex": lambda: (head() + pick(hexa, 2 * r.randint(8, 40)), prose()),
        "assigned_token": lambda: (head() + pick(alnum, r.randint(10, 48)), prose()),
        "assigned_password": lambda: (head() + pick(alnum + "!@#$%*", r.randint(8, 20)), prose()),
        "named_token": lambda: (pick(alnum, r.randint(24, 60)), prose() + r.choice(("api key ", "credential ", "token is ", "private "))),
        "private_key": lambda: ("-----BEGIN RSA PRIVATE KEY-----\n" + pick(alnum + "+/", 200) + "\n-----END RSA PRIVATE KEY-----", prose()),
    }
    false = {
        "checksum": lambda: (pick(hexa, r.choice((32, 40, 64))), prose() + r.choice(("commit ", "md5 ", "checksum ", "sha1: ", "revision ", ""))),
        "slug": lambda: (words(r.randint(4, 8), "-") + str(r.randint(1, 99)), prose()),
        "identifier": lambda: (words(r.randint(4, 8), "_") + str(r.randint(1, 9999)), prose()),
        "long_word": lambda: (syllables(r.randint(10, 16)) + str(r.randint(1, 99)), prose()),
        "address": lambda: (words(r.randint(3, 6), "/") + "/" + str(r.randint(1, 9999)), prose() + r.choice(("https:", "www.", ""))),
        "assigned_words": lambda: (head() + r.choice(("", "your_")) + words(r.randint(1, 3), r.choice(("", "_", "-"))), prose()),
        "placeholder": lambda: (head() + r.choice(("xxxxxxxx", "********", "changeme", "password", "${SECRET}", "os.environ", "example", "placeholder")), prose()),
        "assigned_prose": lambda: (head() + syllables(r.randint(3, 7)), prose()),
        "uuid": lambda: ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), prose() + r.choice(("uuid ", "build ", ""))),
        "padded_number": lambda: (pick(string.digits, r.randint(12, 18)) + pick(lower, 1) * r.randint(8, 12), prose()),
    }
    rows = []
    for k in range(n):
        label = k % 2
        family, make = r.choice(list((real if label else false).items()))
        found, before = make()
        rows.append((found, before, " " + prose(), r.choice(paths if label or r.random() < 0.7 else quiet), label, family))
    return rows


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator):
    """A tree as (feature, cut, low, high), a leaf as the share of label 1."""
    if depth == 0 or len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return float((y.sum() + 0.5) / (len(y) + 1))
    best = None
    for f in rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5) + 1), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        n = np.arange(1, len(t))
        ones = np.cumsum(t)[:-1]
        p, q = ones / n, (t.sum() - ones) / (len(t) - n)
        impurity = n * p * (1 - p) + (len(t) - n) * q * (1 - q)
        impurity[(v[1:] == v[:-1]) | (n < LEAST_LEAF) | (len(t) - n < LEAST_LEAF)] = np.inf
        if len(impurity) and np.isfinite(impurity.min()) and (best is None or impurity.min() < best[0]):
            k = int(impurity.argmin())
            best = (impurity[k], int(f), float((v[k] + v[k + 1]) / 2))
    if best is None:
        return float((y.sum() + 0.5) / (len(y) + 1))
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, _grow(x[low], y[low], depth - 1, rng), _grow(x[~low], y[~low], depth - 1, rng)


def _tree_sql(tree, row: str) -> str:
    if isinstance(tree, float):
        return f"{tree:.6f}D"
    f, cut, low, high = tree
    return f"if({row}.{FEATURES[f]} <= {cut!r}D, {_tree_sql(low, row)}, {_tree_sql(high, row)})"


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 9, bound: int = SAMPLE_FINDINGS) -> list:
    """A forest from at most ``bound`` labelled findings (found, before, after, path, label).

    Null texts count as empty; findings without a label are left out. Without any
    the forest is empty and every score 0.
    """
    findings = findings.where(F.col("label").isNotNull()).select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("found", "before", "after", "path")), "label")
    findings = findings.orderBy(F.xxhash64("found", "before", "after", "path", "label")).limit(bound)
    rows = findings.selectExpr(f"{_features('found', 'before', 'after', 'path')} AS f", "label").collect()
    if not rows:
        return []
    x, y = np.array([list(r["f"]) for r in rows], float), np.array([r["label"] for r in rows], float)
    rng = np.random.default_rng(seed)
    picks = [rng.integers(0, len(y), len(y)) for _ in range(trees)]
    return [_grow(x[p], y[p], depth, rng) for p in picks]


def default_forest(spark) -> list:
    """The forest of ``labelled_findings``, for want of a labelled table."""
    return train_forest(spark.createDataFrame(labelled_findings(), FINDINGS))


def _scored(docs: DataFrame, forest: list, text: str, path: str) -> tuple[DataFrame, dict[str, str]]:
    """(rows, names): docs under names of our own, with gaps (one more than candidates) and found: candidates with score."""
    names = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    source = f"coalesce({names[path]}, '')" if path in names else "''"
    total = " + ".join(_tree_sql(t, "f") for t in forest) or "0D"
    features = _features("hit", f"right(gaps[i], {_AROUND})", f"left(gaps[i + 1], {_AROUND})", source)
    rows = (
        docs.toDF(*names.values())
        .withColumn("whole", F.coalesce(F.col(names[text]).cast("string"), F.lit("")))
        .withColumn("hits", F.expr(f"regexp_extract_all(whole, {_q(PATTERN)}, 0)"))
        .withColumn("gaps", F.expr(f"if(size(hits) > 0, split(whole, {_q(PATTERN)}, -1), array(whole))"))
        .withColumn("seen", F.expr(f"transform(hits, (hit, i) -> named_struct('hit', hit, 'f', {features}))"))
        .withColumn("found", F.expr(f"transform(seen, s -> named_struct('hit', s.hit, 'score', transform(array(s.f), f -> ({total}) / {max(1, len(forest))})[0]))"))
        .drop("seen", "hits", "whole")
    )
    return rows, names


def _starts() -> str:
    """SQL array of where candidates start: all gaps and candidates before each, added up chunk by chunk."""
    added = lambda array: f"aggregate({array}, 0L, (total, w) -> total + w)"
    parts = f"transform(sequence(0, int(ceil(size(found) / {CHUNK})) - 1), c -> slice(widths, c * {CHUNK} + 1, {CHUNK}))"
    before = added("slice(sums, 1, k)")
    inner = f"transform(part, (w, i) -> before + {added('slice(part, 1, i)')} + w - lengths[k * {CHUNK} + i])"
    one = f"transform(array({before}), before -> {inner})[0]"
    body = f"flatten(transform(parts, (part, k) -> {one}))"
    body = f"transform(array(transform(parts, part -> {added('part')})), sums -> {body})[0]"
    body = f"transform(array({parts}), parts -> {body})[0]"
    body = f"transform(array(transform(found, (x, i) -> bigint(char_length(gaps[i]) + char_length(x.hit)))), widths -> {body})[0]"
    return f"transform(array(transform(found, x -> char_length(x.hit))), lengths -> {body})[0]"


def findings(docs: DataFrame, forest: list, text: str = "text", path: str = "source", key: str = "doc_id") -> DataFrame:
    """(doc_id, start, length, found, score, secret): one row for each candidate.

    start counts characters from 0. Null and empty texts have no candidate; long
    ones are scanned as a whole. Candidates do not overlap: of two that could, the
    one that begins first counts, of two that begin together the one whose pattern
    stands first. Repeated rows give their findings once each; an empty table has
    none. A score of exactly THRESHOLD is a secret. Columns of docs may have any
    names.
    """
    rows, names = _scored(docs, forest, text, path)
    rows = rows.where(F.size("found") > 0).select(names[key], "found", F.expr(_starts()).alias("starts"))
    rows = rows.select(F.col(names[key]).alias(key), F.explode(F.arrays_zip("found", "starts")).alias("x"))
    found, score = F.col("x.found.hit"), F.col("x.found.score")
    return rows.select(
        key, F.col("x.starts").alias("start"), F.char_length(found).alias("length"), found.alias("found"), score.alias("score"), (score >= THRESHOLD).alias("secret")
    )


def _masked(found: str) -> str:
    """A finding with its secret part masked; the name it is assigned to stays."""
    return f"concat(regexp_extract({found}, {_q(_HEAD)}, 0), '{MASK}')"


def redact(docs: DataFrame, forest: list, text: str = "text", path: str = "source") -> DataFrame:
    """docs with secrets in the text masked, and ``n_secrets``; null texts stay null.

    All else in a text stays as it is, rejected candidates included. Long texts,
    ties and candidates that could overlap are treated as ``findings`` says.
    Repeated rows keep a row each; an empty table has none. A column named
    n_secrets is replaced; others may have any names.
    """
    docs = docs.drop("n_secrets")
    rows, names = _scored(docs, forest, text, path)
    n = F.expr(f"size(filter(found, x -> x.score >= {THRESHOLD}D))")
    masked = F.expr(
        f"array_join(transform(gaps, (gap, i) -> concat(gap, if(i < size(found), if(found[i].score >= {THRESHOLD}D, {_masked('found[i].hit')}, found[i].hit), ''))), '')"
    )
    own = {c: F.when(n > 0, masked).otherwise(F.col(new)) if c == text else F.col(new) for c, new in names.items()}
    return rows.select(*(value.alias(c) for c, value in own.items()), n.alias("n_secrets"))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every candidate of every document, with its place, score and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = findings(docs, default_forest(spark))
    return rows.select("doc_id", "start", "length", F.sha2(F.col("found").cast("binary"), 256).alias("found_sha256"), F.round("score", 6).alias("score"), "secret")
