"""URL filter: host-suffix and path-prefix expressions against hashed rules.

Each URL is expanded into the expressions that a rule could equal: the last
labels of its host times the first characters of its path. Only the label
counts and path lengths that some rule has are expanded, so no rule that fits
is missed and long URLs stay cheap. Expressions and rules are equi-joined on
the first 8 hex digits of their SHA-256, then confirmed by the whole digest.
DataFrame functions only.

Few rules are of few shapes (labels of the host, length of the path): then each
row has one expression a shape, which is joined with the broadcast rules of that
shape, and no page moves. Rules of many shapes judge each distinct URL once, and
only keys of very many pages are broadcast back to them.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, spread_join, table

#: (host, path, verdict)
DEFAULT_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
RULE_SCHEMA = "rule_host string, rule_path string, rule_verdict string"
#: Rules up to this many, and of this many characters on average, are broadcast; more are shuffled.
BROADCAST_RULES, RULE_CHARS = 200_000, 100
#: Shapes of rules that are joined one after another, without a shuffle.
FEW_SHAPES = 12
SHORT = 8
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def ascii_lower(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """Lower-cased host; empty for null or where ``://`` is missing."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _suffix(host: Column, labels: Column) -> Column:
    """The last labels of a host; null if it has fewer."""
    parts = F.split(host, r"\.")
    return F.when(F.size(parts) >= labels, F.array_join(F.slice(parts, F.size(parts) - labels + 1, labels), "."))


def _prefix(path: Column, length: Column) -> Column:
    """The first characters of a path; null if it has fewer."""
    return F.when(F.char_length(path) >= length, F.substring(path, F.lit(1), length))


def _verdict(rule: str = "_rule", verdict: str = "rule_verdict") -> Column:
    """What the better of two rules has more of: length, then block, then the name."""
    return F.struct(F.char_length(rule).alias("n"), (F.col(verdict) == "block").alias("block"), F.col(rule).alias("rule"), F.col(verdict).alias("verdict"))


def _by_shapes(urls: DataFrame, rules: DataFrame, shapes: list, few: bool) -> DataFrame:
    """urls (host, path, ...) with _best, by one broadcast join for each shape of rules."""
    found = []
    for k, (labels, length) in enumerate(shapes):
        own = rules.where((F.col("_labels") == labels) & (F.col("_length") == length))
        own = own.groupBy("_rule", "_digest").agg(F.max(_verdict()).alias(f"_best_{k}")).select(F.col("_digest").alias(f"_d{k}"), f"_best_{k}", F.substring("_digest", 1, SHORT).alias(f"_s{k}"))
        urls = urls.withColumn("_e", _digest(F.concat(_suffix(F.col("host"), F.lit(labels)), _prefix(F.col("path"), F.lit(length)))))
        urls = urls.join(F.broadcast(own), (F.substring("_e", 1, SHORT) == F.col(f"_s{k}")) & (F.col("_e") == F.col(f"_d{k}")), "left").drop("_e", f"_d{k}", f"_s{k}")
        found.append(f"_best_{k}")
    best = F.greatest(*found) if len(found) > 1 else F.col(found[0]) if found else F.lit(None).cast("struct<n:int,block:boolean,rule:string,verdict:string>")
    return urls.withColumn("_best", best).drop(*found)


def _by_urls(urls: DataFrame, rules: DataFrame, shapes: list, few: bool) -> DataFrame:
    """The same for rules of many shapes: each distinct URL is expanded once, each distinct expression meets the rules once.

    An expression like ``com/`` that very many URLs have is one row of that join, and
    what it found is broadcast back to them.
    """
    each = urls.groupBy("host", "path").agg(F.count("*").alias("members"))
    suffixes = F.transform(F.lit(sorted({n for n, _ in shapes})), lambda n: _suffix(F.col("host"), n))
    prefixes = F.transform(F.lit(sorted({n for _, n in shapes})), lambda n: _prefix(F.col("path"), n))
    expressions = (
        each.select("host", "path", F.explode(F.filter(suffixes, lambda x: x.isNotNull())).alias("_suffix"), prefixes.alias("_prefixes"))
        .select("host", "path", "_suffix", F.explode(F.filter("_prefixes", lambda x: x.isNotNull())).alias("_prefix"))
        .withColumn("_e", _digest(F.concat("_suffix", "_prefix")))
        .select("host", "path", "_e")
    )
    distinct = checkpointed(expressions.groupBy("_e").agg(F.count("*").alias("members")))
    short = F.substring("_e", 1, SHORT).alias("_short")
    own = rules.select("_rule", "rule_verdict", "_digest", F.substring("_digest", 1, SHORT).alias("_short"))
    hits = distinct.select("_e", "members", short).join(F.broadcast(own) if few else own, "_short").where(F.col("_e") == F.col("_digest"))
    hits = checkpointed(hits.groupBy("_e", "members").agg(F.max(_verdict()).alias("_best")))
    many = distinct.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    best = spread_join(expressions, hits, ["_e"], many).groupBy("host", "path").agg(F.max("_best").alias("_best"))
    total = urls.count()
    return spread_join(urls, each.join(best, ["host", "path"], "left"), ["host", "path"], total).drop("members")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict.

    The longest rule wins; of equal ones block, then the last by name; of two
    verdicts for one rule, block wins. URLs that no rule fits get ``default``.
    Null and malformed URLs have an empty host and path, which only a rule with an
    empty host could fit. Rules with a null host, path or verdict never fit; no
    rules give the default to all. Long URLs count as a whole. Repeated rows keep a
    row each, an empty table has none. Columns of pages named host, path, rule or
    verdict are replaced.
    """
    rules = rules.select(*(F.col(c).cast("string") for c in ("rule_host", "rule_path", "rule_verdict"))).dropna()
    rules = rules.select(
        F.concat("rule_host", "rule_path").alias("_rule"),
        "rule_verdict",
        F.size(F.split("rule_host", r"\.")).alias("_labels"),
        F.char_length("rule_path").alias("_length"),
    ).withColumn("_digest", _digest(F.col("_rule")))
    shapes = rules.groupBy("_labels", "_length").agg(F.count("*").alias("n"), F.sum(F.octet_length("_rule")).alias("size")).collect()  # labels times path lengths
    few = sum(r["n"] for r in shapes) <= BROADCAST_RULES and sum(r["size"] for r in shapes) <= BROADCAST_RULES * RULE_CHARS

    urls = pages.drop("host", "path", "rule", "verdict")
    own = {c: f"_{k}" for k, c in enumerate(urls.columns)}  # names of our own, whatever pages calls its columns
    address = F.col(f"`{own[url]}`")
    urls = urls.toDF(*own.values()).withColumns({"host": host_of(address), "path": path_of(address)})
    places = sorted((r["_labels"], r["_length"]) for r in shapes)
    judged = (_by_shapes if few and len(places) <= FEW_SHAPES else _by_urls)(urls, rules, places, few)
    kept = [F.col(new).alias(c) for c, new in own.items()]
    return judged.select(*kept, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every row of pages judged by the default rules."""
    rules = spark.createDataFrame(DEFAULT_RULES, RULE_SCHEMA)
    return filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), rules(rh, rp, rv) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best AS (
  SELECT host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS rv
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules
    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY host, path
)
SELECT page_id, p.host, p.path, b.rule, coalesce(b.rv, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""
