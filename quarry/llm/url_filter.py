"""URL filter: host-suffix and path-prefix expressions, short hash prefixes, full digests.

A rule is ``host`` + ``path`` + ``verdict``. It fits a URL whose host is the rule's host
or one of its subdomains and whose path starts with the rule's path. Every URL is
expanded into the expressions a rule could have (each host suffix at a label
boundary, with each path prefix of a length that occurs among the rules); expression
and rule meet in an equi-join on the first bytes of their SHA-256 digest, the full digest
confirms the hit, and the longest rule wins.

Only DataFrame functions are used. Defined results:

* null URL, or one without ``://``: host and path are empty and no rule fits;
* no rule fits (or the rule table is empty): ``rule`` is null, the verdict is ``default``;
* repeated URLs and repeated rows are judged each on their own, row for row;
* rules with a null host or path are ignored; of two rules with the same host and path
  ``allow`` wins over ``block``; of two rules of equal length the longer host wins;
* other columns of the input are kept; its columns named host, path, rule or verdict are
  replaced by the operator's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stored, table

#: Hex digits of the digest that the join compares before the full digest does.
PREFIX_HEX = 8
#: Rule tables of up to so many rows (about 200 bytes each) are broadcast; larger ones shuffle.
BROADCAST_RULES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules given as (host, path, verdict) tuples, as a table of literals."""
    row = lambda r: F.struct(*[F.lit(v).alias(c) for v, c in zip(r, ("host", "path", "verdict"))])
    return spark.range(1).select(F.inline(F.array(*[row(r) for r in rules])))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host, path, rule, verdict`` to every row of ``pages``."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    book = (
        rules.where("host is not null and path is not null")
        .groupBy(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.min("verdict").alias("r_verdict"))
        .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("r_key", F.substring("r_digest", 1, PREFIX_HEX))
    )
    # one row: how long the rules' paths are, and how many rules there are
    lengths, count = book.agg(F.sort_array(F.collect_set(F.length("r_path"))), F.count(F.lit(1))).first()
    rows = pages.select(*kept, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if not count:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    # Many pages share a host and the head of a path: judge each (host, path head) once. The
    # head is as long as the longest rule path, so no rule can tell two of its pages apart.
    head = F.substring("path", 1, max(lengths))
    heads = rows.where("host <> ''").select("host", head.alias("head")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("head")),
        lambda n: F.substring(F.col("head"), F.lit(1), n),
    )
    expressions = (
        heads.withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
    )
    book = F.broadcast(book) if count <= BROADCAST_RULES else book
    found = (
        expressions.join(book, F.substring("digest", 1, PREFIX_HEX) == F.col("r_key"))
        .where("digest = r_digest and suffix = r_host and prefix = r_path")
        .groupBy("host", "head")
        .agg(F.max(F.struct(
            (F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"),
            F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"),
        )).alias("best"))
        .select(F.col("host").alias("f_host"), F.col("head").alias("f_head"), "best.rule", "best.verdict")
    )
    # As a written table it is shuffled anew (if it isn't small), and the adaptive skew join
    # can split the rows of a host that holds a third of all pages.
    found = stored(found, "url-rules")
    return rows.join(found, (F.col("host") == F.col("f_host")) & (head == F.col("f_head")), "left").select(
        *kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rule_frame(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(r_host, r_path, r_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path, max_by(r_host || r_path, length(r_host || r_path)) AS rule,
  coalesce(max_by(r_verdict, length(r_host || r_path)), 'allow') AS verdict
FROM u LEFT JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
GROUP BY page_id, host, path
"""
