"""URL filters: host-suffix and path-prefix expressions against hashed rules (DataFrame functions only).

Each url is expanded, where it is read, into its host suffixes of the numbers of labels that rules
have, times its path prefixes of the lengths that rules have; expressions meet rules in an equi-join on
a short prefix of the SHA-256 digest, full digests confirm, and the longest rule wins (ties: longer
host, then block, then text). Rows are named by their place in the table, so no group is larger than
the expressions of one url, and what is shuffled is a row for each url. The rules are broadcast only
when counted small; otherwise both sides are shuffled, with the urls' side salted so that an expression
that most urls share is dealt over many tasks.

Defined cases: null urls and urls without ``://`` have empty host and path, fit no rule and get the
default verdict; null page ids stay null; repeated rows stay repeated; an empty rule table leaves
every url to the default; a url of any length takes time in proportion to it, and is expanded into no
more expressions than rules allow; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DEFAULT = "allow"
SHORT = 8
SALTS = 32


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, verdict string")


def split_url(url):
    """(host, path) columns of a url."""
    rest = F.coalesce(F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))), F.lit(""))
    bare = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(bare, r"(?s)^([^/]*)", 1)
    return ascii_lower(host), F.substring(bare, F.length(host) + F.lit(1), F.length(bare))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, broadcast_rules: int = 200_000) -> DataFrame:
    """page_id, host, path, rule, verdict of each page row."""
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host.alias("host"), path.alias("path"))
    text = F.concat("rule_host", "rule_path")
    known = rules.filter("rule_host is not null and rule_path is not null and verdict is not null").select(
        text.alias("rule"), "verdict", F.length("rule_host").alias("host_len"), F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256).alias("digest"),
        F.length("rule_path").alias("path_len"), F.size(F.split("rule_host", r"\.")).alias("labels"),
    )
    lengths, labels = ([r[0] for r in known.select(c).distinct().collect()] for c in ("path_len", "labels"))  # numbers, not rules: bounded by the longest path and host
    none = F.lit(-1)
    own = F.split("host", r"\.")
    suffixes = F.transform(F.filter(F.array(*[F.lit(int(n)) for n in labels] or [none]), lambda n: (n >= 1) & (n <= F.size("own"))), lambda n: F.concat_ws(".", F.slice("own", F.size("own") - n + 1, n)))
    prefixes = F.transform(F.filter(F.array(*[F.lit(int(n)) for n in lengths] or [none]), lambda n: (n >= 0) & (n <= F.length("path"))), lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))
    asked = rows.withColumn("own", own).withColumn("expression", F.explode_outer(pairs))
    digest = F.sha2("expression", 256)
    asked = asked.select("row", "page_id", "host", "path", digest.alias("asked"), F.substring(digest, 1, SHORT).alias("short"))
    known = known.withColumn("short", F.substring("digest", 1, SHORT)).drop("path_len", "labels")
    if known.limit(broadcast_rules + 1).count() <= broadcast_rules:
        met = asked.join(F.broadcast(known), "short", "left")
    else:
        salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
        met = asked.withColumn("salt", salt).join(known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["short", "salt"], "left")
    fits = F.col("digest") == F.col("asked")
    rank = F.struct(F.length("rule").alias("n"), F.col("host_len"), (F.col("verdict") == "block").alias("b"), F.col("rule"), F.col("verdict"))
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(F.when(fits, rank)).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, regexp_extract(rest, '^([^?#]*)', 1) AS bare FROM u),
w AS (SELECT page_id, bare, regexp_extract(bare, '^([^/]*)', 1) AS raw FROM v),
x AS (SELECT row_number() OVER () AS rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(bare, length(raw) + 1) AS path FROM w),
r(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT rid, h || p AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, length(h) DESC, verdict DESC, h || p DESC) AS k
      FROM x JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM x LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (rid)
"""
