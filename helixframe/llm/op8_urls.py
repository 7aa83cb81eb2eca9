"""URL filter: a blocked Bloom filter in front of an exact hash join.

A listed URL is canonical: scheme, ``www.``/``m.`` prefix, port, user, query,
fragment, trailing slash and ``.html`` are gone.  The list is turned into a split
block Bloom filter: a table (block, w0..w7) of 512-bit blocks, built by ``bit_or``.
A page's canonical URL touches one block; only possible hits go on to the exact
join with the list, which removes the false positives.  The filter is a table that
is joined by block: below ``BROADCAST_BYTES`` (its size is known from the count of
the list) it is broadcast, beyond it is an ordinary shuffled join.

Defined cases: null URL or one without ``://`` has empty host and path, fits no
rule, is on no list, verdict allow.  Repeated rows are judged alike; further
columns of the input are ignored; an empty list or table gives no hit.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import ascii_lower

# Fixed values of the rule set: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
BITS_PER_URL = 16
BROADCAST_BYTES = 16 << 20
WORDS = 8


def parsed(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path (both empty for a null URL or one without ``://``)."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.col(url).substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (urls.withColumn("_rest", rest)
            .withColumn("host", ascii_lower(F.regexp_extract("_rest", r"(?s)^([^/?#]*)", 1)))
            .withColumn("path", F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1)).drop("_rest"))


def canonical(host: Column, path: Column) -> Column:
    h = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":[0-9]*$", "")
    h = F.regexp_replace(h, r"^(?:www|m)\.", "")
    return F.concat(h, F.regexp_replace(path, r"(?:\.html?)?/*$", ""))


def judged_by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  ``rules`` is a short list given by the caller."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):  # the longest is outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _block(c: str, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(c)), F.lit(n_blocks)).alias("block")


def _bits(c: str) -> list[Column]:
    """One bit in each of the block's eight 64-bit words, from a second hash."""
    h = F.xxhash64(F.lit("bits"), F.col(c))
    return [F.shiftright(h, 6 * w).bitwiseAND(F.lit(63)).cast("int").alias(f"b{w}") for w in range(WORDS)]


def bloom_table(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    keyed = listed.select(_block(key, n_blocks), *_bits(key))
    return keyed.groupBy("block").agg(*[F.expr(f"bit_or(shiftleft(1L, b{w}))").alias(f"w{w}") for w in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, key: str = "canon", rules=RULES) -> DataFrame:
    """``pages`` with host, path and canon judged against the list: adds rule, listed (boolean), verdict."""
    listed = listed.select(F.col(key).alias("canon")).where("canon is not null and canon <> ''").distinct()
    n = listed.count()
    n_blocks = max(1, -(-n * BITS_PER_URL // 512))
    table = bloom_table(listed, "canon", n_blocks)
    if n_blocks * (WORDS + 1) * 8 <= BROADCAST_BYTES:
        table = F.broadcast(table)
    rule, verdict = judged_by_rule(F.col("host"), F.col("path"), rules)
    keyed = pages.select("*", _block("canon", n_blocks), *_bits("canon")).join(table, "block", "left")
    may = F.lit(True)
    for w in range(WORDS):
        may = may & F.expr(f"(shiftright(w{w}, b{w}) & 1L) = 1L")
    keyed = keyed.withColumn("_may", F.coalesce(may, F.lit(False))).select(*pages.columns, "_may")
    hits = keyed.where("_may").join(listed.withColumn("_on", F.lit(True)), "canon", "left")
    passed = keyed.where("not _may").withColumn("_on", F.lit(False))
    both = hits.select(*passed.columns).unionAll(passed)
    return (both.withColumn("listed", F.coalesce("_on", F.lit(False)))
            .withColumn("rule", rule)
            .withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")))
            .drop("_may", "_on"))


# Words in a host that put its pages on the list (a caller with a feed passes that instead).
LISTED_HOSTS = ["casino", "pills", "bets", "spam", "adult"]


def query(spark, pages: DataFrame) -> DataFrame:
    """Contract columns for the whole table; the list: canonical URLs of all pages on hosts with a listed word."""
    p = parsed(pages.select("page_id", F.col("url").alias("url")))
    p = p.withColumn("canon", canonical(F.col("host"), F.col("path"))).drop("url")
    words = F.lit(False)
    for x in LISTED_HOSTS:
        words = words | F.col("host").contains(x)
    out = filter_urls(p, p.where(words), "canon")
    return out.select("page_id", "host", "path", "rule", "verdict", "listed")


ORACLE = """
WITH r AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
c AS (SELECT *, concat(regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*$', ''), '^(?:www|m)\\.', ''),
      regexp_replace(path, '(?:\\.html?)?/*$', '')) AS canon FROM p),
l AS (SELECT DISTINCT canon FROM c WHERE canon <> '' AND (host LIKE '%casino%' OR host LIKE '%pills%' OR host LIKE '%bets%' OR host LIKE '%spam%' OR host LIKE '%adult%')),
j AS (SELECT c.*, l.canon IS NOT NULL AS listed,
      host = 'org' OR host LIKE '%.org' AS o, host = 'example.org' OR host LIKE '%.example.org' AS eo, host = 'com' OR host LIKE '%.com' AS co
      FROM c LEFT JOIN l ON c.canon = l.canon),
k AS (SELECT page_id, host, path, listed, CASE WHEN eo AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN eo AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN co AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN co AND starts_with(path, '/de/') THEN 'com/de/' WHEN o AND starts_with(path, '/') THEN 'org/' END AS rule FROM j)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM k
"""
