"""URL filters: rules on hosts and path prefixes, matched by hash-prefix joins.

As safe-browsing lists do it: each URL is expanded into expressions (every suffix of its host by every
path prefix of a length that some rule has), expressions meet rules in an equi-join on a short prefix of
their SHA-256, and the full digests confirm a match. The longest matching rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the digest that the join uses.
PREFIX = 4


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    """SHA-256 of an expression, its two parts told apart by a line feed."""
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256))


def prepared(rules: DataFrame) -> DataFrame:
    """Rules (verdict, host, path) with digest, its short prefix and the path's length; of equal rules a block outranks an allow."""
    keyed = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    digest = _key(F.col("host"), F.col("path"))
    return keyed.select(F.concat("host", "path").alias("rule"), "verdict", digest.alias("digest"), F.substring(digest, 1, PREFIX).alias("short"), F.length("path").alias("path_length"))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest rule
    (host and path together) wins, ties go to the greater string; without one, rule is null and the
    verdict is ``otherwise``. A null url, or one without ``://``, has an empty host and path and matches
    nothing but a rule of an empty host. Repeated rows are judged alike, URLs are read whole, and other
    columns of ``pages``, whatever their names, are left out. Empty tables give no row, or no rule.

    Distinct URLs are expanded once, however many rows have them. Path lengths of rules are read first:
    there are at most as many as the longest rule path has characters.
    """
    keyed = prepared(rules)
    lengths = sorted(r.path_length for r in keyed.select("path_length").distinct().collect())
    distinct = pages.where("url is not null").select(F.col("url").alias("known")).distinct().select("known", host(F.col("known")).alias("h"), path(F.col("known")).alias("p"))
    labels = F.split("h", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("p")), lambda n: F.substring(F.col("p"), F.lit(1), n))
    opened = distinct.where("h <> ''").select("known", F.explode(suffixes).alias("suffix"), "p").select("known", "suffix", F.explode(prefixes).alias("prefix"))
    digest = opened.select("known", _key(F.col("suffix"), F.col("prefix")).alias("full")).withColumn("short", F.substring("full", 1, PREFIX))
    listed = keyed.groupBy("short").agg(F.collect_list(F.struct("digest", "rule", "verdict")).alias("rules"))  # as many as share four bytes
    confirmed = F.filter("rules", lambda r: r["digest"] == F.col("full"))
    hits = digest.join(listed, "short").select("known", F.explode(confirmed).alias("hit")).select("known", "hit.rule", "hit.verdict")
    best = hits.groupBy("known").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule").alias("n"), F.col("rule").alias("r"))).alias("best"))
    rows = pages.select("page_id", "url").join(best, F.col("url") == F.col("known"), "left")
    return rows.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
