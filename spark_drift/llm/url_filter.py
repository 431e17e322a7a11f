"""Allow and block rules for URLs, by hashed host-suffix and path-prefix expressions.

A URL is expanded into the expressions (suffix of its host, prefix of its path) that some rule could
have, and joined to the rules on the first bytes of the expressions' digests alone; then the full digest
and the rule's whole path confirm a hit, and the most specific rule wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_drift.util import skew_safe_join

#: Hexadecimal digits of a digest that the join uses.
SHORT = 8
#: Rules are sent to every task up to this many bytes (counted), and shuffled beyond.
BROADCAST_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """rule_host, rule_path and rule_verdict from (verdict, host, path)."""
    return spark.createDataFrame([(h, p, v) for v, h, p in rules], "rule_host string, rule_path string, rule_verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: Sequence[str] = (), default: str = "allow") -> DataFrame:
    """``keep``, host, path, rule and verdict of each row of ``pages``.

    A rule fits its host and all subdomains where the path starts with the rule's. The longest rule
    (host and path together) wins, then the longer host, then block before allow. Without a fitting
    rule, rule is null and verdict ``default``. Each distinct (host, path) is judged once, so a hot
    URL is one row in the joins. The rules are the small side by a count of their bytes; beyond
    ``BROADCAST_BYTES`` both sides are shuffled in a way that lets a hot expression be split. Rules without
    host or path fit nothing; a rule's verdict other than allow or block counts as ``default`` and gives
    way to these.

    A null URL or one without ``://`` has an empty host and path and fits only a rule for the empty
    host. Equal rows give equal rows, empty tables empty ones; kept columns named like a result
    give way to it."""
    kept = [c for c in keep if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*kept, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    # no expression with more labels or deeper than the rules' can hit: two numbers bound the expansion
    listed = rules.where(F.col("rule_host").isNotNull() & F.col("rule_path").isNotNull())
    folders = F.length("rule_path") - F.length(F.translate("rule_path", "/", ""))
    held = 200 + F.octet_length("rule_host") + F.octet_length("rule_path") + F.coalesce(F.octet_length("rule_verdict"), F.lit(0))
    labels, depth, size = listed.agg(F.max(F.size(F.split("rule_host", r"\."))), F.max(folders), F.coalesce(F.sum(held), F.lit(0))).first()
    host_parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(host_parts), F.lit(labels or 1))), lambda n: F.array_join(F.slice(host_parts, -n, n), "."))
    path_parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(path_parts) - 1, F.lit(depth or 0))),
                           lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(path_parts, 1, n), "/"), F.lit("/"))))
    known = rows.select("host", "path").distinct()
    tried = known.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes)).withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
    tried = tried.select("host", "path", "digest", F.substring("digest", 1, SHORT).alias("short"))
    listed = listed.withColumn("rule_digest", _digest(F.col("rule_host"), F.regexp_extract("rule_path", r"(?s)^.*/", 0)))
    listed = listed.withColumn("short", F.substring("rule_digest", 1, SHORT))
    met = tried.join(F.broadcast(listed), "short") if size <= BROADCAST_BYTES else skew_safe_join(tried, listed, ["short"])
    # digests are of one length, so one test of a beginning confirms the whole digest and the rule's path
    hits = met.where(F.concat("digest", "path").startswith(F.concat("rule_digest", "rule_path")))
    # Of rules that fit one URL, total and host length name one host and one path, so the highest
    # rank says all of the winner and hash aggregates of a number do.
    code = F.when(F.col("rule_verdict") == "block", 2).when(F.col("rule_verdict") == "allow", 1).otherwise(0)
    long = lambda c: F.length(c).cast("long")
    rank = (long("rule_host") + long("rule_path")) * (1 << 34) + long("rule_host") * 4 + code
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("_rank"))
    out = rows.join(best, ["host", "path"], "left")
    total, size, code = F.shiftright("_rank", 34).cast("int"), F.shiftright("_rank", 2).bitwiseAND(F.lit((1 << 32) - 1)).cast("int"), F.col("_rank").bitwiseAND(F.lit(3))
    rule = F.concat(F.right("host", size), F.left("path", total - size))
    verdict = F.when(code == 2, "block").when(code == 1, "allow").otherwise(F.lit(default))
    return out.select(*kept, "host", "path", rule.alias("rule"), verdict.alias("verdict"))
