"""URL rules by host-suffix and path-prefix expressions, joined on short hash prefixes and confirmed on full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower

#: Hex digits of the digest that the join compares; the full digest confirms.
PREFIX_HEX = 8
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 2)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """(action, host, path) to one row per expression; of equal rules, block stands. Rules without a host fit nothing."""
    rule = F.concat(ascii_lower(F.col("host")), F.coalesce(F.col("path"), F.lit("")))
    return (
        rules.where(F.length("host") > 0)
        .select(rule.alias("rule"), F.length("host").alias("host_len"), F.size(F.split("host", r"\.")).alias("labels"), F.length(F.coalesce("path", F.lit(""))).alias("path_len"), "action")
        .groupBy("rule", "host_len", "labels", "path_len")
        .agg(F.max("action").alias("action"))  # block sorts after allow
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )


def expressions(host: Column, path: Column, labels: list[int], path_lens: list[int]) -> Column:
    """Array of the host suffixes of these label counts, each with the path prefixes of these lengths.

    A rule can only equal an expression of its own shape, so shapes without a rule aren't built."""
    count = F.size(F.split(host, r"\."))
    suffixes = F.filter(F.array(*[F.when((host != "") & (count >= k), F.substring_index(host, ".", -k)) for k in labels]), lambda x: x.isNotNull())
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n) if n else F.lit("")) for n in path_lens]), lambda x: x.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest rule wins,
    then the longer host, then block. Null URLs and those without ``://`` have empty host and path, no rule and the default verdict.
    Distinct (host, path) pairs are judged once, so repeated URLs cost one row; an empty table gives an empty table.
    Spark broadcasts the rules only while they are under its size threshold; beyond it the join shuffles, and adaptive
    execution splits a hot prefix. Columns of urls that bear the names of the result are replaced.
    """
    rules = prepare_rules(rules)
    shapes = rules.agg(F.array_sort(F.collect_set("labels")), F.array_sort(F.collect_set("path_len"))).first()  # bounded by the longest rule, not by the rules' number
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    parts = urls.select(*kept, host_of(urls[url_col]).alias("host"), path_of(urls[url_col]).alias("path"))
    if not shapes[0]:
        return parts.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    sites = parts.select("host", "path").distinct()
    wide = sites.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), shapes[0], shapes[1])).alias("said"))
    wide = wide.withColumn("said_digest", F.sha2("said", 256)).withColumn("short", F.substring("said_digest", 1, PREFIX_HEX))
    hits = wide.join(rules, "short").where(F.col("said_digest") == F.col("digest"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("host_len"), F.col("action"), F.col("rule"))).alias("best"))
    return parts.join(best, ["host", "path"], "left").select(*kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
