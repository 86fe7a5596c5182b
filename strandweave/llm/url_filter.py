"""Allow and block rules for URLs by hashed host-suffix and path-prefix expressions.

A rule is a host and a path, like ``example.com/de/``; it fits the host and all
its subdomains where the path starts with the rule's. Each URL is expanded into
the expressions that a rule can have been filed under: every suffix of its host
after a dot, with every prefix of its path that ends in a slash; but no host with more
labels and no path with more slashes than a rule has. Expressions meet rules by the first four bytes of their digests; then the full digest, the host
and the path are confirmed. The longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.common import lower_ascii

RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def host_of(url: Column) -> Column:
    """What is between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, in lower case; else empty."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column, labels: int) -> Column:
    """The suffixes of at most ``labels`` labels, the host itself among them if it has no more."""
    parts = F.split(F.substring_index(host, ".", -labels), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def path_prefixes(path: Column, slashes: int) -> Column:
    """The empty path and all prefixes of at most ``slashes`` slashes that end in one."""
    head = F.substring_index(path, "/", slashes)
    parts = F.split(F.when(F.length(head) < F.length(path), F.concat(head, F.lit("/"))).otherwise(path), "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def short(full: Column) -> Column:
    return F.conv(F.substring(full, 1, 8), 16, 10).cast("long")


def file_rules(rules: DataFrame) -> DataFrame:
    """Rules ``host, path, verdict`` under the expression that every URL they fit has.

    That is the host with the path up to its last slash, since a path that starts
    with the rule's has this prefix. Of rules with the same host and path a block
    goes before an allow. Rows without host or path are no rules.
    """
    known = rules.where("host is not null and path is not null").select(lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    known = known.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))
    filed = F.regexp_extract("rule_path", r"(?s)^(.*/)?", 1)
    full = digest(F.col("rule_host"), filed)
    return known.select(short(full).alias("short"), full.alias("full"), "rule_host", "rule_path", "rule_verdict")


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """Per page ``page_id, host, path, rule, verdict``.

    A URL that is null or has no ``://`` has empty host and path. Where no rule
    fits, ``rule`` is null and the verdict ``otherwise``. Of two fitting rules
    the longer host and path together win, then the longer host. Repeated rows
    and null ids are judged like any other.

    Different hosts and paths are expanded once, however many pages share them,
    and no deeper than the longest rule goes: two numbers come back for that.
    Rules are joined as Spark sees fit by their size.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    places = rows.where("host <> ''").select("host", "path").distinct()
    filed = file_rules(rules)
    count = lambda text, sign: F.max(F.length(text) - F.length(F.replace(F.col(text), F.lit(sign), F.lit(""))))
    dots, slashes = filed.agg(count("rule_host", "."), count("rule_path", "/")).first()
    asked = places.select("host", "path", F.explode(host_suffixes(F.col("host"), (dots or 0) + 1)).alias("_h"))
    asked = asked.select("host", "path", "_h", F.explode(path_prefixes(F.col("path"), slashes or 0)).alias("_p"))
    asked = asked.withColumn("_full", digest(F.col("_h"), F.col("_p"))).withColumn("short", short(F.col("_full")))
    hits = asked.join(filed, "short").where(
        (F.col("_full") == F.col("full")) & (F.col("_h") == F.col("rule_host")) & F.startswith("path", "rule_path"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("_best"))
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(otherwise)).alias("verdict"))


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")
