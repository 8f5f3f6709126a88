"""URL filter: host-suffix and path-prefix expressions, joined by short hash, confirmed by full digest.

A URL is expanded into every combination of a suffix of its host's labels and a prefix
of its path that ends behind a slash (and the empty prefix), no deeper than the deepest rule.
Expressions meet the rules in an equi-join on the first ``SHORT`` hex digits of their SHA-256;
the whole digest and, for a rule whose path ends inside a segment, the rest of the path are
confirmed behind the join. Of the rules that fit, the longest wins (host and path together, then the host,
then block before allow, then the rule's text). Distinct URLs are judged once, so a URL
that many rows share costs one row, and only the ``url`` column is read for the verdict.

Null URLs and URLs without ``://`` have an empty host and path and get the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from avalista.llm.common import free_names

SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"


def _part(url: Column, group: int) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, PATTERN, group)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return _part(url, 2)


def _heads(path: Column) -> Column:
    """The path up to its last slash, that slash included."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 1)


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with the expression, digest and short hash they are looked up by. Null host or path: empty."""
    host, path = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER), F.coalesce("path", F.lit(""))
    key = F.concat(F.lit("r"), host, F.lit("\n"), _heads(path))
    return rules.select(
        host.alias("r_host"), path.alias("r_path"), F.col("verdict").alias("r_verdict"), F.sha2(key, 256).alias("r_digest"),
        F.substring(F.sha2(key, 256), 1, SHORT).alias("r_short"),
    ).distinct()


def expand(urls: DataFrame, labels: int, slashes: int) -> DataFrame:
    """A row per expression of each row's ``host`` and ``path``, at most so many labels and slashes deep."""
    parts = F.split("host", r"\.", -1)
    n = F.size(parts)
    suffixes = F.transform(
        F.sequence(F.greatest(n - labels + 1, F.lit(1)), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))
    steps = F.split("path", "/", -1)
    depth = F.least(F.size(steps) - 1, F.lit(slashes))
    prefixes = F.transform(
        F.sequence(F.lit(0), depth), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, F.lit(1), i), "/"), F.lit("/"))))
    key = lambda host: F.transform(prefixes, lambda path: F.concat(F.lit("r"), host, F.lit("\n"), path))
    return urls.withColumn("expression", F.explode(F.flatten(F.transform(suffixes, key))))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` added."""
    compiled = compile_rules(rules)
    deepest = compiled.agg(
        F.max(F.size(F.split("r_host", r"\.", -1))), F.max(F.size(F.split("r_path", "/", -1)) - 1)
    ).first()
    labels, slashes = deepest[0] or 1, deepest[1] or 0
    key, won, said = free_names(pages, "_url", "_rule", "_verdict")
    urls = pages.select(F.col(url_col).alias("u_url")).filter(F.col("u_url").isNotNull()).distinct()
    urls = urls.select("u_url", host_of(F.col("u_url")).alias("host"), path_of(F.col("u_url")).alias("path"))
    hashed = expand(urls, labels, slashes).withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    fits = (F.col("short") == F.col("r_short")) & (F.col("digest") == F.col("r_digest")) & F.startswith(F.col("path"), F.col("r_path"))
    rule = F.concat("r_host", "r_path")
    best = F.max(F.struct(
        F.length(rule).alias("n"), F.length("r_host").alias("n_host"), (F.col("r_verdict") == "block").alias("blocks"),
        rule.alias("rule"), F.col("r_verdict").alias("verdict")))
    verdicts = hashed.join(compiled, fits).groupBy("u_url").agg(best.alias("best")).select(F.col("u_url").alias(key), F.col("best.rule").alias(won), F.col("best.verdict").alias(said))
    url = F.col(url_col)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return pages.select(*kept).join(verdicts, url == F.col(key), "left").select(
        *kept, F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"),
        F.col(won).alias("rule"), F.coalesce(said, F.lit(default)).alias("verdict"),
    )
