"""URL filters: pattern rules indexed by their rarest literal token, with DataFrame operations only.

A rule is a verdict with a host and a path pattern: it fits the host and all its subdomains (an empty host: any),
where the URL's path starts with the pattern, in which ``*`` stands for any characters. Each literal token of a
rule, an alphanumeric run that must be a whole token of every URL the rule fits, is looked up in the token counts
of the corpus, and the rule is filed under the rarest. A URL's tokens then fetch the few rules filed under them,
and only those are tried with regular expressions. Rules without such a token are filed under the empty token,
which every URL has. URLs are judged once each, however many pages have them.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the crawl: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: What no rule of the crawl fits is blocked by these patterns, which name no host, and else allowed.
PATTERNS = (
    ("block", "", "*/ads/"),
    ("block", "", "*/cart/"),
    ("block", "", "*/login/"),
    ("block", "", "*/tracking/"),
    ("block", "", "*/wp-admin/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("([a-z0-9]+)"), F.lit(1)))


def rule_tokens(host: str, path: str) -> list[str]:
    """The tokens that every URL the rule fits has whole: bounded on both sides by what the rule itself says."""
    bounded = re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*]|$)", path.lower().replace("**", "*")) if path else []
    return sorted({*re.findall(r"[a-z0-9]+", host.lower()), *bounded})


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...], rank: int) -> DataFrame:
    """(rule, verdict, rule_host, pattern, tokens, rank): the rules as rows, read from one JSON text in the JVM."""
    rows = []
    for verdict, host, path in rules:
        pattern = "(?s)^" + ".*".join("\\Q" + part + "\\E" if part else "" for part in path.split("*"))
        rows.append({"rule": host + path, "verdict": verdict, "rule_host": host.lower(), "pattern": pattern, "tokens": rule_tokens(host, path) or [""], "rank": rank})
    schema = "array<struct<rule: string, verdict: string, rule_host: string, pattern: string, tokens: array<string>, rank: int>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, patterns=PATTERNS) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (null if no rule of ``rules`` fits), verdict.

    Of the rules that fit, the longest wins (host and path together; equally long ones: the greatest as text); it
    outranks every pattern. What nothing fits is allowed. Null URLs and such without ``://`` have empty host and
    path and are judged by those; URLs of any length are read whole. Repeated rows give a row each; other columns are not
    read, whatever their names. An empty table gives no rows.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(url_col).alias("url")).where("url is not null").distinct().select("url", host.alias("host"), path.alias("path"))
    found = urls.select("url", "host", "path", F.explode(F.array_union(tokens(F.concat("host", "path")), F.array(F.lit("")))).alias("token"))
    every = rule_table(spark, rules, 1)
    if patterns:
        every = every.unionByName(rule_table(spark, patterns, 0))
    filed = every.withColumn("token", F.explode("tokens")).drop("tokens")
    counts = found.join(filed.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = filed.join(counts, "token", "left").groupBy("rule", "verdict", "rule_host", "pattern", "rank").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    fits_host = (F.col("rule_host") == "") | (F.col("host") == F.col("rule_host")) | F.endswith(F.col("host"), F.concat(F.lit("."), F.col("rule_host")))
    tried = found.join(rarest, "token").where(fits_host & F.regexp_like("path", F.col("pattern")))
    best = tried.groupBy("url").agg(F.max(F.struct("rank", F.length("rule").alias("size"), "rule", "verdict")).alias("best"))
    host, path = host_and_path(F.col("page.url"))
    judged = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).alias("page").join(best.alias("b"), F.col("page.url") == F.col("b.url"), "left")
    return judged.select(
        F.col("id").alias(id_col), host.alias("host"), path.alias("path"), F.when(F.col("best.rank") == 1, F.col("best.rule")).alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict")
    )


def keep_allowed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """The rows of ``pages`` whose URL is allowed; all columns stay. Rows are judged by their URL alone, so repeated and
    null ids change nothing; a null URL is judged like an empty one."""
    bad = judge(pages.select(F.col(url_col).alias("url")).distinct(), "url", "url", **options).where("verdict = 'block'")
    bad = bad.select(F.col("url").alias("__url")).distinct()
    return pages.join(bad, pages[url_col].eqNullSafe(bad["__url"]), "left_anti")
