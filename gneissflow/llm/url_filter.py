"""URL rules by hash prefixes of host-suffix and path-prefix expressions.

Every distinct URL is expanded into expressions, as rule lists of safe-browsing kind do: host
suffixes first, which join the hosts of the rules, then for each host found the path prefixes.  Only
suffixes of as many labels, and prefixes of as many characters, as some rule of the kind has are
built, so the work is linear in a URL whatever dots and slashes it holds.  An expression joins on
the first ``PREFIX_HEX`` hex digits of its SHA-256, the full digest confirms the match, and the
longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_HEX = 8  # 4 bytes
#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """host, path, verdict of each rule."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _suffixes(host: Column, depths: list[int]) -> Column:
    """The parent domains of so many labels, the host itself included."""
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    return F.array_compact(F.array(*[F.when(dots >= n - 1, F.substring_index(host, ".", -n)) for n in depths]).cast("array<string>"))


def _hashed(df: DataFrame, text: Column, full: str, short: str) -> DataFrame:
    return df.withColumn(full, F.sha2(text, 256)).withColumn(short, F.substring(full, 1, PREFIX_HEX))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, rule and verdict; rows, order and other columns as they were.

    A rule fits its host and all subdomains if the URL's path starts with the rule's path.  The
    longest rule (host and path together, then the longer host, then the smaller text) wins; of two
    rules alike, block wins.  No rule: null and ``default``.  A null URL or one without ``://`` has
    an empty host and path and fits no rule.  Columns of ``pages`` with the new names are replaced.
    Rules with a null or empty host fit nothing; a null path is the empty one.  The numbers of labels
    of rule hosts (one for each number that occurs) are the only thing brought to the driver.
    """
    low = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rules = rules.select(low.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''")
    depths = sorted(r[0] for r in rules.select(F.size(F.split("host", r"\."))).distinct().collect())
    # each host with the lengths of its rules' paths; each rule: of two alike, block > allow
    hosts = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("_lengths"))
    hosts = _hashed(hosts, F.col("host"), "_host_digest", "_host_short").drop("host")
    listed = rules.groupBy("host", "path").agg(F.max("verdict").alias("_verdict"))
    listed = _hashed(listed, F.concat("host", F.lit("\u0000"), "path"), "_digest", "_short")
    listed = listed.select("_digest", "_short", F.concat("host", "path").alias("_rule"), "_verdict", F.length("host").alias("_hl"))
    urls = pages.select(F.col("url").alias("__g_url")).where("__g_url IS NOT NULL").distinct()
    urls = urls.select("__g_url", host_of("__g_url").alias("_host"), path_of("__g_url").alias("_path")).where("_host <> ''")
    own = urls.select("__g_url", "_path", F.explode(_suffixes(F.col("_host"), depths)).alias("_sfx"))
    own = _hashed(own, F.col("_sfx"), "_full", "_host_short").join(hosts, "_host_short").where("_full = _host_digest")
    fits = F.filter("_lengths", lambda n: n <= F.length("_path"))
    own = own.select("__g_url", "_sfx", F.explode(F.transform(fits, lambda n: F.substring(F.col("_path"), F.lit(1), n))).alias("_pfx"))
    own = _hashed(own, F.concat("_sfx", F.lit("\u0000"), "_pfx"), "_full", "_short")
    met = own.join(listed, "_short").where("_full = _digest")
    rank = F.struct(F.length("_rule").alias("n"), F.col("_hl").alias("h"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))
    best = met.groupBy("__g_url").agg(F.max(rank).alias("__g_best"))
    out = pages.drop("host", "path", "rule", "verdict").join(best, F.col("url") == F.col("__g_url"), "left")
    return out.withColumns({
        "host": host_of("url"), "path": path_of("url"), "rule": F.col("__g_best.rule"),
        "verdict": F.coalesce(F.col("__g_best.verdict"), F.lit(default)),
    }).drop("__g_url", "__g_best")
