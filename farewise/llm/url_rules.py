"""URL allow and block rules by hashed host-suffix and path-prefix expressions.

Each URL expands into (host suffix, path prefix) expressions cut at label and slash borders. Their short hash
prefixes are equi-joined with those of the rules; a match is then confirmed on the full digest and on the rest of
the rule's path, and the longest confirmed rule decides. The number of expressions is limited by the depth of the
deepest rule, read from the rules themselves, so nothing that could match is left out.

Defined results: a null URL or one without `://` has empty host and path and takes the default verdict, as does a
URL no rule fits; of rules of equal length the one with the longer host wins, then block before allow, and repeated
rules change nothing. An empty rule table gives every URL the default. Rules with a null or empty host are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that the join compares.
PREFIX_DIGITS = 8
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, SMALL)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    """Digest of an expression, whose host begins with a dot: a suffix of an URL's host then begins at a label."""
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, PREFIX_DIGITS), 16, 10).cast("bigint")


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their digest; a path is cut after its last slash for the join."""
    host = F.translate("host", UPPER, SMALL)
    path = F.coalesce("path", F.lit(""))
    stem = F.regexp_extract(path, r"(?s)^(.*/)?", 0)
    return (
        rules.filter("host is not null and host != '' and verdict is not null")
        .select(host.alias("rule_host"), path.alias("rule_path"), F.col("verdict").alias("rule_verdict"), stem.alias("stem"))
        .distinct()
        .withColumn("rule_digest", _digest(F.concat(F.lit("."), "rule_host"), F.col("stem")))
        .withColumn("rule_key", _prefix(F.col("rule_digest")))
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id", default: str = "allow"
) -> DataFrame:
    """One row per page row: page_id, host, path, rule (or null) and verdict."""
    table = rule_table(rules)
    deepest = table.agg(
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.max(F.size(F.split("stem", "/")) - 1).alias("slashes"),
    ).first()
    labels, slashes = deepest["labels"] or 0, deepest["slashes"] or 0
    own = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(page_id).alias("page_id"),
        url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"),
    )
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.concat(F.lit("."), F.array_join(F.slice(parts, -n, n), ".")),
    )
    # Prefixes that end in a slash, the empty one first; at most as many slashes as any rule has.
    pieces = F.split("path", "/")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(pieces) - 1, F.lit(slashes))),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(pieces, 1, n), "/"), F.lit("/"))),
    )
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _prefix(_digest(h, p)))))
    spread = own.withColumn("key", F.explode(keys if labels else F.array(F.lit(0).cast("bigint"))))
    # Only prefixes are join keys; of what they bring together the whole digest is computed and compared.
    host_end = F.substring(F.concat(F.lit("."), "host"), -F.length("rule_host") - 1, F.length("rule_host") + 1)
    path_start = F.substring("path", F.lit(1), F.length("stem"))
    sure = (
        (F.col("key") == F.col("rule_key"))
        & (_digest(host_end, path_start) == F.col("rule_digest"))
        & F.col("path").startswith(F.col("rule_path"))
    )
    length = F.length("rule_host") + F.length("rule_path")
    rank = F.struct(length.alias("n"), F.length("rule_host").alias("h"), F.col("rule_verdict"), F.concat("rule_host", "rule_path").alias("rule"))
    best = F.max(F.when(F.col("rule_host").isNotNull(), rank)).alias("best")
    return (
        spread.join(table, sure, "left")
        .groupBy("row", "page_id", "host", "path")
        .agg(best)
        .select(
            "page_id", "host", "path", F.col("best.rule").alias("rule"),
            F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
        )
    )
