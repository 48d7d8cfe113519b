"""URL filters: expand a URL into host suffixes x path prefixes, equi-join on short hash prefixes, confirm digests.

Everything is DataFrame functions. Distinct (host, path) pairs are looked up once, so that a URL, host or path that
holds a large share of the rows costs one lookup; the verdicts go back to the rows by a plain equi-join that adaptive
execution may split or broadcast, whichever the measured sizes allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Scheme, host and path of a URL: after the first "://".
URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Hex digits of the SHA-256 digest that the equi-join compares; the full digest is confirmed after it.
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL_PATTERN, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PATTERN, 2)


def label_count(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _expressions(host: Column, path: Column, label_counts: list[int], slash_lengths: list[int], open_lengths: list[int]) -> Column:
    """array<string>: every host suffix of as many labels as some rule has, followed by every path prefix of a length
    that some rule has."""
    suffixes = F.array(*[F.when(label_count(host) >= n, F.substring_index(host, ".", -n)) for n in label_counts]).cast("array<string>")
    suffixes = F.filter(suffixes, lambda s: s != "")  # nulls go as well

    def prefixes(lengths: list[int]) -> Column:
        fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(path))
        return F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))

    paths = F.array_distinct(F.concat(F.filter(prefixes(slash_lengths), lambda p: p.endswith("/")), prefixes(open_lengths)))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(paths, lambda p: F.concat(s, p))))


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    ``rules`` has host, path, verdict ('allow' or 'block'). A rule fits its host and all subdomains when the URL's
    path starts with the rule's path. The longest rule wins; of equally long ones the longer host, then 'block'.
    Without a fitting rule: rule null, verdict ``default``.

    Null URLs or URLs without "://": host and path empty, ``default``. Null ids stay. Repeated rows each keep their
    row. Rules with a null or empty host, or a null verdict, are ignored; a null path counts as "". Other columns of
    either input are ignored, whatever their names. An empty rule table gives ``default`` everywhere. Any URL length
    is taken whole, in time linear in its length. To the driver go the distinct forms of rules: lengths of paths and
    counts of labels, as many as the rules' own, whatever the pages.
    """
    urls = pages.select(F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    known = (
        rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .where("rule_host != '' AND rule_verdict IS NOT NULL")
        .distinct()
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("rule_digest", F.sha2(F.col("rule"), 256))
    )
    # Rules by the short prefix of their digest, of which a few can share one: the full digests are confirmed after the join.
    filed = known.groupBy(F.substring("rule_digest", 1, PREFIX_DIGITS).alias("rule_prefix")).agg(F.collect_list(F.struct("rule_digest", "rule", "rule_host", "rule_verdict")).alias("filed"))
    forms = known.select(F.length("rule_path").alias("n"), F.col("rule_path").endswith("/").alias("slash"), label_count(F.col("rule_host")).alias("labels")).distinct().collect()
    slash_lengths = sorted({r["n"] for r in forms if r["slash"]})
    open_lengths = sorted({r["n"] for r in forms if not r["slash"]})
    label_counts = sorted({r["labels"] for r in forms})

    looked_up = (
        urls.select("host", "path")
        .where("host != ''")
        .distinct()
        .select("host", "path", F.explode(_expressions(F.col("host"), F.col("path"), label_counts, slash_lengths, open_lengths)).alias("expression"))
        .select("host", "path", F.sha2("expression", 256).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    met = looked_up.join(filed, F.col("prefix") == F.col("rule_prefix"))
    hits = met.select("host", "path", F.inline(F.filter("filed", lambda r: r["rule_digest"] == F.col("digest"))))
    order = F.struct(F.length("rule"), F.length("rule_host"), F.col("rule_verdict") == "block")
    best = (
        hits.groupBy(F.col("host").alias("hit_host"), F.col("path").alias("hit_path"))
        .agg(F.max_by(F.struct("rule", "rule_verdict"), order).alias("best"))
        .withColumn("hit_key", F.xxhash64("hit_host", "hit_path"))
    )
    # The extra key makes this exchange both sides, so that a hot (host, path) can be split.
    joined = urls.withColumn("url_key", F.xxhash64("host", "path")).join(
        best, (F.col("url_key") == F.col("hit_key")) & (F.col("host") == F.col("hit_host")) & (F.col("path") == F.col("hit_path")), "left"
    )
    return joined.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
