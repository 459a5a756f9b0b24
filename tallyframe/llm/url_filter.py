"""Allow and block URLs by rules and by a list, with a blocked Bloom filter before the exact join.

Every URL has a few *keys*: each suffix of its host with each path prefix as long as
some rule's path, and its canonical form.  A blocked Bloom filter of the keys of
all entries (one 64-bit word per block) is probed inside the scan; only possible
hits go on to an exact hash join, which removes the false ones.  All is
DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import bloom
from tallyframe.storage import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """What is between ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(host: Column, path: Column) -> Column:
    """Host without ``www.`` and path without closing slashes; scheme, query and fragment do not count."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def _entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, rule, verdict, rank): one row per rule and per listed canonical URL."""
    written = F.concat("host", "path")
    ruled = (
        rules.where("host is not null and path is not null")
        .select(
            F.concat(F.lit("r:"), "host", F.lit(" "), "path").alias("key"),
            written.alias("rule"),
            "verdict",
            F.length(written).alias("rank"),
            F.length("path").alias("path_length"),
        )
        .groupBy("key", "rule", "rank", "path_length")
        .agg(F.max("verdict").alias("verdict"))
    )
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    urls = (
        listed.where(host != "")
        .select(F.concat(F.lit("u:"), canonical_url(host, path)).alias("key"))
        .distinct()
        .select(
            "key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"),
            F.lit(-1).alias("rank"), F.lit(None).cast("int").alias("path_length"),
        )
    )
    return ruled.select("key", "rule", "verdict", "rank", "path_length").unionByName(urls)


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every row of ``pages``: (id, host, path, rule, verdict, listed).

    ``rules`` has (host, path, verdict ``allow``/``block``): a rule fits its host and all
    its subdomains when the URL's path starts with the rule's; the longest rule
    (host and path together, then the longer host) decides.  Without a rule a URL
    whose canonical form is in ``listed`` (column ``url``) is blocked, all others allowed.

    A null URL or one without ``://`` has an empty host and path and is allowed; repeated
    rows give repeated results; empty rules and lists match nothing; a rule given
    twice with both verdicts blocks (``max``).  Other columns of ``pages`` are not
    looked at.  Hot URLs and hot rules: hits are looked up per distinct URL
    and the joins are plain shuffle joins that adaptive execution may split or,
    for a list of known small size, broadcast.
    """
    entries = settle(_entries(rules, listed), "url-entries")
    facts = entries.agg(F.count("*").alias("n"), F.collect_set("path_length").alias("lengths")).first()
    lengths = sorted(facts["lengths"])
    blocks = bloom.blocks_for(facts["n"])
    rows = pages.select(F.col(id_col), F.col(url_col).alias("__url")).withColumns(
        {"host": url_host(F.col("__url")), "path": url_path(F.col("__url"))}
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fitting = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    ruled = F.flatten(
        F.transform(
            suffixes,
            lambda s: F.transform(fitting, lambda n: F.concat(F.lit("r:"), s, F.lit(" "), F.substring(F.col("path"), 1, n))),
        )
    )
    keys = F.array_union(ruled, F.array(F.concat(F.lit("u:"), canonical_url(F.col("host"), F.col("path")))))
    words = bloom.bloom_words(entries.select("key"), blocks)
    probed = (
        rows.where("host <> ''").select("__url", keys.alias("keys"), words.alias("words")).select(
            "__url",
            F.filter("keys", lambda k: bloom.may_contain("words", blocks, k)).alias("hits"),
        )
    )
    possible = probed.where(F.size("hits") > 0).select("__url", F.explode("hits").alias("key")).distinct()
    best = (
        possible.join(entries.drop("path_length"), "key")
        .groupBy("__url")
        .agg(
            F.max(F.struct("rank", F.instr(F.reverse("rule"), "/"), "rule", "verdict")).alias("best"),
            F.bool_or(F.col("rule").isNull()).alias("on_list"),
        )
    )
    return rows.join(best, "__url", "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("on_list", F.lit(False)).alias("listed"),
    )
