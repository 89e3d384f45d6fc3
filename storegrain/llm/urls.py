"""URL filter: a blocked Bloom filter in front of an exact hash join.

Every listed key sets ``PROBES`` bits in one 64-bit block; the blocks are an aggregate (``bit_or``) of at most
``MAX_BLOCKS`` rows, so the table that is broadcast has a fixed bound. A page looks up the keys that could list it: its
canonical URL, and host suffixes with path prefixes for rules. Keys whose bits are all set go on to the join with
the list itself, which removes the false positives. Only column functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2**17 blocks of 8 bytes: about 1 MB as numbers.
MAX_BLOCKS, PROBES, BITS_FOR_KEY = 1 << 17, 4, 16
SCHEME = "://"

#: Host, path and verdict of the rules: fixed values.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, SCHEME)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(F.substring_index(F.substring_index(rest, "#", 1), "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return _ascii_lower(host), F.substring(rest, F.char_length(host) + 1, F.char_length(rest))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without a slash at its end; query, fragment and scheme do not matter."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, "/+$", ""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> Column:
    other = F.xxhash64(F.lit("bits"), key)
    places = [F.shiftright(other, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(PROBES)]
    return reduce(lambda x, y: x.bitwiseOR(y), (F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places))


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """``block, bits``, at most ``blocks`` rows."""
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(F.bit_or(_bits(F.col(key))).alias("bits"))


def blocks_for(n: int) -> int:
    """A power of two with ``BITS_FOR_KEY`` bits for each key, at most ``MAX_BLOCKS``."""
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * 64 < n * BITS_FOR_KEY:
        blocks *= 2
    return blocks


def look_up(candidates: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """The rows of ``candidates`` whose key is listed, with the columns of ``listed``: filter first, then the exact join."""
    blocks = blocks_for(listed.count())
    filter_rows = F.broadcast(bloom_blocks(listed, key, blocks).select(F.col("block").alias("__block"), F.col("bits").alias("__bits")))
    wanted = _bits(F.col(key))
    possible = candidates.join(filter_rows, _block(F.col(key), blocks) == F.col("__block")).where(
        F.col("__bits").bitwiseAND(wanted) == wanted).drop("__block", "__bits")
    return possible.join(listed, key)


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col, host, path, rule, verdict, listed``, one row for each row of ``pages``.

    ``rules`` (host, path, verdict): a rule fits its host and all subdomains if the path of the URL starts with the rule's; the longest
    fitting rule decides, of equally long ones the larger in order. Where none fits, a URL whose canonical form is in ``listed`` (column ``url``, any
    form) is blocked and any other one allowed.

    A null URL and one without ``://`` have an empty host and path, fit no rule and are allowed. Repeated rows are judged alike.
    Rules or listed URLs with a null part count for nothing; repeated ones count once. Null ids stay. Other columns are
    not looked at; without pages the result is empty.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(url_col).alias("url")).where(F.col("url").contains(SCHEME)).distinct()
    urls = urls.select("url", *(x.alias(n) for x, n in zip(host_and_path(F.col("url")), ("host", "path"))))

    rules = rules.select(_ascii_lower("host").alias("host"), "path", "verdict").dropna()
    by_key = rules.groupBy(F.concat_ws("\n", "host", "path").alias("key")).agg(F.min(F.struct(
        F.concat("host", "path").alias("rule"), "verdict")).alias("rule"))
    lengths = [r[0] for r in rules.select(F.char_length("path")).distinct().collect()]  # at most as many as a path is long
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths)) if lengths
                        else F.array().cast("array<string>"), lambda p: p.isNotNull())
    keys = urls.select("url", F.explode(F.flatten(F.transform(suffixes, lambda s: F.transform(
        prefixes, lambda p: F.concat_ws("\n", s, p))))).alias("key"))
    longest = look_up(keys, by_key, "key").groupBy("url").agg(F.max_by(
        "rule", F.struct(F.char_length("rule.rule"), F.concat("rule.rule"))).alias("rule"))

    named = listed.select(*(x.alias(n) for x, n in zip(host_and_path(F.col("url")), ("host", "path")))).where("host != ''")
    named = named.select(canonical(F.col("host"), F.col("path")).alias("key")).distinct()
    on_list = look_up(urls.select("url", canonical(F.col("host"), F.col("path")).alias("key")), named, "key").select(
        "url", F.lit(True).alias("listed"))

    found = longest.join(on_list, "url", "full").select(F.col("url").alias("__url"), "rule", "listed")
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path")).join(
        found, F.col("url") == F.col("__url"), "left")
    return out.select(
        F.col("id").alias(id_col), "host", "path", F.col("rule.rule").alias("rule"),
        F.coalesce("rule.verdict", F.when(F.col("listed"), "block"), F.lit("allow")).alias("verdict"),
        F.coalesce("listed", F.lit(False)).alias("listed"))
