"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join. DataFrame functions only.

Rows: null urls and urls without "://" have an empty host and path, fit no rule and are on no list. Repeated
rows are judged each; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Host labels whose pages make up the default list.
SPAM_LABELS = ("spam-farm", "cheap-pills", "casino-win")

BITS_PER_KEY = 16
BLOCK_BITS = 256
#: Blocks that may be broadcast, 16 keys in each: a row takes about 100 bytes, so 20 MB. Beyond it the blocks are joined
#: by a shuffle.
MOST_BROADCAST_BLOCKS = 200_000
#: Rules that may be put into one expression.
MOST_RULES = 500


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or m., path without an ending slash, query without tracking fields, no fragment."""
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda part: (part != "") & ~part.rlike(r"^(utm_[a-z]*|ref)(=|$)")))
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (as host and path) and its verdict; null where none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, where, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == where) | host.endswith(f".{where}")) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(where + start)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, lane: int) -> Column:
    """The bit of one of a block's four 64-bit lanes."""
    at = F.pmod(F.shiftrightunsigned(F.xxhash64(key, F.lit(7)), 6 * lane), F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at)


def bloom_blocks(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """One row per block that has keys: block and its lanes."""
    lanes = [F.bit_or(_bit(F.col(column), i)).alias(f"bloom_{i}") for i in range(4)]
    return keys.groupBy(_block(F.col(column), blocks).alias("bloom_block")).agg(*lanes)


def on_list(urls: DataFrame, column: str, listed: DataFrame, listed_column: str) -> DataFrame:
    """urls with a boolean on_list: whether the row's key is in listed. urls may repeat; null keys are on no list. Other columns may have
    any name; one named on_list is replaced. The keys and the filter's verdicts are written to the shared folder, so that urls are read once."""
    names = [name for name in urls.columns if name != "on_list"]
    urls = urls.select(F.struct(*(F.col(f"`{name}`") for name in names)).alias("row"), F.col(f"`{column}`").alias("key"))
    keys = written(listed.select(F.col(listed_column).alias("listed_key")).where(F.col("listed_key").isNotNull()).distinct())
    blocks = max(1, -(-keys.count() * BITS_PER_KEY // BLOCK_BITS))
    filled = bloom_blocks(keys, "listed_key", blocks)
    key = F.col("key")
    probe = urls.withColumn("bloom_at", F.when(key.isNotNull(), _block(key, blocks)))
    side = F.broadcast(filled) if blocks <= MOST_BROADCAST_BLOCKS else filled
    joined = probe.join(side, F.col("bloom_at") == F.col("bloom_block"), "left")
    possible = F.lit(True)
    for i in range(4):
        possible = possible & (F.col(f"bloom_{i}").bitwiseAND(_bit(key, i)) != 0)
    judged = written(joined.withColumn("possible", F.coalesce(possible, F.lit(False))).drop("bloom_at", "bloom_block", *(f"bloom_{i}" for i in range(4))))
    missed = judged.where(~F.col("possible")).drop("possible").withColumn("on_list", F.lit(False))
    exact = judged.where("possible").drop("possible").join(keys, key == F.col("listed_key"), "left")
    found = missed.unionByName(exact.withColumn("on_list", F.col("listed_key").isNotNull()).drop("listed_key"))
    return found.select("row.*", "on_list")


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and on_list per row of pages; listed has a column url of blocked urls."""
    url = F.col("url")
    narrow = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.when(F.instr(url, "://") > 0, canonical(url)).alias("canonical"))
    found = on_list(narrow, "canonical", listed.select(F.when(F.instr(url, "://") > 0, canonical(url)).alias("key")), "key")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("on_list"), F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "on_list")


def default_list(pages: DataFrame) -> DataFrame:
    """Urls of pages whose host has a label of SPAM_LABELS."""
    labels = F.array(*(F.lit(x) for x in SPAM_LABELS))
    return pages.select("url").where(F.arrays_overlap(F.split(host_of(F.col("url")), r"\."), labels)).select("url")


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, default_list(pages))


ORACLE = r"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, url, r,
         translate(regexp_extract(coalesce(r, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(coalesce(r, ''), '^[^?#]*\?([^#]*)', 1), '&'),
                     lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]*|ref)(=|$)'))) AS fields
  FROM rest
), keyed AS (
  SELECT *, CASE WHEN instr(url, '://') > 0 THEN
         regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '')
         || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END END AS canonical FROM parts
), listed AS (
  SELECT DISTINCT canonical AS key FROM keyed
  WHERE list_has_any(string_split(host, '.'), ['spam-farm', 'cheap-pills', 'casino-win']) AND canonical IS NOT NULL
), judged AS (
  SELECT page_id, host, path, l.key IS NOT NULL AS on_list,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM keyed LEFT JOIN listed l ON canonical = l.key
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN on_list THEN 'block' ELSE 'allow' END AS verdict, on_list
FROM judged
"""
