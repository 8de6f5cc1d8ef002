"""URL filters: host and path rules, then a blocked Bloom filter before an exact join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

#: (host, path, verdict). A rule fits its host and all subdomains where the path starts with its own; the longest wins.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: The listing of the registered query has the canonical URLs whose md5 begins with one of these, in another spelling.
LISTED = ("0", "3", "6", "9", "c")
#: Query parameters that don't name a page.
TRACKING = ("fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
#: A block is eight words of 32 bits, one bit set in each; odd multipliers choose the bits. Fixed values.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
#: Listed URLs per block (21 bits each). Up to so many blocks of about 80 bytes (10 MB) are broadcast; more are met by a shuffle.
PER_BLOCK, BROADCAST_BLOCKS = 12, 1 << 17


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' without ://."""
    at = F.instr(url, "://")
    raw = F.substring_index(F.substring_index(F.substring_index(F.substr(url, at + 3), "/", 1), "?", 1), "#", 1)
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit("")).otherwise(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; '' without ://."""
    at = F.instr(url, "://")
    rest = F.substring_index(F.substring_index(F.substr(url, at + 3), "?", 1), "#", 1)
    slash = F.instr(rest, "/")
    return F.when((F.coalesce(at, F.lit(0)) == 0) | (slash == 0), F.lit("")).otherwise(F.substr(rest, slash))


def canonical(url: Column) -> Column:
    """Host without www., m. or blog.; path without .html and slashes at its end; other than tracking parameters, sorted."""
    after = F.substr(url, F.instr(url, "://") + 3)
    bare = F.substring_index(after, "#", 1)
    mark = F.instr(bare, "?")
    query = F.when(mark == 0, F.lit("")).otherwise(F.substr(bare, mark + 1))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    host = F.regexp_replace(host_of(url), r"^(www|m|blog)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"\.html$", ""), r"/+$", "")
    text = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) == 0, F.lit("")).otherwise(text)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule string (host + path) and verdict of the longest rule that fits; nulls where none does."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(order):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _bits(h: Column) -> list[Column]:
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright((low.bitwiseAND(F.lit(0x7FFFFFFF)) * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int")) for s in SALTS]


def blocked_bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the canonical URLs in column key; a row for each block with a member."""
    h = F.xxhash64("key")
    rows = listed.select(F.pmod(F.shiftright(h, 32), F.lit(blocks)).cast("int").alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(_bits(h))])
    return rows.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(8)])


def filter_urls(pages: DataFrame, listing: DataFrame, rules=RULES, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages.

    A rule decides where one fits; two rules of one length that both fit go by order of host and path. Else the page is
    blocked if its canonical URL is in `listing` (column url), and gets `otherwise` if not. The filter's blocks follow the
    listing without a bound, so it never fills up; they are broadcast up to BROADCAST_BLOCKS and beyond met by an equi-join
    on the block. Possible hits alone go to the exact join, whose keys are the whole canonical URLs, so false positives don't
    matter and none is missed. Listed URLs are made distinct first, by partial aggregation. Null urls, and those without
    ://, have an empty host and path, and are never listed. Repeated rows are judged alike; an empty listing lists nothing,
    no rows give no rows; other columns are ignored.
    """
    keys = cut(listing.select(canonical(F.col("url")).alias("key")).filter("key <> ''").distinct())
    blocks = max(1, -(-keys.count() // PER_BLOCK))
    bloom = blocked_bloom(keys, blocks)
    bloom = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("_by_rule", verdict)
    judged = judged.withColumn("_key", F.when(F.col("rule").isNull() & (F.col("host") != ""), canonical(F.col("url"))))
    h = F.xxhash64("_key")
    block = F.pmod(F.shiftright(h, 32), F.lit(blocks)).cast("int")
    nowhere = -1 - F.pmod(F.xxhash64("page_id"), F.lit(1 << 16)).cast("int")  # rows that need no look are spread over blocks that don't exist
    tested = judged.withColumn("_block", F.when(F.col("_key").isNotNull(), block).otherwise(nowhere))
    met = tested.join(bloom, tested["_block"] == bloom["block"], "left")
    every = F.lit(True)
    for i, bit in enumerate(_bits(h)):
        every = every & (F.col(f"w{i}").bitwiseAND(bit) == bit)
    maybe = met.withColumn("_maybe", F.coalesce(every, F.lit(False)))
    columns = ["page_id", "host", "path", "rule"]
    clear = maybe.filter(~F.col("_maybe")).select(*columns, F.coalesce("_by_rule", F.lit(otherwise)).alias("verdict"))
    hits = maybe.filter("_maybe").select(*columns, "_key").join(keys.withColumnRenamed("key", "_listed"), F.col("_key") == F.col("_listed"), "left")
    return clear.unionByName(hits.select(*columns, F.when(F.col("_listed").isNotNull(), F.lit("block")).otherwise(F.lit(otherwise)).alias("verdict")))


def listing_of(pages: DataFrame) -> DataFrame:
    """A listing that grows with the pages and divides every host: URLs of some canonical forms, spelled in another way, and near misses of the others.

    The choice goes by the md5 of the canonical URL, so it depends on no host. A near miss is the canonical URL with one more
    character; it fills the filter but must not block.
    """
    named = pages.select(canonical(F.col("url")).alias("_key")).filter("_key <> ''")  # once, as a column, since it is used often
    key = F.col("_key")
    bare, query = F.substring_index(key, "?", 1), F.when(F.instr(key, "?") > 0, F.substr(key, F.instr(key, "?") + 1))
    parts = named.select("_key", bare.alias("_bare"), F.coalesce(query, F.lit("")).alias("_query"))
    html = F.when(F.contains("_bare", F.lit("/")), F.lit(".html")).otherwise("")
    spelled = F.concat(F.lit("https://www."), "_bare", html, F.lit("?utm_source=list&"), "_query", F.lit("#top"))
    other = F.concat(F.lit("http://"), "_bare", F.lit("~?"), "_query")
    return parts.select(F.when(F.substring(F.md5("_key"), 1, 1).isin(*LISTED), spelled).otherwise(other).alias("url"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, listing_of(pages))


ORACLE = r"""
WITH parts AS (
  SELECT page_id, url,
    CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*(/[^?#]*)', 1) ELSE '' END AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
  END AS rule,
  CASE WHEN host = '' THEN '' ELSE
    regexp_replace(host, '^(www|m|blog)\.', '') || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(
         string_split(regexp_extract(regexp_extract(url, '^[^#]*'), '\?(.*)$', 1), '&'),
         lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('fbclid', 'gclid', 'ref', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'))), '&'), ''), '')
  END AS key
  FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN key <> '' AND substr(md5(key), 1, 1) IN ('0', '3', '6', '9', 'c') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
