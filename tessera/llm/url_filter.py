"""URL filters: a blocked Bloom filter in front of an exact hash join, in Spark functions only.

Listed canonical URLs are ``host/path/`` prefixes. A page's candidates are the prefixes of its URL:
every suffix of its host at a dot with every prefix of its path that ends in a slash. Each different
candidate is put to the Bloom filter once, and those it passes go to a hash join with the list, which
removes its false positives; the pages of the candidates that are left then meet their rules, those of
candidates of over HOT_PAGES pages by a broadcast (there are few of them). The longest listed prefix decides.

Edge cases: a null url or one without ``://`` has empty host and path and no rule; repeated rows come
out as often as they came in; an empty list gives the default verdict; other columns are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Words of 64 bits in a block; a key sets one bit in each.
LANES = 4
BITS_PER_KEY = 16
#: Blocks up to which the filter (40 bytes a block) is broadcast.
MAX_BROADCAST_BLOCKS = 1 << 18
#: Listed prefixes up to which those found are broadcast; beyond, only candidates of so many pages.
MAX_BROADCAST_RULES, HOT_PAGES = 100_000, 1_000_000


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: host with A-Z lower-cased, path up to ``?`` or ``#``."""
    host = F.translate(F.regexp_extract(url, _SPLIT, 1), _UPPER, _UPPER.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit("lane"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * i).bitwiseAND(63).cast("int")) for i in range(LANES)]


def build_filter(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """Blocked Bloom filter of the `key` column: (block, w0..w3) of the blocks in use; number of blocks."""
    n_blocks = max(1, -(-n_keys * BITS_PER_KEY // (64 * LANES)))
    masks = [m.alias(f"m{i}") for i, m in enumerate(_masks(F.col("key")))]
    blocks = keys.select(_block(F.col("key"), n_blocks).alias("block"), *masks).groupBy("block")
    return blocks.agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(LANES))), n_blocks


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url).

    rules(host, path, action): a rule fits its host and all subdomains where the url's path starts with
    its path, which must end in a slash; the longest wins, on equal length the one later in order.
    """
    listed = rules.select(F.concat("host", "path").alias("key"), F.col("action")).groupBy("key").agg(F.max("action").alias("action"))
    bad = ~F.col("path").endswith("/") | ~F.col("path").startswith("/") | (F.col("host") == "") | F.col("host").contains("/")
    depth = rules.agg(
        F.count_distinct(F.concat("host", "path")).alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels"),
        F.max(F.size(F.split("path", "/")) - 1).alias("slashes"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"),
    ).first()
    if depth["bad"]:
        raise ValueError("a rule needs a host and a path that starts and ends with a slash")
    host, path = canonical(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    own = base.select("*", F.lit(1).cast("long").alias("copies"), F.lit(None).cast("struct<size:int,key:string,action:string>").alias("found"))
    if not depth["n"]:
        rows = own
    else:
        found = _hits(base, listed, depth).select("page_id", "host", "path", F.lit(0).cast("long").alias("copies"), F.struct(F.length("key").alias("size"), "key", "action").alias("found"))
        rows = own.unionByName(found)
    best = rows.groupBy("page_id", "host", "path").agg(F.sum("copies").alias("copies"), F.max("found").alias("found"))
    once = best.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return once.select("page_id", "host", "path", F.col("found.key").alias("rule"), F.coalesce("found.action", F.lit(default)).alias("verdict"))


def _hits(base: DataFrame, listed: DataFrame, depth) -> DataFrame:
    """page_id, host, path, key, action: the listed prefixes of each page."""
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    cut = base.select(
        "*", labels.alias("labels"), parts.alias("parts"),
        F.least(F.size(labels), F.lit(depth["labels"])).alias("n_hosts"), F.least(F.size(parts) - 1, F.lit(depth["slashes"])).alias("n_paths"),
    ).where("n_paths > 0")
    hosts = F.transform(F.sequence(F.lit(1), F.col("n_hosts")), lambda i: F.array_join(F.slice("labels", F.size("labels") - i + 1, i), "."))
    paths = F.transform(F.sequence(F.lit(1), F.col("n_paths")), lambda i: F.concat(F.array_join(F.slice("parts", F.lit(1), i), "/"), F.lit("/")))
    pairs = cut.select("page_id", "host", "path", F.explode(hosts).alias("h"), paths.alias("paths"))
    keys = pairs.select("page_id", "host", "path", "h", F.explode("paths").alias("p")).select("page_id", "host", "path", F.concat("h", "p").alias("key"))
    blocks, n_blocks = build_filter(listed, depth["n"])
    if n_blocks <= MAX_BROADCAST_BLOCKS:  # the size of the filter is bounded by its number of blocks
        blocks = F.broadcast(blocks)
    asked = keys.groupBy("key").agg(F.count(F.lit(1)).alias("pages"))
    probed = asked.withColumn("block", _block(F.col("key"), n_blocks)).join(blocks, "block")
    passed = reduce(lambda a, b: a & b, (F.col(f"w{i}").bitwiseAND(m) != 0 for i, m in enumerate(_masks(F.col("key")))))
    hits = probed.where(passed).select("key", "pages").join(listed.hint("shuffle_hash"), "key")
    if depth["n"] <= MAX_BROADCAST_RULES:  # no more hits than listed prefixes
        return keys.join(F.broadcast(hits.drop("pages")), "key")
    hot = F.broadcast(hits.where(F.col("pages") > HOT_PAGES).drop("pages"))  # at most a row for each HOT_PAGES candidates
    cool = hits.where(F.col("pages") <= HOT_PAGES).drop("pages").hint("shuffle_hash")
    return keys.join(hot, "key").unionByName(keys.join(hot.select("key"), "key", "left_anti").join(cool, "key"))
