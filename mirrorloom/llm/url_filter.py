"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

#: Bits of the Bloom filter for each listed URL; a block has 8 words of 32 bits.
BITS_PER_KEY, BLOCK_BITS = 16, 256
#: A filter of this size at most is broadcast (20 million listed URLs); a larger one is joined by block.
MAX_BROADCAST_BYTES = 64 << 20
# Odd multipliers, one for each word of a block, that pick the word's bit.
_SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without www., m. or blog. and port, path without .html and closing slashes; null without host."""
    # The very end: $ would also stand before a closing line break (\n, \r, U+0085, U+2028), which belongs to the address.
    bare = F.regexp_replace(F.regexp_replace(host, r"^(www|m|blog)\.", ""), r":[0-9]*\z", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(F.regexp_replace(path, r"/+\z", ""), r"\.html?\z", "")))


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """The filter as rows: block, and its 8 words of 32 bits. keys: the column key."""
    h = F.xxhash64("key")
    words = [F.bit_or(_bit(h, i)).alias(f"w{i}") for i in range(8)]
    return keys.groupBy(_block(h, n_blocks).alias("block")).agg(*words)


def _block(h: Column, n_blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(n_blocks))


def _bit(h: Column, i: int) -> Column:
    """The bit of word i: five bits of the low half of the hash times an odd number below 2**31."""
    product = h.bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(_SALTS[i] >> 1 | 1)
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(product.bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, url_col: str = "url", max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """pages with host, path, rule, verdict and listed (whether the canonical URL is on the list).

    rules: (verdict, host and path), as ("block", "com/en/"). A rule fits its host and all
    its subdomains if the path starts with the rule's; the longest that fits wins, and its
    verdict goes before the list. Without a rule a page is blocked if its canonical URL is
    listed, else allowed. listed: a table whose column ``key`` holds canonical URLs; nulls and
    repeated rows in it don't matter. A null URL, or one without ``://``, has an empty host
    and path, fits no rule and is not listed. Columns of pages named like the new ones are
    renamed source_<name>.

    The list may be of any size: its filter has BITS_PER_KEY bits for each key and is broadcast
    only if it is smaller than max_broadcast, else joined by block (pages without key stay spread as they were read). Pages that miss
    go no further; possible hits meet the list in an exact join, which removes false positives.
    """
    new = ("host", "path", "rule", "verdict", "listed")
    base = pages.select(*[F.col(f"`{c}`").alias(f"source_{c}" if c.lower() in new else c) for c in pages.columns])
    url = F.col(f"`{f'source_{url_col}' if url_col.lower() in new else url_col}`").cast("string")
    key, block, hit, exact_key, *word = fresh(base, "canonical_url", "bloom_block", "may_be_listed", "listed_url", *[f"w{i}" for i in range(8)])
    rule = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for what, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last that fits is the longest
        if what not in ("allow", "block"):
            raise ValueError(f"a rule is allow or block, not {what}")
        host, slash, path = name.partition("/")
        fits = ((F.col("host") == host.lower()) | F.col("host").endswith(f".{host.lower()}")) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, what).otherwise(verdict)
    judged = base.withColumn("host", url_host(url)).withColumn("path", url_path(url))
    judged = judged.withColumns({"rule": rule, "verdict": verdict, key: canonical(F.col("host"), F.col("path"))})

    keys = materialize(listed.select(F.col("key").cast("string")).dropna().distinct(), "listed")
    n_blocks = max(1, -(-keys.count() * BITS_PER_KEY // BLOCK_BITS))
    blocks = materialize(bloom_blocks(keys, n_blocks).toDF(block, *word), "blocks")
    if n_blocks * BLOCK_BITS // 4 <= max_broadcast:  # eight longs and the number of the block in memory
        blocks = F.broadcast(blocks)
    h = F.xxhash64(key)
    probed = judged.withColumn(block, F.when(F.col(key).isNotNull(), _block(h, n_blocks)).otherwise(-1 - F.spark_partition_id())).join(blocks, block, "left")
    maybe = F.lit(True)
    for i in range(8):
        maybe = maybe & (F.col(word[i]).bitwiseAND(_bit(h, i)) != 0)
    probed = probed.withColumn(hit, F.coalesce(maybe, F.lit(False))).drop(block, *word)
    probed = materialize(probed, "probed")
    missed = probed.filter(~F.col(hit)).withColumn("listed", F.lit(False))
    exact = keys.select(F.col("key").alias(exact_key), F.lit(True).alias("listed"))
    hits = probed.filter(F.col(hit)).join(exact, F.col(key) == F.col(exact_key), "left").drop(exact_key).withColumn("listed", F.coalesce("listed", F.lit(False)))
    out = missed.unionByName(hits)
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow"))).drop(key, hit)
