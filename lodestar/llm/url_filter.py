"""URL filters: a blocked Bloom filter before an exact hash join.

Each URL asks for a few keys: its canonical form with and without the path,
and each suffix of its host with each path prefix that some rule has the
length of.  A key is looked up in one block of the filter, eight 64-bit words
of which it sets one bit each.  The blocks are a table by number; it is
broadcast up to a size that is checked.  Only keys that may be listed go on to
the exact join, which removes the false positives.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = 8
#: Keys for each block: 32 bits a key.
KEYS = 16
#: A list up to this many keys is joined by broadcast, a longer one by shuffle.
BROADCAST_KEYS = 100_000
#: Blocks of the filter that are broadcast at most (72 bytes each, 38 MB); more are joined by shuffle.
BROADCAST_BLOCKS = 1 << 19

LIST = "key string, rule string, verdict string, size int"


def host_of(url: str) -> str:
    """SQL: what lies between the first :// and the next /, ? or #, with A-Z in lower case; null or without :// gives ''."""
    rest = f"substring({url}, instr({url}, '://') + 3)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"CASE WHEN coalesce(instr({url}, '://'), 0) = 0 THEN '' ELSE translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{upper}', '{upper.lower()}') END"


def path_of(url: str) -> str:
    """SQL: what follows the host up to ? or #."""
    rest = f"substring({url}, instr({url}, '://') + 3)"
    return f"CASE WHEN coalesce(instr({url}, '://'), 0) = 0 THEN '' ELSE regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) END"


def canonical(host: str, path: str) -> str:
    """SQL: host without a leading www., m. or blog., and path without a trailing slash, .html or .htm."""
    return f"concat(regexp_replace({host}, '^(www|m|blog)[.]', ''), regexp_replace({path}, '(/|[.]html?)$', ''))"


def listed(spark: SparkSession, rules: Iterable[tuple[str, str, str]], urls: DataFrame | None = None) -> DataFrame:
    """The list of a filter: rules (host, path prefix, verdict), and blocked canonical URLs (the first column of urls); one without a path stands for all pages of its host."""
    rows = [(f"r\t{h}\t{p}", h + p, v, len(h + p)) for h, p, v in rules]
    out = spark.createDataFrame(rows, LIST)
    if urls is not None:
        url = F.col(urls.columns[0])
        out = out.unionByName(urls.where(url.isNotNull()).select(F.concat(F.lit("u\t"), url).alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(0).alias("size")).distinct())
    return out


def _bits(key: str, blocks: int) -> tuple[str, str]:
    """SQL: the block of a key, and its hash from which each word's bit is taken."""
    return f"pmod(xxhash64({key}), {blocks}L)", f"xxhash64({key}, 7)"


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter: (block, w0 .. w7), a row for each block that has a key."""
    block, h = _bits("key", blocks)
    bit = lambda i: f"bit_or(shiftleft(1L, cast(shiftrightunsigned({h}, {6 * i}) & 63 as int)))"
    return keys.groupBy(F.expr(block).alias("block")).agg(*[F.expr(bit(i)).alias(f"w{i}") for i in range(WORDS)])


def may_hold(rows: DataFrame, words: DataFrame, blocks: int) -> DataFrame:
    """The rows whose column key the filter may hold; the filter is broadcast."""
    block, h = _bits("key", blocks)
    mask = " and ".join(f"(shiftrightunsigned(_w{i}, cast(shiftrightunsigned({h}, {6 * i}) & 63 as int)) & 1) = 1" for i in range(WORDS))
    words = words.select(F.col("block").alias("_b"), *[F.col(f"w{i}").alias(f"_w{i}") for i in range(WORDS)])
    return rows.join(F.broadcast(words), F.expr(f"{block} = _b and {mask}")).drop("_b", *[f"_w{i}" for i in range(WORDS)])


def filtered(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, listed) of each page.

    rule is the longest one that fits (by length, then by text) and decides
    the verdict; else a listed canonical URL or host is blocked, and the rest gets
    ``default``.  A null URL or one without :// has empty host and path and
    fits nothing.  Rows may repeat or have a null key: each gives its row.
    """
    n = rules.count()
    blocks = max(16, 1 << (max(1, n // KEYS) - 1).bit_length())
    words = bloom(rules, blocks)
    lengths = [r[0] for r in rules.where("rule is not null").select(F.expr("length(split(key, '\t')[2])")).distinct().orderBy(F.expr("1")).collect()]
    base = pages.select(F.col(key).alias("page_id"), F.expr(host_of(url)).alias("host"), F.expr(path_of(url)).alias("path"))
    urls = base.where("host != ''").select("host", "path").distinct().withColumn("_parts", F.split("host", "[.]"))
    # only suffixes of as many labels as some rule's host has: a host of very many labels has no more of them
    depths = [r[0] for r in rules.where("rule is not null").select(F.expr("size(split(split(key, '\t')[1], '[.]'))")).distinct().orderBy(F.expr("1")).collect()]
    suffixes = f"transform(filter(array({', '.join(map(str, depths)) or '0'}), d -> d between 1 and size(_parts)), d -> array_join(slice(_parts, size(_parts) - d + 1, d), '.'))"
    prefixes = f"filter(array({', '.join(map(str, lengths)) or '-1'}), n -> n between 0 and length(path))"
    asked = f"concat(flatten(transform({suffixes}, h -> transform({prefixes}, n -> concat('r\t', h, '\t', left(path, n))))), array(concat('u\t', {canonical('host', 'path')}), concat('u\t', {canonical('host', "''")})))"
    # the filter: each key of each distinct URL with the words of its block, by number; then the exact join
    block, h = _bits("key", blocks)
    asks = urls.select("host", "path", F.explode(F.expr(asked)).alias("key")).withColumn("block", F.expr(block)).alias("k")
    known = F.broadcast(words) if blocks <= BROADCAST_BLOCKS else words
    mask = " and ".join(f"(shiftrightunsigned(f.w{i}, cast(shiftrightunsigned({h.replace("key", "k.key")}, {6 * i}) & 63 as int)) & 1) = 1" for i in range(WORDS))
    hits = asks.join(known.alias("f"), F.expr(f"k.block = f.block and {mask}")).select("k.host", "k.path", "k.key")
    exact = F.broadcast(rules) if n <= BROADCAST_KEYS else rules
    hits = hits.join(exact, "key").groupBy("host", "path").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct("size", "rule", "verdict"))).alias("best"), F.max(F.when(F.col("rule").isNull() & F.col("verdict").isNotNull(), F.col("verdict"))).alias("own")
    )
    found = base.join(hits, ["host", "path"], "left")
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", "own", F.lit(default)).alias("verdict"), F.col("own").isNotNull().alias("listed"))
