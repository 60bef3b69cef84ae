"""Benchmark decontamination by spaced seeds.

A mask keeps some of the token positions of a window and ignores the rest,
so a window still matches when an ignored token was replaced.  The masked
windows of the benchmark are hashed and joined with those at every position
of every text; a hit gives an item and a diagonal (position in the text less
position in the item).  Around a hit the whole item is laid on the text along
its diagonal, and those few beside it that have hits too, and the item's
tokens that agree are counted.

The masks keep four tokens each and were chosen so that of items with 12, 15,
18 and 20 words of which 60 % stay, at places drawn at random, 99.4, 98.1,
99.9 and 100 % have a hit, and all of 30 words or more.  Items of under 12
words have masks of their own besides: their places are cut into so few
groups that as many words as must stay always leave two (from 7 words on
three) of them in one group, and each two or three places of a group are a
mask.  So no short item whose words stay to the least overlap is missed.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .url_filter import BROADCAST_BLOCKS, KEYS, bloom, may_hold

MASKS = ("11101", "1010011", "110001001", "1100101")
#: Diagonals that count together, so that a few words more or less in the text do not part an item.
BAND = 4
#: A benchmark of up to this many masked windows is broadcast (about 64 MB), a larger one is joined by shuffle.
BROADCAST_SEEDS = 1_000_000
#: Items of fewer words have masks that miss none of them.
SHORT = 12


def places(n: int, overlap: float) -> list[tuple[int, ...]]:
    """Sets of places of an item of n words, of which each choice of as many places as must agree holds one."""
    least = max(1, math.ceil(overlap * n - 1e-9))
    kept = min(least, 2 if n < 7 else 3)
    if kept == 1:
        return [(p,) for p in range(n - least + 1)]
    groups = (least - 1) // (kept - 1)  # so many groups, with kept - 1 places in each, hold fewer than least
    cuts = [n * g // groups for g in range(groups + 1)]
    return [c for a, b in itertools.pairwise(cuts) for c in itertools.combinations(range(a, b), kept)]


def short_masks(lengths: Sequence[int], overlap: float) -> tuple[list[str], dict[int, list[tuple[int, tuple[int, ...]]]]]:
    """(masks, for each length the number of the mask and the places of each of its sets)."""
    masks: dict[str, int] = {}
    by = {}
    for n in lengths:
        by[n] = []
        for at in places(n, overlap):
            mask = "".join("1" if p + at[0] in at else "0" for p in range(at[-1] - at[0] + 1))
            by[n].append((masks.setdefault(mask, len(masks)), at))
    return list(masks), by


def _tokens(df: DataFrame) -> DataFrame:
    """df with _h, the hashes of the words of its text: runs of letters and digits of ASCII and of all characters beyond, in lower case."""
    words = F.expr(r"array_remove(split(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), '')")
    return df.withColumn("_w", words).withColumn("_h", F.expr("transform(_w, w -> xxhash64(w))")).drop("_w")


def _seeds(mask: str, k: int, whole: bool = False) -> str:
    """SQL: for each window of _h, the hash of the positions that the mask keeps; with whole, of an array of its length only."""
    kept = ", ".join("x" if i == 0 else f"get(_h, i + {i})" for i, c in enumerate(mask) if c == "1")
    return f"CASE WHEN size(_h) {'!=' if whole else '<'} {len(mask)} THEN cast(array() as array<bigint>) ELSE transform(slice(_h, 1, size(_h) - {len(mask) - 1}), (x, i) -> xxhash64({k}, {kept})) END"


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: Sequence[str] = MASKS, overlap: float = 0.6) -> DataFrame:
    """(doc_id, item_id, n_matched, n_words, overlap, first_word) of each document and item that overlap enough.

    n_matched counts the item's words that the text has at their place on
    one diagonal with a hit, or on those with hits up to BAND beyond it;
    overlap is its share of the item's n_words; first_word is that diagonal,
    where the item would begin (of equal ones the smallest).  Scraps of an
    item that lie farther apart do not add up.  Items of SHORT words or more,
    but fewer than the longest mask spans, are sought as a whole, too.  Texts or items without
    words match nothing, as do rows whose id is null.  Rows that share a
    document id are tried each, and the best counts.  What is gathered for a
    text and an item has no more diagonals than the text has words.
    """
    items = _tokens(benchmark.select("item_id", "text")).where("item_id is not null and size(_h) > 0").select("item_id", "_h")
    items = stored(items, "benchmark-items")
    sizes = [r[0] for r in items.where(f"size(_h) < {max(SHORT, *map(len, masks))}").select(F.size("_h")).distinct().orderBy(F.expr("1")).collect()]
    whole = len(masks)  # masks from here on are for items of their length alone
    masks = [*masks, *("1" * n for n in sizes if n >= SHORT)]
    own, by = short_masks([n for n in sizes if n < SHORT], overlap)
    seeds = items
    per = [F.transform(F.expr(_seeds(m, k, k >= whole)), lambda x, i: F.struct(x.alias("seed"), i.alias("q"))) for k, m in enumerate(masks)]
    for n, sets in by.items():
        each = ", ".join(f"named_struct('seed', xxhash64({len(masks) + k}, {', '.join(f'get(_h, {p})' for p in at)}), 'q', {at[0]})" for k, at in sets)
        per.append(F.expr(f"CASE WHEN size(_h) = {n} THEN array({each}) ELSE cast(array() as array<struct<seed: bigint, q: int>>) END"))
    masks = [*masks, *own]
    seeds = stored(seeds.select("item_id", F.explode(F.flatten(F.array(*per))).alias("s")).select("s.seed", "item_id", F.col("s.q").alias("q")), "benchmark-seeds")
    text = F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t")  # tells rows of one id apart
    rows = _tokens(docs.select("doc_id", text, "text").where("doc_id is not null"))
    offsets = sorted({i for m in masks for i, c in enumerate(m) if c == "1"})
    shifted = [F.expr(f"slice(_h, {o + 1}, greatest(size(_h) - {o}, 0))").alias(f"h{o}") for o in offsets]
    rows = rows.select("doc_id", "_t", F.posexplode(F.arrays_zip(*shifted)).alias("at", "z"))
    rows = rows.select("doc_id", "_t", "at", *[F.col("z")[f"h{o}"].alias(f"h{o}") for o in offsets])
    rows = rows.select("doc_id", "_t", "at", *[F.expr(f"CASE WHEN h{len(m) - 1} IS NOT NULL THEN xxhash64({k}, {', '.join(f'h{i}' for i, c in enumerate(m) if c == '1')}) END").alias(f"s{k}") for k, m in enumerate(masks)])
    asked = F.array(*[F.col(f"s{k}") for k in range(len(masks))])
    known_seeds = seeds.count()
    if known_seeds <= BROADCAST_SEEDS:
        # places without any known seed go before their seeds become rows
        known = seeds.select("seed").distinct()
        for k in range(len(masks)):
            rows = rows.join(F.broadcast(known.select(F.col("seed").alias(f"s{k}"), F.lit(True).alias(f"f{k}"))), f"s{k}", "left")
        rows = rows.where(" or ".join(f"f{k}" for k in range(len(masks))))
        seeds = F.broadcast(seeds)
    found = rows.select("doc_id", "_t", "at", F.explode(asked).alias("seed")).where("seed is not null")
    blocks = max(16, 1 << (max(1, known_seeds // KEYS) - 1).bit_length())
    if BROADCAST_SEEDS < known_seeds and blocks <= BROADCAST_BLOCKS:
        # only seeds that the filter lets pass are shuffled
        key = F.col("seed").cast("string")
        found = may_hold(found.withColumn("key", key), bloom(seeds.select(key.alias("key")).distinct(), blocks), blocks).drop("key")
    found = found.join(seeds, "seed")
    found = found.select("doc_id", "_t", "item_id", F.expr("cast(at - q as int)").alias("diagonal"))
    hits = stored(found.groupBy("doc_id", "_t", "item_id").agg(F.collect_set("diagonal").alias("_d")), "benchmark-hits")

    keys = hits.select("doc_id", "_t").distinct()
    # a filter of the texts with hits is broadcast, so that little else is shuffled to the exact join with the hits, however many these are
    blocks = min(BROADCAST_BLOCKS, max(16, 1 << (max(1, hits.count() // KEYS) - 1).bit_length()))
    key = F.xxhash64("doc_id", "_t").alias("key")
    texts = may_hold(docs.select("doc_id", text, "text").withColumn("key", key), bloom(keys.select(key), blocks), blocks).drop("key").dropDuplicates(["doc_id", "_t"])
    pairs = hits.join(_tokens(texts), ["doc_id", "_t"]).join(items.withColumnRenamed("_h", "_i"), "item_id")
    near = f"filter(_d, e -> e between d and d + {BAND})"
    agree = f"size(filter(sequence(0, size(_i) - 1), i -> exists(b, e -> coalesce(get(_h, e + i) = get(_i, i), false))))"
    best = f"array_max(transform(transform(array_sort(_d), d -> named_struct('d', d, 'b', {near})), x -> named_struct('m', {agree.replace('exists(b,', 'exists(x.b,')}, 'd', -x.d)))"
    pairs = pairs.select("doc_id", "item_id", F.expr(best).alias("_x"), F.expr("cast(size(_i) as bigint)").alias("n_words"))
    pairs = pairs.where(F.expr("_x.m / n_words") >= overlap).groupBy("doc_id", "item_id").agg(F.max("_x").alias("_x"), F.max("n_words").alias("n_words"))
    return pairs.select("doc_id", "item_id", F.expr("cast(_x.m as bigint)").alias("n_matched"), "n_words", F.expr("_x.m / n_words").alias("overlap"), F.expr("cast(-_x.d as bigint)").alias("first_word"))
