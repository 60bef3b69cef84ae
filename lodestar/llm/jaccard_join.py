"""N-gram Jaccard join by parity sketches.

A text is the set of its distinct word n-grams.  The set's hashes are XORed
as single bits into a sketch: two sketches differ in no more bits than the
sets differ in members, so the Hamming distance is a lower bound of the
symmetric difference.

Within a size band, sets that may link differ in at most d members.  The
sketch is dealt by hash into P = d + 1 + s words; a linked pair agrees in
1 + s words at least (pigeonhole).  Words with few members say little, so each
set leaves out its s weakest, ordered by members and then by hash, and joins on
the other d + 1.  Of the words in which a pair agrees, the strongest has s
weaker ones beside it in either set and is left out by neither: no pair is
lost.

First a few words of each set find most links: each bucket's members meet
its most popular member, and those that a sharp sketch lets pass are
verified.  Then all words are asked, but only of members that still bear
names of different components (one component may have several there, which
costs pairs and loses none): again with the most popular member first, then of
all that is left.  Before that last step each component gets one name, since
there all members of a bucket meet that differ in it: two names of a group of
linked texts would pair its halves.  A small sketch within the bucket's join and the sharp
one after it leave few of the unlinked pairs, and what passes is verified on
the n-grams of the whole texts.  That gives the exact components of the link
graph without all pairs of a group of linked texts.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, hashed, mixed, released, slices, stored, translated, words_of
from .components import starred

_U = np.uint64


@dataclass(frozen=True)
class Bands:
    """Size bands for a least similarity of ``percent`` / 100; each is ``ratio`` times as wide as the last."""

    percent: int
    ratio: float = 1.5

    def of(self, n: int) -> int:
        """The band of a set of n members: the largest k with low(k) <= n."""
        k = max(0, int(math.log(n) / math.log(self.ratio)) - 1)
        while self.low(k + 1) <= n:
            k += 1
        return k

    def low(self, k: int) -> int:
        return max(k + 1, math.ceil(self.ratio**k))

    def most_apart(self, total: int) -> int:
        """The largest symmetric difference of a linked pair whose sizes sum to total."""
        return (100 - self.percent) * total // (100 + self.percent)

    def spans(self, n: int) -> list[int]:
        """The bands a set of n members takes part in: its own, and those above whose sets it may link with."""
        k = self.of(n)
        most = 100 * n // self.percent
        return list(range(k, self.of(most) + 1))

    def shape(self, k: int) -> tuple[int, int, int, int]:
        """Of band k: words P, words s that are left out, and words of the small and of the sharp sketch.

        The small sketch has 8 bits for each member that may differ, and 4 in
        large sets, up to 256 words: unlike sets differ there in a good part
        more bits than the bound allows.  The sharp one has 16 and tells sets
        apart that differ in a tenth more members than linked ones may; folded,
        it is the small one.
        """
        d = self.most_apart(2 * (self.low(k + 1) - 1))
        s = math.ceil(0.3 * (d + 1)) + 1
        small = max(4, math.ceil(d / 8)) if d <= 512 else max(64, min(256, math.ceil(d / 16)))
        return d + 1 + s, s, small, small * max(2, math.ceil(d / 4 / small))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct n-grams of a sequence of word hashes, as sorted hashes; fewer words make one n-gram, none make none."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out = mixed(out * _U(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j])
    return np.unique(out) if n > 1 else np.unique(mixed(out))


def parity(members: np.ndarray, words: int) -> np.ndarray:
    """A sketch of 64 * words bits: each member flips one bit."""
    part = ((members >> _U(32)) * _U(words)) >> _U(32)
    at = (part * _U(64) + (members & _U(63))).astype(np.int64)
    odd = (np.bincount(at, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(_U)


def dealt(members: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """A sketch of very wide words, each carried by the XOR of its members' hashes, and how many members each word has.

    Members flip bits so far apart that unlike words are alike by chance only
    as 64-bit hashes are; members are sorted, and so are their words.
    """
    part = (((members >> _U(32)) * _U(words)) >> _U(32)).astype(np.int64)
    size = np.bincount(part, minlength=words)
    out = np.zeros(words, _U)
    at = np.flatnonzero(size)
    if len(at):
        out[at] = np.bitwise_xor.reduceat(mixed(members), (np.cumsum(size) - size)[at])
    return out, size


def class_of(members: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit name, as two signed longs."""
    name = hashlib.blake2b(members.tobytes(), digest_size=16).digest()
    return int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True)


def word_sets(text: pa.Array, n: int):
    """The n-gram set of each text of an Arrow array."""
    counts, words = words_of(translated(text, LOWER))
    codes = hashed(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
    end = 0
    for c in counts:
        yield shingles(codes[end : end + c], n)
        end += int(c)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, which, text): which is a hash of the text, that tells rows of one doc_id apart; whole numbers become long."""
    key = F.col("doc_id").cast("long") if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int") else F.col("doc_id")
    return docs.select(key.alias("doc_id"), F.xxhash64("text").alias("which"), "text")


def named(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, which, hi, lo, n) of each document of ``_keyed``: its set's name and size."""

    def run(batches):
        for rows, text in slices(batches):
            out = [(*class_of(members), len(members)) for members in word_sets(text, n)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("which"), *(pa.array(c, pa.int64()) for c in zip(*out))], names=["doc_id", "which", "hi", "lo", "n"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, which long, hi long, lo long, n long")


SKETCHES = "cid long, n long, band int, keys array<long>, few array<long>, small array<long>, sharp array<long>"
#: Words by which a set meets others at first.
FEW = 12


def sketches(texts: DataFrame, n: int, percent: int, ratio: float = 1.5) -> DataFrame:
    """A row for each class (cid, hi, lo, text) and band that it takes part in; a text that is not of the class is passed over."""
    bands = Bands(percent, ratio)

    def run(batches):
        shapes: dict[int, tuple[int, int, int, int]] = {}
        seen = set()  # rows that repeat a document: one number for each class of the task
        for rows, text in slices(batches):
            out = ([], [], [], [], [], [], [])
            for cid, hi, lo, members in zip(*(rows.column(c).to_pylist() for c in ("cid", "hi", "lo")), word_sets(text, n)):
                if cid in seen or class_of(members) != (hi, lo):
                    continue
                seen.add(cid)
                for k in bands.spans(len(members)):
                    p, s, small, sharp = shapes.get(k) or shapes.setdefault(k, bands.shape(k))
                    (long, size), wide = dealt(members, p), parity(mixed(members), sharp)
                    keys = mixed(long + mixed(np.arange(p, dtype=_U) + _U(k << 32)))
                    keys = keys[np.lexsort((keys, size))[s:]]
                    few = np.partition(keys, FEW)[:FEW] if len(keys) > FEW else keys
                    for column, value in zip(out, (cid, len(members), k, keys, few, np.bitwise_xor.reduce(wide.reshape(-1, small)), wide)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), *map(_lists, out[3:])], names=["cid", "n", "band", "keys", "few", "small", "sharp"])

    return texts.select("cid", "hi", "lo", "text").mapInArrow(run, SKETCHES)


def _near(percent: int, a: str, b: str, sketch: str):
    """The conditions on sizes and sketches that each linked pair meets."""
    most = f"floor({100 - percent} * ({a}.n + {b}.n) / {100 + percent})"
    return F.expr(f"abs({a}.n - {b}.n) <= {most} and {_apart(a, b, sketch)} <= {most}")


def _apart(a: str, b: str, sketch: str) -> str:
    return f"aggregate(zip_with({a}.{sketch}, {b}.{sketch}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the distinct pairs (a, b) of classes, the links, as a stored table: (a, b, both, n_a, n_b), the sizes of intersection and sets.

    Each class is read as the text of its smallest document; of rows that
    share its id, the one with the class's hash.
    """

    def run(batches):
        for rows, text in slices(batches, "text_a", 1 << 20):
            other = rows.column("text_b").cast(pa.large_string())
            out = []
            ids = (rows.column(c).to_pylist() for c in ("a", "b", "hi_a", "lo_a", "hi_b", "lo_b"))
            for a, b, ha, la, hb, lb, x, y in zip(*ids, word_sets(text, n), word_sets(other, n)):
                if class_of(x) == (ha, la) and class_of(y) == (hb, lb):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        out.append((a, b, both, len(x), len(y)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], names=["a", "b", "both", "n_a", "n_b"])

    texts = docs.where("doc_id is not null")
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("cid").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "which", "hi", "lo")]), side)
    pairs = known = stored(pairs, "jaccard-pairs")
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("doc_id").alias(f"rep_{side}"), F.col("which").alias(f"which_{side}"), F.col("text").alias(f"text_{side}")), [f"rep_{side}", f"which_{side}"])
    links = pairs.select("a", "b", "hi_a", "lo_a", "hi_b", "lo_b", "text_a", "text_b").mapInArrow(run, "a long, b long, both long, n_a long, n_b long").distinct()
    links = stored(links, "jaccard-links")
    released(docs.sparkSession, known)
    return links


def _sharp(pairs: DataFrame, made: DataFrame, percent: int) -> DataFrame:
    """(a, b, far) of the pairs (a, b, band), each once and with its two classes in the given order, that the sharp sketch lets pass."""
    pairs = pairs.repartition("a", "band").distinct()  # dealt as the first join wants it
    for side in ("a", "b"):
        pairs = pairs.join(made.select(F.col("cid").alias(side), "band", F.struct("n", "sharp").alias("s" + side)), [side, "band"])
    return pairs.where(_near(percent, "sa", "sb", "sharp")).select("a", "b", F.expr(f"{_apart('sa', 'sb', 'sharp')} / (sa.n + sb.n)").alias("far"))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _met(keys: DataFrame) -> DataFrame:
    """(a, b, band): each class a of the buckets (key, cid, band, component) with their most popular members b, where these are of other components."""
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    sets = keys.join(sizes, "key").groupBy("cid", "band", "component").agg(F.sum("size").alias("p"), F.collect_list("key").alias("keys"))
    keys = stored(sets.select("cid", "band", "component", "p", F.explode("keys").alias("key")), "jaccard-met")
    top = keys.groupBy("key").agg(F.max(F.struct("p", "component", "cid")).alias("x"))
    return keys.join(top, "key").where("component != x.component").select(F.col("cid").alias("a"), F.col("x.cid").alias("b"), "band")


def _with_component(df: DataFrame, parts: DataFrame) -> DataFrame:
    """df with the component of each cid; a class without links is its own."""
    return df.join(parts.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, ratio: float = 1.5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document: the smallest doc_id reachable by links.

    Words are runs of other characters than ASCII white space, A-Z in lower
    case; two texts link when 100 * |intersection| >= percent * |union| of
    their n-gram sets.  A text of fewer than n words is one n-gram.  A null
    text counts as empty; an empty set links with nothing and is its own
    component.  Rows with a null doc_id take no part and get a null
    component; rows that repeat a doc_id each get their component.  A doc_id
    may be of any type that has an order.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = _keyed(docs)
    own = stored(named(docs, n), "jaccard-own")
    classes = own.where("n > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "which")).alias("x")).select("hi", "lo", F.col("x.doc_id").alias("rep"), F.col("x.which").alias("which"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
    texts = docs.withColumnRenamed("doc_id", "rep").join(classes, ["rep", "which"])
    made = stored(sketches(texts, n, percent, ratio), "jaccard-sketches")
    released(spark)

    def linked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs asked, of each class with the nearest that the sharp sketch lets pass, and the links among them."""
        near = _sharp(pairs, made, percent).groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b"))
        near = stored(near.select(*_ordered("a", "b")), "jaccard-near")
        return near, verified(docs, near, classes, n, percent)

    # links by a few words; one round of stars gives most of their components one name
    asked, links = linked(_met(made.select("cid", "band", F.col("cid").alias("component"), F.explode("few").alias("key"))))
    edges, parts = starred(links, 1)
    released(spark, links)

    # what meets across components in any word: again with the most popular members first, then all that still does
    keys = _with_component(made.select("cid", "band", "keys"), parts).select("cid", "band", "component", F.explode("keys").alias("key"))
    mixed_keys = keys.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    mixed_keys = stored(mixed_keys, "jaccard-mixed")
    released(spark)
    open_ = stored(keys.join(mixed_keys, "key").select("key", "cid", "band", "component"), "jaccard-open")
    released(spark, mixed_keys)
    more, links = linked(_met(open_))
    asked = asked.union(more)
    edges, parts = starred(edges.union(links.select("a", "b")))  # to the end: no pairs within what is linked already
    released(spark, links)
    open_ = _with_component(open_.drop("component"), parts).join(made.select("cid", "band", "n", "small"), ["cid", "band"])
    x, y = open_.alias("x"), open_.alias("y")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & _near(percent, "x", "y", "small"))
    rest = stored(rest.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), "x.band"), "jaccard-rest")
    released(spark)
    rest = stored(_sharp(rest, made, percent).select(*_ordered("a", "b")).distinct().join(asked, ["a", "b"], "left_anti"), "jaccard-sharp")
    released(spark, made)
    links = verified(docs, rest, classes, n, percent)
    _, parts = starred(edges.union(links.select("a", "b")))

    of = stored(_with_component(classes, parts), "jaccard-components")
    least = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = stored(of.join(least, "component").select("hi", "lo", "component_id"), "jaccard-ids")
    found = own.join(ids, ["hi", "lo"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))
