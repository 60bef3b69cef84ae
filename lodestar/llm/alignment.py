"""Alignment of the tokens of two vocabularies over the same bytes.

A is a byte-level BPE that reads a space and the text, B a SentencePiece
model that adds that space itself.  The bytes of all documents of an Arrow
batch stand one after another.  The ends of all A tokens and of all B tokens
are counted by place at once; where both end is a cut, and the running
numbers of ends and cuts give each token's group, each linked pair of tokens
and, at the documents' own ends, each document's sums.

Two tokens are linked if their byte ranges overlap.  The overlap of two
tokens has no end of either kind inside, so there is one linked pair for
each place where a token ends.

Spark sums how often each pair of ids is linked.  A document's figures on
these counts come from the table of counts itself: broadcast while it has no
more rows than a stated number, else by a join of the documents' distinct
pairs with it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, slices, stored, text_rows
from .parts import Parts, at_single_spaces, behind_space, pieces, summed

MARK = "\u2581"
#: Pairs of ids whose counts are broadcast, some 16 bytes each.
BROADCAST = 8_000_000


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligned:
    """Tokens of the documents of a batch that have any: ids of A and B, their ends by byte, and how many each document has."""

    def __init__(self, ids, sizes, lengths, counts):
        (self.a, self.b), (n_a, n_b) = ids, counts
        self.n_a, self.n_b = n_a, n_b
        total = int(lengths.sum())
        self.end_a, self.end_b = np.cumsum(sizes[0]), np.cumsum(sizes[1])
        ends_a, ends_b = (np.bincount(e, minlength=total + 1) for e in (self.end_a, self.end_b))
        self.cut = (ends_a > 0) & (ends_b > 0)
        either = (ends_a > 0) | (ends_b > 0)
        self.cuts = np.cumsum(self.cut)
        stops = np.cumsum(lengths)
        self.n_groups = np.diff(self.cuts[stops], prepend=0)
        self.n_links = np.diff(np.cumsum(either)[stops], prepend=0)
        at = np.flatnonzero(either) - 1
        self.link_a, self.link_b = np.cumsum(ends_a)[at], np.cumsum(ends_b)[at]
        self.group_a, self.group_b = self.cuts[self.end_a - 1], self.cuts[self.end_b - 1]


class Aligner:
    """Both vocabularies, with the bytes and the decimal names of their ids."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        first = Tokenizer.from_file(a)
        first.encode_special_tokens = True
        second = sentencepiece.SentencePieceProcessor(model_file=b)
        self.parts = Parts(behind_space(first), pieces(second))
        stands, names = byte_characters(), first.get_vocab()
        self.size_a, self.size_b = max(names.values()) + 1, second.get_piece_size()
        spelled = [b""] * self.size_a
        for s, i in names.items():
            spelled[i] = bytes(stands[c] for c in s) if all(c in stands for c in s) else s.encode()
        other = [bytes([int(s[3:5], 16)]) if second.is_byte(i) else s.replace(MARK, " ").encode() for i, s in ((i, second.id_to_piece(i)) for i in range(self.size_b))]
        self.spelled = [pa.array(x, pa.large_binary()) for x in (spelled, other)]
        self.lengths = [np.fromiter(map(len, x), np.int64, len(x)) for x in (spelled, other)]
        # the decimal form of each id with what follows it: within a run of tokens, or at the end of a group's run
        self.decimal = pa.array([f"{i}{e}" for n, last in ((self.size_a, "|"), (self.size_b, ";")) for i in range(n) for e in (",", last)], pa.large_binary())

    def align(self, text: pa.Array) -> tuple[np.ndarray, Aligned]:
        """(which texts have tokens, their tokens).

        A text has none if it is empty or if the bytes of its A or B tokens
        differ from a space and the text.
        """
        raw, offsets = bytes_of(text)
        whole = np.insert(np.frombuffer(raw, np.uint8), offsets[:-1], 32)
        lengths = np.diff(offsets) + 1
        values, codes, per = at_single_spaces(text)
        at = self.parts.places(values)[codes]
        ids, counts = [], []
        for k in (0, 1):
            found, n = self.parts.gathered(k, at)
            ids.append(found)
            counts.append(summed(n, per))
        ok = lengths > 1
        for k in (0, 1):
            ok &= summed(self.lengths[k][ids[k]], counts[k]) == lengths

        def kept():
            return [i[np.repeat(ok, n)] for i, n in zip(ids, counts)], whole[np.repeat(ok, lengths)], lengths[ok]

        some, want, sizes = kept()
        bad = np.zeros(len(want), bool)
        for k in (0, 1):
            bad |= np.frombuffer(bytes_of(self.spelled[k].take(pa.array(some[k], pa.int64())))[0], np.uint8) != want
        if bad.any():
            ok[np.flatnonzero(ok)[summed(bad.astype(np.int64), sizes) > 0]] = False
            some, want, sizes = kept()
        return ok, Aligned(some, [self.lengths[k][some[k]] for k in (0, 1)], sizes, [n[ok] for n in counts])

    def digests(self, x: Aligned) -> list[str]:
        """SHA-256 of the groups of each document, written ``a1,a2|b1;a3|b2,b3``."""
        groups = int(x.cuts[-1])
        in_a, in_b = (np.bincount(g, minlength=groups) for g in (x.group_a, x.group_b))
        codes = np.empty(len(x.a) + len(x.b), np.int64)
        codes[np.arange(len(x.a)) + (np.cumsum(in_b) - in_b)[x.group_a]] = 2 * x.a.astype(np.int64) + x.cut[x.end_a]
        codes[np.arange(len(x.b)) + np.cumsum(in_a)[x.group_b]] = 2 * (self.size_a + x.b.astype(np.int64)) + x.cut[x.end_b]
        data, offsets = bytes_of(self.decimal.take(pa.array(codes)))
        stops = offsets[np.cumsum(x.n_a + x.n_b)].tolist()
        view = memoryview(data)
        return [hashlib.sha256(view[i : j - 1]).hexdigest() for i, j in zip([0, *stops], stops)]


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    return _ALIGNERS.get((a, b)) or _ALIGNERS.setdefault((a, b), Aligner(a, b))


def _spread(ok: np.ndarray, values, kind) -> np.ndarray:
    """Values of the texts that have tokens, and zeros for the others."""
    out = np.zeros(len(ok), kind)
    out[ok] = values
    return out


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each document, in a stored table: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times, row.

    pairs are the distinct linked pairs of ids, as id of A * size of B + id of
    B, and times says how many links of the document have each.  row numbers
    the rows.  A text that is null or empty, or that one of the vocabularies
    doesn't give back byte for byte, has zeros, an empty string and no pairs.
    Repeated rows and those without a doc_id have rows of their own.  The
    strings of special tokens are plain text.
    """

    def run(batches):
        tool = aligner(a, b)
        for rows, text in slices(batches):
            ok, x = tool.align(text)
            sha = np.full(len(ok), "", object)
            sha[ok] = tool.digests(x)
            pair = x.a[x.link_a].astype(np.int64) * tool.size_b + x.b[x.link_b]
            space = tool.size_a * tool.size_b
            keys, times = np.unique(np.repeat(np.arange(len(x.n_links)), x.n_links) * space + pair, return_counts=True)
            distinct = np.bincount(keys // space, minlength=len(x.n_links))
            offsets = pa.array(np.concatenate([[0], np.cumsum(_spread(ok, distinct, np.int64))]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *(pa.array(_spread(ok, v, np.int64)) for v in (x.n_a, x.n_b, x.n_groups, x.n_links)), pa.array(sha, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(keys % space)), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    out = text_rows(docs).mapInArrow(run, f"doc_id {key}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, id_a, id_b, links, best) over all documents, in a stored table; best tells whether no pair with this id of B has more links."""
    sums = found.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("links"))
    sums = stored(sums.withColumn("id_b", F.col("pair") % size_b), "pairs")
    top = sums.groupBy("id_b").agg(F.max("links").alias("top"))  # as many rows as B has ids
    out = sums.join(F.broadcast(top), "id_b")
    return stored(out.select("pair", F.expr(f"pair div {size_b}").alias("id_a"), "id_b", "links", (F.col("links") == F.col("top")).alias("best")), "pair-counts")


def scored(found: DataFrame, counts: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """The rows of ``aligned`` with n_best (links whose count is the highest of their id of B, ties included) and count_sum (over links)."""
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if counts.count() > broadcast:
        one = found.select("row", F.inline(F.arrays_zip("pairs", "times"))).join(counts.select(F.col("pair").alias("pairs"), "links", "best"), "pairs")
        sums = one.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))
        return found.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).select(columns)
    spark = found.sparkSession
    rows = counts.select("pair", "links", "best").toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast([rows.column(c).to_numpy() for c in ("pair", "links", "best")])
    plain = [c for c in columns if c not in ("n_best", "count_sum")]

    def run(batches):
        pair, links, best = known.value
        for batch in batches:
            lists = batch.column("pairs")
            at = np.searchsorted(pair, lists.flatten().to_numpy())
            times, per = batch.column("times").flatten().to_numpy(), lists.value_lengths().to_numpy()
            more = {"n_best": summed(times * best[at], per), "count_sum": summed(times * links[at], per)}
            yield pa.RecordBatch.from_arrays([pa.array(more[c], pa.int64()) if c in more else batch.column(c) for c in columns], names=columns)

    kinds = {f.name: f.dataType.simpleString() for f in found.schema} | {"n_best": "long", "count_sum": "long"}
    return found.select(*plain, "pairs", "times").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def groups(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each group of each document: doc_id, group (from 0), first and last byte of the text with its space, ids_a, ids_b."""

    def run(batches):
        tool = aligner(a, b)
        for rows, text in slices(batches):
            ok, x = tool.align(text)
            ends = np.flatnonzero(x.cut)
            doc = np.repeat(np.flatnonzero(ok), x.n_groups)
            group = np.arange(len(ends)) - np.repeat(np.cumsum(x.n_groups) - x.n_groups, x.n_groups)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            base = np.repeat(starts[np.cumsum(x.n_groups) - x.n_groups], x.n_groups) if len(ends) else ends
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(g, minlength=len(ends)))]), pa.int32()), pa.array(i, pa.int32())) for g, i in ((x.group_a, x.a), (x.group_b, x.b))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(doc)), pa.array(group, pa.int64()), pa.array(starts - base), pa.array(ends - base), *lists], names=["doc_id", "group", "first", "last", "ids_a", "ids_b"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return text_rows(docs).mapInArrow(run, f"doc_id {key}, group long, first long, last long, ids_a array<int>, ids_b array<int>")
