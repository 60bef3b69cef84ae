"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents longer than a sequence are cut into pieces of its length; no other
document is cut.  Pieces are placed by best-fit decreasing: longest first,
each into the open sequence whose remaining room is the tightest that holds
it.  Pieces of one length are alike to this rule, and so are sequences with
the same room: the numbers of pieces of each length (as many figures as a
sequence has tokens, whatever the corpus) decide which ranks of each length
go to which sequences.  A segment tree over the remaining capacities finds
the tightest one with an open sequence in logarithmic time.  Spark counts
the lengths, numbers the pieces of each length across all partitions, and
gives each its place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, text_rows
from .parts import Parts, between_spaces, between_white_space, lowered, summed

_PARTS: dict[str, Parts] = {}


def ids_of(vocabulary: str, text: pa.Array, special: str = "<|") -> tuple[np.ndarray, np.ndarray]:
    """All ids of an Arrow array of texts, and how many each has."""
    if vocabulary not in _PARTS:
        from tokenizers import Tokenizer

        _PARTS[vocabulary] = Parts(between_spaces(Tokenizer.from_file(vocabulary)))
    memory = _PARTS[vocabulary]
    words, codes, counts = between_white_space(lowered(text, special))
    ids, sizes = memory.gathered(0, memory.places(words)[codes])
    return ids, summed(sizes, counts)


def pieces(docs: DataFrame, vocabulary: str, most: int = 2048, end: int = 0, special: str = "<|") -> DataFrame:
    """A row for each piece of each document, in a stored table.

    Columns: doc_id, piece (from 0), start (ids of the document before it),
    length, ids_crc32, ids (little-endian unsigned 32-bit integers), part (the
    task that wrote it) and rank (from 0, among the pieces of this length that
    the task wrote).  The vocabulary lower-cases and its tokens hold no white
    space, so a text is encoded by its words.  The string of a special token,
    all of which hold ``special``, gives its id.  Each document ends with the id
    ``end``; a null or empty text has that id alone.  Each row is packed,
    repeated ones and those without a doc_id too.
    """

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
        for rows, text in slices(batches):
            ids, sizes = ids_of(vocabulary, text, special)
            ids = np.insert(ids, np.cumsum(sizes), end).astype("<u4")
            sizes = sizes + 1
            cuts = -(-sizes // most)
            doc = np.repeat(np.arange(len(sizes)), cuts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            length = np.minimum(sizes[doc] - piece * most, most)
            ends = np.cumsum(length)
            order = np.argsort(length, kind="stable")
            found, first, n = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(first, n) + seen[length[order]]
            seen[found] += n
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), length.tolist())]
            offsets = np.concatenate([[0], 4 * ends])
            data = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * most), pa.array(length), pa.array(crc, pa.int64()), data, pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "rank"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return stored(text_rows(docs).mapInArrow(run, f"doc_id {key}, piece int, start long, length long, ids_crc32 long, ids binary, part int, rank long"), "pieces")


class Capacities:
    """A segment tree over the capacities 0 to most: how many open sequences have each."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.open = [0] * (2 * self.width)

    def add(self, capacity: int, n: int) -> None:
        k = capacity + self.width
        while k:
            self.open[k] += n
            k >>= 1

    def tightest(self, size: int) -> int | None:
        """The smallest capacity of size or more that an open sequence has."""
        k = size + self.width
        if self.open[k]:
            return size
        while k > 1 and (k & 1 or not self.open[k + 1]):  # up, to the nearest subtree to the right that has one
            k >>= 1
        if k == 1:
            return None
        k += 1
        while k < self.width:
            k = 2 * k if self.open[2 * k] else 2 * k + 1
        return k - self.width


def best_fit_decreasing(counts, most: int) -> tuple[np.ndarray, int]:
    """(runs, number of sequences) for counts[s] pieces of each length s.

    A run is (length, first rank, first sequence, pieces in each sequence,
    offset of the first of them, sequences): rank first + k goes to sequence
    first sequence + k // pieces, at offset + k % pieces * length.  The result
    is that of placing piece after piece: the tightest sequence stays the
    tightest until a piece no longer fits into it.  A length splits no more
    than one range of alike sequences into three, so there are at most 1 + 2 *
    most ranges, and at most most * (1 + 2 * most) runs, however many pieces.
    """
    tree, ranges, runs, made = Capacities(most), [[] for _ in range(most + 1)], [], 0

    def opened(room, first, n):
        if room and n:
            ranges[room].append((first, n))
            tree.add(room, n)

    for size in range(most, 0, -1):
        rank, left = 0, int(counts[size])
        while left:
            room = tree.tightest(size)
            if room is None:
                room = most
                first, n = made, -(-left // (most // size))
                made += n
            else:
                first, n = ranges[room].pop()
                tree.add(room, -n)
            each = room // size
            full = min(n, left // each)
            for n_bins, per in ((full, each), (1, left - full * each)) if full < n else ((full, each),):
                if n_bins and per:
                    runs.append((size, rank, first, per, most - room, n_bins))
                    opened(room - per * size, first, n_bins)
                    rank, left = rank + n_bins * per, left - n_bins * per
                    first, n = first + n_bins, n - n_bins
            opened(room, first, n)
    return np.array(runs, np.int64).reshape(-1, 6), made


def packed(found: DataFrame, most: int = 2048, ids: bool = True) -> DataFrame:
    """The pieces with sequence_id and offset (places in a sequence have no gaps), and their ids if asked for."""
    spark = found.sparkSession
    seen = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    seen = stored(seen.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    counts = np.zeros(most + 1, np.int64)
    for r in seen.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length: at most ``most``
        counts[r.length] = r.n
    runs, _ = best_fit_decreasing(counts, most)
    known = spark.sparkContext.broadcast(runs[np.lexsort((runs[:, 1], runs[:, 0]))])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"][: int(ids)]]
    numbered = found.join(seen, ["part", "length"]).select(*columns, (F.col("before") + F.col("rank")).alias("rank"))
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != "rank")

    def run(batches):
        size, first, sequence, per, offset, _ = known.value.T
        keys = (size << 48) + first
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            k = rank - first[at]
            placed = [pa.array(sequence[at] + k // per[at]), pa.array(offset[at] + k % per[at] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *placed], names=[*columns, "sequence_id", "offset"])

    return numbered.mapInArrow(run, f"{out}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, pieces) of each packed sequence; pieces are (offset, length, doc_id, piece) in order."""
    row = F.struct("offset", "length", "doc_id", "piece", "ids")
    out = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(row)).alias("rows"))
    joined = F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r.ids)), ""))
    return out.select("sequence_id", "n_tokens", joined.alias("ids"), F.transform("rows", lambda r: F.struct(r.offset, r.length, r.doc_id, r.piece)).alias("pieces"))
