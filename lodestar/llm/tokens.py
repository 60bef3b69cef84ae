"""Token ids in length-delimited binary files.

A shard is a data file of records and an index file beside it.  A record is
its payload's length (8 bytes), the masked CRC-32 of those 8 bytes, the
payload, and the masked CRC-32 of the payload; all integers are little
endian.  The payload is the document's key (8 bytes), a byte that tells
whether the key is null and how wide an id is (2 or 4), and the ids.  The
index has a fixed-size entry for each record: key, offset in the data file,
number of ids, and the null flag.  It is all that a shuffled reader needs
to fetch records in any order.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, slices, stored

ENTRY = np.dtype([("key", "<i8"), ("offset", "<u8"), ("n", "<u4"), ("null", "<u4")])
#: Text of a shard at most, as far as ranges of keys are even.
SHARD_BYTES = 256 << 20
#: Encoded parts that a Python worker remembers before it forgets those that came once.
MEMORY = 400_000


def masked(crc: int) -> int:
    """A CRC rotated and offset, so that the CRC of data that holds CRCs stays of use."""
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def framed(key: int | None, ids: np.ndarray) -> bytes:
    """One record."""
    wide = 2 if ids.dtype.itemsize == 2 else 4
    payload = struct.pack("<qB", key or 0, wide | (0x80 if key is None else 0)) + ids.tobytes()
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(zlib.crc32(head))) + payload + struct.pack("<I", masked(zlib.crc32(payload)))


def unframed(data: memoryview | bytes, at: int) -> tuple[int | None, np.ndarray, int]:
    """The record at an offset: key, ids, and the offset of the next; ValueError if a checksum is wrong."""
    head = bytes(data[at : at + 8])
    n, check = struct.unpack("<Q", head)[0], struct.unpack_from("<I", data, at + 8)[0]
    if check != masked(zlib.crc32(head)):
        raise ValueError(f"length of the record at {at} is damaged")
    payload = data[at + 12 : at + 12 + n]
    if struct.unpack_from("<I", data, at + 12 + n)[0] != masked(zlib.crc32(payload)):
        raise ValueError(f"record at {at} is damaged")
    key, flags = struct.unpack_from("<qB", payload)
    ids = np.frombuffer(payload, "<u2" if flags & 0x7F == 2 else "<u4", offset=9)
    return None if flags & 0x80 else key, ids, at + 16 + n


class Grown:
    """An array that grows at its end, in amortised constant time for each value."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(self.n + 2 * len(values), self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)

    def array(self) -> np.ndarray:
        return self.data[: self.n]


class Encoder:
    """A byte-level BPE tokenizer of the tokenizers library that remembers the words that come again.

    Its pattern never lets a token cross the place before a single space
    between two other characters, and within such a part no token begins with
    a space but the first.  So many new parts are encoded in one call, and
    the ids that begin with a space tell where each part starts.  Texts with
    other runs of white space are encoded whole.
    """

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        vocabulary = self.tokenizer.get_vocab()
        self.wide = np.uint16 if max(vocabulary.values()) < 65536 else np.uint32
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space, which the vocabulary shows as U+0120
        self.begins[[i for w, i in vocabulary.items() if w.startswith("\u0120")]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.sizes = Grown(self.wide), Grown(np.int64)
        self.again = np.zeros(0, bool)

    def _forget(self) -> None:
        """Keeps the parts that came again since this was last done."""
        names = [s for s, keep in zip(self.known, self.again) if keep]
        which = np.flatnonzero(self.again)
        ids, sizes = _gathered(self.ids.array(), self.sizes.array(), which), self.sizes.array()[which]
        self.clear()
        self.known = {s: k for k, s in enumerate(names)}
        self.ids.extend(ids)
        self.sizes.extend(sizes)
        self.again = np.zeros(len(names), bool)

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.wide) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The places in memory of distinct parts that follow a space."""
        if len(self.known) > MEMORY:
            self._forget()
        at = np.fromiter(map(self.known.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        self.again[at[at >= 0]] = True
        fresh = [s for s, k in zip(parts, at.tolist()) if k < 0]
        for k in range(0, len(fresh), 4096):
            some = fresh[k : k + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, self.wide)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(some):
                sizes = np.diff(starts, append=len(ids))
            else:  # a vocabulary or pattern of another kind
                each = self._each([" " + s for s in some])
                ids, sizes = np.concatenate(each), np.array(list(map(len, each)), np.int64)
            self.ids.extend(ids)
            self.sizes.extend(sizes)
        at[at < 0] = len(self.known) + np.arange(len(fresh))
        self.known.update(zip(fresh, itertools.count(len(self.known))))
        self.again = np.concatenate([self.again, np.zeros(len(fresh), bool)])
        return at

    def encode(self, text: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow array of texts, ``end`` after each text, and how many each text has."""
        lists = pc.split_pattern(text, " ")
        offsets = np.asarray(lists.offsets, np.int64)
        flat = lists.flatten().dictionary_encode()
        values, codes = flat.dictionary.to_numpy(zero_copy_only=False).tolist(), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = offsets - offsets[0]
        ends = [pc.utf8_is_space(pc.utf8_slice_codeunits(flat.dictionary, *k)).to_numpy(zero_copy_only=False) for k in ((0, 1), (-1, None))]
        odd = ends[0] | ends[1] | (pc.binary_length(flat.dictionary).to_numpy(zero_copy_only=False) == 0)
        whole = np.logical_or.reduceat(odd[codes], offsets[:-1]) if len(codes) else np.zeros(0, bool)
        later = ~np.repeat(whole, np.diff(offsets))
        later[offsets[:-1]] = False
        # parts that follow a space by their place in memory; then the first parts and the whole texts; then the end id
        asked = np.flatnonzero(np.bincount(codes[later], minlength=len(values)))
        place = np.zeros(len(values), np.int64)
        place[asked] = self.numbers(list(map(values.__getitem__, asked.tolist())))
        base = self.sizes.n
        heads = [s.as_py() if w else values[c] for s, w, c in zip(text, whole.tolist(), codes[offsets[:-1]].tolist())]
        distinct = {s: k for k, s in enumerate(dict.fromkeys(heads))}
        each = [*self._each(list(distinct)), np.array([end], self.wide)]
        codes = place[codes]
        codes[offsets[:-1]] = base + np.fromiter(map(distinct.__getitem__, heads), np.int64, len(heads))
        kept = later
        kept[offsets[:-1]] = True
        per = np.add.reduceat(kept, offsets[:-1], dtype=np.int64) if len(codes) else np.zeros(0, np.int64)
        codes = np.insert(codes[kept], np.cumsum(per), base + len(each) - 1)
        ids = np.concatenate([self.ids.array(), *each])
        sizes = np.concatenate([self.sizes.array(), np.fromiter(map(len, each), np.int64, len(each))])
        marks = np.cumsum(per + 1) - 1
        return _gathered(ids, sizes, codes), np.diff(np.cumsum(sizes[codes])[marks], prepend=0)


def _gathered(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of values, one after another; run k has sizes[k] values."""
    starts, n = (np.cumsum(sizes) - sizes)[which], sizes[which]
    ends = np.cumsum(n)
    return values[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - starts, n)]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, special: bool = True) -> Encoder:
    return _ENCODERS.get((path, special)) or _ENCODERS.setdefault((path, special), Encoder(path, special))


def write_tokens(docs: DataFrame, vocabulary: str, end: int = 2, folder: str | None = None, special: bool = True, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, str]:
    """Encodes docs in ascending doc_id order (nulls first) to shards in a shared folder; (a row for each shard, folder).

    There are as many shards as shuffle partitions, and more where a shard would
    hold over ``shard_bytes`` of text.

    A shard's files bear the name of the task attempt that wrote them; the
    table of shards names those of the attempts that count, so that a task
    that runs again leaves no half file in the result.  Texts that share a
    doc_id are ordered by a hash.  A null text is empty.  The string of a special
    token in a text gives its id, as the library does of itself; with
    ``special`` false it is ordinary text.
    """
    from pyarrow import fs

    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes), 1)
    rows = rows.repartitionByRange(count, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        enc, at, total, count = encoder(vocabulary, special), 0, 0, 0
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/{name}.rec") as out, files.open_output_stream(f"{base}/{name}.idx") as entries:
            for some, text in slices(batches, most=4 << 20):
                ids, sizes = enc.encode(text, end)
                stop, index = 0, []
                for key, n in zip(some.column("doc_id").to_pylist(), sizes.tolist()):
                    record = framed(key, ids[stop : stop + n])
                    out.write(record)
                    index.append((key or 0, at, n, key is None))
                    stop, at, total = stop + n, at + len(record), total + n
                entries.write(np.array(index, ENTRY).tobytes())
                count += len(index)
        yield pa.RecordBatch.from_pydict({"part": [part], "shard": [name], "records": [count], "ids": [total]}, pa.schema([("part", pa.int32()), ("shard", pa.string()), ("records", pa.int64()), ("ids", pa.int64())]))

    return stored(rows.mapInArrow(run, "part int, shard string, records long, ids long"), "shards"), folder


def read_tokens(shards: DataFrame, folder: str, block: int = 256) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, record) of each record of the shards, read from their files and verified.

    start counts the ids of all records before it, in the order of shards.
    The table of shards is as long as there are shards, and its totals are
    summed on the driver.
    """
    from pyarrow import fs

    spark = shards.sparkSession
    listed, start = [], 0
    for r in shards.orderBy("part").collect():
        listed.append((r.shard, r.records, start))
        start += r.ids
    todo = spark.createDataFrame(listed, "shard string, records long, start long").repartition(max(1, len(listed)), "shard")

    def run(batches):
        files, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist()):
                with files.open_input_stream(f"{base}/{shard}.idx") as f:
                    index = np.frombuffer(f.read(), ENTRY)
                with files.open_input_file(f"{base}/{shard}.rec") as f:
                    for lo in range(0, len(index), block):
                        some = index[lo : lo + block]
                        begin = int(some["offset"][0])
                        finish = int(index["offset"][lo + block]) if lo + block < len(index) else f.size()
                        data, out = memoryview(f.read_at(finish - begin, begin)), ([], [], [], [], [], [])
                        for k, e in enumerate(some):
                            key, ids, _ = unframed(data, int(e["offset"]) - begin)
                            if len(ids) != e["n"] or (key or 0) != e["key"]:
                                raise ValueError(f"index of {shard} doesn't fit record {lo + k}")
                            for column, v in zip(out, (key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard, lo + k)):
                                column.append(v)
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (*[pa.int64()] * 4, pa.string(), pa.int64()))], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "record"])

    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, record long")
