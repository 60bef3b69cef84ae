"""Reading, shared storage and Arrow text kernels that the operators share."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once by a Python worker.  Bounds its memory whatever the batch size is.
SLICE_BYTES = 2 << 20
#: Rows that the Parquet reader decodes at once and bytes of a row group that the writer gathers, where whole texts pass: (setting, its default, value).
SMALL_RUNS = (("spark.sql.parquet.columnarReaderBatchSize", "4096", 256), ("parquet.block.size", "134217728", 8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; Python workers on this machine then find the package wherever they start."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, root)))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_small_runs(spark: SparkSession) -> None:
    """From now on the session reads and writes Parquet in small runs of rows.

    By default each task's reader holds 4096 rows and its writer up to 128 MB
    of them, which for whole texts is more than a heap of 1 GB has for eight
    tasks.  Values other than the defaults stay.
    """
    for name, default, value in SMALL_RUNS:
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, str(value))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Where the session has no such setting, a session within one process (tests,
    a bench) sets a folder of its own; one with executors elsewhere gets a
    ValueError, since they would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        import tempfile

        root = "file://" + os.path.join(tempfile.gettempdir(), "lodestar-shared")
        os.makedirs(root.removeprefix("file://"), exist_ok=True)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, computed once and reread from a table in the shared folder: its lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote and that no later job reads.

    The collection afterwards lets Spark's cleaner see that the shuffles of
    the finished jobs are out of use, so that their files go as well.  The
    listeners hold on to the last query that ended; a small one takes its
    place first.
    """
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    spark.range(1).count()
    gc.collect()
    spark._jvm.System.gc()


def slices(batches, column: str = "text", most: int | None = None) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(rows, their texts with null as empty) in runs of about ``most`` bytes; a longer text comes alone."""
    most = most or SLICE_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at), text.slice(at, to - at)
            at = to


def bytes_of(text: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of a large_string array in one piece, and the offsets of its values."""
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if data is not None else b""
    return raw, offsets - offsets[0]


def translated(text: pa.Array, to: bytes) -> pa.Array:
    """Each byte replaced by the table ``to`` (which maps ASCII to ASCII only)."""
    raw, offsets = bytes_of(text)
    return pa.Array.from_buffers(pa.large_string(), len(text), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.translate(to))])


#: A-Z to a-z and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and every other ASCII character that is neither letter nor digit to a space.
LOWER_ALNUM = bytes(32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else c for b, c in enumerate(LOWER))


def words_of(text: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Words between ASCII white space: how many each text has, and all of them, dictionary encoded."""
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    keep = pc.not_equal(flat, "")
    offsets = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
    kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    counts = np.diff(kept[offsets])
    words = flat.filter(keep).dictionary_encode()
    return counts, words


def hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    values = words.to_numpy(zero_copy_only=False)
    return pd.util.hash_array(values.astype(object), categorize=False) if len(values) else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_rows(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the columns ``more`` of df, whatever else it holds."""
    return df.select("doc_id", "text", *more)


def crc_mod(column: str, n: int):
    """crc32 of the decimal text of a key, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)
