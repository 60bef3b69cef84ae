"""Quality classifier on random-indexing word vectors.

A word's index vector has a few entries of +1 and -1 at places drawn by its
hash; its word vector is the sum of the index vectors of its neighbours,
over the whole corpus.  Words share a fixed number of hash rows, so the
table has a size that is a parameter: tasks sum their part of it, and the
parts are summed slice by slice.  A document pools the vectors of its
words; a two-layer network in numpy reads that, and its logits are divided
by a temperature that was fitted on rows held back from training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed, mixed, slices, stored, text_rows, words_of

#: Hash rows and columns of the table of word vectors: 2 MB.
ROWS, DIM, SLICES = 1 << 13, 64, 32
NONZERO, WINDOW = 2, 2
#: Labelled rows that the network is fitted on, at most: those with the smallest hash of their key.
SAMPLE = 8000
#: Bytes of text whose word vectors a Python worker holds at once: some 50 MB of them.
POOLED = 1 << 19
_U = np.uint64


def _rows_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    counts, words = words_of(text)
    h = hashed(words.dictionary)
    return counts, h[words.indices.to_numpy(zero_copy_only=False)] if len(words) else h


def _index(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vectors of hashes."""
    m = mixed(h)
    places = np.stack([(m >> _U(8 * j)) % _U(DIM) for j in range(NONZERO)], 1).astype(np.int64)
    signs = np.stack([((m >> _U(60 - j)) & _U(1)).astype(np.int8) * 2 - 1 for j in range(NONZERO)], 1)
    return places, signs.astype(np.float32)


def _summed(batches, key: str = "slice"):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for s, v in zip(b.column("slice").to_pylist(), b.column("vectors").to_pylist()):
            v = np.frombuffer(v, np.int64)
            total[s] = total[s] + v if s in total else v.copy()
    yield _packed(total)


def _packed(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype(np.int64).tobytes() for v in total.values()], pa.binary())], names=["slice", "vectors"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors of all texts: ROWS unit vectors of DIM; rows that no word has are zero."""

    def part(batches):
        table = np.zeros(ROWS * DIM, np.int64)
        for _, text in slices(batches):
            counts, h = _rows_of(text)
            if not len(h):
                continue
            row = (h % _U(ROWS)).astype(np.int64)
            doc = np.repeat(np.arange(len(counts)), counts)
            places, signs = _index(h)
            for off in range(1, WINDOW + 1):
                same = doc[off:] == doc[:-off]
                for a, b in ((slice(None, -off), slice(off, None)), (slice(off, None), slice(None, -off))):
                    at = (row[a][same, None] * DIM + places[b][same]).ravel()
                    table += np.bincount(at, weights=signs[b][same].ravel(), minlength=ROWS * DIM).astype(np.int64)
        size = ROWS * DIM // SLICES
        yield _packed({s: table[s * size : (s + 1) * size] for s in range(SLICES)} if table.any() else {})

    kind = "slice int, vectors binary"
    parts = docs.select("text").mapInArrow(part, kind)
    # summed in a stream, first in several tasks for each slice, then in one: no task holds more than its slices
    parts = parts.repartition(4 * SLICES, "slice", F.expr("pmod(xxhash64(vectors), 8)")).mapInArrow(_summed, kind)
    parts = parts.repartition(SLICES, "slice").mapInArrow(_summed, kind)
    out = np.zeros((SLICES, ROWS * DIM // SLICES), np.float32)
    for r in parts.collect():
        out[r[0]] = np.frombuffer(r[1], np.int64)
    out = out.reshape(ROWS, DIM)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def pooled(text: pa.Array, table: np.ndarray) -> np.ndarray:
    """The mean and the mean absolute value of each text's word vectors, and the logarithm of its number of words; zeros without words."""
    counts, h = _rows_of(text)
    out = np.zeros((len(counts), 2 * DIM + 1), np.float32)
    if len(h):
        has = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[has]
        v = table[(h % _U(ROWS)).astype(np.int64)]
        n = counts[has, None].astype(np.float32)
        out[has, :DIM] = np.add.reduceat(v, starts, axis=0) / n
        out[has, DIM : 2 * DIM] = np.add.reduceat(np.abs(v), starts, axis=0) / n
        out[has, -1] = np.log1p(counts[has])
    return out


class Network:
    """Two layers, tanh between them, and a temperature; trained by Adam with a fixed seed."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 48, epochs: int = 60, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(d, np.float32), np.ones(d, np.float32))
        self.w = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.temperature = 1.0
        if len(set(y.tolist())) < 2:  # nothing to tell apart: the share of label 1, smoothed
            self.w[2][:] = 0
            self.w[3][0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
            return
        order = rng.permutation(len(x))
        held, used = order[: len(x) // 5], order[len(x) // 5 :]
        z = (x - self.mean) / self.scale
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            rng.shuffle(used)
            for at in range(0, len(used), 128):
                b = used[at : at + 128]
                t += 1
                h = np.tanh(z[b] @ self.w[0] + self.w[1])
                e = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - y[b]) / len(b)
                back = np.outer(e, self.w[2]) * (1 - h * h)
                grads = [z[b].T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ e + 1e-4 * self.w[2], e.sum(keepdims=True)]
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        logits, target = self.logits(x[held]), y[held]
        loss = lambda s: np.mean(np.logaddexp(0, logits / s) - target * logits / s)
        self.temperature = float(min(np.geomspace(0.25, 20, 200), key=loss)) if len(held) else 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def labelled(labels: DataFrame, label: str, train, most: int) -> DataFrame:
    """(doc_id, y) of the labelled rows that train admits, at most ``most``: a bounded sample that does not depend on their order."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def one_text_each(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, y, text) of the sample's documents: of rows that share a doc_id the one whose text has the smallest hash, so there are no more rows than the sample has."""
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long"), text).join(F.broadcast(sample.select(F.col("doc_id").cast("long"), "y")), "doc_id").withColumn("t", F.xxhash64("text"))
    return rows.groupBy("doc_id", "y").agg(F.min(F.struct("t", "text")).alias("x")).select("doc_id", "y", F.col("x.text").alias("text"))


def fitted(docs: DataFrame, labels: DataFrame, train, label: str = "quality", most: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors of all docs, and a network fitted on the sample of labelled ones."""
    table = word_vectors(docs)
    sample = stored(labelled(labels, label, train, most), "quality-sample")

    def features(batches):
        for rows, text in slices(batches, most=POOLED):
            x = pooled(text, table)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("y"), pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "y", "x"])

    # the sample has `most` rows at most, so its side is small whatever the corpus is
    rows = one_text_each(docs, sample).mapInArrow(features, "doc_id long, y int, x binary").collect()
    rows.sort()
    x = np.array([np.frombuffer(r[2], np.float32) for r in rows]).reshape(len(rows), 2 * DIM + 1)
    return table, Network(x.astype(np.float64), np.array([r[1] for r in rows], np.float64))


def scored(docs: DataFrame, table: np.ndarray, network: Network) -> DataFrame:
    """(doc_id, score) of each document.  A null text counts as empty; an empty text gets the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast((table, network))  # 2 MB and the weights: sizes are parameters

    def run(batches):
        table, network = shared.value
        for rows, text in slices(batches, most=POOLED):
            yield pa.RecordBatch.from_arrays([pc.cast(rows.column("doc_id"), pa.int64()), pa.array(network.scores(pooled(text, table)))], names=["doc_id", "score"])

    return text_rows(docs).mapInArrow(run, "doc_id long, score double")


def kept(docs: DataFrame, table: np.ndarray, network: Network, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast((table, network))

    def run(batches):
        table, network = shared.value
        for rows, text in slices(batches, most=POOLED):
            yield rows.filter(pa.array(network.scores(pooled(text, table)) >= least))

    return docs.mapInArrow(run, docs.schema)
