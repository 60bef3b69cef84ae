"""SentencePiece segmentations sampled from the piece lattice.

The lattice of a unit (a word with the spaces before it as marks U+2581, so
that no piece of the model crosses from one unit to the next) has an edge for
each piece that the unit holds.  The
forward pass sums the weights of all paths to each place; the backward pass
draws, from the end, each last piece in proportion to the weight of the
paths that end with it.  That gives each segmentation its exact
probability.  The draws are hashes of seed, row key, unit and place, so a
row's segmentation does not depend on partitions, batches or retries.

Nothing is normalised, and characters without a piece become byte pieces:
decoding gives back each text exactly.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, slices

MARK = "▁"
#: The sums of longer units than this are kept with an exponent of their own.
LONGEST = 48
#: Edges of remembered lattices in a Python worker.
MEMORY = 2_000_000
#: Characters whose lattices are made at once.
AT_ONCE = 1 << 17
_U = np.uint64


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _longer(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of strings that have one character more."""
    return mixed(h * _U(0x9E3779B97F4A7C15) + points.astype(_U) + _U(1))


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


class Lattices:
    """The lattices of all units seen, as arrays: nodes with their edges, edges with start, piece and cumulated share."""

    def __init__(self, path: str, theta: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(s[3:5], 16): i for i, s in enumerate(self.names) if sp.is_byte(i)}
        plain = [i for i in range(len(self.names)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        # A BPE model scores by the order of merges; the weight of a piece falls with its rank (Zipf).
        ranks = {i: k for k, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
        self.spread = 50.0  # a factor for each character: the same for all paths, it keeps sums in range
        weight = np.array([(ranks[i] + 10.0) ** -theta * self.spread ** len(self.names[i]) for i in plain])
        self.rare = (2.0 * len(self.names)) ** -theta * self.spread
        self.pieces = {self.names[i]: (i, w) for i, w in zip(plain, weight.tolist())}
        # a piece with a mark behind another character would cross units
        self.apart = not any(MARK in self.names[i].lstrip(MARK) for i in plain)
        self.known = self._prefixes(plain, weight)
        self.clear()

    def _prefixes(self, plain: list[int], weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length, of all prefixes of pieces: sorted hashes, the piece that a prefix is or -1, and its weight."""
        sizes = np.array([len(self.names[i]) for i in plain])
        points = _points([self.names[i] for i in plain])
        begins = np.cumsum(sizes) - sizes
        at, h, out = np.arange(len(plain)), np.zeros(len(plain), _U), []
        for length in range(1, int(sizes.max(initial=0)) + 1):
            on = sizes[at] >= length
            at = at[on]
            h = _longer(h[on], points[begins[at] + length - 1])
            hashes, which = np.unique(h, return_inverse=True)
            piece, w = np.full(len(hashes), -1, np.int32), np.zeros(len(hashes))
            whole = sizes[at] == length
            piece[which[whole]], w[which[whole]] = np.array(plain, np.int32)[at[whole]], weight[at[whole]]
            out.append((hashes, piece, w))
        return out

    def clear(self) -> None:
        self.units: dict[str, int] = {}
        self.spelled: dict[str, int] = {}  # characters without a piece
        # the end node of each unit; the first edge of each node but a unit's start, its nodes are consecutive; each edge's start, code and share
        self.arrays = [Grown(t) for t in (np.int32, np.int32, np.int32, np.int32, np.float64)]

    def add(self, units: list[str]) -> None:
        """The lattices of distinct new units, all at once: edges by length, then sums by place."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        raw = _points(units)
        # units hold a space as such; a mark that the text itself holds is no space and is spelled in bytes
        seen = np.where(raw == ord(" "), np.uint32(ord(MARK)), np.where(raw == ord(MARK), np.uint32(0), raw))
        place = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
        left = np.repeat(size, size) - place
        at, h, found = np.arange(len(raw)), np.zeros(len(raw), _U), []
        alone = np.zeros(len(raw), bool)
        for length, (hashes, piece, weight) in enumerate(self.known, 1):
            on = left[at] >= length
            at = at[on]
            h = _longer(h[on], seen[at + length - 1])
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            on = hashes[k] == h
            at, h, k = at[on], h[on], k[on]
            whole = piece[k] >= 0
            if length == 1:
                alone[at[whole]] = True
            found.append((at[whole], np.full(int(whole.sum()), length), piece[k[whole]], weight[k[whole]]))
        bare = np.flatnonzero(~alone)  # no piece for the character alone
        points, which = np.unique(raw[bare], return_inverse=True)
        spelled = np.array([-1 - self.spelled.setdefault(chr(c), len(self.spelled)) for c in points.tolist()], np.int32)
        found.append((bare, np.ones(len(bare), np.int64), spelled[which], np.full(len(bare), self.rare)))
        begin, length, code, weight = (np.concatenate(x) for x in zip(*found))
        node = begin + length - 1
        order = np.argsort(node * 64 - length)
        begin, node, code, weight = begin[order], node[order], code[order], weight[order]
        count = np.bincount(node, minlength=len(raw))
        first = np.cumsum(count) - count
        # the weight of all paths to each node, place after place: sums times 2 ** power
        sums, paths, power = np.ones(len(raw)), np.zeros(len(node)), np.zeros(len(raw), np.int64)
        long = int(size.max(initial=0)) > LONGEST
        by_place = np.argsort(place[node].astype(np.int32 if long else np.uint8), kind="stable")
        ends = np.cumsum(np.bincount(place[node], minlength=1))
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            e = by_place[a:b]
            if len(e):
                first_place = place[begin[e]] == 0
                paths[e] = weight[e] * np.where(first_place, 1.0, sums[begin[e] - 1])
                new = np.flatnonzero(np.diff(node[e], prepend=-1))
                if long:
                    own = np.where(place[node[e]] == 0, 0, power[node[e] - 1])  # of the place before, which each unit has
                    paths[e] = np.ldexp(paths[e], np.where(first_place, 0, power[begin[e] - 1]) - own)
                    sums[node[e[new]]], more = np.frexp(np.add.reduceat(paths[e], new))
                    power[node[e[new]]] = own[new] + more
                else:
                    sums[node[e[new]]] = np.add.reduceat(paths[e], new)
        for j in range(1, int(count.max(initial=0))):
            e = first[count > j] + j
            paths[e] += paths[e - 1]
        share = paths / paths[first + count - 1][node]
        nodes, edges = self.arrays[1].n, self.arrays[3].n
        for known, new in zip(self.arrays, (nodes + np.cumsum(size) - 1, edges + first, place[begin], code, share)):
            known.extend(new)
        for u in units:
            self.units[u] = len(self.units)

    def numbers(self, units: list[str]) -> np.ndarray:
        if self.arrays[3].n > MEMORY:
            self.clear()
        fresh, n = ([], []), [0, 0]
        for u in dict.fromkeys(units):
            if u not in self.units:
                long = len(u) > LONGEST
                fresh[long].append(u)
                n[long] += len(u)
                if n[long] > AT_ONCE:
                    self.add(fresh[long])
                    fresh[long].clear()
                    n[long] = 0
        for some in fresh:
            if some:
                self.add(some)
        return np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))

    def flat(self) -> list[np.ndarray]:
        return [known.array() for known in self.arrays]

    def ids_of(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each code, as starts and values: pieces first, then spelled characters from the end."""
        lists = [[self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] for c in self.spelled]
        n = len(self.names)
        sizes = np.array([1] * n + [len(x) for x in lists], np.int64)
        return sizes, np.array([*range(n), *(i for x in lists for i in x)], np.int32)

    def _units(self, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct units of texts, and the unit and the text of each occurrence in order."""
        lists = pc.split_pattern(text, " ")
        offsets = np.asarray(lists.offsets, np.int64)
        offsets = offsets - offsets[0]
        flat = lists.flatten().dictionary_encode()
        values, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(text)), np.diff(offsets))
        first = np.zeros(len(codes), bool)
        first[offsets[:-1]] = True
        # a part behind a space is a unit with it; texts with runs of spaces are taken apart one by one
        odd = pc.match_substring(text, "  ").to_numpy(zero_copy_only=False) if self.apart else np.ones(len(text), bool)
        some = ~odd[row] & ~(first & (np.array(list(map(len, values)), np.int64)[codes] == 0))
        asked, which = np.unique(codes[some] * 2 + first[some], return_inverse=True)
        units = [values[a >> 1] if a & 1 else " " + values[a >> 1] for a in asked.tolist()]
        row = row[some]
        if odd.any():
            places, more, more_row = {u: k for k, u in enumerate(units)}, [], []
            for r in np.flatnonzero(odd).tolist():
                s = text[r].as_py()
                for u in re.findall(" *[^ ]+| +", s) if self.apart else [s] * bool(s):
                    more.append(places.setdefault(u, len(places)))
                    more_row.append(r)
            units = list(places)
            which, row = np.concatenate([which, np.array(more, np.int64)]), np.concatenate([row, np.array(more_row, np.int64)])
            order = np.argsort(row, kind="stable")
            which, row = which[order], row[order]
        return units, which, row

    def sample(self, text: pa.Array, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has; an empty text has none."""
        units, which, row = self._units(text)
        unit = self.numbers(units)[which]
        per_row = np.bincount(row, minlength=len(text))
        last, edge_at, start, code, share = self.flat()
        ordinal = np.arange(len(unit)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        base = mixed(mixed(keys + _U(seed * 0x9E3779B97F4A7C15 % 2**64))[row] + ordinal.astype(_U))
        node = last[unit].astype(np.int64)
        zero = np.concatenate([[0], last[:-1].astype(np.int64) + 1])[unit]  # the node after the unit's start
        here, steps = np.arange(len(unit)), []
        count = np.zeros(len(unit), np.int64)
        while len(here):
            u = (mixed(base[here] + (node - zero[here] + 1).astype(_U)) >> _U(11)).astype(np.float64) * 2.0**-53
            edge = edge_at[node].astype(np.int64)
            behind = np.flatnonzero(share[edge] <= u)
            while len(behind):
                edge[behind] += 1
                behind = behind[share[edge[behind]] <= u[behind]]
            steps.append((here, code[edge]))
            count[here] += 1
            to = start[edge].astype(np.int64)
            on = to > 0
            here = here[on]
            node = zero[here] + to[on] - 1
        ends = np.cumsum(count)
        drawn = np.zeros(ends[-1] if len(ends) else 0, np.int64)
        for k, (at, c) in enumerate(steps):
            drawn[ends[at] - 1 - k] = c
        sizes, ids = self.ids_of()
        drawn = np.where(drawn < 0, len(self.names) - 1 - drawn, drawn)
        begins = np.cumsum(sizes) - sizes
        n = sizes[drawn]
        upto = np.cumsum(n)
        out = ids[np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - n - begins[drawn], n)]
        row_of = row[np.repeat(np.arange(len(unit)), count)]
        return out, np.bincount(row_of, weights=n, minlength=len(text)).astype(np.int64)


class Decoder:
    """Texts from ids: pieces with the mark as a space, byte pieces as bytes."""

    def __init__(self, lattices: Lattices):
        spelled = {i: bytes([b]) for b, i in lattices.bytes.items()}
        parts = [spelled.get(i, name.replace(MARK, " ").encode()) for i, name in enumerate(lattices.names)]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        n = self.sizes[ids]
        ends = np.cumsum(n)
        data = self.data[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - self.starts[ids], n)]
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


_LATTICES: dict[tuple, Lattices] = {}


def lattices(path: str, theta: float) -> Lattices:
    return _LATTICES.get((path, theta)) or _LATTICES.setdefault((path, theta), Lattices(path, theta))


def encoded(docs: DataFrame, model: str, seed: int = 1, theta: float = 1.0) -> DataFrame:
    """(doc_id, n_tokens, ids, lossless) of each document.

    The row key is doc_id; rows that repeat it, and rows where it is null,
    are drawn alike if their texts are.  A null text is empty and has no
    ids.  lossless tells that decoding the ids gave the text again.
    """

    def run(batches):
        lat = lattices(model, theta)
        dec = Decoder(lat)
        for rows, text in slices(batches, most=1 << 20):
            keys = pc.fill_null(rows.column("doc_id"), -1).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
            ids, sizes = lat.sample(text, keys, seed)
            same = pc.equal(dec.decode(ids, sizes), text)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(ids)), same], names=["doc_id", "n_tokens", "ids", "lossless"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, lossless boolean")


def decoded(tokens: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give the empty text."""

    def run(batches):
        dec = Decoder(lattices(model, 1.0))
        for rows in batches:
            lists = rows.column("ids")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), dec.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes).cast(pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
