"""Token ids of the parts of texts, remembered for the parts that come again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import LOWER, bytes_of
from .tokens import Grown, _gathered

#: Gives the ids of distinct parts, one part after another, and how many each has.
Coder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
#: Parts that a Python worker remembers before it forgets those that came once.
MEMORY = 400_000
#: New parts that are encoded in one call.
AT_ONCE = 4096


def _lists(each: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    return np.fromiter((i for ids in each for i in ids), np.uint32, int(sizes.sum())), sizes


def behind_space(tokenizer) -> Coder:
    """Parts as they are encoded behind a space by a byte-level BPE, whose ids that begin with a space tell where a part begins.

    Parts with white space at an edge or a space within are encoded one by one.
    """
    vocabulary = tokenizer.get_vocab()
    begins = np.zeros(max(vocabulary.values()) + 1, bool)
    begins[[i for w, i in vocabulary.items() if w.startswith("Ġ")]] = True

    def alone(parts):
        return _lists([e.ids for e in tokenizer.encode_batch_fast([" " + s for s in parts], add_special_tokens=False)])

    def coder(parts):
        if any(" " in s or not s or s[0].isspace() or s[-1].isspace() for s in parts):
            return alone(parts)
        ids = np.array(tokenizer.encode_batch_fast([" " + " ".join(parts)], add_special_tokens=False)[0].ids, np.uint32)
        starts = np.flatnonzero(begins[ids])
        return (ids, np.diff(starts, append=len(ids))) if len(starts) == len(parts) else alone(parts)

    return coder


def between_spaces(tokenizer, end: str = "</w>") -> Coder:
    """Parts without white space, for a vocabulary whose tokens hold none.

    A part of letters alone is one word to it, and ids whose names finish with
    ``end`` tell where words end; so these are encoded in one call, and the
    others one by one.
    """
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for w, i in vocabulary.items() if w.endswith(end)]] = True

    def coder(parts):
        letters = pc.utf8_is_alpha(pa.array(parts, pa.large_string())).to_numpy(zero_copy_only=False)
        plain = [s for s, k in zip(parts, letters.tolist()) if k]
        ids = np.array(tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(ends[ids])
        if len(last) != len(plain):
            return _lists([e.ids for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)])
        rest, more = _lists([e.ids for e in tokenizer.encode_batch_fast([s for s, k in zip(parts, letters.tolist()) if not k], add_special_tokens=False)])
        sizes = np.zeros(len(parts), np.int64)
        sizes[letters], sizes[~letters] = np.diff(last, prepend=-1), more
        each = np.concatenate([sizes[letters], more])
        order = np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])
        return _gathered(np.concatenate([ids, rest]), each, np.argsort(order)), sizes

    return coder


def pieces(processor) -> Coder:
    """Parts as a SentencePiece model encodes them, each with a space before it that the model adds."""
    return lambda parts: _lists(processor.encode(parts, num_threads=1))


class Parts:
    """The ids of parts of texts by one or more coders."""

    def __init__(self, *coders: Coder):
        self.coders = coders
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = [Grown(np.uint32) for _ in self.coders]
        self.sizes = [Grown(np.int64) for _ in self.coders]
        self.again = np.zeros(0, bool)

    def _forget(self) -> None:
        """Keeps the parts that came again since this was last done."""
        names = [s for s, keep in zip(self.known, self.again) if keep]
        which = np.flatnonzero(self.again)
        held = [(_gathered(i.array(), n.array(), which), n.array()[which]) for i, n in zip(self.ids, self.sizes)]
        self._clear()
        self.known = {s: k for k, s in enumerate(names)}
        for (ids, sizes), i, n in zip(held, self.ids, self.sizes):
            i.extend(ids)
            n.extend(sizes)
        self.again = np.zeros(len(names), bool)

    def places(self, parts: list[str]) -> np.ndarray:
        """The places in memory of distinct parts; they hold until the next call."""
        if len(self.known) > MEMORY:
            self._forget()
        at = np.fromiter((self.known.get(s, -1) for s in parts), np.int64, len(parts))
        self.again[at[at >= 0]] = True
        fresh = [s for s, k in zip(parts, at.tolist()) if k < 0]
        for k in range(0, len(fresh), AT_ONCE):
            for coder, i, n in zip(self.coders, self.ids, self.sizes):
                ids, sizes = coder(fresh[k : k + AT_ONCE])
                i.extend(ids)
                n.extend(sizes)
        at[at < 0] = len(self.known) + np.arange(len(fresh))
        for s in fresh:
            self.known[s] = len(self.known)
        self.again = np.concatenate([self.again, np.zeros(len(fresh), bool)])
        return at

    def gathered(self, coder: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts at these places, one after another, and how many each has."""
        sizes = self.sizes[coder].array()
        return _gathered(self.ids[coder].array(), sizes, at), sizes[at]


def summed(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values; run k has counts[k] of them."""
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - counts]


_LETTER, _SIGN = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _SIGN
_KIND[[*range(48, 58), *range(65, 91)]] = 0
_KIND[97:123] = _LETTER


def lowered(text: pa.Array, special: str) -> pa.Array:
    """A-Z lower-cased, and a space between each letter a-z and an ASCII sign behind it; texts that hold ``special`` stay as they are.

    A vocabulary that lower-cases, drops white space and never has a letter and
    a sign behind it in one token gives the same ids, and words come again
    more often.
    """
    raw, offsets = bytes_of(text)
    before = np.frombuffer(raw, np.uint8)
    out = np.frombuffer(raw.translate(LOWER), np.uint8)
    kind = _KIND[out]
    cut = np.zeros(len(out), bool)
    cut[1:] = (kind[:-1] == _LETTER) & (kind[1:] == _SIGN)
    kept = pc.match_substring(text, special).to_numpy(zero_copy_only=False)
    if kept.any():
        held = np.repeat(kept, np.diff(offsets))
        out = np.where(held, before, out)
        cut &= ~held
    at = np.flatnonzero(cut)
    offsets = offsets + np.searchsorted(at, offsets, side="left")
    return pa.Array.from_buffers(pa.large_string(), len(text), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.insert(out, at, 32))])


def between_white_space(text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct parts, which part each place holds, how many each text has) of texts cut at ASCII white space."""
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    keep = pc.not_equal(flat, "")
    offsets = np.asarray(lists.offsets, np.int64)
    kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    words = flat.filter(keep).dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(kept[offsets - offsets[0]])


def at_single_spaces(text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The same for texts cut at each space between two characters that are no white space; the space itself is in no part.

    What stands at other spaces stays together, so that a run of white space
    is never cut.  An empty text has one empty part.
    """
    lists = pc.split_pattern(text, " ")
    offsets = np.asarray(lists.offsets, np.int64)
    offsets = offsets - offsets[0]
    flat = lists.flatten().dictionary_encode()
    values, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.binary_length(flat.dictionary).to_numpy(zero_copy_only=False) == 0
    head, tail = (pc.utf8_is_space(pc.utf8_slice_codeunits(flat.dictionary, *k)).to_numpy(zero_copy_only=False) | empty for k in ((0, 1), (-1, None)))
    counts = np.diff(offsets)
    glued = np.zeros(len(codes), bool)  # to the part before
    glued[1:] = tail[codes[:-1]] | head[codes[1:]]
    glued[offsets[:-1]] = False
    if glued.any():
        first = np.flatnonzero(~glued)
        size = np.diff(first, append=len(codes))
        number = {s: k for k, s in enumerate(values)}
        new = codes[first]
        for k in np.flatnonzero(size > 1).tolist():
            s = " ".join(values[c] for c in codes[first[k] : first[k] + size[k]].tolist())
            new[k] = number.setdefault(s, len(number))
        counts = summed((~glued).astype(np.int64), counts)
        codes, values = new, list(number)
    used, codes = np.unique(codes, return_inverse=True)
    return [values[k] for k in used.tolist()], codes, counts
