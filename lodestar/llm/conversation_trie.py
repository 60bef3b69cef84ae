"""The prefix trie of conversations, built as a Patricia tree.

The rebuilt conversations are sorted as sequences of turns, so those that
share a prefix stand together.  Each task walks through its sorted run with a
stack that has an entry only where the tree branches, where a conversation
ends, or at a leaf; an edge between two entries keeps the lengths of the
turns on it.  All sums are made on these entries when they leave the stack.
The nodes with a single child along an edge have its lower end's members and
leaves, and what they save more is a sum over the rest of the edge; they
become rows only at the end.

Only nodes on a task's first or last sequence can have members in another
task.  These are written node by node, each task with its own share, and
added up by a grouping; what belongs to a whole subtree of them is summed
along the sequences by a window.  Everything else is complete in its task.

Equal conversations are counted before they are sorted.  The hash over the
members that end at a node is made in two steps: runs of sorted ids are
written as blocks, and a node's blocks are fed to SHA-256 in order, so that
a task holds one block of a node, however many members end there.

Turns are known by MD5 of role and text; the ids of turns of one conversation
(28 bytes a turn) must fit a task, the texts need not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bytes of a turn's id.
WIDE = 16
#: Ids in a block of members.
BLOCK = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, path, chars) of each rebuilt conversation: the ids of its turns in one value, and their code points.

    A conversation's turns are ordered by turn (null first); rows of one turn
    by role and by the hash of their text, repeated rows stay.  A null role or
    text is empty.  Conversation c begins with the first h = crc32(c) % most
    turns of conversation c - c % group, if there is one, and goes on with its
    own turns after its first h.  Rows without a conv_id belong to no
    conversation.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn"), role.alias("role"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("id"), F.length(text).alias("chars"))
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("root"), turn.alias("turn")).repartition("root")
    own = turns.groupBy("root", "conv_id").agg(F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(t.id, t.chars)).alias("own"))
    heads = own.where("conv_id = root").select("root", F.slice("own", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    none = F.filter("own", lambda t: F.lit(False))
    joined = own.join(heads, "root", "left").withColumn("h", h)
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.expr("slice(own, h + 1, size(own))"))
    out = joined.select("conv_id", turns.alias("turns"))
    return out.select("conv_id", F.unhex(F.array_join("turns.id", "")).alias("path"), F.col("turns.chars").alias("chars"))


class _Point:
    """An entry of the stack: a node where the tree branches or a conversation ends, with the sums of its subtree so far."""

    __slots__ = ("depth", "members", "conv", "children", "leaves", "saved", "end", "held")

    def __init__(self, depth):
        self.depth, self.members, self.conv, self.children, self.leaves, self.saved, self.end, self.held = depth, 0, None, 0, 0, 0, None, []


def _shared(a: bytes, b: bytes) -> int:
    """Turns in which two paths agree from the start."""
    n = min(len(a), len(b)) // WIDE
    if a[: n * WIDE] == b[: n * WIDE]:
        return n
    x, y = (np.frombuffer(v, np.uint64, 2 * n) for v in (a, b))
    return int(np.argmax(x != y)) // 2


def _prefixes(path: bytes) -> list[bytes]:
    """MD5 of each prefix of a path, the empty one first."""
    h = hashlib.md5()
    out = [h.digest()]
    for k in range(0, len(path), WIDE):
        h.update(path[k : k + WIDE])
        out.append(h.copy().digest())
    return out


def walked(rows: Iterator[tuple[bytes, list[int], int, int]], part: int) -> Iterator[tuple]:
    """The tree of a sorted run of distinct (path, chars, members, smallest member), as rows.

    A row is (id, depth, parent, path number, chars, top, later, members, conv,
    parent's conv, children, leaves, saved, end).  Nodes within the run have no
    id: top is the least depth on the edge above them, later has for each node
    on the edge the code points from it to the edge's end (the end not
    counted), and either parent's conv is known or parent is the id of a node
    on the border.  Nodes on the first sequence (path number 2 * part) and the
    last one (2 * part + 1) come one by one with id, parent's id and the
    share of this run; children, leaves and saved of these count nodes within
    the run only.
    """
    stack: list[_Point] = []
    first = path = chars = None
    prefixes: list[bytes] = []
    border = 0  # depth down to which the present path is the first one

    def complete(p: _Point, above: _Point, inside: bool):
        """Takes a node within the run off: its row waits for its parent's smallest member if that is within the run too."""
        p.saved += (p.members - 1) * chars[p.depth - 1]
        later = [0, *accumulate(chars[p.depth - 2 : above.depth - 1 if above.depth else None : -1])] if p.depth - above.depth > 1 else [0]
        for row in p.held:
            yield (*row[:9], p.conv, *row[10:])
        row = (None, p.depth, None if inside else prefixes[above.depth], None, None, above.depth + 1, later[::-1], p.members, p.conv, None, p.children, p.leaves or 1, p.saved, p.end)
        above.children += 1
        above.leaves += p.leaves or 1
        above.saved += p.saved + (p.members - 1) * later[-1]
        _add(above, p)
        if inside:
            above.held.append(row)
        else:
            yield row

    def on_border(p: _Point, top: int, ids: list[bytes], number: int):
        """The nodes from depth top to p, one by one; those above p have its sums."""
        for d in range(top, p.depth + 1):
            at = d == p.depth
            yield (ids[d], d, ids[d - 1] if d else None, number, chars[d - 1] if d else 0, None, None, p.members, p.conv, None, p.children if at else 0, p.leaves, p.saved, p.end if at else None)

    def _add(above: _Point, p: _Point):
        above.members += p.members
        above.conv = p.conv if above.conv is None else min(above.conv, p.conv)

    def popped(to: int):
        """Takes all points below a depth off, and leaves one there."""
        nonlocal border
        while stack[-1].depth > to:
            p = stack.pop()
            if stack[-1].depth < to:
                stack.append(_Point(to))
            above = stack[-1]
            if p.depth <= border:
                yield from on_border(p, above.depth + 1, prefixes, 2 * part)
                above.leaves += p.leaves
                above.saved += p.saved
                _add(above, p)
            else:
                yield from complete(p, above, above.depth > border)
        border = min(border, to)

    for new, sizes, members, conv in rows:
        if path is None:
            first, prefixes = new, _prefixes(new)
            border = len(new) // WIDE
            stack = [_Point(0)]
        else:
            yield from popped(_shared(path, new))
        path, chars = new, sizes
        depth = len(new) // WIDE
        if stack[-1].depth < depth:
            stack.append(_Point(depth))
        p = stack[-1]
        p.members, p.conv, p.end = members, conv, hashlib.md5(new).digest()
    if path is None:
        return
    # what is left on the stack is the last path; it is the first one down to ``border``
    ids = _prefixes(path)
    while stack:
        p = stack.pop()
        top = stack[-1].depth + 1 if stack else 0
        for row in p.held:
            yield (*row[:2], ids[p.depth], *row[3:])
        for d in range(p.depth, top - 1, -1):
            at = d == p.depth
            yield (ids[d], d, ids[d - 1] if d else None, 2 * part + (d > border), chars[d - 1] if d else 0, None, None, p.members, p.conv, None, p.children if at else 0, p.leaves, p.saved, p.end if at else None)
        if stack:
            stack[-1].leaves += p.leaves
            stack[-1].saved += p.saved
            _add(stack[-1], p)
    # the last path shares its upper nodes with the first one: there it has no share of its own
    if len(path) // WIDE > border:
        for d in range(border + 1):
            yield (ids[d], d, ids[d - 1] if d else None, 2 * part + 1, chars[d - 1] if d else 0, None, None, 0, None, None, 0, 0, 0, None)


_SCHEMA = pa.schema([("id", pa.binary()), ("depth", pa.int64()), ("parent", pa.binary()), ("number", pa.int64()), ("chars", pa.int64()), ("top", pa.int64()), ("later", pa.list_(pa.int64())), ("members", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("end", pa.binary())])
_KINDS = "id binary, depth long, parent binary, number long, chars long, top long, later array<long>, members long, conv_id long, parent_conv_id long, children long, leaves long, saved long, end binary"


def _walk(batches):
    from pyspark import TaskContext

    def rows():
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                some = b.slice(k, 1024)
                yield from zip(*(some.column(c).to_pylist() for c in ("path", "chars", "members", "conv_id")))

    out = []
    for row in walked(rows(), TaskContext.get().partitionId()):
        out.append(row)
        if len(out) == 4096:
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in out], _SCHEMA)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in out], _SCHEMA)


def member_hashes(convs: DataFrame) -> DataFrame:
    """(end, ends_sha256): SHA-256 of the ascending, comma-joined ids of the conversations with one path, by MD5 of the path."""
    rows = convs.select(F.unhex(F.md5("path")).alias("end"), "conv_id")
    count = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartitionByRange(count, "end", "conv_id").sortWithinPartitions("end", "conv_id")

    def blocks(batches):
        for b in batches:
            end, conv = b.column("end").to_pylist(), b.column("conv_id").to_pylist()
            cuts = [k for k in range(len(end)) if not k or end[k] != end[k - 1]]
            cuts = [k for a, z in zip(cuts, [*cuts[1:], len(end)]) for k in range(a, z, BLOCK)]
            ids = [",".join(map(str, conv[a:z])) for a, z in zip(cuts, [*cuts[1:], len(end)])]
            yield pa.RecordBatch.from_arrays([pa.array([end[k] for k in cuts], pa.binary()), pa.array([conv[k] for k in cuts], pa.int64()), pa.array(ids, pa.string())], names=["end", "first", "ids"])

    def hashed(batches):
        end = h = None
        for b in batches:
            done = []
            for key, ids in zip(b.column("end").to_pylist(), b.column("ids").to_pylist()):
                if key != end:
                    if h is not None:
                        done.append((end, h.hexdigest()))
                    end, h = key, hashlib.sha256(ids.encode())
                else:
                    h.update(b",")
                    h.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([x for _, x in done])], names=["end", "ends_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([h.hexdigest()])], names=["end", "ends_sha256"])

    packed = rows.mapInArrow(blocks, "end binary, first long, ids string")
    return packed.repartition("end").sortWithinPartitions("end", "first").mapInArrow(hashed, "end binary, ends_sha256 string")


def trie(convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations (conv_id, path, chars).

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the
    root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256.  Without
    conversations there is no node; a conversation without turns ends at the
    root.  convs is read more than once.
    """
    spark = convs.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    distinct = convs.groupBy("path", "chars").agg(F.count("*").alias("members"), F.min("conv_id").alias("conv_id"))
    found = stored(distinct.repartitionByRange(count, "path").sortWithinPartitions("path").mapInArrow(_walk, _KINDS), "trie-points")
    # nodes on borders: shares added up; a node belongs to the first sequence that has it
    lines = found.where("id IS NOT NULL")
    nodes = lines.groupBy("id", "depth", "parent", "chars").agg(
        F.min("number").alias("owner"), *(F.sum(c).alias(c) for c in ("members", "children", "leaves", "saved")), F.min("conv_id").alias("conv_id"), F.max("end").alias("end")
    )
    nodes = stored(nodes, "trie-border")
    below = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("more"))
    nodes = nodes.join(below, "id", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0)))
    # what the border's own nodes add to all above them, along the sequence that owns them
    own = nodes.select("id", "owner", (F.col("children") == 0).cast("long").alias("leaf"), ((F.col("members") - 1) * F.col("chars")).alias("gain"))
    along = lines.select("id", "depth", "number").join(own, "id")
    mine = F.col("number") == F.col("owner")
    down = Window.partitionBy("number").orderBy(F.col("depth").desc())
    along = along.select("id", *(F.sum(F.when(mine, F.col(c)).otherwise(0)).over(down).alias(c) for c in ("leaf", "gain")))
    along = along.groupBy("id").agg(F.sum("leaf").alias("leaf"), F.sum("gain").alias("gain"))
    nodes = nodes.join(along, "id").select("id", "depth", "parent", "conv_id", F.col("members").alias("n_convs"), F.col("children").alias("n_children"), (F.col("leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved") + F.col("gain")).alias("saved_tokens"), "end")
    nodes = stored(nodes, "trie-border-sums")
    above = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("above"))
    border = nodes.join(above, "parent", "left").select("conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "end")
    # nodes within a task's run, and those of one child along their edges
    inner = found.where("id IS NULL").join(above, "parent", "left")
    one = inner.select("depth", "top", "members", "conv_id", F.coalesce("parent_conv_id", "above").alias("above"), "children", "leaves", "saved", "end", F.posexplode("later").alias("k", "later"))
    here = F.col("top") + F.col("k")
    last = here == F.col("depth")
    within = one.select(
        "conv_id", here.alias("depth"), F.when(F.col("k") == 0, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("members").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("members") - 1) * F.col("later")).alias("saved_tokens"), F.when(last, F.col("end")).alias("end"),
    )
    out = border.unionByName(within).join(member_hashes(convs), "end", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
