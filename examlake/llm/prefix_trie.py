"""Prefix trie of conversations: adaptive radix trees over fixed-width turn ids, one for each range of sorted conversations, joined at their edges.

A turn's id is 16 bytes of a digest of its role and text, a conversation's key the
ids in order, so byte order groups conversations by shared beginnings.  Spark
deals conversations out in ranges of (key, conv_id); a hot first turn, or copies of
one conversation, spread over as many ranges as their number asks for.  Each task
inserts its range into an adaptive radix tree, which sorts it.  A node that is no
prefix of the range's first or last key has all its members there and is final.
The others are edges: their counts add up over ranges, less what two neighbouring
ranges both counted, which their facing keys tell.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlake.llm.common import small_batches, written

#: Bytes of a turn id; words as every counting operator here takes them.
WIDTH = 16
WORD = r"[^\x20\x09-\x0D]+"
#: A conversation borrows from the one at the foot of its block, at most so many turns less one.
BLOCK, HEADS = 20, 4
#: Conversations and turns of a range, by which the number of ranges is set.
CONVERSATIONS, TURNS = 20_000, 200_000
#: Rows of an output batch, and kinds of rows.
ROWS = 4096
FINAL, EDGE, FACE = 0, 1, 2

NODE = "kind int, conv_id long, depth int, edge binary, parent_edge binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends string, first_end long"
MADE = f"{NODE}, range long, low binary, low_words array<int>, high binary"


# -- the tree ---------------------------------------------------------------------------------------------------------


class Node:
    """A node of the tree: compressed path, members that end here, and children in one of four layouts by their number.

    Up to 4 and up to 16 children: a sorted row of bytes beside the children.  Up
    to 48: an index of 256 bytes into the children.  More: 256 places.
    """

    __slots__ = ("path", "ends", "row", "bytes", "kids", "size", "at_edge")

    def __init__(self, path: bytes, row: int):
        self.path, self.row, self.ends = path, row, []
        self.bytes, self.kids, self.size, self.at_edge = bytearray(), [], 0, False

    def child(self, byte: int) -> Node | None:
        if self.size <= 16:
            at = bisect_left(self.bytes, byte)
            return self.kids[at] if at < self.size and self.bytes[at] == byte else None
        if self.size <= 48:
            at = self.bytes[byte]
            return self.kids[at] if at < 255 else None
        return self.kids[byte]

    def put(self, byte: int, node: Node) -> None:
        """Add or replace a child; the layout grows with the number of children."""
        if self.size <= 16:
            at = bisect_left(self.bytes, byte)
            if at < self.size and self.bytes[at] == byte:
                self.kids[at] = node
                return
            self.bytes.insert(at, byte)
            self.kids.insert(at, node)
            self.size += 1
            if self.size == 17:
                index = bytearray(b"\xff" * 256)
                for i, b in enumerate(self.bytes):
                    index[b] = i
                self.bytes = index
        elif self.size <= 48:
            if self.bytes[byte] < 255:
                self.kids[self.bytes[byte]] = node
                return
            self.bytes[byte] = self.size
            self.kids.append(node)
            self.size += 1
            if self.size == 49:
                self.kids = [self.kids[i] if i < 255 else None for i in self.bytes]
                self.bytes = bytearray()
        else:
            self.size += self.kids[byte] is None
            self.kids[byte] = node

    def children(self) -> list[Node]:
        """In order of their bytes."""
        if self.size <= 16:
            return self.kids
        if self.size <= 48:
            return [self.kids[i] for i in self.bytes if i < 255]
        return [k for k in self.kids if k is not None]


def _shared(a: bytes, b: bytes) -> int:
    """Bytes that two strings begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def insert(root: Node, key: bytes, conv: int, row: int) -> None:
    node, at = root, 0
    while True:
        if at == len(key):
            node.ends.append(conv)
            return
        child = node.child(key[at])
        if child is None:
            leaf = Node(key[at:], row)
            leaf.ends.append(conv)
            node.put(key[at], leaf)
            return
        same = _shared(child.path, key[at : at + len(child.path)])
        if same < len(child.path):
            middle = Node(child.path[:same], child.row)
            child.path = child.path[same:]
            middle.put(child.path[0], child)
            node.put(key[at], middle)
            child = middle
        node, at = child, at + same


def _mark(root: Node, key: bytes) -> None:
    node, at = root, 0
    root.at_edge = True
    while at < len(key):
        node = node.child(key[at])
        at += len(node.path)
        node.at_edge = True


def _rows_of(root: Node, keys: list[bytes], words: list[list[int]]) -> list[dict]:
    """The trie nodes of a tree: those byte depths that end a turn, children before parents."""
    order, todo = [], [(root, -1, -1)]
    while todo:
        node, above, begin = todo.pop()
        end = 0 if begin < 0 else begin + len(node.path)
        order.append((node, above, begin, end))
        todo += [(k, len(order) - 1, end) for k in node.children()]
    held = [[0, None, 0, 0, []] for _ in order]  # of the children: members, smallest, leaves, saved tokens, topmost rows
    rows: list[dict] = []
    for i in range(len(order) - 1, -1, -1):
        node, above, begin, end = order[i]
        n, least, leaves, saved, tops = held[i]
        n += len(node.ends)
        least = min(x for x in (least, min(node.ends, default=None)) if x is not None)
        for depth in range(end // WIDTH, begin // WIDTH, -1):
            here = sorted(node.ends) if depth * WIDTH == end else []
            saved += (n - 1) * words[node.row][depth - 1] if depth else 0
            leaves = leaves or 1
            text = ",".join(map(str, here))
            row = {"conv_id": least, "depth": depth, "n_convs": n, "n_children": len(tops), "n_leaves": leaves, "saved_tokens": saved, "parent": None}
            if node.at_edge:
                row |= {"kind": EDGE, "edge": hashlib.sha256(keys[node.row][: depth * WIDTH]).digest()[:WIDTH], "ends": text if here else None, "first_end": here[0] if here else None}
                if depth:
                    row["parent_edge"] = hashlib.sha256(keys[node.row][: (depth - 1) * WIDTH]).digest()[:WIDTH]
            else:
                row |= {"kind": FINAL, "ends_sha256": hashlib.sha256(text.encode()).hexdigest()}
            for top in tops:
                if rows[top]["kind"] == FINAL:
                    rows[top] |= {"parent_edge": row["edge"]} if node.at_edge else {"parent_conv_id": least}
            rows.append(row)
            tops = [len(rows) - 1]
        if above >= 0:
            to = held[above]
            to[0], to[2], to[3] = to[0] + n, to[2] + leaves, to[3] + saved
            to[1] = least if to[1] is None else min(to[1], least)
            to[4] += tops
    return rows


def _batches(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for begin in range(0, len(rows), ROWS):
        part = rows[begin : begin + ROWS]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in part], f.type) for f in schema], schema=schema)


_LONGS = ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "first_end", "range")
_NODE = pa.schema([(c.split()[0], pa.int64() if c.split()[0] in _LONGS else {"int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[c.split()[1]]) for c in NODE.split(", ")])
_MADE = pa.schema([*_NODE, ("range", pa.int64()), ("low", pa.binary()), ("low_words", pa.list_(pa.int32())), ("high", pa.binary())])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of this task's range, and a row with the keys that face its neighbours."""
    keys: list[bytes] = []
    words: list[list[int]] = []
    root = Node(b"", 0)
    for batch in batches:
        for conv, ids, counts in zip(batch.column("conv_id").to_pylist(), batch.column("ids").to_pylist(), batch.column("words").to_pylist(), strict=True):
            key = b"".join(ids)
            insert(root, key, conv, len(keys))
            keys.append(key)
            words.append(counts)
    if keys:
        low, high = min(range(len(keys)), key=keys.__getitem__), max(range(len(keys)), key=keys.__getitem__)
        _mark(root, keys[low])
        _mark(root, keys[high])
        face = {"kind": FACE, "range": TaskContext.get().partitionId(), "low": keys[low], "low_words": words[low], "high": keys[high]}
        yield from _batches([face, *_rows_of(root, keys, words)], _MADE)


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What two neighbouring ranges both counted of the nodes that their facing keys share, to be taken off."""
    for batch in batches:
        for high, low, words in zip(batch.column("high").to_pylist(), batch.column("next_low").to_pylist(), batch.column("next_words").to_pylist(), strict=True):
            depth = _shared(high, low) // WIDTH
            rows, digest, edges = [], hashlib.sha256(), []
            for d in range(depth + 1):
                edges.append(digest.copy().digest()[:WIDTH])
                digest.update(low[d * WIDTH : (d + 1) * WIDTH])
            saved = 0
            for d in range(depth, -1, -1):
                saved += words[d - 1] if d else 0
                rows.append({"kind": EDGE, "edge": edges[d], "depth": d, "parent_edge": edges[d - 1] if d else None, "n_convs": 0, "n_children": -int(d < depth), "n_leaves": -int(depth * WIDTH == len(high)), "saved_tokens": saved})
            yield from _batches(rows, _NODE)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each edge's ends, which come sorted in chunks: nothing but the hash's state is held."""
    at, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()])], ["edge", "ends_sha256"])

    for batch in batches:
        for edge, ends in zip(batch.column("edge").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if edge != at:
                if digest:
                    yield done()
                at, digest = edge, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ends.encode())
    if digest:
        yield done()


# -- conversations ----------------------------------------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns array<struct<turn, id, words>>`` in the order of turns, null first; equal turns in the order of their ids."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn_id = F.unhex(F.substring(F.sha2(named.cast("binary"), 256), 1, 2 * WIDTH))
    rows = conversations.where("conv_id is not null").select("conv_id", F.struct("turn", turn_id.alias("id"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, ids, words``: the first h turns of the conversation at the foot of the block, then the own turns after the first h."""
    own = written(turns(conversations), "turns")
    foot = own.where(f"conv_id % {BLOCK} = 0").select(F.col("conv_id").alias("foot"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    joined = own.withColumn("h", h).withColumn("foot", F.expr(f"if(h > 0, conv_id - conv_id % {BLOCK}, null)")).join(foot, "foot", "left")
    whole = F.expr("concat(slice(coalesce(head, slice(turns, 1, 0)), 1, h), slice(turns, h + 1, size(turns)))")
    return written(joined.select("conv_id", whole.alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words")), "rebuilt")


def nodes(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of the rebuilt ``conversations`` (``conv_id, turn, role, text``; others are ignored).

    Columns: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.  Null roles and texts are empty; rows without a
    conv_id belong to no conversation and are left out; repeated rows are turns
    of their own; turns with one number follow in the order of their ids.  An
    empty table has no nodes, not even a root.  A conversation's key, 16 bytes a
    turn, is one row.  The hash of a node's ends is sequential by its nature: one
    task reads them in order, chunk after chunk, and holds none.
    """
    small_batches(conversations.sparkSession)
    full = rebuilt(conversations)
    size = full.agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("turns")).first()
    ranges = max(full.sparkSession.sparkContext.defaultParallelism, size["n"] // CONVERSATIONS + 1, (size["turns"] or 0) // TURNS + 1)
    made = written(full.repartitionByRange(ranges, "ids", "conv_id").mapInArrow(_trees, MADE), "trees")
    beside = Window.orderBy("range")
    faces = made.where(f"kind = {FACE}").select("high", F.lead("low").over(beside).alias("next_low"), F.lead("low_words").over(beside).alias("next_words"))
    own = made.where(f"kind = {EDGE}").select(*(f.name for f in _NODE))
    edges = own.union(faces.where("next_low is not null").mapInArrow(_twice, NODE)).groupBy("edge").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_edge").alias("parent_edge"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))
    )
    ends = own.where("ends is not null").select("edge", "first_end", "ends").repartition("edge").sortWithinPartitions("edge", "first_end").mapInArrow(_digests, "edge binary, ends_sha256 string")
    edges = written(edges.join(ends, "edge", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))), "edges")
    parents = edges.select(F.col("edge").alias("parent_edge"), F.col("conv_id").alias("of_parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    final = made.where(f"kind = {FINAL}")
    below = final.where("parent_edge is not null").drop("parent_conv_id").select("parent_edge", *(c for c in columns if c != "parent_conv_id"))
    below = below.union(edges.select("parent_edge", *(c for c in columns if c != "parent_conv_id"))).join(parents, "parent_edge", "left").withColumnRenamed("of_parent", "parent_conv_id")
    return final.where("parent_edge is null").select(*columns).union(below.select(*columns)).withColumn("depth", F.col("depth").cast("long"))
