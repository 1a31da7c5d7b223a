"""Prefix trie of conversations, built by range shards (operator 13).

A conversation is a sequence of turns, and a turn is the 128-bit hash of its role
and text.  Sequences are sorted by those hashes over the whole cluster; equal ones
are folded into one with a count, their ids hashed in order from chunks.  A shard
is a run of consecutive sequences of about ``SHARD`` turns.  It numbers its own
turns by a dictionary and inserts its sequences into a ternary search tree, the
median first, then the medians of both halves, so that the turns after a node
form a balanced tree.  Nodes in reverse order of creation then hand their
members, leaves and savings to their parents.

A node that several shards share is a prefix of the first or last sequence of
each of them.  These two spines of a shard stay open: they are rows again, a
sequence with what is closed so far by depth, and go through the same step in
the next round, in far fewer shards, until one shard holds all that is left and
closes it.  A closed node whose parent was still open finds it by the parent's
path hash at the end.

Turns come by turn number (null first), turns of one number by their hashes.
Null role or text counts as empty.  Rows without a conv_id belong to no
conversation and are left out.  Repeated rows are turns like others.  An empty
table gives no nodes, not even a root; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscope.llm.spill import stored

#: Turns of a shard (and rows, so that each round leaves far fewer spines), and
#: ids in one chunk of a folded sequence.
SHARD, SHARD_ROWS, CHUNK = 1 << 18, 32, 1 << 16
#: So many spines are closed by one task.
LAST = 1 << 11
#: Turns of a partition at least, where there are less than shuffle partitions.
FEW = 1 << 13
ID = 16
#: Turns of another conversation that ``prefixed`` puts in front, at most.
FRONT = 5
NONE = np.iinfo(np.int64).max
EMPTY = hashlib.sha256(b"").hexdigest()

# ------------------------------------------------------------------- sequences

SEQUENCES = pa.schema([("conv_id", pa.int64()), ("seq", pa.binary()), ("sizes", pa.binary())])
SEQUENCES_SQL = "conv_id long, seq binary, sizes binary"


def _prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences from rows sorted by (base, conversation, turn); the base's own
    rows come first.  The first ``front`` turns are the base's, the rest is the
    conversation's own after as many."""
    base = conv = None
    first: tuple[list, list] = ([], [])
    ids, sizes, front, out = [], [], 0, []

    def done():
        if conv == base:
            first[0][:], first[1][:] = ids[:FRONT], sizes[:FRONT]
        seq = first[0][:front] + ids[front:]
        return conv, b"".join(seq), np.array(first[1][:front] + sizes[front:], "<i8").tobytes()

    for b in batches:
        for own_base, c, h, i, size in zip(*(x.to_pylist() for x in b.columns)):
            if c != conv:
                if conv is not None:
                    out.append(done())
                if own_base != base:
                    base, first = own_base, ([], [])
                conv, ids, sizes, front = c, [], [], h
            ids.append(i)
            sizes.append(size)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), SEQUENCES)], schema=SEQUENCES)
            out = []
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(done(), SEQUENCES)], schema=SEQUENCES)


def sequences(conversations: DataFrame, front: str = "0", base: str = "conv_id") -> DataFrame:
    """(conv_id, seq: the turns' hashes, sizes: their texts' code points as int64).

    ``front`` and ``base`` are SQL over conv_id: the first ``front`` turns (at most
    ``FRONT``) are those of conversation ``base``, whose own base is itself."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("id"),
        F.length(text).cast("long").alias("size"),
    ).where("conv_id is not null")
    turns = turns.withColumns({"base": F.expr(base).cast("long"), "front": F.expr(front).cast("long")})
    return (
        turns.repartition("base")
        .sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "id")
        .select("base", "conv_id", "front", "id", "size")
        .mapInArrow(_prefixed, SEQUENCES_SQL)
    )


# ------------------------------------------------------------------------ fold

FOLDED = pa.schema([("seq", pa.binary()), ("sizes", pa.binary()), ("n", pa.int64()), ("low", pa.int64()), ("ids", pa.binary())])
FOLDED_SQL = "seq binary, sizes binary, n long, low long, ids binary"


def _fold(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Equal neighbours become one row with their ids in order, ``chunk`` at most."""
    seq = sizes = None
    ids: list[int] = []
    out: list[tuple] = []
    for b in batches:
        for c, s, z in zip(*(x.to_pylist() for x in b.columns)):
            if s != seq or len(ids) == chunk:
                if ids:
                    out.append((seq, sizes, len(ids), ids[0], ",".join(map(str, ids)).encode()))
                seq, sizes, ids = s, z, []
            ids.append(c)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), FOLDED)], schema=FOLDED)
            out = []
    if ids:
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], f.type) for x, f in zip((seq, sizes, len(ids), ids[0], ",".join(map(str, ids)).encode()), FOLDED)], schema=FOLDED
        )


# ------------------------------------------------------------------------ trie


class Spine:
    """A sequence and, for each of its depths, what is known of that node so far:
    members, least member, closed children, their leaves and savings, and the
    hash of those that end there."""

    __slots__ = ("seq", "sizes", "values", "ends")

    def __init__(self, seq: bytes, sizes: np.ndarray, values: np.ndarray, ends: dict[int, str]):
        self.seq, self.sizes, self.values, self.ends = seq, sizes, values, ends

    @classmethod
    def of(cls, seq: bytes, sizes: bytes, n: int, low: int, ends: str) -> Spine:
        depth = len(seq) // ID
        values = np.zeros((5, depth + 1), np.int64)
        values[0], values[1] = n, low
        return cls(seq, np.frombuffer(sizes, "<i8"), values, {depth: ends})


def _medians(n: int) -> Iterator[int]:
    """0..n-1, the median first, then those of both halves."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            todo += [(m + 1, b), (a, m)]


class Tree:
    """A ternary search tree over the turns of sorted sequences.  Node 0 is the
    root; ``lower`` and ``higher`` lead to other turns after the same parent,
    ``child`` to the turns after this one; 0 is none."""

    def __init__(self, spines: list[Spine]):
        every = np.frombuffer(b"".join(s.seq for s in spines), f"V{ID}")
        self.turns, codes = np.unique(every, return_inverse=True)
        codes = codes.tolist()
        starts = np.cumsum([0] + [len(s.seq) // ID for s in spines]).tolist()
        self.code, self.lower, self.child, self.higher = [-1], [0], [0], [0]
        self.parent, self.depth, self.size = [0], [0], [0]
        self.paths: list = [None] * len(spines)
        for i in _medians(len(spines)):
            self.paths[i] = self._insert(codes[starts[i] : starts[i + 1]], spines[i].sizes)
        self.values = np.zeros((5, len(self.code)), np.int64)
        self.values[1] = NONE
        self.ends: dict[int, str] = {}
        for s, path in zip(spines, self.paths):
            at = np.array(path)
            self.values[0, at] += s.values[0]
            self.values[1, at] = np.minimum(self.values[1, at], s.values[1])
            self.values[2:, at] += s.values[2:]
            for d, sha in s.ends.items():
                self.ends[path[d]] = sha

    def _insert(self, codes: list[int], sizes: np.ndarray) -> list[int]:
        code, lower, child, higher = self.code, self.lower, self.child, self.higher
        path, at = [0], 0
        for d, c in enumerate(codes):
            links, from_ = child, at
            node = child[at]
            while node and code[node] != c:
                links, from_ = (lower, node) if c < code[node] else (higher, node)
                node = links[node]
            if not node:
                node = len(code)
                links[from_] = node
                for column, x in ((code, c), (lower, 0), (child, 0), (higher, 0), (self.parent, at), (self.depth, d + 1), (self.size, int(sizes[d]))):
                    column.append(x)
            path.append(node)
            at = node
        return path

    def close(self, opened: set[int]) -> None:
        """Hand leaves and savings up, from the last node to the first; a node's
        children are younger than it.  Open nodes keep theirs."""
        n, low, kids, leaves, saved = (x.tolist() for x in self.values)
        parent, size = self.parent, self.size
        for i in range(len(n) - 1, -1, -1):
            if i in opened:
                continue
            if not kids[i]:
                leaves[i] = 1
            saved[i] += (n[i] - 1) * size[i]
            if i:
                p = parent[i]
                kids[p] += 1
                leaves[p] += leaves[i]
                saved[p] += saved[i]
        self.values = np.array([n, low, kids, leaves, saved], np.int64)


CLOSED = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
OPEN = [("own", pa.binary()), ("above", pa.binary()), ("seq", pa.binary()), ("sizes", pa.binary()), ("values", pa.binary()), ("ends", pa.list_(pa.string()))]
STEP = pa.schema(CLOSED + OPEN)
CLOSED_SQL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
STEP_SQL = CLOSED_SQL + ", own binary, above binary, seq binary, sizes binary, values binary, ends array<string>"


def _path_hashes(seq: bytes) -> list[bytes]:
    """The hash of each prefix, the empty one first."""
    h, out = hashlib.blake2b(digest_size=16), []
    out.append(h.digest())
    for a in range(0, len(seq), ID):
        h.update(seq[a : a + ID])
        out.append(h.digest())
    return out


def _shard(spines: list[Spine], first_round: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Closed nodes and open spines of one shard."""
    t = Tree(spines)
    ends_of = [0, len(spines) - 1] if len(spines) > 1 else [0]
    opened = set() if last else {i for x in ends_of for i in t.paths[x]}
    t.close(opened)
    n, low, kids, leaves, saved = t.values
    closed = np.array([i for i in range(len(n)) if i not in opened], np.int64)
    parent = np.array(t.parent)[closed]
    unknown = np.isin(parent, list(opened)) if opened else np.zeros(len(closed), bool)
    own: list = [None] * len(closed)
    above: list = [None] * len(closed)
    if unknown.any():
        key = {i: k for x in ends_of for i, k in zip(t.paths[x], _path_hashes(spines[x].seq))}
        above = [key[p] if u else None for p, u in zip(parent.tolist(), unknown.tolist())]
    if not first_round:  # an earlier round may have closed children of these nodes
        key = {}
        for s, path in zip(spines, t.paths):
            key.update(zip(path, _path_hashes(s.seq)))
        own = [key[i] for i in closed.tolist()]
    none = pa.array([None] * len(closed), pa.binary())
    lows = low[closed]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(lows), pa.array(np.array(t.depth)[closed]), pa.array(low[parent], mask=unknown | (closed == 0)), pa.array(n[closed]), pa.array(kids[closed]),
            pa.array(leaves[closed]), pa.array(saved[closed]), pa.array([t.ends.get(i, EMPTY) for i in closed.tolist()], pa.string()),
            pa.array(own, pa.binary()), pa.array(above, pa.binary()), none, none, none, pa.array([None] * len(closed), pa.list_(pa.string())),
        ],
        schema=STEP,
    )
    told: set[int] = set()
    for x in ends_of if opened else []:
        path = np.array(t.paths[x])
        fresh = np.array([i not in told for i in t.paths[x]])
        values = np.where(fresh, t.values[:, path], 0)
        values[1, ~fresh] = NONE
        sha = [t.ends.get(i) if new else None for i, new in zip(t.paths[x], fresh)]
        told.update(t.paths[x])
        row = [None] * (len(CLOSED) + 2) + [spines[x].seq, spines[x].sizes.tobytes(), values.tobytes(), sha]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, STEP)], schema=STEP)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[Spine]:
    """One spine for each sequence, its chunks of ids hashed in order."""
    seq = None
    for b in batches:
        for s, z, n, low, ids in zip(*(x.to_pylist() for x in b.columns)):
            if s != seq:
                if seq is not None:
                    yield Spine.of(seq, sizes, members, least, sha.hexdigest())
                seq, sizes, members, least, sha = s, z, 0, low, hashlib.sha256()
            sha.update(b"," + ids if members else ids)
            members += n
    if seq is not None:
        yield Spine.of(seq, sizes, members, least, sha.hexdigest())


def _reopened(batches: Iterator[pa.RecordBatch]) -> Iterator[Spine]:
    for b in batches:
        for seq, sizes, values, ends in zip(*(x.to_pylist() for x in b.columns)):
            yield Spine(seq, np.frombuffer(sizes, "<i8"), np.frombuffer(values, "<i8").reshape(5, -1), {d: x for d, x in enumerate(ends) if x})


def _step(batches: Iterator[pa.RecordBatch], read, shard: int, rows: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Shards of consecutive sequences, as many as the partition has."""
    some: list[Spine] = []
    turns = 0
    for s in read(batches):
        if not last and turns > shard and len(some) >= rows:
            yield from _shard(some, read is _folded, last)
            some, turns = [], 0
        some.append(s)
        turns += 1 + len(s.seq) // ID
    if some:
        yield from _shard(some, read is _folded, last)


def _parts(spark, turns: int, shard: int, few: int = FEW) -> int:
    """Partitions for so many turns: a shard each, or less where there are few."""
    return max(1, math.ceil(turns / shard), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(turns / few)))


def nodes(seqs: DataFrame, shard: int = SHARD, shard_rows: int = SHARD_ROWS, chunk: int = CHUNK, last: int = LAST, few: int = FEW) -> DataFrame:
    """One row for each distinct prefix of the sequences: conv_id (its smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    spark = seqs.sparkSession
    seqs = stored(seqs, "trie-sequences")
    turns = F.coalesce(F.sum(F.octet_length("seq") / ID + 1), F.lit(0)).cast("long")
    n = _parts(spark, seqs.agg(turns).first()[0], shard, few)
    fold = lambda b: _fold(b, chunk)
    folded = stored(seqs.repartitionByRange(n, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(fold, FOLDED_SQL), "trie-folded")
    closed, read, one = [], _folded, n == 1
    left = (folded.coalesce(1) if one else folded.repartitionByRange(n, "seq")).sortWithinPartitions("seq", "low")
    while True:
        step = partial(_step, read=read, shard=shard, rows=shard_rows, last=one)
        done = stored(left.mapInArrow(step, STEP_SQL), "trie-round")
        closed.append(done.where("seq is null"))
        if one:
            break
        spines = done.where("seq is not null").select("seq", "sizes", "values", "ends")
        rows, size = spines.agg(F.count(F.lit(1)), turns).first()
        read, one = _reopened, rows <= last
        n = 1 if one else max(1, min(_parts(spark, size, shard, few), rows // shard_rows))
        left = spines.coalesce(1).sortWithinPartitions("seq") if one else spines.repartitionByRange(n, "seq").sortWithinPartitions("seq")
    every = closed[0]
    for more in closed[1:]:
        every = every.unionByName(more)
    columns = [f.name for f in STEP][: len(CLOSED)]
    known = every.where("above is null").select(*columns)
    if len(closed) == 1:
        return known
    parents = every.where("own is not null").select(F.col("own").alias("above"), F.col("conv_id").alias("parent"))
    found = every.where("above is not null").join(parents, "above").withColumn("parent_conv_id", F.col("parent"))
    return known.unionByName(found.select(*columns))


def digest_sql() -> str:
    """The same in DuckDB: prefixes as chains of hashes, subtree sums over the
    ancestors of each node, taken from its smallest member's prefixes."""
    crc = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split({c}::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
        lambda crc, b: list_reduce(list_concat([xor(crc, b)], list_transform(range(8), lambda x: 0::UBIGINT)), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT)"""
    return f"""
    WITH t AS (
      SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, length(coalesce(text, '')) AS size,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
    h AS (SELECT c, ({crc.format(c="c")} % 6)::BIGINT AS front FROM (SELECT DISTINCT c FROM t)),
    built AS (
      SELECT h.c, 0 AS part, t.pos, t.id, t.size FROM h JOIN t ON t.c = h.c - h.c % 100 AND t.pos <= h.front
      UNION ALL SELECT h.c, 1, t.pos, t.id, t.size FROM h JOIN t ON t.c = h.c AND t.pos > h.front),
    placed AS (SELECT c, id, size, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth FROM built),
    paths AS (
      SELECT c, depth, size, string_agg(id, '') OVER (PARTITION BY c ORDER BY depth) AS path FROM placed
      UNION ALL SELECT c, 0, 0, '' FROM h),
    keyed AS (SELECT c, depth, size, md5(path) AS k, CASE WHEN depth > 0 THEN md5(substr(path, 1, length(path) - 32)) END AS up FROM paths),
    node AS (SELECT k, min(up) AS up, min(depth) AS depth, min(c) AS c, min(size) AS size, count(*) AS n FROM keyed GROUP BY k),
    kids AS (SELECT up, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up),
    under AS (
      SELECT a.k, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((node.n - 1) * node.size) AS saved
      FROM node LEFT JOIN kids ON kids.up = node.k JOIN keyed a ON a.c = node.c AND a.depth <= node.depth GROUP BY a.k),
    ends AS (
      SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM keyed
      WHERE (c, depth) IN (SELECT c, max(depth) FROM keyed GROUP BY c) GROUP BY k)
    SELECT node.c AS conv_id, node.depth::BIGINT AS depth, above.c AS parent_conv_id, node.n::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
           under.leaves::BIGINT AS n_leaves, under.saved::BIGINT AS saved_tokens, coalesce(ends.sha, '{EMPTY}') AS ends_sha256
    FROM node JOIN under USING (k) LEFT JOIN kids ON kids.up = node.k LEFT JOIN node above ON above.k = node.up LEFT JOIN ends ON ends.k = node.k"""


def prefix_digest(conversations: DataFrame) -> DataFrame:
    """The nodes of conversations whose first crc32(conv_id) % 6 turns are replaced
    by those of the conversation that begins their hundred."""
    return nodes(sequences(conversations, "crc32(cast(conv_id as string)) % 6", "conv_id - conv_id % 100"))
