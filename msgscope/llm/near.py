"""Near-duplicate documents by ProbMinHash (operator 2).

A document is its weighted shingles: runs of five words with their counts (all
its words, if fewer).  Similarity is the probability Jaccard of two documents,
``sum over common d of 1 / sum over d' of max(a(d')/a(d), b(d')/b(d))``; with
equal counts it is the plain Jaccard of the shingle sets.  0.8 or more is a link.

1. Equal texts fold into one node (by a 128-bit hash).  Nodes are numbered in the
   order of (least doc_id, hash), by ranges over the cluster.
2. Signatures: every shingle sends arrivals of a Poisson process of the rate of
   its count to random registers, and stops once an arrival comes after the
   latest register; a register keeps the shingle that came first, so two documents
   agree in a register with a probability of their similarity.
3. Banding: ``BANDS`` hashes of ``ROWS`` registers each.  Each bucket's least
   node leads it; every other member is paired with that leader, once however
   many buckets say so.  No other pairs are made.
4. Verification: exact similarity to the leader, in blocks of bounded size that
   each hold the leader.  Whoever isn't linked to it (the rest of its group) is
   held against the other members by signature, and exactly where that says at
   least ``CUT``, unless links known by then connect the two; pairs of blocks
   share that work, and only links that connect something new come out.
5. Connected components of the links give the classes.

Word: a run of characters other than space and \\t \\n \\v \\f \\r, unchanged.  A
document without words (null, empty) is like no other, so it is a class of its own
and stays.  Documents are told apart by doc_id and text: different texts of one
doc_id, or of rows without one, are different documents, and their classes have
the same number where their least doc_ids are equal.  A null doc_id is the least,
and the number of its class.  An empty table gives an empty result.  Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscope.llm import textbuf as tb
from msgscope.llm.components import components
from msgscope.llm.repeats import NO_ID, keyed, real_id
from msgscope.llm.spill import stored

SHINGLE = 5
SIMILAR = 0.8
BANDS = 32
ROWS = 5
REGISTERS = BANDS * ROWS
#: An estimate under this is more than 3.5 standard errors below SIMILAR.
CUT = SIMILAR - 3.5 * (SIMILAR * (1 - SIMILAR) / REGISTERS) ** 0.5
#: Text of a block of a group, and what a row counts for at least.
BLOCK_BYTES = 1 << 20
ROW_BYTES = 2_048
SLICE = 1 << 19
SLICE_ROWS = 2_000

# ----------------------------------------------------------------- signatures


def weighted_shingles(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles of each text, in this order."""
    start, end, by_row = tb.words(raw, off)
    sums = tb.prefix(tb.word_hashes(raw, start, end))
    at = tb.whole_runs(by_row, SHINGLE)
    row = np.searchsorted(by_row, at, side="right") - 1
    n = np.diff(by_row)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    h = np.concatenate([tb.span_hash(sums, at, at + SHINGLE), tb.span_hash(sums, by_row[short], by_row[short + 1])])
    row = np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], h[first], np.diff(np.append(first, len(h)))


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """In (0, 1]."""
    return ((tb.salted(h, salt) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m: the shingle that came first in each register (0 for rows without any).

    In round i every shingle still in play sends its i-th arrival.  A shingle is
    out once its time is past the latest register of its document."""
    time = np.full(n * m, np.inf)
    who = np.zeros(n * m, np.uint64)
    latest = np.full(n, np.inf)
    now = np.zeros(len(h))
    live = np.arange(len(h))
    i = 0
    while len(live):
        e, r = h[live], row[live]
        now = now - np.log(_uniform(e, 2 * i + 101)) / weight[live]
        cell = r * m + (tb.salted(e, 2 * i + 102) % np.uint64(m)).astype(np.int64)
        np.minimum.at(time, cell, now)
        won = time[cell] == now
        who[cell[won]] = e[won]
        touched = np.unique(r[won])
        latest[touched] = time.reshape(n, m)[touched].max(axis=1)
        stay = now < latest[r]
        live, now = live[stay], now[stay]
        i += 1
    return who.reshape(n, m)


def band_hashes(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = sig.shape[1] // rows
    part = sig.reshape(len(sig), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands)).copy()
    for j in range(rows):
        h = tb.salted(h ^ part[:, :, j], 31 + j)
    return h


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard of two documents, given by sorted shingles and counts."""
    common, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    a, b = wa[i].astype(float), wb[j].astype(float)
    ratio = b / a
    order = np.argsort(ratio, kind="stable")
    ratio, a, b = ratio[order], a[order], b[order]
    # shingles of one side only have ratio 0 or infinity
    below = np.concatenate([[0], np.cumsum(a)]) + (wa.sum() - a.sum())
    above = wb.sum() - np.concatenate([[0], np.cumsum(b)])
    last = np.searchsorted(ratio, ratio, side="right")
    return float((1 / (below[last] / a + above[last] / b)).sum())


# --------------------------------------------------------------------- stages


def hashed(docs: DataFrame) -> DataFrame:
    """``docs`` with the text's 128-bit hash (a, b)."""
    return docs.withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit(1), "text")})


def nodes(rows: DataFrame) -> DataFrame:
    """(node, a, b, rep: the least doc_id with that text) of every text with words,
    numbered in the order of (rep, a, b)."""
    firsts = stored(rows.where("NOT empty").groupBy("a", "b").agg(F.min("doc_id").alias("rep")), "firsts")
    order = firsts.repartitionByRange("rep", "a", "b").sortWithinPartitions("rep", "a", "b")
    return stored(order.select(F.monotonically_increasing_id().alias("node"), "a", "b", "rep"), "nodes")


def bands(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n: bytes of text, bands array<long>) and the long columns ``more``
    of every row with words."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", *more, "n")] + [("bands", pa.list_(pa.int64()))])

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, SLICE_ROWS):
                b = big.slice(at, SLICE_ROWS)
                for a, z, raw, off in tb.slices(b, "text", SLICE):
                    row, h, w = weighted_shingles(raw, off)
                    own = np.unique(row)
                    if not len(own):
                        continue
                    place = np.zeros(z - a, np.int64)
                    place[own] = np.arange(len(own))
                    keys = band_hashes(signatures(place[row], h, w, len(own)))
                    lists = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * BANDS, pa.array(keys.ravel().view(np.int64)))
                    told = [b.column(i).slice(a, z - a).take(pa.array(own)) for i in range(len(more) + 1)]
                    yield pa.RecordBatch.from_arrays([*told, pa.array(np.diff(off)[own]), lists], schema=schema)

    sql = "".join(f"{c} long, " for c in ("doc_id", *more, "n")) + "bands array<bigint>"
    return docs.select("doc_id", *more, "text").mapInArrow(run, sql)


def led_pairs(keys: DataFrame) -> DataFrame:
    """(doc_id, leader, n) for every bucket of two or more, each pair once, and
    each leader with itself."""
    each = keys.select("doc_id", "n", F.explode("bands").alias("k"))
    buckets = each.groupBy("k").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader <> last").select("k", "leader")
    buckets = stored(buckets, "buckets")  # a table of its own, so that Spark can split the join's hot keys
    return each.join(buckets, "k").groupBy("doc_id", "leader").agg(F.max("n").alias("n"))


class Links:
    """Union-find over the members of one block pair."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _shingled(texts: list[bytes]):
    """(row, hash, count) of all shingles, and (hashes, counts) of each text."""
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, h, w = weighted_shingles(np.frombuffer(b"".join(texts), np.uint8), off)
    edge = np.searchsorted(row, np.arange(len(texts) + 1))
    return row, h, w, [(h[x:y], w[x:y]) for x, y in zip(edge[:-1], edge[1:])]


def like_leader(lead: np.ndarray, texts: list[bytes], similar: float = SIMILAR) -> np.ndarray:
    """For each text whether it is similar to one of the leader's (``lead``)."""
    *_, own = _shingled(texts)
    leaders = [own[j] for j in np.flatnonzero(lead)]
    return np.array([any(similarity(*x, *y) >= similar - 1e-12 for y in leaders) for x in own], dtype=bool)


def rest_links(ids: np.ndarray, asks: np.ndarray, open_: np.ndarray, texts: list[bytes], similar: float = SIMILAR) -> list[tuple[int, int]]:
    """Links that connect the texts that ask (``asks``: not linked to the leader)
    with the others of one pair of blocks.  All that aren't ``open_`` hang
    together, by the leader."""
    row, h, w, own = _shingled(texts)
    sig = (signatures(row, h, w, len(ids)) & np.uint64(0xFFFF)).astype(np.uint16)
    _, node = np.unique(ids, return_inverse=True)  # rows that share an id are one
    links, out, found = Links(int(node.max()) + 1), [], []
    settled = node[~open_]
    for j in settled[1:]:
        links.join(int(settled[0]), int(j))
    for i in np.flatnonzero(asks):
        agree = (sig == sig[i]).mean(axis=1)
        ok = np.flatnonzero((agree >= CUT) & ~asks & (node != node[i]))
        found.append(np.stack([agree[ok], np.full(len(ok), i), ok], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 3))
    for _, i, j in pairs[np.argsort(-pairs[:, 0], kind="stable")]:
        i, j = int(i), int(j)
        if links.root(int(node[i])) != links.root(int(node[j])) and similarity(*own[i], *own[j]) >= similar - 1e-12:
            links.join(int(node[i]), int(node[j]))
            out.append((int(ids[i]), int(ids[j])))
    return out


def _parts(n) -> F.Column:
    """Blocks for rows of ``n`` bytes; a short row counts as ROW_BYTES, so that a
    block's rows are bounded, too."""
    return F.ceil(F.sum(F.greatest(n, F.lit(ROW_BYTES))) / BLOCK_BYTES).cast("int")


def _block(of: F.Column, salt: int) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(salt), "doc_id"), of).cast("int")


def _by_group(rows: DataFrame, keys: int, run, sql: str) -> DataFrame:
    """``run`` (key, columns as lists) -> record batch, over each run of rows that
    agree in the first ``keys`` columns; such rows are brought together first."""
    names = rows.columns

    def each(batches):
        key, held = None, []
        for b in batches:
            for values in zip(*(c.to_pylist() for c in b.columns)):
                if values[:keys] != key:
                    if held:
                        yield run(key, list(zip(*held)))
                    key, held = values[:keys], []
                held.append(values[keys:])
        if held:
            yield run(key, list(zip(*held)))

    return rows.repartition(*names[:keys]).sortWithinPartitions(*names).mapInArrow(each, sql)


def starred(pairs: DataFrame, sizes: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, leader, n, linked) of every pair: whether the two are similar.  A
    large group lies in several blocks, each with the leader."""
    schema = pa.schema([("doc_id", pa.int64()), ("leader", pa.int64()), ("n", pa.int64()), ("linked", pa.bool_())])
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    to = F.when(F.col("doc_id") == F.col("leader"), every).otherwise(F.array(_block(F.col("parts"), 1)))
    placed = pairs.join(sizes, "leader").select("leader", "doc_id", "n", F.explode(to).alias("part"))
    rows = placed.join(texts, "doc_id").select("leader", "part", "doc_id", "n", F.encode("text", "UTF-8").alias("t"))

    def run(key, columns):
        ids, n, own = columns
        lead = np.array(ids) == key[0]
        hit = like_leader(lead, own, similar)
        keep = np.flatnonzero(~lead)
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), pa.array([key[0]] * len(keep), pa.int64()), pa.array([n[i] for i in keep], pa.int64()), pa.array(hit[keep])], schema=schema)

    return _by_group(rows, 2, run, "doc_id long, leader long, n long, linked boolean")


def verified(pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Links (u, v) among the members of each leader's group."""
    sizes = stored(pairs.groupBy("leader").agg(_parts(F.col("n")).alias("parts"), (F.count("*") - 1).alias("members")), "sizes")
    star = stored(starred(pairs, sizes, texts, similar), "star")
    links = star.where("linked").select(F.col("doc_id").alias("u"), F.col("leader").alias("v"))
    rest = star.groupBy("doc_id", "leader").agg(F.max("n").alias("n"), F.max("linked").alias("linked")).where("NOT linked")
    rest = stored(rest.select("doc_id", "leader", "n", F.lit(True).alias("open")), "rest")
    # groups in which someone is left, and someone else is there to be like
    left = rest.groupBy("leader").agg(_parts(F.col("n")).alias("asking")).join(sizes.where("members > 1"), "leader")
    left = stored(left.select("leader", "asking", "parts"), "left")
    members = pairs.where("doc_id <> leader").join(left, "leader").join(rest.select("doc_id", "leader", "open"), ["doc_id", "leader"], "left")
    asked = F.transform(F.sequence(F.lit(0), F.col("asking") - 1), lambda p: F.struct(F.lit(False).alias("asks"), p.alias("p"), _block(F.col("parts"), 1).alias("q")))
    asks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.lit(True).alias("asks"), _block(F.col("asking"), 2).alias("p"), q.alias("q")))
    is_open = F.coalesce("open", F.lit(False))
    dealt = members.select("leader", "doc_id", is_open.alias("open"), F.explode(F.when(is_open, F.concat(asked, asks)).otherwise(asked)).alias("b"))
    rows = dealt.join(texts, "doc_id").select("leader", "b.p", "b.q", "doc_id", "b.asks", "open", F.encode("text", "UTF-8").alias("t"))
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(_, columns):
        ids, ask, is_open, own = columns
        found = rest_links(np.array(ids), np.array(ask), np.array(is_open), own, similar) if any(ask) else []
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], schema=schema)

    return links.unionByName(_by_group(rows, 3, run, "u long, v long"))


def classes(docs: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Tables of the rows of ``docs`` (see ``keyed``): (doc_id, a, b, empty), and for
    each text with words (a, b, rep, class_id: the least doc_id of its class,
    first: whether it is the class's least node)."""
    empty = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = stored(hashed(docs).select("doc_id", "a", "b", empty.alias("empty")), "hashes")
    node = nodes(rows)
    text = ["a", "b", "doc_id"]
    numbers = node.withColumnRenamed("rep", "doc_id")
    found = bands(hashed(docs), ("a", "b")).join(numbers, text).select(F.col("node").alias("doc_id"), "n", "bands")
    keys = stored(found.dropDuplicates(["doc_id"]), "bands")
    pairs = stored(led_pairs(keys), "pairs")
    # they grow with the corpus: the same join at every size
    asked = numbers.join(pairs.select(F.col("doc_id").alias("node")).distinct(), "node").hint("merge")
    own = hashed(docs.where(F.col("text").isNotNull())).join(asked, text)
    texts = stored(own.select(F.col("node").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "texts")
    roots = components(verified(pairs, texts, similar))
    least = node.select(F.col("node").alias("v"), F.col("rep").alias("class_id"))
    other = stored(roots.join(least, "v").select(F.col("u").alias("node"), "class_id"), "others")
    every = node.join(other, "node", "left").select("a", "b", "rep", F.coalesce("class_id", "rep").alias("class_id"), F.col("class_id").isNull().alias("first"))
    return rows, stored(every, "classes")


def near_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id, of every row."""
    rows, found = classes(keyed(docs), similar)
    alone = rows.where("empty").select("doc_id", F.col("doc_id").alias("class_id"))
    out = rows.where("NOT empty").join(found, ["a", "b"]).select("doc_id", "class_id").unionByName(alone)
    return out.select(real_id(F.col("doc_id")).alias("doc_id"), real_id(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs``, unchanged, but of each class only the one that comes
    first: of its least node the row with the least doc_id, of repeated rows the
    least.  So no text goes unless one like it stays."""
    rows, found = classes(keyed(docs), similar)
    key = ["doc_id", "a", "b"]
    told = rows.where("NOT empty").groupBy(*key).agg(F.count("*").alias("n")).join(found, ["a", "b"])
    stays = F.col("first") & (F.col("doc_id") == F.col("rep"))
    # they grow with the corpus: the same join at every size
    marked = stored(told.where(~stays | (F.col("n") > 1)).select(*key, stays.alias("again")), "marked")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    every = hashed(docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), docs["text"].cast("string").alias("text"), row))
    single = every.join(marked.hint("merge"), key, "left_anti").select("row")
    least = every.join(marked.where("again").hint("merge"), key, "left_semi").groupBy(*key).agg(F.min("row").alias("row")).select("row")
    return single.unionByName(least).select(*[F.col("row")[c].alias(c) for c in docs.columns])
