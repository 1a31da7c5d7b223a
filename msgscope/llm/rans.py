"""Token ids in files coded by a static range asymmetric numeral system (operator 4).

One table of quantised token frequencies, counted over the whole corpus, is
shared by all blocks.  A block holds whole documents, about ``BLOCK`` ids, and
is coded independently by ``LANES`` interleaved coders: in each step every lane
codes one id, so numpy works on a vector of states.  Every ``STEPS`` steps the
lane states are kept as a checkpoint and the words since are cut off into a
segment with a CRC-32 of its ids, so segments decode alone, in parallel or from
the middle.  Files are Parquet with one row a block, written by Spark's own
committer, in ascending doc_id order (``part``, ``seq``); the table lies beside
them.

Null text counts as empty (only the end id); repeated rows are kept; rows of one
doc_id follow each other in the order of a hash of their text; a null doc_id comes
first; an empty table gives empty files.  The string of an added token in a text
is that token, as the library has it.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from msgscope.llm import textbuf as tb
from msgscope.llm.spill import folder

SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 2048
STEPS = 128
BLOCK = 1 << 20
END_ID = 0
#: Distinct parts that a worker remembers.
CACHE = 1_500_000
SLICE = 1 << 19

# ------------------------------------------------------------------ tokenizer

#: White space before a run of other characters starts a part that encodes
#: alone: no match of the byte-level pattern goes on from such a run into it.  So
#: does ASCII punctuation behind an ASCII letter or digit.
ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
PUNCT = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 13]] = True
#: Texts with any other white space are encoded as a whole.
RARE_BLANK = re.compile(rb"[\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Bytes that such white space can begin with.
RARE_LEAD = np.zeros(256, dtype=bool)
RARE_LEAD[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Longer parts are encoded each time.
LONG_PART = 64
_SECOND = tb.salted(np.arange(256, dtype=np.uint64), 78)
_encoders: dict = {}


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order, a place of each, which of them each value is)."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


class PartEncoder:
    """Ids of whole texts by the tokenizers library, asking it once for each
    distinct part; the parts of a text encode independently.  Parts are told
    apart by two 64-bit hashes."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        d = json.loads(spec)
        #: Texts with an added token's string are encoded as a whole, too: a part
        #: might cut it.
        self.added = [t["content"].encode() for t in d.get("added_tokens") or []]
        pre = d.get("pre_tokenizer") or {}
        self.by_part = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not d.get("normalizer")
        if self.by_part:  # a token's characters stand for bytes, one each
            vocab = self.tok.get_vocab(with_added_tokens=True)
            self.size = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, i in vocab.items():
                self.size[i] = len(token)
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, np.uint64)  # sorted
        self.check = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int32)
        self.length = np.zeros(0, np.int16)
        self.hits = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def shrink(self) -> None:
        """Forget the parts that came in one slice only; if that isn't enough, all."""
        keep = np.flatnonzero(self.hits > 1)
        if len(keep) > CACHE // 2:
            return self.clear()
        length = self.length[keep].astype(np.int64)
        self.flat = self.flat[np.repeat(self.start[keep].astype(np.int64), length) + tb.ragged(length)]
        self.used = len(self.flat)
        self.key, self.check, self.length = self.key[keep], self.check[keep], self.length[keep]
        self.start = (np.cumsum(length) - length).astype(np.int32)
        self.hits = np.zeros(len(keep), np.int32)
        return None

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, number of ids of each part) for parts that begin with white space
        and don't end with it: they encode alike when strung together, and the
        tokens' sizes tell where each ends."""
        size = np.array([len(p) for p in parts], np.int64)
        strung = [b"".join(parts[a : a + 4000]).decode("utf-8") for a in range(0, len(parts), 4000)]
        ids = np.concatenate([np.array(x, np.uint32) for x in self.encode(strung)]) if parts else np.zeros(0, np.uint32)
        at, ends = np.cumsum(self.size[ids]), np.cumsum(size)
        last = np.searchsorted(at, ends)
        if len(parts) and (last[-1] >= len(at) or np.any(at[last] != ends)):
            return None
        return ids, np.diff(last, prepend=-1)

    def _add(self, key: np.ndarray, check: np.ndarray, parts: list[bytes], strung: np.ndarray) -> None:
        length = np.zeros(len(parts), np.int64)
        order = np.concatenate([np.flatnonzero(strung), np.flatnonzero(~strung)])
        n = int(strung.sum())
        got = self._together([parts[i] for i in order[:n]])
        if got is None:  # never seen; then each for itself
            n, got = 0, (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        rest = self.encode([parts[i].decode("utf-8") for i in order[n:]]) if n < len(order) else []
        length[order] = np.concatenate([got[1], np.array([len(x) for x in rest], np.int64)])
        ids = np.concatenate([got[0], np.array([i for x in rest for i in x], np.uint32)])
        start = np.empty(len(parts), np.int64)
        start[order] = self.used + np.cumsum(length[order]) - length[order]
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(ids), self.used // 2), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        at = np.searchsorted(self.key, key)
        new = (("key", key), ("check", check), ("start", start), ("length", length), ("hits", np.zeros(len(key))))
        for name, values in new:
            old = getattr(self, name)
            setattr(self, name, np.insert(old, at, values.astype(old.dtype)))

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        n, data = len(off) - 1, raw.tobytes()
        text = lambda s, e: data[s:e].decode("utf-8")
        if not self.by_part:
            ids = self.encode([text(s, e) for s, e in zip(off[:-1], off[1:])])
            return np.fromiter((i for x in ids for i in x), np.uint32), np.array([len(x) for x in ids], np.int64)
        if len(self.key) > CACHE:
            self.shrink()
        blank = BLANK[raw]
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        begin[1:] |= ALNUM[raw[:-1]] & PUNCT[raw[1:]]
        begin[off[:-1][off[:-1] < len(raw)]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(raw))[: len(start)]
        by_row = np.searchsorted(start, off)
        key = tb.span_hash(tb.prefix(tb.BYTE_VALUE[raw]), start, end)
        check = tb.span_hash(tb.prefix(_SECOND[raw]), start, end)
        rare = [m.start() for m in RARE_BLANK.finditer(data)] if RARE_LEAD[raw].any() else []
        rare += [m.start() for x in self.added if x in data for m in re.finditer(re.escape(x), data)]
        whole = np.unique(np.searchsorted(off, rare, side="right") - 1)
        odd = np.zeros(len(start), dtype=bool)
        for r in whole:
            odd[by_row[r] : by_row[r + 1]] = True
        alone = ~odd & (end - start > LONG_PART)
        plain = np.flatnonzero(~odd & ~alone)
        distinct, first, which = _distinct(key[plain])
        own = check[plain][first]
        at = np.searchsorted(self.key, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.key)
        known[inside] = self.key[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            where = plain[first[new]]
            strung = blank[start[where]] & ~blank[end[where] - 1]
            self._add(distinct[new], own[new], [data[s:e] for s, e in zip(start[where].tolist(), end[where].tolist())], strung)
            at = np.searchsorted(self.key, distinct)
        self.hits[at] += 1
        alone[plain[self.check[at][which] != check[plain]]] = True  # equal in one hash only
        source, length = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        if len(plain):
            source[plain], length[plain] = self.start[at][which], self.length[at][which]
        # parts and whole texts that were not looked up stand behind the rest
        place = [(i, text(start[i], end[i])) for i in np.flatnonzero(alone)] + [(by_row[r], text(off[r], off[r + 1])) for r in whole]
        extra, more = [], self.used
        for (i, _), ids in zip(place, self.encode([t for _, t in place]) if place else []):
            source[i], length[i] = more, len(ids)
            extra += ids
            more += len(ids)
        flat = np.concatenate([self.flat[: self.used], np.array(extra, np.uint32)]) if extra else self.flat
        ends = np.cumsum(length)
        at = np.repeat(source - (ends - length), length)
        at += np.arange(len(at))
        return flat[at], np.diff(np.concatenate([[0], ends])[by_row])


def part_encoder(key: str, spec: str) -> PartEncoder:
    if key not in _encoders:
        _encoders[key] = PartEncoder(spec)
    return _encoders[key]


# ---------------------------------------------------------------------- coder


def quantise(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale, at least 1 for each id that occurs.
    What rounding leaves over is given to, or taken from, the most frequent
    ids, so the share of every id stays right."""
    total, room = int(counts.sum()), 1 << scale
    if not total:
        return np.zeros(len(counts), np.uint64)
    if np.count_nonzero(counts) > room:
        raise ValueError("more ids than slots")
    f = np.where(counts > 0, np.maximum(1, np.floor(counts * (room / total))), 0).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    left = room - int(f.sum())
    if left > 0:
        f[order[0]] += left
    for i in order:
        if left >= 0:
            break
        take = min(-left, int(f[i]) - 1)
        f[i] -= take
        left += take
    return f.astype(np.uint64)


class Coder:
    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale, self.freq = np.uint64(scale), freq.astype(np.uint64)
        self.mask = np.uint64((1 << scale) - 1)
        self.below = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    def encode(self, ids: np.ndarray) -> list[dict]:
        """Segments in reading order; coded from the last id to the first."""
        state = np.full(LANES, LOW, np.uint64)
        room = np.uint64(63) - self.scale
        f_all, c_all = self.freq[ids], self.below[ids]
        words: list[np.ndarray] = []
        out: list[dict] = []
        for t in range((len(ids) - 1) // LANES, -1, -1):
            f, c = f_all[t * LANES : (t + 1) * LANES], c_all[t * LANES : (t + 1) * LANES]
            x = state[: len(f)]
            full = x >= (f << room)
            words.append(x[full].astype(np.uint32))
            x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[: len(f)] = (q << self.scale) + (x - q * f) + c
            if t % STEPS == 0:
                own = ids[t * LANES : (t + STEPS) * LANES]
                out.append({
                    "states": state.astype("<u8").tobytes(), "words": np.concatenate(words[::-1]).astype("<u4").tobytes(),
                    "n": len(own), "crc": zlib.crc32(own.astype("<u4").tobytes()),
                })
                words = []
        return out[::-1]

    def decode(self, segment: dict) -> np.ndarray:
        """The ids of one segment, from its checkpoint alone; checks the CRC."""
        state = np.frombuffer(segment["states"], "<u8").astype(np.uint64)
        words = np.frombuffer(segment["words"], "<u4").astype(np.uint64)
        n, at = segment["n"], 0
        out = np.empty(n, np.uint32)
        for a in range(0, n, LANES):
            x = state[: min(LANES, n - a)]
            slot = x & self.mask
            s = self.symbol[slot.astype(np.int64)]
            out[a : a + len(s)] = s
            x = self.freq[s] * (x >> self.scale) + slot - self.below[s]
            low = np.flatnonzero(x < LOW)
            x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
            at += len(low)
            state[: len(x)] = x
        if zlib.crc32(out.astype("<u4").tobytes()) != segment["crc"] or at != len(words):
            raise ValueError("a segment's checksum does not match its ids")
        return out


# ---------------------------------------------------------------------- files

SEGMENT = pa.struct([("states", pa.binary()), ("words", pa.binary()), ("n", pa.int64()), ("crc", pa.int64())])
RAW = "part int, seq int, n_tokens long, doc_ids array<long>, lengths array<long>, ids binary"
FILES = "part int, seq int, n_tokens long, doc_ids array<long>, lengths array<long>, segments array<struct<states:binary,words:binary,n:long,crc:long>>"


def _blocks(docs: DataFrame, tokenizer_file: str, block: int) -> DataFrame:
    """Blocks of ids in ascending doc_id order."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        encode = part_encoder(tokenizer_file, spec.value)
        part, seq = TaskContext.get().partitionId(), 0
        keys, lengths, ids, held = [], [], [], 0

        def row():
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_tokens": held, "doc_ids": keys, "lengths": np.concatenate(lengths).tolist(), "ids": np.concatenate(ids).tobytes()}], schema=schema)

        for b in batches:
            for a, z, raw, off in tb.slices(b, "text", SLICE):
                flat, length = encode(raw, off)
                flat = np.insert(flat, np.cumsum(length), END_ID).astype("<u4")
                keys += b.column(0).slice(a, z - a).to_pylist()
                lengths.append(length + 1)
                ids.append(flat)
                held += len(flat)
                if held >= block:
                    yield row()
                    keys, lengths, ids, held = [], [], [], 0
                    seq += 1
        if keys:
            yield row()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    # the hash deals out rows without an id, or of one id, to several tasks
    return own.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text").mapInArrow(run, RAW)


def _counts(blocks: DataFrame) -> DataFrame:
    """How often each id occurs: a partial count a task, then a sum by id."""
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(1, np.int64)
        for b in batches:
            for x in b.column(0):
                own = np.bincount(np.frombuffer(x.as_py(), "<u4"))
                if len(own) > len(total):
                    total, own = own, total
                total[: len(own)] += own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], schema=schema)

    return blocks.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, tokenizer_file: str, path: str, block: int = BLOCK) -> None:
    """Encode every text and write ``path``/blocks and ``path``/table."""
    spark = docs.sparkSession
    raw_path = folder(spark, "ids")
    _blocks(docs, tokenizer_file, block).write.option("compression", "zstd").parquet(raw_path)
    raw = spark.read.schema(RAW).parquet(raw_path)
    # bounded by the vocabulary, whatever the corpus
    got = _counts(raw).collect()
    counts = np.zeros(max([r["id"] for r in got], default=0) + 1, np.int64)
    for r in got:
        counts[r["id"]] = r["n"]
    freq = quantise(counts)
    spark.createDataFrame([(int(i), int(f)) for i, f in enumerate(freq) if f], "id int, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("segments", pa.list_(SEGMENT))])

    def run(batches):
        coder = Coder(shared.value)
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                segments = coder.encode(np.frombuffer(row.column(5)[0].as_py(), "<u4"))
                yield pa.RecordBatch.from_arrays([*row.columns[:5], pa.array([segments], pa.list_(SEGMENT))], schema=schema)

    raw.mapInArrow(run, FILES).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, doc_id, at: first id within the block, ids binary) of each document."""
    table = spark.read.schema("id int, freq long").parquet(f"{path}/table").collect()
    freq = np.zeros(max([r["id"] for r in table], default=0) + 1, np.uint64)
    for r in table:
        freq[r["id"]] = r["freq"]
    shared = spark.sparkContext.broadcast(freq)
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        coder = Coder(shared.value)
        for b in batches:
            for i in range(b.num_rows):
                part, seq, _, keys, lengths, segments = (c[i].as_py() for c in b.columns)
                ids = np.concatenate([coder.decode(s) for s in segments]).astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(keys), pa.int32()), pa.array([seq] * len(keys), pa.int32()), pa.array(keys, pa.int64()),
                        pa.array(starts, pa.int64()), pa.array([ids[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()),
                    ],
                    schema=schema,
                )

    return spark.read.schema(FILES).parquet(f"{path}/blocks").mapInArrow(run, "part int, seq int, doc_id long, at long, ids binary")


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, block_start): ids before each block.  Sums run within a part;
    only one row a part is summed over all parts."""
    index = spark.read.schema(FILES).parquet(f"{path}/blocks").select("part", "seq", "n_tokens")
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("before"))
    return (
        index.withColumn("inside", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
        .join(parts, "part")
        .select("part", "seq", (F.col("before") + F.col("inside")).alias("block_start"))
    )


def token_digest(docs: DataFrame, tokenizer_file: str, path: str | None = None) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or folder(spark, "tokens")
    write_tokens(docs, tokenizer_file, path)
    read = read_tokens(spark, path).select("part", "seq", "doc_id", "at", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return read.join(block_starts(spark, path), ["part", "seq"]).select(
        "doc_id", (F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
