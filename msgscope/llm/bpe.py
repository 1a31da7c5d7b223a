"""Byte-level BPE with the tiktoken library (operator 8).

The rank file's bytes travel to the tasks as a broadcast (a vocabulary: its
size is the tokenizer's, whatever the corpus).  Long texts are cut by a regex at
safe boundaries, where no match of the pre-splitting pattern can continue, so
that ids equal those of the uncut text.  Decoding joins raw bytes.

Null text counts as empty: no ids.  Repeated rows give repeated results; other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A match of the pattern that holds a character other than white space ends
#: before the next white space, so a text may be cut between the two.
SAFE_CUT = regex.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])")
LONG_TEXT = 1 << 16

_encodings: dict = {}


def encoding(name: str, pattern: str, ranks: bytes):
    """The tiktoken encoding, built once in each worker process."""
    import tiktoken

    key = (name, pattern)
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        _encodings[key] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def safe_parts(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """Parts of at least ``size`` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > size:
        m = SAFE_CUT.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(enc, text: str, size: int = LONG_TEXT) -> np.ndarray:
    if len(text) <= size:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(x, disallowed_special=()) for x in safe_parts(text, size)])


def _map(docs: DataFrame, rank_file: str, pattern: str, schema: pa.Schema, sql: str, each):
    """``each`` (encoding, small batch) -> batch, over all rows."""
    with open(rank_file, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        enc = encoding(rank_file, pattern, ranks.value)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                yield pa.RecordBatch.from_arrays(each(enc, b.slice(a, 256)), schema=schema)

    return docs.mapInArrow(run, sql)


TOKENS = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
BACK = TOKENS.append(pa.field("bytes", pa.binary()))


def _encoded(enc, b: pa.RecordBatch) -> list:
    ids = [encode(enc, t or "") for t in b.column(1).to_pylist()]
    return [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]


def _decoded(enc, ids: pa.Array) -> pa.Array:
    return pa.array([enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in ids.to_pylist()], pa.binary())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def tokenize(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids binary: little-endian unsigned 32-bit) for each row."""
    return _map(_texts(docs, id_col, text_col), rank_file, pattern, TOKENS, "id long, n_tokens long, ids binary", _encoded)


def detokenize(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(id, n_tokens, ids, bytes): the raw bytes of the ids."""
    each = lambda enc, b: [*b.columns, _decoded(enc, b.column(2))]
    return _map(tokens.select("id", "n_tokens", "ids"), rank_file, pattern, BACK, "id long, n_tokens long, ids binary, bytes binary", each)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``detokenize`` of ``tokenize``, by one worker a task."""

    def each(enc, b):
        out = _encoded(enc, b)
        return [*out, _decoded(enc, out[2])]

    return _map(_texts(docs, id_col, text_col), rank_file, pattern, BACK, "id long, n_tokens long, ids binary, bytes binary", each)


def round_trip_digest(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes."""
    return round_trip(docs, rank_file, pattern).select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("bytes"), 256).alias("decoded_sha256"),
    )


