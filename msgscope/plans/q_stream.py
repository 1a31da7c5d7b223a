"""Registered queries: Structured Streaming forms of scoring and lockout.

Both run a file stream over the given table to completion (availableNow)
and return the sink's contents; their results must equal the batch forms,
so the batch oracles apply."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from msgscope.operators.scoring import summarize_batch
from msgscope.plans.q_service import SQL_BATCH_SUMMARY, SQL_LOCKOUT, rounded
from msgscope.plans.registry import query
from msgscope.plans.rules import RULE_MODELS
from msgscope.sources.tables import read_table
from msgscope.streaming.scoring import stream_lockout as _stream_lockout
from msgscope.streaming.scoring import stream_score as _stream_score

FILES_A_BATCH = 32


@query("stream_score", SQL_BATCH_SUMMARY)
def stream_score(spark, d):
    """STR-01 + AGG-34: all turns scored in micro-batches by every model."""
    schema = read_table(spark, d, "conversations").schema
    preds = _stream_score(spark, os.path.join(d, "conversations.parquet"), schema, RULE_MODELS, FILES_A_BATCH)
    s = summarize_batch(preds.drop("batch_id"), list(RULE_MODELS))
    return s.select(
        "model_id", "predictions", "spam", "ham",
        rounded(F.col("avg_confidence"), 4).alias("avg_confidence"), rounded(F.col("avg_spam_probability"), 4).alias("avg_spam_probability"),
    )


@query("stream_lockout", SQL_LOCKOUT)
def stream_lockout(spark, d):
    """STR-02 streaming: keyed state per identifier across micro-batches."""
    schema = read_table(spark, d, "events").schema
    return _stream_lockout(spark, os.path.join(d, "events.parquet"), schema, FILES_A_BATCH)
