"""Stream scoring (STR-01) and the streaming lockout driver (STR-02).

Streams read a parquet file source, run the same column expressions as the
batch path, and write through an exactly-once sink under the shared
checkpoint folder; ``run_to_completion`` drives a query with
``Trigger(availableNow=True)`` so tests and registered queries can turn a
stream into a finite DataFrame.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgscope.session import checkpoint_dir
from msgscope.streaming.lockout import lockout_stream


def stream_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    base = os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")
    return os.path.join(base, "out"), os.path.join(base, "checkpoint")


def scored_batches_sink(out_path: str, score: Callable[[DataFrame], DataFrame]):
    """foreachBatch writer: score one micro-batch and write it to
    ``out/batch_id=<id>`` with overwrite, so a replayed batch (after a failure)
    replaces its own output instead of duplicating it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(os.path.join(out_path, f"batch_id={batch_id}"))

    return write


def run_to_completion(writer) -> None:
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Asked of the store that holds the path, whichever it is."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).isDirectory()


def _file_stream(spark: SparkSession, source_path: str, schema, max_files: int) -> DataFrame:
    """File stream over a folder (a table of several part files, too), or over
    one file via its folder and a name filter."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if not _is_folder(spark, source_path):
        reader = reader.option("pathGlobFilter", os.path.basename(source_path))
        source_path = os.path.dirname(source_path)
    return reader.parquet(source_path)


def stream_scored(spark: SparkSession, source_path: str, schema, score: Callable[[DataFrame], DataFrame], max_files: int) -> DataFrame:
    """Every turn of a file stream through ``score`` (msg_id, text -> rows);
    returns the rows of all micro-batches with ``batch_id``."""
    out, ckpt = stream_paths(spark, "score")
    src = _file_stream(spark, source_path, schema, max_files).select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text")
    run_to_completion(src.writeStream.foreachBatch(scored_batches_sink(out, score)).option("checkpointLocation", ckpt))
    return spark.read.parquet(out)


def stream_score(spark: SparkSession, source_path: str, schema, models: dict, max_files: int) -> DataFrame:
    """Score every row of a file stream with ``models``; returns the scored
    rows (``model_id, msg_id, p, prediction, batch_id``)."""
    from msgscope.operators.scoring import score_with_models

    return stream_scored(spark, source_path, schema, lambda batch: score_with_models(batch, models), max_files)


def stream_lockout(spark: SparkSession, source_path: str, schema, max_files: int) -> DataFrame:
    """Lockout decisions for a file stream of events; append-mode parquet
    sink (exactly-once through the sink's log)."""
    out, ckpt = stream_paths(spark, "lockout")
    ev = (
        _file_stream(spark, source_path, schema, max_files)
        .where(F.col("event_type").isin("error", "signup"))
        .select("event_id", F.col("user_id").alias("identifier"), "ts", (F.col("event_type") == "signup").alias("success"))
    )
    run_to_completion(
        lockout_stream(ev).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", ckpt)
    )
    return spark.read.parquet(out)
