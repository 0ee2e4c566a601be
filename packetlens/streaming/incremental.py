"""Incremental adjudication: packets decided as their span files arrive.

Packets don't depend on each other, and a packet's spans come in one file, so
each micro-batch is a batch job of its own and needs no state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from packetlens.sources.sinks import commit_records


def adjudicate_stream(spans: DataFrame, pipeline: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs ``pipeline`` (spans to records) on each micro-batch and commits its records to the folder ``out``.

    A batch is a run of its own number: run again after a failure it is there
    once, and readers (``sinks.committed_records``) see whole batches only.
    """

    def batch(rows: DataFrame, number: int) -> None:
        commit_records(pipeline(rows), out, f"batch-{number}")

    writer = spans.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
