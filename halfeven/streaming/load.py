"""Continuous loads: each micro-batch of a stream is appended to a table as one atomic change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.session import Session


def append_stream(session: Session, table: str, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that appends `stream` to `table`, batch by batch, under the table's constraints.

    A batch that the table already holds (after a restart in the middle of a commit) is skipped by its number,
    which the session keeps per table; a batch that breaks a constraint stops the query and leaves nothing.
    """
    done = session.engine.batches

    def each(batch: DataFrame, number: int) -> None:
        if number > done.get((table, checkpoint), -1):
            session.append(table, batch)
            done[table, checkpoint] = number

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
