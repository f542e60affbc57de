"""A stream of rows into a store: each micro-batch is one upsert, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.writes import Writer
from ..runtime import scratch


def upsert_stream(rows: DataFrame, writer: Writer, entity: str, name: str, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Starts a query that upserts each batch of ``rows``. The batch number is committed together with its rows,

    so a batch that is given again after a failure changes nothing. Without a trigger, everything there is and comes is processed.
    """

    def batch(df: DataFrame, number: int) -> None:
        store = writer.store
        if number <= store.done(name):
            return
        store.begin()
        try:
            writer.upsert(entity, df)
            store.mark(name, number)
            store.commit()
        except BaseException:
            store.rollback()
            raise

    stream = rows.writeStream.foreachBatch(batch).queryName(name).option("checkpointLocation", checkpoint or scratch(rows.sparkSession, name))
    return (stream.trigger(**trigger) if trigger else stream).start()
