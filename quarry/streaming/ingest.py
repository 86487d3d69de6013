"""Documents from a stream into an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.index import Index


def ingest(stream: DataFrame, index: Index, checkpoint: str, available_now: bool = True, interval: str = "1 minute") -> StreamingQuery:
    """Upsert every micro-batch of stream(doc_id, text, doc_ord?, meta?) into
    the index. A batch that is repeated after a failure puts the same
    documents in again, so each counts once."""

    def put(batch: DataFrame, _: int) -> None:
        index.add_documents(batch)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
