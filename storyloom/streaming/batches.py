"""A stream of documents, batch by batch. A document is one row, so batches share no state and need no watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from storyloom.plans.corpus import Corpus


def write_relations(stream: DataFrame, folder: str, checkpoint: str, names: Iterable[str] = ("events", "segments", "relations"), once: bool = False, make: Callable[[DataFrame], Corpus] = Corpus) -> StreamingQuery:
    """Appends the named relations of each batch as Parquet under folder; once: ends when what is there has been read.

    A batch that is run again after a failure replaces what it wrote: each batch has a folder of its own, by its number.
    """

    def batch(df: DataFrame, number: int) -> None:
        corpus = make(df)
        events = corpus.events.persist()
        corpus.__dict__["events"] = events
        try:
            for name in names:
                getattr(corpus, name).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            events.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
