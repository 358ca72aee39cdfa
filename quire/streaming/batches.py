"""An extension: documents that arrive as a stream. A document is split whole, so each micro-batch of whole documents is a batch of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quire.operators.split import split_nodes
from quire.sources.html_nodes import parse_nodes


def split_stream(fragments: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, level: int = 1) -> StreamingQuery:
    """fragments: a stream of (doc_id, fragment). sink gets each batch's articles and the batch's number, which a repeated batch has again."""

    def each(batch: DataFrame, nth: int) -> None:
        sink(split_nodes(parse_nodes(batch), level, batch), nth)

    return fragments.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
