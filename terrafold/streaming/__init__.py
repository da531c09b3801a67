"""The engine is batch: what it computes has no streams.  :func:`rerun` is how to drive a batch function from one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def rerun(stream: DataFrame, function: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Run ``function`` on what is new, once through, for each micro-batch."""
    return stream.writeStream.foreachBatch(lambda df, _: function(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
