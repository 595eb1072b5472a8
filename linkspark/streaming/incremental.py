"""New targets against a standing Source 1 index, micro-batch by micro-batch: the reverse pass as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linkspark.operators.blocking import pass_views, reverse_pairs
from linkspark.operators.index_store import stored_index

SPEC = "name:10"


def link_stream(targets: DataFrame, source1: DataFrame, path: str, checkpoint: str, spec: str = SPEC, budget: int = 50_000) -> StreamingQuery:
    """Write the reverse pairs of each batch of the stream ``targets`` (records) to ``path``, a folder per batch.

    The index of Source 1 is written below ``path`` when the stream starts, unless it is there, and read by every batch. A
    batch that is run again after a failure overwrites its own folder, so every target is linked once.
    """
    index = stored_index(source1, f"{path}/_index", pass_views(spec), variants=False)

    def link(batch: DataFrame, number: int) -> None:
        reverse_pairs(index, batch, spec, budget).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return targets.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
