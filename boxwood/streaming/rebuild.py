"""A tree over boxes that arrive in micro-batches.

The split of a node depends on all of its boxes, so nothing can be updated in
place: each batch is appended to a table, and the tree is built over the table anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from boxwood.plans.tree import Tree, build, normalized


def rebuild_on_batch(stream: DataFrame, boxes_path: str, checkpoint: str, use: Callable[[Tree, int], None], **how: int) -> StreamingQuery:
    """Starts a query that, after each batch, builds the tree over all boxes so far and hands it to use with the batch's number.

    A batch is a folder of its own below boxes_path, which is replaced if the
    batch runs again, so boxes count once.
    """

    def run(batch: DataFrame, number: int) -> None:
        normalized(batch).write.mode("overwrite").parquet(f"{boxes_path}/batch={number}")
        use(build(batch.sparkSession.read.parquet(boxes_path).drop("batch"), **how), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
