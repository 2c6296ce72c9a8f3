"""Re-analysis of a growing edge table (an extension: the batch analysis is the whole contract).

Edges arrive as a stream of files; each micro-batch is added to the edge table once, under
its batch id, and the operators given run over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import projection


def watch_edges(spark: SparkSession, source: str, table: str, checkpoint: str, analyse: Callable[[DataFrame, int], None], schema: str = "src string, dst string") -> StreamingQuery:
    """Run ``analyse(proj, batch id)`` over all edges so far, whenever new ones arrived.

    A batch that is run again overwrites its own folder, so no edge is added twice.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        analyse(projection(spark.read.parquet(table).select("src", "dst")), batch_id)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
