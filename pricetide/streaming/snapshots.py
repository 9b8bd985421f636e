"""Visits saved as they come in."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pricetide.sources.tables import Tables


def save_stream(log: DataFrame, tables: Tables, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Merge each micro-batch of visits into the daily rows; late visits rewrite their own day.

    No state is kept between batches: the table is the state. A batch that is replayed after a failure carries the
    same number and finds its merge done. `name` tells apart streams that save to the same tables.
    """

    def save(batch: DataFrame, number: int) -> None:
        tables.save_snapshots(batch, f"{name}-{number}")

    return (
        log.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
