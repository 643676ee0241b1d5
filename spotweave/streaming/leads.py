"""Continuous intake of leads: a file stream, validated, with valid and rejected rows landed in two tables.

Each row stands alone, so there is no state and no watermark. A micro-batch is landed under its own id and counts once the ledger has it: one that
is run again after a failure, between the two tables or anywhere else, replaces what it left, and its rows get the same ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.intake import LEAD, append_leads


def stream_leads(spark: SparkSession, source: str, root: str, checkpoint: str, available_now: bool = True, schema: str = LEAD):
    def land(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        append_leads(batch, root, batch_id)
        batch.unpersist()

    out = spark.readStream.schema(schema).json(source).writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
