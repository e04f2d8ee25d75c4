"""Documents that arrive as a stream, kept as bitmaps by value.

New documents are appended as packed words (rg_id, value, w, bits); an index is built from the
words when one is wanted, so a value that is new never renumbers what is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slotwise.functions import bitset
from slotwise.operators.index import BitmapIndex


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that takes all there is of ``stream`` (rg_id, doc, value) and ends.

    A batch that is run again after a failure overwrites its own directory.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        kept = batch.where("value IS NOT NULL").select(F.col("rg_id").cast("int").alias("rg_id"), "doc", "value")
        bitset.pack(kept, "doc", ["rg_id", "value"]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_of(spark: SparkSession, path: str, column_path: str = "value", **how) -> BitmapIndex:
    """An index of everything ingested under ``path``."""
    words = spark.read.parquet(path).groupBy("rg_id", "value", "w").agg(F.bit_or("bits").alias("bits"))
    return BitmapIndex.of_words(words, column_path, **how)
