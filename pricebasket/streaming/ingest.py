"""New page snapshots as a stream: each micro-batch is collected and committed as one version of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pricebasket.jobs.monthly import collect_into
from pricebasket.settings import DEFAULTS, Settings
from pricebasket.sources.schemas import PAGES
from pricebasket.sources.snapshots import Store


def start_ingest(spark: SparkSession, pages: str, outlets: DataFrame, store: str, checkpoint: str, dataset: str, settings: Settings = DEFAULTS) -> StreamingQuery:
    """Collects what has arrived under `pages` since the last run into the store, and stops.

    A micro-batch that is repeated after a failure finds its id in the store if it was committed, and else starts from the version
    before; readers never see half of one.
    """
    source = spark.readStream.schema(PAGES).parquet(pages)

    def merge(batch: DataFrame, batch_id: int) -> None:
        collect_into(Store(batch.sparkSession, store), batch, outlets, dataset, f"{checkpoint.rstrip('/')}#{batch_id}", settings)

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
