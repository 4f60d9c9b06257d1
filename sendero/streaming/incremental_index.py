"""Incremental place index from a stream of event files (S7 over a stream).

New interaction files are picked up by a file stream source; each
micro-batch is bound and cleaned, its catalogue (first row per url) is
embedded, and ids the index lacks are inserted (``foreachBatch`` keyed
merge).  Progress lives in the checkpoint location, so a restarted job
resumes after the last committed batch; re-running a batch is harmless
because insert-new-only is idempotent.

With files arriving in id order this equals the batch build; one edge
differs: a site whose earliest row has no name is dropped from the batch
catalogue for good, while a later batch may still insert it (the stale-index
rule D11 of the batch ingest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sendero.functions import narratives as N
from sendero.operators.aggregates import place_catalog
from sendero.operators.clean import clean_interactions
from sendero.operators.embed import HashedTokenEmbedder
from sendero.sources import bindings
from sendero.sources.index import PLACE_METADATA, VectorIndex, place_index_rows
from sendero.sources.tables import table


def place_index_batch(spark: SparkSession, sf_dir: str, events: DataFrame, embedder=None) -> DataFrame:
    embedder = embedder or HashedTokenEmbedder()
    catalog = place_catalog(clean_interactions(bindings.interacciones(spark, sf_dir, events, comments=False)))
    texts = catalog.select("url_sitio", "nombre_sitio", "categoria_sitio", "ubicacion",
                           N.place_document().alias("documento"))
    return place_index_rows(texts, embedder(texts, "url_sitio", "documento"))


def start_place_index_stream(spark: SparkSession, sf_dir: str, events_dir: str, index_path: str,
                             state_path: str | None = None, max_files_per_trigger: int = 1,
                             file_pattern: str = "*.parquet"):
    """Start the stream over files of ``events_dir`` matching ``file_pattern``
    (trigger availableNow: drain what is there, then stop)."""
    events_schema = table(spark, sf_dir, "events").schema
    index = VectorIndex(spark, index_path, PLACE_METADATA).get_or_create()
    # Beside the collection it feeds, so that a restart finds it.
    state = state_path or f"{index_path.rstrip('/')}/_stream"
    stream = (
        spark.readStream.schema(events_schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .option("pathGlobFilter", file_pattern)
        .parquet(events_dir)
    )

    def merge(batch: DataFrame, epoch_id: int) -> None:
        index.insert_new(place_index_batch(spark, sf_dir, batch))

    return (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
