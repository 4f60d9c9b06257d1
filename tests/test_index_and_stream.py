"""Vector collections: create, upsert, insert-new-only; the streaming build."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from sendero.plans.pipeline import Pipeline
from sendero.sources.index import PLACE_METADATA, VectorIndex, index_summary, place_index_rows
from sendero.streaming.incremental_index import start_place_index_stream


def _rows(spark, docs):
    data = [(i, d, [1.0, 0.0], (i, "c", "l", i)) for i, d in docs]
    return spark.createDataFrame(
        data, "id string, document string, embedding array<double>, "
              "metadata struct<nombre_sitio:string,categoria_sitio:string,ubicacion:string,url_sitio:string>")


def test_upsert_twice_equals_once(spark, tmpdir_path):
    idx = VectorIndex(spark, f"{tmpdir_path}/i", PLACE_METADATA).get_or_create()
    assert idx.count() == 0
    b = _rows(spark, [("a", "A"), ("b", "B")])
    idx.upsert(b)
    once = sorted(map(tuple, idx.read().select("id", "document").collect()))
    idx.upsert(b)
    assert sorted(map(tuple, idx.read().select("id", "document").collect())) == once


def test_upsert_replaces_insert_new_keeps(spark, tmpdir_path):
    idx = VectorIndex(spark, f"{tmpdir_path}/i", PLACE_METADATA)
    idx.overwrite(_rows(spark, [("a", "old")]))
    idx.insert_new(_rows(spark, [("a", "new"), ("b", "B")]))
    assert dict(map(tuple, idx.read().select("id", "document").collect())) == {"a": "old", "b": "B"}
    idx.upsert(_rows(spark, [("a", "new")]))
    assert dict(map(tuple, idx.read().select("id", "document").collect())) == {"a": "new", "b": "B"}
    assert set(idx.listing().columns) == {"nombre_sitio", "categoria_sitio", "ubicacion", "url_sitio", "documento_indexado"}


def test_stream_build_equals_batch_build(spark, tmpdir_path):
    p = Pipeline(spark, SF_SMALL)
    batch = index_summary(place_index_rows(p.place_texts, p.place_vectors))
    path = f"{tmpdir_path}/stream-index"
    q = start_place_index_stream(spark, SF_SMALL, SF_SMALL, path, state_path=f"{tmpdir_path}/state",
                                 file_pattern="events.parquet")
    q.awaitTermination()
    streamed = index_summary(VectorIndex(spark, path, PLACE_METADATA).read())
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_stream_over_several_batches(spark, tmpdir_path):
    import os
    import time

    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = os.path.join(tmpdir_path, "events_in")
    os.makedirs(src)
    bounds = [0, 300, 700, 10**9]
    for n, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        part = events.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).toPandas()
        part.to_parquet(os.path.join(src, f"part-{n}.parquet"), index=False,
                        coerce_timestamps="us", allow_truncated_timestamps=True)
        time.sleep(0.05)  # distinct modification times keep the batch order
    path = f"{tmpdir_path}/stream-index-3"
    q = start_place_index_stream(spark, SF_SMALL, src, path, state_path=f"{tmpdir_path}/state3")
    q.awaitTermination()
    assert len(q.recentProgress) >= 3
    p = Pipeline(spark, SF_SMALL)
    batch = index_summary(place_index_rows(p.place_texts, p.place_vectors))
    streamed = index_summary(VectorIndex(spark, path, PLACE_METADATA).read())
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
