"""Collections: published versions, two writers, buckets written anew, removal."""

import os
import time

import pytest

from sendero.sources.index import PLACE_METADATA, ConcurrentWrite, VectorIndex


def _rows(spark, docs):
    return spark.createDataFrame(
        [(i, d, [1.0, 0.0], (i, "c", "l", i)) for i, d in docs], "id string, document string, embedding array<double>, "
        "metadata struct<nombre_sitio:string,categoria_sitio:string,ubicacion:string,url_sitio:string>")


def _content(idx):
    return {r.id: r.document for r in idx.read().collect()}


def _files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_of_two_writers_one_loses_and_deletes_only_its_own(spark, tmp_path):
    path = str(tmp_path / "c")
    first, second = VectorIndex(spark, path, PLACE_METADATA), VectorIndex(spark, path, PLACE_METADATA)
    first.upsert(_rows(spark, [("a", "A"), ("b", "B")]))
    stale = first._current()
    second._current = lambda: stale  # it began before the first one's next write
    first.upsert(_rows(spark, [("a", "A2")]))
    kept = _files(path)
    for write in (second.upsert, second.insert_new, second.overwrite):
        with pytest.raises(ConcurrentWrite):
            write(_rows(spark, [("c", "C")]))
    assert _files(path) == kept
    assert _content(first) == {"a": "A2", "b": "B"}
    del second._current
    second.insert_new(_rows(spark, [("c", "C")]))
    assert _content(first) == {"a": "A2", "b": "B", "c": "C"}


def test_a_late_writer_cannot_publish_a_version_that_has_left(spark, tmp_path):
    idx = VectorIndex(spark, str(tmp_path / "c"), PLACE_METADATA).get_or_create()
    stale = idx._current()
    for n in range(4):
        idx.upsert(_rows(spark, [("a", str(n))]))
    late = VectorIndex(spark, idx.path, PLACE_METADATA)
    late._current = lambda: stale
    with pytest.raises(ConcurrentWrite):
        late.upsert(_rows(spark, [("a", "late")]))
    assert _content(idx) == {"a": "3"}


def test_a_small_batch_leaves_most_files_alone(spark, tmp_path):
    idx = VectorIndex(spark, str(tmp_path / "c"), PLACE_METADATA, bucket_rows=10)
    docs = {f"s{n:03d}": f"d{n}" for n in range(400)}
    idx.upsert(_rows(spark, docs.items()))
    before = idx._current()
    assert before["buckets"] == 64 and idx.count() == 400
    idx.upsert(_rows(spark, [("s007", "other")]))
    after = idx._current()
    same = {f for _, f, _ in before["folders"]} & {f for _, f, _ in after["folders"]}
    assert len(same) == len(before["folders"]) - 1
    idx.insert_new(_rows(spark, [("new", "N"), ("s008", "ignored")]))
    assert len({f for _, f, _ in idx._current()["folders"]} - {f for _, f, _ in after["folders"]}) == 1
    assert _content(idx) == docs | {"s007": "other", "new": "N"}


def test_buckets_double_and_full_ones_are_written_anew(spark, tmp_path):
    idx = VectorIndex(spark, str(tmp_path / "c"), PLACE_METADATA, bucket_rows=20)
    want = {}
    for n in range(12):
        batch = {f"r{n}-{i}": f"d{n}" for i in range(5)}
        want |= batch
        idx.insert_new(_rows(spark, batch.items()))
    current = idx._current()
    assert current["buckets"] == 4 and _content(idx) == want and idx.count() == 60
    assert max(sum(1 for b, _, _ in current["folders"] if b == k) for k in range(4)) <= 8


def test_a_change_is_seen_whole_or_not_at_all(spark, tmp_path):
    idx = VectorIndex(spark, str(tmp_path / "c"), PLACE_METADATA)
    idx.upsert(_rows(spark, [("a", "A")]))
    publish, seen = idx._publish, []

    def watched(*args):
        seen.append(_content(VectorIndex(spark, idx.path, PLACE_METADATA)))
        return publish(*args)

    idx._publish = watched
    idx.insert_new(_rows(spark, [("b", "B")]))
    assert seen == [{"a": "A"}] and _content(idx) == {"a": "A", "b": "B"}


def test_ids_are_removed_and_empty_changes_publish_nothing(spark, tmp_path):
    idx = VectorIndex(spark, str(tmp_path / "c"), PLACE_METADATA)
    idx.upsert(_rows(spark, [("a", "A"), ("b", "B"), ("c", "C")]))
    ids = spark.createDataFrame([("a",), ("b",), ("absent",)], "id string")
    idx.upsert(_rows(spark, [("b", "B2")]), remove=ids)  # an id in both stays, with the new row
    assert _content(idx) == {"b": "B2", "c": "C"}
    version = idx._current()["version"]
    idx.upsert(_rows(spark, []))
    idx.insert_new(_rows(spark, [("b", "ignored")]))
    assert idx._current()["version"] == version


def test_vacuum_takes_only_writes_that_no_version_names(spark, tmp_path):
    idx = VectorIndex(spark, str(tmp_path / "c"), PLACE_METADATA)
    idx.upsert(_rows(spark, [("a", "A")]))
    _, added = idx._write(_rows(spark, [("b", "B")]), 1)  # a writer that dies before it publishes
    assert idx.vacuum(0) == []
    assert idx.vacuum(int(time.time() * 1000) + 60_000) == [added[0][1].split("/")[0]]
    assert _content(idx) == {"a": "A"}
