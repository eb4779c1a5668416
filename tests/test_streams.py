"""Pages and registrations that arrive in several runs of a stream."""

from datetime import datetime

import pytest

from folioframe.operators import templates
from folioframe.streaming import streams

PAGE = "doc_id string, ts timestamp, announced bigint, elapsed_ms double"
EVENT = "template_id bigint, fingerprint string, status string, ts timestamp, event_id bigint"


def at(minute):
    return datetime(2024, 1, 1, 0, minute)


@pytest.fixture
def arrive(spark, tmp_path):
    """Write rows as the next file and let the stream go on."""
    def step(rows, schema, process):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        df = spark.read.parquet(f"{tmp_path}/in")
        process(streams.page_stream(spark, f"{tmp_path}/in", df.schema))

    return step


def test_document_is_written_once(spark, tmp_path, arrive):
    out = f"{tmp_path}/out"
    process = lambda stream: streams.document_complete(stream, out, f"{tmp_path}/checkpoint")
    arrive([("a", at(1), 2, 5.0), ("b", at(2), 1, None), ("c", None, None, 1.0)], PAGE, process)
    arrive([("a", at(0), 2, 7.0), ("d", at(3), 3, 1.0)], PAGE, process)
    arrive([("a", at(9), 2, 1.0), ("b", at(9), 1, 1.0)], PAGE, process)  # further pages of finished documents
    rows = {r.doc_id: (r.pages, r.elapsed_ms, r.completed_at, r.state) for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).count() == 3
    assert rows == {"a": (2, 12.0, at(1), "complete"), "b": (1, 0.0, at(2), "complete"), "c": (1, 1.0, None, "complete")}


def test_idle_document_is_reported_and_forgotten(spark, tmp_path, arrive):
    out = f"{tmp_path}/out"
    process = lambda stream: streams.document_complete(stream, out, f"{tmp_path}/checkpoint", idle_hours=1 / 3_600_000)
    arrive([("a", at(1), 3, 5.0), ("b", at(2), 1, 1.0)], PAGE, process)
    arrive([("z", at(5), 1, 1.0)], PAGE, process)
    rows = sorted((r.doc_id, r.pages, r.state) for r in spark.read.parquet(out).collect())
    assert rows == [("a", 1, "incomplete"), ("b", 1, "complete"), ("z", 1, "complete")]


def test_registry_takes_new_fingerprints_only(spark, tmp_path, arrive):
    # the folder's own name must not be taken for a batch
    folder = f"{tmp_path}/batch-0/registry"
    streams.start_registry(spark.createDataFrame([(-1, "p", 0)], streams.TEMPLATE), folder, buckets=4)
    process = lambda stream: streams.registry_updates(stream, folder, f"{tmp_path}/checkpoint", buckets=4)
    arrive([(1, "p", None, at(1), 1), (2, "q", None, at(1), 3), (3, "q", None, at(1), 2), (3, None, "active", at(2), 4)], EVENT, process)
    arrive([(4, "q", None, at(3), 5), (5, "r", None, at(3), 6), (3, None, "retired", at(4), 7)], EVENT, process)
    stored = sorted((r.template_id, r.fingerprint, r.batch_id) for r in streams.stored_templates(spark, folder).collect())
    assert stored == [(-1, "p", -1), (3, "q", 0), (5, "r", 1)]
    assert [(r.template_id, r.status) for r in streams.stored_status(spark, folder).collect()] == [(3, "retired")]
    # a replay of the second batch writes the same rows in the same place
    again = spark.createDataFrame([(4, "q", 5), (5, "r", 6)], streams.TEMPLATE)
    known = streams.stored_templates(spark, folder).where("batch_id <> 1")
    streams._append_templates(templates.register(again, known), folder, 1, 4)
    assert sorted((r.template_id, r.fingerprint, r.batch_id) for r in streams.stored_templates(spark, folder).collect()) == stored
