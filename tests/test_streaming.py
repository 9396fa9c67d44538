import json

import pytest
from conftest import DATA, rows

from thesaurion.streaming.ingest import ConceptStore, ingest, sessions, windowed_counts


def test_ingest_in_batches_and_again(spark, tmp_path):
    store = ConceptStore(spark, f"{tmp_path}/store")
    assert store.version() == -1 and store.read().count() == 0
    inbox = tmp_path / "in"
    inbox.mkdir()

    def deliver(name, data):
        (inbox / name).write_text("".join(json.dumps(x) + "\n" for x in data))
        ingest(spark, str(inbox), store, f"{tmp_path}/check").awaitTermination()
        return rows(store.read().select("concept_id", "label", "definition").na.fill("-"))

    assert deliver("a.json", [{"prefix": "hpo", "concept_id": "1", "label": "A", "definition": "d"}, {"prefix": "hpo", "concept_id": "2", "label": "B"}]) == [("1", "A", "d"), ("2", "B", "-")]
    assert deliver("b.json", [{"prefix": "hpo", "concept_id": "1", "label": "AA"}, {"prefix": "hpo", "concept_id": None}]) == [("1", "AA", "d"), ("2", "B", "-")]
    v = store.version()
    store.apply(store.read().limit(0), v)  # the same batch again
    assert store.version() == v and store.read().count() == 2


def test_bad_line_fails(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text('{"prefix": "hpo", "concept_id"\n')
    with pytest.raises(Exception):
        ingest(spark, f"{tmp_path}/in", ConceptStore(spark, f"{tmp_path}/s"), f"{tmp_path}/c").awaitTermination()


def test_windows_agree_for_stream_and_table(spark):
    path = f"{DATA}/events.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(DATA)
    q = windowed_counts(stream, "6 hours").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.sql("select start, event_type, n from w")) == rows(windowed_counts(table, "6 hours").select("start", "event_type", "n"))
    assert sessions(table).selectExpr("sum(n)").first()[0] == table.count()
