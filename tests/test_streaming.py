"""Streams give the rows that the same operator gives on the whole table."""

import pytest

from tidemark.sources.tables import table
from tidemark.streaming import windows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("operator", [windows.tumbling, windows.sessions])
def test_stream_equals_table(spark, tmp_path, operator):
    events = table(spark, FOLDER, "events")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    name = operator.__name__
    run = operator(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    run.awaitTermination(120)
    key = lambda r: tuple(map(str, r))
    assert sorted(spark.table(name).collect(), key=key) == sorted(operator(events).collect(), key=key)


def test_first_seen_drops_repeats(spark):
    events = table(spark, FOLDER, "events")
    assert windows.first_seen(events.unionAll(events)).count() == events.select("event_id").distinct().count()
