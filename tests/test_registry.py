"""The entry points: names, SQL partners and the flagship query."""

import pytest

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["source_id", "severity"]
    assert df.count() > 0


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("name", ["stream_sessions", "stream_open_sessions"])
def test_streams_read_tables_that_are_folders(spark, tmp_path, name, parts):
    rows = [(c, t, "user", "x") for c in range(60) for t in range(4)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.repartition(parts).write.parquet(f"{tmp_path}/conversations.parquet")
    got = entry.queries()[name](spark, str(tmp_path)).collect()
    # Two sessions of two turns each; those of the last conversation end after the watermark.
    assert len(got) == (120 if name == "stream_open_sessions" else 118)
    assert all(r["turns"] == 2 for r in got)
