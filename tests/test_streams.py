"""Streams of several files out of time order: what is drained equals the batch."""

import pytest
from pyspark.sql import functions as F

from folioscope.streaming import loads


def files(spark, folder, rows):
    """One file per row, in the given order of arrival."""
    schema = "user_id long, kind string, ts timestamp, event_id long"
    df = spark.createDataFrame(rows, "user_id long, kind string, ts string, event_id long").withColumn("ts", F.to_timestamp("ts"))
    for i in range(len(rows)):
        df.where(F.col("event_id") == rows[i][3]).coalesce(1).write.mode("append").parquet(folder)
    return loads.arriving_files(spark, folder, spark.read.schema(schema).parquet(folder).schema, "parquet", per_batch=1)


ROWS = [
    (1, "a", "2024-01-09 10:00:00", 1), (1, "a", "2024-01-01 10:00:00", 2), (2, "b", "2024-01-05 10:00:00", 3),
    (1, "a", "2024-01-01 11:00:00", 4), (2, "b", "2024-01-05 23:59:59", 5), (1, "a", "2023-06-01 00:00:00", 6),
]


def test_late_rows_are_counted(spark, tmp_path):
    stream = files(spark, str(tmp_path / "in"), ROWS)
    loads.load_window_counts(stream, "user_id", "ts", "1 day", str(tmp_path / "out"), str(tmp_path / "state"))
    found = loads.total_counts(spark, str(tmp_path / "out"), "user_id", 1)
    got = {(r.user_id, str(r.inicio.date())): (r.n, r.actividad_excesiva) for r in found.collect()}
    assert got == {(1, "2024-01-09"): (1, False), (1, "2024-01-01"): (2, True), (2, "2024-01-05"): (2, True), (1, "2023-06-01"): (1, False)}


def test_keys_are_loaded_once_over_batches(spark, tmp_path):
    stream = files(spark, str(tmp_path / "in"), ROWS)
    loads.load_once_per_key(stream, ["user_id", "kind"], ["event_id"], str(tmp_path / "out"), str(tmp_path / "state"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == 2 and {(r.user_id, r.kind) for r in found.collect()} == {(1, "a"), (2, "b")}


SCHEMA = "a long, b string, id long, note string"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_a_batch_reads_nothing_stored_before(spark, tmp_path):
    """Each load goes to a folder of its own, so the keys skipped can come from the state alone."""
    seen, arrived = set(), str(tmp_path / "in")
    for step in range(4):
        rows = [(k, f"k{k % 3}", 1000 * step + k, f"n{step}") for k in range(step * 50, step * 50 + 100)] * 2
        arrive(spark, arrived, rows)
        stream = loads.arriving_files(spark, arrived, spark.read.parquet(arrived).schema, "parquet")
        out = str(tmp_path / f"out{step}")
        query = loads.load_once_per_key(stream, ["a", "b"], ["id"], out, str(tmp_path / "state"))
        found = {(r.a, r.b) for r in spark.read.parquet(out).collect()}
        new = {(r[0], r[1]) for r in rows} - seen
        assert found == new and spark.read.parquet(out).count() == len(new)
        seen |= new
        done = [p for p in query.recentProgress if p.numInputRows]
        # The rows are scanned as rows and as keys; both are those of this batch, and so are the lookups.
        assert sum(p.numInputRows for p in done) == 2 * len(rows)
        assert done[-1].stateOperators[0].numRowsTotal == len(seen)
        assert done[-1].stateOperators[0].numRowsUpdated == len(new)


def test_null_keys_ties_repeats_and_a_hot_key(spark, tmp_path):
    arrived, out, big = str(tmp_path / "in"), str(tmp_path / "out"), 2**60 + 1
    batches = [
        [(None, None, 5, "x"), (None, None, 4, "y"), (1, None, None, "null order first"), (1, None, 0, "z"), (2, "b", 1, None)],
        [(None, None, 1, "late"), (big, "b", big, "exact"), (big - 1, "b", 2, "other")] + [(9, "hot", i, "h") for i in range(30_000, 0, -1)],
        [(9, "hot", 0, "late"), (1, "", 3, "empty text is no null"), (2, "b", 0, "late")],
    ]
    for rows in batches:
        arrive(spark, arrived, rows)
        stream = loads.arriving_files(spark, arrived, spark.read.parquet(arrived).schema, "parquet")
        loads.load_once_per_key(stream, ["a", "b"], ["id"], out, str(tmp_path / "state"))
    found = sorted((tuple(r) for r in spark.read.parquet(out).drop("lote").collect()), key=str)
    assert found == sorted([
        (None, None, 4, "y"), (1, None, None, "null order first"), (2, "b", 1, None), (big, "b", big, "exact"),
        (big - 1, "b", 2, "other"), (9, "hot", 1, "h"), (1, "", 3, "empty text is no null"),
    ], key=str)


def test_a_repeated_batch_stores_the_same_rows(spark, tmp_path):
    """A batch that fails after its rows were written is run again from the state before it."""
    arrived, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    arrive(spark, arrived, [(k, "b", k, "n") for k in range(20)])
    stream = loads.arriving_files(spark, arrived, spark.read.parquet(arrived).schema, "parquet")

    def fails(batch, number):
        loads.first_of_new_keys(batch, ["a", "b"], ["id"]).write.mode("overwrite").parquet(loads.batch_folder(out, number))
        raise RuntimeError("lost after writing")

    with pytest.raises(Exception, match="lost after writing"):
        loads.drain(loads.keyed_rows(stream, ["a", "b"]), state, fails)
    loads.load_once_per_key(stream, ["a", "b"], ["id"], out, state)
    assert sorted(r.a for r in spark.read.parquet(out).collect()) == list(range(20))


def test_only_keys_and_no_rows(spark, tmp_path):
    arrived, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, arrived, [])
    arrive(spark, arrived, [(1, "a", 1, "n"), (1, "a", 2, "n")])
    stream = loads.arriving_files(spark, arrived, spark.read.parquet(arrived).schema, "parquet").select("a", "b")
    loads.load_once_per_key(stream, ["a", "b"], ["a"], out, str(tmp_path / "state"))
    assert [tuple(r) for r in spark.read.parquet(out).drop("lote").collect()] == [(1, "a")]
