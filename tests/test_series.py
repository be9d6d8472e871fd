"""Features kept current batch by batch against the full computation."""

import random

import pytest
from pyspark.sql import functions as F

from gridtide.operators.features import clock_features, trailing_features, with_drop_label
from gridtide.streaming import series

HOURLY = "grid_id long, i int, call_in double, call_out double, internet_activity double, total_activity double"


def hourly_rows(spark, rows):
    table = spark.createDataFrame([(c, i, v / 4, v / 2, v, v * 2) for c, i, v in rows], HOURLY)
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=F.col("i"))
    return table.withColumn("timestamp", F.when(F.col("i") >= 0, stamp)).withColumn("hour", F.hour("timestamp")).drop("i")


def plain(df):
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in rows), key=repr)


def in_full(table):
    return plain(clock_features(with_drop_label(trailing_features(table))))


@pytest.mark.parametrize("order", ["in_time", "shuffled"])
def test_batches_equal_the_full_computation(spark, tmp_path, order):
    pick, out = random.Random(7), str(tmp_path / "out")
    rows = [(cell, i, float(pick.randint(0, 9))) for cell in (1, 2, 3) for i in range(70) if pick.random() < 0.8]
    if order == "in_time":
        rows.sort(key=lambda row: row[1])
    else:
        pick.shuffle(rows)
    third = len(rows) // 3
    for number, part in enumerate((rows[:third], rows[third : 2 * third], rows[2 * third :])):
        series.apply_batch(hourly_rows(spark, part), number, out)
    assert plain(series.current_features(spark, out)) == in_full(hourly_rows(spark, rows))


def test_corrections_replays_and_rows_without_keys(spark, tmp_path):
    out = str(tmp_path / "out")
    first = [(1, i, 1.0 + i % 5) for i in range(40)] + [(2, i, 2.0) for i in range(3)]
    series.apply_batch(hourly_rows(spark, [*first, (None, 1, 9.0), (1, None, 9.0)]), 0, out)
    # An earlier hour corrected, twice in one batch (the greater row stays), and a new hour; the batch is run again.
    second = hourly_rows(spark, [(1, 10, 7.0), (1, 10, 8.0), (1, 40, 3.0)])
    series.apply_batch(second, 1, out)
    series.apply_batch(second, 1, out)
    series.apply_batch(hourly_rows(spark, []), 2, out)
    series.apply_batch(hourly_rows(spark, [(1, 41, 5.0), (3, 0, 1.0)]), 3, out)
    merged = {(c, i): v for c, i, v in first} | {(1, 10): 8.0, (1, 40): 3.0, (1, 41): 5.0, (3, 0): 1.0}
    assert plain(series.current_features(spark, out)) == in_full(hourly_rows(spark, [(c, i, v) for (c, i), v in merged.items()]))
    # Row 10 reaches from row 9 to row 34; rows 39 and 40 are next to the new hour.
    changed = spark.read.parquet(f"{out}/features").where("batch_id = 1")
    hours = changed.select(F.expr("timestampdiff(HOUR, TIMESTAMP '2024-01-01', timestamp)").alias("h")).collect()
    assert sorted(row.h for row in hours) == [*range(9, 35), 39, 40]
    assert {row.grid_id for row in changed.collect()} == {1}


def test_batches_in_time_read_no_history(spark, tmp_path, monkeypatch):
    out, read = str(tmp_path / "out"), []
    stored = series.stored_or_empty
    monkeypatch.setattr(series, "stored_or_empty", lambda spark, path, schema: read.append(path) or stored(spark, path, schema))
    for number in range(3):
        series.apply_batch(hourly_rows(spark, [(1, number, 1.0), (2, number, 2.0)]), number, out)
    assert f"{out}/tail" in read and f"{out}/history" not in read
    series.apply_batch(hourly_rows(spark, [(1, 1, 4.0)]), 3, out)
    assert f"{out}/history" in read


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    out, landing = str(tmp_path / "out"), str(tmp_path / "landing")
    first, second = [(1, i, 1.0 + i) for i in range(30)], [(1, i, 2.0) for i in (31, 30)]
    table = hourly_rows(spark, first)
    for part in (table, hourly_rows(spark, second)):
        part.coalesce(1).write.mode("append").parquet(landing)
        series.keep_features(spark.readStream.schema(table.schema).parquet(landing), out)
    assert plain(series.current_features(spark, out)) == in_full(hourly_rows(spark, first + second))
