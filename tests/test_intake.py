"""Landing intake: verdicts, routing, and only new files on the next run."""

import pytest
from pyspark.sql import functions as F

from gridtide import texts
from gridtide.sources.sinks import latest_status, require_status
from gridtide.streaming.intake import file_verdicts, read_lines, run_intake

HEADER = "datetime,CellID,countrycode,smsin,smsout,callin,callout,internet"
GOOD = "2013-11-01 00:00:00,1,39,0.5,,0.25,,10.5"

FILES = {
    "sms-call-internet-mi-2013-11-01.csv": [HEADER, GOOD, "2013-11-01 01:00:00,2,0,,,,,", ""],
    "sms-call-internet-mi-2013-11-02.csv": ["CellID,datetime,countrycode,smsin,smsout,callin,callout,internet", GOOD],
    "sms-call-internet-mi-2013-11-03.csv": [HEADER, GOOD, "yesterday,1,39,1,1,1,1,1", "2013-11-03,,39,-1,1,1,1,1"],
    "sms-call-internet-mi-2013-11-04.csv": [HEADER, GOOD, "2013-11-04 00:00:00,1,39,x,1,1,1,-1"],
    "sms-call-internet-mi-2013-11-05.csv": [HEADER],
    "sms-call-internet-mi-2013-11-06.csv": [HEADER, "2013-11-06 00:00:00,,39,1,1,1,1,1"],
    "sms-call-internet-mi-2013-11-07.csv": [HEADER, "2013-11-07 00:00:00,1,39,1,-1,1,1,x"],
    "sms-call-internet-mi-2013-11-08.csv": [HEADER, GOOD, HEADER, "bad,1,39,1,1,1,1,1"],
    "sms-call-internet-mi-2013-11-09.csv": [HEADER, GOOD + ",7"],
    "sms-call-internet-mi-2013-11-10.csv": [],
    "notes.csv": ["anything"],
}

REASONS = {
    "01": ("VALID", 2, texts.CHECKS_PASSED),
    "03": ("REJECTED", 3, texts.BAD_TIME + "1"),
    "04": ("REJECTED", 2, "Non-numeric values found in activity column 'smsin': 1"),
    "05": ("REJECTED", 0, texts.NO_ROWS),
    "06": ("REJECTED", 1, texts.NO_CELL + "1"),
    "07": ("REJECTED", 1, "Negative activity values found in 'smsout': 1"),
    "08": ("REJECTED", 3, texts.BAD_TIME + "2"),
    "09": ("REJECTED", 0, texts.RAGGED + "1"),
    "10": ("REJECTED", 0, texts.UNREADABLE),
}


def land(folder, names):
    folder.mkdir(exist_ok=True)
    for name in names:
        (folder / name).write_text("\n".join(FILES[name]) + ("\n" if FILES[name] else ""))


def name_of(day):
    return f"sms-call-internet-mi-2013-11-{day}.csv"


def test_verdicts_name_the_first_failing_check(spark, tmp_path):
    land(tmp_path / "in", FILES)
    rows = {r.source: r for r in file_verdicts(read_lines(spark, str(tmp_path / "in"))).collect()}
    assert "notes.csv" not in rows
    for day, expected in REASONS.items():
        if day != "10":
            row = rows[name_of(day)]
            assert (row.status, row.row_count, row.reason) == expected, day
    mismatch = rows[name_of("02")]
    assert mismatch.status == "REJECTED" and mismatch.row_count == 0
    assert mismatch.reason.startswith("Schema mismatch. Expected columns: ['datetime', 'CellID'")
    assert mismatch.reason.endswith(
        "Found: ['CellID', 'datetime', 'countrycode', 'smsin', 'smsout', 'callin', 'callout', 'internet']"
    )


def test_intake_routes_whole_files_and_processes_each_once(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    first = [n for n in FILES if n != name_of("04")]
    land(landing, first)
    totals = run_intake(spark, str(landing), out)
    assert totals == {"total_files": 9, "valid_files": 1, "rejected_files": 8, "rows_ingested": 2, "batches": [0]}
    log = {r.source: (r.status, r.row_count, r.reason) for r in spark.read.parquet(f"{out}/log").collect()}
    assert log[name_of("10")] == REASONS["10"]
    raw = spark.read.parquet(f"{out}/raw")
    assert raw.count() == 2
    row = raw.where("CellID = 1").first()
    assert (row.datetime, row.countrycode, row.smsin, row.smsout, row.internet) == ("2013-11-01 00:00:00", 39, 0.5, None, 10.5)
    rejected = spark.read.parquet(f"{out}/rejected")
    assert rejected.where(F.col("source") == name_of("03")).count() == 4

    assert run_intake(spark, str(landing), out)["total_files"] == 0
    land(landing, [name_of("04")])
    assert run_intake(spark, str(landing), out) == {
        "total_files": 1, "valid_files": 0, "rejected_files": 1, "rows_ingested": 0, "batches": [1],
    }
    assert spark.read.parquet(f"{out}/raw").count() == 2
    assert spark.read.parquet(f"{out}/log").count() == 10
    assert latest_status(spark, f"{out}/status", "intake")["counts"]["rejected_files"] == 1


def test_failed_intake_is_recorded(spark, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(Exception):
        run_intake(spark, str(tmp_path / "missing"), out)
    with pytest.raises(ValueError, match="FAILURE"):
        require_status(spark, f"{out}/status", "intake")


def test_empty_landing_is_rejected_and_does_not_block_later_files(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    land(landing, [name_of("10")])
    (landing / name_of("11")).write_text("\n \n")
    first = run_intake(spark, str(landing), out)
    assert (first["total_files"], first["rejected_files"]) == (2, 2)
    land(landing, [name_of("01")])
    assert run_intake(spark, str(landing), out)["valid_files"] == 1
    log = {r.source: r.reason for r in spark.read.parquet(f"{out}/log").collect()}
    assert log[name_of("10")] == log[name_of("11")] == texts.UNREADABLE and len(log) == 3


def test_each_file_is_judged_in_its_own_batch(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    days = ["01", "02", "03", "05", "06", "07"]
    land(landing, [name_of(day) for day in days])
    assert run_intake(spark, str(landing), out, max_files=1)["batches"] == list(range(6))
    log = spark.read.parquet(f"{out}/log")
    assert log.count() == log.select("source").distinct().count() == log.select("batch_id").distinct().count() == 6
