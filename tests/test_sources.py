"""Readers, writers, GeoJSON and end-to-end plans on small files."""

import json

import pytest
from pyspark.sql import functions as F

from gridtide.operators import clean
from gridtide.plans.batch import run_batch
from gridtide.plans import daily
from gridtide.streaming.intake import run_intake
from gridtide.plans.daily import abandon_run, export_dashboard, require_inputs, published_run, run_daily, run_from_landing, run_processing
from gridtide.plans.detection import run_detection
from gridtide.schemas import HOURLY_COLUMNS
from gridtide.sources import geojson, sinks, usage

HEADER = "datetime,CellID,countrycode,smsin,smsout,callin,callout,internet"


def square(x, y):
    return [[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]]


def feature(properties, geometry, **extra):
    return {"type": "Feature", "properties": properties, "geometry": geometry, **extra}


@pytest.fixture
def grid_file(tmp_path):
    shapes = [
        feature({"cellId": 1}, {"type": "Polygon", "coordinates": [square(0, 0)]}),
        feature({"cellId": 2}, {"type": "MultiPolygon", "coordinates": [[square(10, 0)], [square(20, 0)]]}),
        feature({"cellId": 3}, {"type": "Point", "coordinates": [5, 5]}),
        feature({"other": 4}, {"type": "Polygon", "coordinates": [square(1, 1)]}),
        feature({"cellId": 5}, None),
        feature({"cell_id": 6}, {"type": "Polygon", "coordinates": [square(2, 2)]}),
        feature({"cellId": 0}, {"type": "Polygon", "coordinates": [square(3, 3)]}, id=77),
    ]
    path = tmp_path / "grid.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": shapes}, indent=1))
    return str(path)


@pytest.fixture
def usage_files(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for day in (1, 2):
        lines = [HEADER]
        for hour in range(24):
            for cell in (1, 2):
                amount = 10 if hour == 12 else 1
                lines += [f"2013-11-0{day} {hour:02d}:00:00,{cell},{code},{amount},,1,,{cell}.5" for code in (0, 39)]
        (folder / f"sms-call-internet-mi-2013-11-0{day}.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


def test_typed_read_renames_and_parses(spark, usage_files):
    df = usage.read_typed_usage(spark, usage_files)
    assert df.columns == ["timestamp", "grid_id", "country_code", "sms_in", "sms_out", "call_in", "call_out", "internet"]
    assert dict(df.dtypes)["timestamp"] == "timestamp"
    assert df.count() == 192 and df.where("timestamp IS NULL").count() == 0
    assert usage.with_source_file(usage.read_usage(spark, usage_files)).select("source").distinct().count() == 2


def test_missing_path_and_reordered_header_raise(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        usage.read_usage(spark, str(tmp_path / "nothing*.csv")).count()
    bad = tmp_path / "bad.csv"
    bad.write_text("CellID,datetime,countrycode,smsin,smsout,callin,callout,internet\n1,2013-11-01 00:00:00,0,,,,,\n")
    with pytest.raises(Exception):
        usage.read_usage(spark, str(bad)).collect()


def test_text_and_inferred_reads(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(HEADER + "\nx,1,0,-1,,y,,2\n")
    row = usage.read_text_usage(spark, str(path)).first()
    assert (row.datetime, row.callin, row.smsout) == ("x", "y", None)
    assert dict(usage.read_inferred(spark, str(path)).dtypes)["CellID"] == "int"


def test_geojson_reference_centroids_and_report(spark, grid_file):
    shapes = geojson.read_features(spark, grid_file)
    reference = {r.grid_id: json.loads(r.geometry) for r in geojson.grid_reference(shapes).collect()}
    assert set(reference) == {1, 2, 3, 0}
    assert reference[1] == {"type": "Polygon", "coordinates": [square(0, 0)]}
    fallback = {r.grid_id for r in geojson.grid_reference(shapes, fallback=True).collect()}
    assert fallback == {1, 2, 3, 6, 77}
    assert {r.grid_id for r in geojson.grid_reference(shapes, id_offset=1).collect()} == {2, 3, 4, 1}
    places = {r.grid_id: (r.centroid_latitude, r.centroid_longitude) for r in geojson.centroids(shapes).collect()}
    assert set(places) == {1, 2, 0}
    assert places[1] == pytest.approx((0.4, 0.4))
    assert places[2] == pytest.approx((0.4, 15.4))
    outer = {r.grid_id for r in geojson.centroids(shapes, exterior_only=True).collect()}
    assert outer == {1, 0}
    report = geojson.structure_report(shapes).first()
    assert report.top_level_type == "FeatureCollection" and report.total_features == 7
    assert report.grid_id_location == "features[].properties.cellId" and report.sample_grid_id == "1"
    assert report.geometry_type == "Polygon" and report.sample_coordinates_rings == 1


def test_empty_collection_raises(spark, tmp_path):
    path = tmp_path / "empty.geojson"
    path.write_text('{"type": "FeatureCollection", "features": []}')
    with pytest.raises(ValueError, match="no features"):
        geojson.read_features(spark, str(path))


def test_dynamic_overwrite_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "date string, v int")
    sinks.overwrite_partitions(frame, path)
    sinks.overwrite_partitions(spark.createDataFrame([("2024-01-02", 3)], "date string, v int"), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 3]


def test_files_by_cell_split_a_heavy_cell(spark, tmp_path):
    path = tmp_path / "t"
    df = spark.range(3000).select(
        F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("grid_id"),
        F.timestamp_seconds("id").alias("timestamp"),
    )
    sinks.write_by_cell(df, str(path), files=6)
    assert len(list(path.glob("*.parquet"))) == 6
    assert spark.read.parquet(str(path)).count() == 3000


def test_exports_verification_and_footprint(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "grid_id int, total double")
    path = str(tmp_path / "t")
    sinks.write_table(df, path)
    assert sinks.verify_written(df, path, forbidden=("geometry",)).count() == 1
    with pytest.raises(ValueError, match="instead of 5"):
        sinks.verify_written(df, path, expected_rows=5)
    with pytest.raises(ValueError, match="must not be stored"):
        sinks.verify_written(df, path, forbidden=("total",))
    size = sinks.storage_footprint(spark, {"t": path}).first()
    assert size.files >= 1 and size.size_mb > 0
    sinks.write_single_csv(df, str(tmp_path / "csv"), max_rows=1)
    assert usage.read_inferred(spark, str(tmp_path / "csv")).first().total == 2.0
    with pytest.raises(ValueError, match="more than 1 rows"):
        sinks.write_single_csv(df.union(df), str(tmp_path / "csv2"), max_rows=1)


def test_daily_run_publishes_tables_and_status(spark, tmp_path, usage_files, grid_file):
    out = str(tmp_path / "out")
    rows = usage.read_typed_usage(spark, usage_files)
    warehouse = run_daily(spark, rows, grid_file, out, "run1")
    assert published_run(spark, out) == "run1"
    assert sinks.latest_status(spark, f"{out}/status", "processing")["counts"]["rows_published"] == 96
    mark = spark.read.parquet(f"{out}/marks").first()
    analytics = spark.read.parquet(f"{out}/run1/analytics")
    assert (mark.run_id, mark.layer, mark.rows) == ("run1", "activity", 96)
    assert mark.latest == analytics.agg(F.max("timestamp")).first()[0]
    assert set(analytics.columns) == {*HOURLY_COLUMNS, "geometry"} and analytics.count() == 96
    facts = spark.read.parquet(f"{warehouse}/fact_network_activity")
    assert facts.count() == 96 and "geometry" not in facts.columns
    assert spark.read.parquet(f"{warehouse}/dim_time").agg(F.max("time_key")).first()[0] == 48
    summary = spark.read.parquet(f"{warehouse}/day_summary").orderBy("summary_date").first()
    assert (summary.active_grids, summary.peak_hour, summary.top_grid) == (2, 12, 2)
    dashboard = usage.read_inferred(spark, export_dashboard(spark, out)).collect()
    assert [r.grid_id for r in dashboard] == [2, 1]
    assert require_inputs(spark, usage_files) == 2
    with pytest.raises(ValueError, match="no input files"):
        require_inputs(spark, usage_files, glob="*.txt")

    dirty = rows.withColumn("grid_id", F.when(F.col("country_code") == 0, F.col("grid_id")))
    with pytest.raises(ValueError, match="rejected_rows"):
        run_processing(spark, dirty, geojson.grid_reference(geojson.read_features(spark, grid_file)), out, "run2")
    with pytest.raises(ValueError, match="FAILURE"):
        published_run(spark, out)


def test_a_day_without_accepted_rows_fails_the_gate(spark, tmp_path, usage_files, grid_file):
    rows = usage.read_typed_usage(spark, usage_files).withColumn("grid_id", F.lit(None).cast("long"))
    with pytest.raises(ValueError, match="no_output_rows"):
        run_daily(spark, rows, grid_file, str(tmp_path / "out"), "run1")


def test_landed_files_reach_the_warehouse(spark, tmp_path, usage_files, grid_file):
    landing, out = tmp_path / "raw", str(tmp_path / "out")
    (landing / "sms-call-internet-mi-2013-11-09.csv").write_text("datetime,wrong\n1,2\n")
    run_from_landing(spark, str(landing), grid_file, out, "run1")
    assert spark.read.parquet(f"{out}/run1/warehouse/day_summary").count() == 2
    assert run_from_landing(spark, str(landing), grid_file, out, "run2") is None
    day = (landing / "sms-call-internet-mi-2013-11-01.csv").read_text().replace("2013-11-01", "2013-11-03")
    (landing / "sms-call-internet-mi-2013-11-03.csv").write_text(day)
    warehouse = run_from_landing(spark, str(landing), grid_file, out, "run3")
    assert [str(r.summary_date) for r in spark.read.parquet(f"{warehouse}/day_summary").collect()] == ["2013-11-03"]
    stages = spark.read.parquet(f"{out}/status").select("stage", "run_id", "status").collect()
    assert {tuple(r) for r in stages} == {(s, r, "SUCCESS") for s in ("processing", "warehouse") for r in ("run1", "run3")}


def test_rows_accepted_before_a_stop_are_published_once(spark, tmp_path, usage_files, grid_file, monkeypatch):
    landing, out = tmp_path / "raw", str(tmp_path / "out")
    run_intake(spark, str(landing), f"{out}/intake")  # the first call stops right after the intake
    warehouse = run_from_landing(spark, str(landing), grid_file, out, "run1")
    assert warehouse == f"{out}/run1/warehouse" and spark.read.parquet(f"{warehouse}/day_summary").count() == 2
    assert run_from_landing(spark, str(landing), grid_file, out, "run2") is None

    day = (landing / "sms-call-internet-mi-2013-11-01.csv").read_text()
    (landing / "sms-call-internet-mi-2013-11-03.csv").write_text(day.replace("2013-11-01", "2013-11-03"))

    def stopped(*args, **kwargs):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:  # this one stops after it has stored its layers, before the warehouse
        patch.setattr(daily, "run_warehouse", stopped)
        with pytest.raises(KeyboardInterrupt):
            run_from_landing(spark, str(landing), grid_file, out, "run3")
    (landing / "sms-call-internet-mi-2013-11-04.csv").write_text(day.replace("2013-11-01", "2013-11-04"))
    assert run_from_landing(spark, str(landing), grid_file, out, "run4") == f"{out}/run4/warehouse"
    days = {run: [str(r.summary_date) for r in spark.read.parquet(f"{out}/{run}/warehouse/day_summary").orderBy("summary_date").collect()] for run in ("run1", "run3", "run4")}
    assert days == {"run1": ["2013-11-01", "2013-11-02"], "run3": ["2013-11-03"], "run4": ["2013-11-04"]}
    assert run_from_landing(spark, str(landing), grid_file, out, "run5") is None
    with pytest.raises(ValueError, match="has claimed"):
        (landing / "sms-call-internet-mi-2013-11-05.csv").write_text(day.replace("2013-11-01", "2013-11-05"))
        run_from_landing(spark, str(landing), grid_file, out, "run4")


def test_a_failed_run_is_tried_again_until_it_is_given_up(spark, tmp_path, usage_files, grid_file, monkeypatch):
    landing, out = tmp_path / "raw", str(tmp_path / "out")

    def failing(rules):
        raise ValueError("quality check failed")

    with monkeypatch.context() as patch:
        patch.setattr(daily, "require_passed", failing)
        for run in ("run1", "run2"):
            with pytest.raises(ValueError, match="quality check failed"):
                run_from_landing(spark, str(landing), grid_file, out, run)
    assert set(daily.open_runs(spark, out)) == {"run1"}
    abandon_run(spark, out, "run1", "bad delivery")
    assert run_from_landing(spark, str(landing), grid_file, out, "run3") is None


def scans_of(spark, path):
    """Number of executed plans that read files below a path."""
    executions = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [executions.apply(i).physicalPlanDescription() for i in range(executions.size())]
    return sum(any("Location" in line and path in line for line in plan.splitlines()) for plan in plans)


def test_counts_of_a_run_come_from_its_writes(spark, tmp_path, usage_files, grid_file):
    from gridtide.operators.quality import quality_gate

    out = str(tmp_path / "out")
    reference, _ = daily.stored_reference(spark, grid_file, out, "r")
    raw = str(tmp_path / "stored_usage")
    sinks.write_table(usage.read_typed_usage(spark, usage_files), raw)
    base = run_processing(spark, spark.read.parquet(raw), reference, out, "r")
    assert scans_of(spark, raw) == 1
    assert [scans_of(spark, f"{base}/{layer}") for layer in ("clean", "hourly", "analytics", "report")] == [1, 1, 0, 0]
    counts = sinks.latest_status(spark, f"{out}/status", "processing")["counts"]
    stored = {name: spark.read.parquet(f"{base}/{name}") for name in ("report", "clean", "hourly", "analytics")}
    assert counts["rows_published"] == stored["analytics"].count() and counts["rows_in"] == stored["report"].first()["rows_in"]
    rules = quality_gate(stored["report"], stored["clean"], stored["hourly"], stored["analytics"])
    assert rules.where("NOT passed").isEmpty()


def test_a_report_that_was_counted_twice_is_counted_again(spark, tmp_path, usage_files, grid_file):
    reference, _ = daily.stored_reference(spark, grid_file, str(tmp_path), "r")
    rows = usage.read_typed_usage(spark, usage_files)

    def store(name, df, by, aggregates):
        table, counts = sinks.counted_table(df, str(tmp_path / name), aggregates, by)
        return table, counts | {"rows": counts["rows"] - 5} if name == "clean" else counts

    layers = daily.gated_layers(rows, reference, store)
    assert layers.counts["flow"] == {"rows_in": 192, "rows_rejected": 0, "nulls_handled": layers.counts["flow"]["nulls_handled"], "rows_out": 192}


def test_batch_refuses_reordered_headers_and_survives_without_rows(spark, tmp_path, usage_files):
    folder = tmp_path / "odd"
    folder.mkdir()
    (folder / "sms-call-internet-mi-2013-11-01.csv").write_text(HEADER.replace("smsin,smsout", "smsout,smsin") + "\n2013-11-01 00:00:00,1,39,100,,1,,1\n")
    with pytest.raises(Exception, match="header does not conform"):
        run_batch(spark, str(folder), str(tmp_path / "bad"))
    (folder / "sms-call-internet-mi-2013-11-01.csv").write_text(HEADER + "\n,1,39,100,,1,,1\n")
    out = run_batch(spark, str(folder), str(tmp_path / "none"))
    assert spark.read.parquet(f"{out}/daily_summary").count() == 0


def test_batch_run_exports_per_file_and_combined(spark, tmp_path, usage_files):
    out = run_batch(spark, usage_files, str(tmp_path / "batch"))
    profile = spark.read.parquet(f"{out}/profiling_summary").orderBy("source").collect()
    assert len(profile) == 2
    assert profile[0].cadence_ok and profile[0].max_country_rows_per_grid_hour == 2
    assert (profile[0].busiest_hour, profile[0].busiest_grid_id, profile[0].sms_out_nulls) == (12, 2, 96)
    assert (profile[0].rows_with_missing_activity_filled, profile[0].rows_dropped_duplicates) == (96, 0)
    assert spark.read.parquet(f"{out}/daily_summary").count() == 2
    assert spark.read.parquet(f"{out}/grid_summary").count() == 2
    assert spark.read.parquet(f"{out}/grid_hour").count() == 96


def test_detection_bundle(spark, tmp_path, usage_files):
    from gridtide.operators.hourly import hourly_by_calendar

    hourly = hourly_by_calendar(clean.clean_usage(usage.read_typed_usage(spark, usage_files)).clean)
    stored = str(tmp_path / "hourly")
    sinks.write_table(hourly, stored)
    hourly = spark.read.parquet(stored)
    for fmt in ("json", "csv"):
        marks = str(tmp_path / f"marks_{fmt}")
        files = run_detection(spark, hourly, str(tmp_path / f"bundle_{fmt}"), "2024-01-01T00:00:00", fmt, marks=marks, run_id="r")
        manifest = json.loads(spark.read.text(files["manifest"]).first().value)
        assert manifest["schema_version"] == "1.0" and manifest["total_grid_hours"] == 96
        assert manifest["files"]["alerts"] == f"network_alerts.{fmt}"
        summary = spark.read.json(files["summary"]).first()
        assert summary.total_alert_records == manifest["total_alerts"] > 0
        assert sum(summary.alerts_by_type.asDict().values()) == summary.total_alert_records
        assert spark.read.text(files["limitations"]).count() > 3
    alerts = usage.read_alerts(spark, str(tmp_path / "bundle_json" / "network_alerts.json"))
    mark = spark.read.parquet(str(tmp_path / "marks_json")).first()
    assert (mark.layer, mark.rows, mark.latest) == ("alerts", alerts.count(), alerts.agg(F.max("timestamp")).first()[0])
    assert alerts.count() == manifest["total_alerts"] and dict(alerts.dtypes)["timestamp"] == "timestamp"
    with pytest.raises(ValueError, match="unsupported format"):
        sinks.write_alerts(alerts, str(tmp_path / "x"), "xml")
