"""Rule alerts over a stored hourly table, exported as a bundle."""

from pyspark.sql import Observation

from gridtide.operators.alerts import (
    DROP_MULTIPLIER,
    FLOOR_PERCENTILE,
    HIGH_MULTIPLIER,
    SPIKE_MULTIPLIER,
    activity_floor,
    detect_alerts,
)
from gridtide.sources.sinks import append_mark, taken, write_bundle

MULTIPLIERS = {
    "HIGH_ACTIVITY_MULTIPLIER": HIGH_MULTIPLIER,
    "DROP_ACTIVITY_MULTIPLIER": DROP_MULTIPLIER,
    "SPIKE_MULTIPLIER": SPIKE_MULTIPLIER,
}


def run_detection(spark, hourly, out, generated_at, fmt="json", percentile=FLOOR_PERCENTILE, totals=None,
                  marks=None, run_id=None):
    """Detect, export and summarise alerts over a stored hourly table.

    The floor is computed once, from `totals` (grid_id, date, total_activity) where the daily mart has them. Besides
    it the table is read once for the alerts and once, without columns, for their share of all rows. With a path of
    `marks` the latest alert is noted there, as the write has seen it.
    """
    floor = activity_floor(hourly, percentile, totals=totals)
    alerts = detect_alerts(hourly, percentile, floor=floor)
    seen = Observation() if marks else None
    files = write_bundle(spark, alerts, hourly, floor, out, MULTIPLIERS, percentile, generated_at, fmt, seen)
    if marks:
        append_mark(spark, marks, run_id, "alerts", taken(seen))
    return files
