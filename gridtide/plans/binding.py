"""Binding of generic event and order tables to the usage model, with the same binding as SQL.

An event is one usage record: its type decides which measure its value belongs to, its user or the
zone of its country code is the cell. Orders, customers and line items stand in for other inputs.
"""

from pyspark.sql import functions as F

from gridtide.functions.columns import lattice_x, lattice_y
from gridtide.operators.clean import clean_usage
from gridtide.operators.hourly import hourly_by_cell
from gridtide.operators.warehouse import dim_time, fact_activity
from gridtide.schemas import MEASURES, RAW_TO_CANONICAL

# Event type carrying each measure.
MEASURE_EVENTS = {
    "sms_in": "click",
    "sms_out": "view",
    "call_in": "purchase",
    "call_out": "signup",
    "internet": "error",
}
WIDTH = 10
ZONE_CODES = 34
SCALE = 2


def rounded(df, digits=4):
    """Round every double column, so that results do not depend on summation order."""
    names = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({name: F.round(name, digits) for name in names}) if names else df


class Tables:
    """Frames derived from one folder of Parquet tables."""

    def __init__(self, spark, folder):
        self.spark = spark
        self.folder = folder

    def read(self, name):
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def usage(self, cells="user"):
        """Usage records; cells are users, or the three zones of country codes."""
        code = F.get_json_object("props", "$.k").try_cast("int")
        zone = F.floor(code / F.lit(ZONE_CODES)).cast("long")
        cell = F.col("user_id") if cells == "user" else zone
        return self.read("events").select(
            F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp"),
            (cell + 1).alias("grid_id"),
            code.alias("country_code"),
            *[F.when(F.col("event_type") == kind, F.col("value")).alias(name) for name, kind in MEASURE_EVENTS.items()],
        )

    def dirty_usage(self):
        """Usage with measures shifted below zero and missing cells and times."""
        usage = self.usage()
        code = F.col("country_code")
        return usage.withColumns(
            {
                "grid_id": F.when(code != 0, F.col("grid_id")),
                "timestamp": F.when(code != 1, F.col("timestamp")),
                **{name: F.col(name) - 50 for name in MEASURES},
            }
        )

    def raw_text(self):
        """Usage under the raw file header with every cell as text, some of them malformed."""
        usage = self.usage()
        code = F.col("country_code")
        columns = {
            "datetime": F.when(code == 1, "not a time").otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")),
            "CellID": F.when(code == 0, "cell?").otherwise(F.col("grid_id").cast("string")),
            "countrycode": code.cast("string"),
        }
        for raw, name in RAW_TO_CANONICAL.items():
            if name in MEASURES:
                text = F.format_string("%.2f", name)
                columns[raw] = F.when(F.col(name).isNotNull(), F.when(code == 2, "n/a").otherwise(text))
        return usage.select(*[value.alias(name) for name, value in columns.items()])

    def raw(self):
        """Usage under the raw file header, typed, with the source day as file name."""
        usage = self.usage()
        names = {name: raw for raw, name in RAW_TO_CANONICAL.items()}
        text = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
        day = F.concat(F.lit("usage-"), F.to_date("timestamp").cast("string"))
        return usage.withColumn("source", day).withColumn("timestamp", text).withColumnsRenamed(names)

    def clean(self, cells="user"):
        return clean_usage(self.usage(cells)).clean

    def hourly(self, cells="user"):
        return hourly_by_cell(self.clean(cells), SCALE)

    def shipments(self):
        """Usage from line items: parts are cells, the ship date is the time."""
        return self.read("lineitem").select(
            F.col("l_shipdate").cast("timestamp").alias("timestamp"),
            F.col("l_partkey").alias("grid_id"),
            F.col("l_linenumber").alias("country_code"),
            F.col("l_quantity").alias("sms_in"),
            F.col("l_discount").alias("sms_out"),
            F.col("l_tax").alias("call_in"),
            F.lit(0.0).alias("call_out"),
            F.col("l_extendedprice").alias("internet"),
        )

    def shipments_hourly(self):
        return hourly_by_cell(self.shipments(), SCALE)

    def cells(self):
        """Cell dimension from all customers, placed on a lattice."""
        cell = F.col("c_custkey") + 1
        x, y = lattice_x(cell, WIDTH), lattice_y(cell, WIDTH)
        return self.read("customer").select(
            cell.alias("grid_id"),
            (F.lit(45.0) + y * 0.002).alias("centroid_latitude"),
            (F.lit(9.0) + x * 0.003).alias("centroid_longitude"),
        )

    def geometry(self):
        """Cell geometry as text, keyed by cell; NULL where the balance is negative."""
        cell = F.col("c_custkey") + 1
        place = F.concat(
            F.lit('{"type":"Point","coordinates":['),
            lattice_x(cell, WIDTH).cast("string"),
            F.lit(","),
            lattice_y(cell, WIDTH).cast("string"),
            F.lit("]}"),
        )
        shape = F.when(F.col("c_acctbal") >= 0, place)
        return self.read("customer").select(cell.alias("grid_id"), shape.alias("geometry"))

    def points(self):
        """Customers as points of an almost regular lattice."""
        cell = F.col("c_custkey") + 1
        x, y = lattice_x(cell, WIDTH), lattice_y(cell, WIDTH)
        return self.read("customer").select(
            cell.alias("grid_id"),
            (x.cast("double") + F.col("c_acctbal") * 1e-6).alias("x"),
            y.cast("double").alias("y"),
        )

    def times(self, cells="user"):
        return dim_time(self.hourly(cells))

    def fact(self, cells="user"):
        return fact_activity(self.hourly(cells), self.times(cells))


def _measure_sql(pattern, names=MEASURES):
    return ", ".join(pattern.format(name=name) for name in names)


_EVENT_CASES = ", ".join(
    f"CASE WHEN event_type = '{kind}' THEN value END AS {name}" for name, kind in MEASURE_EVENTS.items()
)
_CODE = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def usage_sql(cells="user"):
    cell = "user_id + 1" if cells == "user" else f"CAST({_CODE} // {ZONE_CODES} AS BIGINT) + 1"
    return (
        f"usage AS (SELECT date_trunc('hour', ts) AS timestamp, {cell} AS grid_id, "
        f"{_CODE} AS country_code, {_EVENT_CASES} FROM events)"
    )


CALENDAR_SQL = (
    "CAST(timestamp AS DATE) AS date, CAST(hour(timestamp) AS INTEGER) AS hour, "
    "CAST(dayofweek(timestamp) + 1 AS INTEGER) AS day_of_week"
)
_FILLED = _measure_sql("coalesce({name}, CAST(0 AS DOUBLE)) AS {name}")
CLEAN_SQL = f"clean AS (SELECT timestamp, grid_id, country_code, {_FILLED}, {CALENDAR_SQL} FROM usage)"


def fixed_sum_sql(name):
    return f"CAST(sum(CAST(round({name} * 100) AS BIGINT)) AS DOUBLE) / 100"


def hourly_sql(source="clean"):
    sums = ", ".join(
        f"{fixed_sum_sql(name)} AS {'internet_activity' if name == 'internet' else name}" for name in MEASURES
    )
    return (
        f"sums AS (SELECT grid_id, timestamp, {sums} FROM {source} GROUP BY 1, 2), "
        "totals AS (SELECT *, sms_in + sms_out AS total_sms, call_in + call_out AS total_calls FROM sums), "
        "hourly AS (SELECT *, total_sms + total_calls + internet_activity AS total_activity, "
        f"{CALENDAR_SQL} FROM totals)"
    )


def with_hourly(cells="user"):
    return f"WITH {usage_sql(cells)}, {CLEAN_SQL}, {hourly_sql()}"


DIRTY_SQL = (
    "dirty AS (SELECT CASE WHEN country_code <> 1 THEN timestamp END AS timestamp, "
    "CASE WHEN country_code <> 0 THEN grid_id END AS grid_id, country_code, "
    + _measure_sql("{name} - 50 AS {name}")
    + " FROM usage)"
)

SHIPMENTS_SQL = (
    "shipments AS (SELECT l_shipdate AS timestamp, l_partkey AS grid_id, l_linenumber AS country_code, "
    "l_quantity AS sms_in, l_discount AS sms_out, l_tax AS call_in, CAST(0 AS DOUBLE) AS call_out, "
    "l_extendedprice AS internet FROM lineitem)"
)


def with_shipments_hourly():
    return f"WITH {SHIPMENTS_SQL}, {hourly_sql('shipments')}"


CELLS_SQL = (
    f"cells AS (SELECT c_custkey + 1 AS grid_id, 45.0::DOUBLE + CAST(c_custkey // {WIDTH} AS DOUBLE) * 0.002 "
    f"AS centroid_latitude, 9.0::DOUBLE + CAST(c_custkey % {WIDTH} AS DOUBLE) * 0.003 AS centroid_longitude "
    "FROM customer)"
)
GEOMETRY_SQL = (
    "geometry AS (SELECT c_custkey + 1 AS grid_id, CASE WHEN c_acctbal >= 0 THEN '{\"type\":\"Point\",\"coordinates\":[' || "
    f"CAST(c_custkey % {WIDTH} AS VARCHAR) || ',' || CAST(c_custkey // {WIDTH} AS VARCHAR) || ']}}' "
    "END AS geometry FROM customer)"
)
TIMES_SQL = (
    "times AS (SELECT CAST(row_number() OVER (ORDER BY timestamp) AS INTEGER) AS time_key, timestamp, "
    "CAST(timestamp AS DATE) AS date, CAST(year(timestamp) AS INTEGER) AS year, "
    "CAST(month(timestamp) AS INTEGER) AS month, CAST(day(timestamp) AS INTEGER) AS day, "
    "CAST(hour(timestamp) AS INTEGER) AS hour, CAST(dayofweek(timestamp) + 1 AS INTEGER) AS day_of_week, "
    "dayname(timestamp) AS day_name FROM (SELECT DISTINCT timestamp FROM hourly))"
)
FACT_SQL = (
    "fact AS (SELECT t.time_key, h.grid_id, h.sms_in, h.sms_out, h.call_in, h.call_out, h.internet_activity, "
    "h.total_sms, h.total_calls, h.total_activity FROM hourly h JOIN times t USING (timestamp))"
)
