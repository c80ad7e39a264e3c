"""The driver's tables in the shapes of the station data, and the same as SQL.

A station is a user of ``events``; an observation an event, its counts functions of ``value``; a trip leads from a user's
event to the next one, with blanks, junk, reversed times, missing ends and copies at fixed remainders of the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationlens.functions import rules
from stationlens.functions.rules import RuleConfig

#: Thresholds that fit the gaps between a user's events (hours, not minutes).
CONFIG = RuleConfig(persistence_seconds=12 * 3600, stale_after_seconds=180, priority_update_interval_seconds=24 * 3600)
SOURCE = "station_feed"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_observations(load(spark, sf_dir, "events"))


def as_observations(events: DataFrame) -> DataFrame:
    bikes = F.floor("value") % 13
    return events.select(
        F.col("user_id").cast("string").alias("station_id"), F.col("user_id").cast("string").alias("short_name"), "event_id", F.col("ts").cast("timestamp").alias("event_time"),
        bikes.alias("bikes"), (12 - bikes).alias("docks"), (F.col("event_id") * 7 % 200).alias("source_age_seconds"),
        (F.col("event_type") != "error").alias("in_service"), (F.col("event_id") % 23 != 0).alias("timely"), F.col("event_id").alias("input_offset"), "event_type",
    )


OBSERVATIONS = """obs AS (SELECT CAST(user_id AS VARCHAR) AS station_id, event_id, ts AS event_time, CAST(floor(value) AS BIGINT) % 13 AS bikes, 12 - CAST(floor(value) AS BIGINT) % 13 AS docks,
  event_id * 7 % 200 AS source_age_seconds, event_type <> 'error' AS in_service, event_id % 23 <> 0 AS timely, event_type FROM events)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    risk = rules.risk(F.col("bikes"), F.col("docks"), stale=rules.is_stale(F.col("source_age_seconds"), None, CONFIG), offline=~F.col("in_service"), doubtful=~F.col("timely"), cfg=CONFIG)
    return o.withColumn("risk", risk)


STATES = (
    OBSERVATIONS
    + """, st AS (SELECT *, CASE WHEN source_age_seconds > 180 THEN 'STALE' WHEN NOT in_service THEN 'OFFLINE' WHEN NOT timely OR (bikes = 0 AND docks = 0) THEN 'DATA_QUALITY' WHEN bikes = 0 THEN 'EMPTY'
  WHEN docks = 0 THEN 'FULL' WHEN bikes <= 2 THEN 'LOW_BIKES' WHEN docks <= 2 THEN 'LOW_DOCKS' ELSE 'BALANCED' END AS risk FROM obs)"""
)


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf_dir, "events").select("event_id", "ts", F.lead("ts").over(w).alias("te"), F.lead("event_id").over(w).alias("e2")).filter("te IS NOT NULL")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
    turned = F.col("event_id") % 19 == 0
    station = lambda c: F.concat(F.lit("s"), (F.col(c) % 40).cast("string"))
    name = lambda c: F.concat(F.lit("Station "), (F.col(c) % 40).cast("string"))
    trips = e.select(
        F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.concat(F.lit("r"), F.col("event_id").cast("string"))).alias("ride_id"),
        F.lit("classic").alias("rideable_type"),
        F.when(F.col("event_id") % 31 == 0, "bad").otherwise(text(F.when(turned, F.col("te")).otherwise(F.col("ts")))).alias("started_at"),
        text(F.when(turned, F.col("ts")).otherwise(F.col("te"))).alias("ended_at"),
        F.when(F.col("event_id") % 13 != 0, name("event_id")).alias("start_station_name"), F.when(F.col("event_id") % 13 != 0, station("event_id")).alias("start_station_id"),
        F.when(F.col("e2") % 17 != 0, name("e2")).otherwise("").alias("end_station_name"), F.when(F.col("e2") % 17 != 0, station("e2")).otherwise("").alias("end_station_id"),
        F.when(F.col("event_id") % 29 == 0, "junk").otherwise((40 + F.col("event_id") % 60).cast("string")).alias("start_lat"), F.lit("-73.9").alias("start_lng"),
        F.lit("40.7").alias("end_lat"), F.lit("-74.0").alias("end_lng"), F.lit("member").alias("member_casual"),
        F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string"), F.lit(".csv")).alias("_source_file"), F.lit("modern").alias("_source_schema_variant"), "event_id",
    )
    return trips.unionByName(trips.filter("event_id % 10 = 0").withColumn("_source_file", F.lit("f9.csv"))).drop("event_id")


RAW_TRIPS = """lead_events AS (SELECT event_id, ts, lead(ts) OVER w AS te, lead(event_id) OVER w AS e2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
one AS (SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'r' || event_id END AS ride0,
  CASE WHEN event_id % 31 = 0 THEN 'bad' ELSE strftime(CASE WHEN event_id % 19 = 0 THEN te ELSE ts END, '%Y-%m-%d %H:%M:%S.%g') END AS started_at,
  strftime(CASE WHEN event_id % 19 = 0 THEN ts ELSE te END, '%Y-%m-%d %H:%M:%S.%g') AS ended_at,
  CASE WHEN event_id % 13 <> 0 THEN 'Station ' || (event_id % 40) END AS start_station_name, CASE WHEN event_id % 13 <> 0 THEN 's' || (event_id % 40) END AS start_station_id,
  CASE WHEN e2 % 17 <> 0 THEN 'Station ' || (e2 % 40) END AS end_station_name, CASE WHEN e2 % 17 <> 0 THEN 's' || (e2 % 40) END AS end_station_id,
  CASE WHEN event_id % 29 <> 0 THEN 40.0 + event_id % 60 END AS start_lat, event_id, 'f' || (event_id % 3) || '.csv' AS _source_file FROM lead_events WHERE te IS NOT NULL),
raw AS (SELECT * FROM one UNION ALL SELECT * REPLACE ('f9.csv' AS _source_file) FROM one WHERE event_id % 10 = 0),
timed AS (SELECT *, TRY_CAST(started_at AS TIMESTAMP) AS ls, TRY_CAST(ended_at AS TIMESTAMP) AS le,
  coalesce(ride0, sha256(concat_ws('|', started_at, ended_at, coalesce(start_station_id, '<null>'), coalesce(end_station_id, '<null>'), coalesce(start_station_name, '<null>'), coalesce(end_station_name, '<null>')))) AS ride_id FROM raw),
utc AS (SELECT *, (ls AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS us, (le AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS ue FROM timed),
lasted AS (SELECT *, (epoch_us(ue) - epoch_us(us)) / 1e6 AS duration_seconds FROM utc),
norm AS (SELECT *, us IS NULL OR ue IS NULL AS no_time, coalesce(duration_seconds <= 0, true) AS no_length FROM lasted),
trips AS (SELECT *, concat_ws('|', CASE WHEN no_time THEN 'TIMESTAMP_INVALID' END, CASE WHEN no_length THEN 'DURATION_NONPOSITIVE' END, CASE WHEN duration_seconds > 86400 THEN 'DURATION_OVER_24H' END,
  CASE WHEN start_station_id IS NULL THEN 'START_STATION_MISSING' END, CASE WHEN end_station_id IS NULL THEN 'END_STATION_MISSING' END, CASE WHEN start_lat IS NULL OR start_lat > 90 THEN 'COORDINATE_MISSING_OR_INVALID' END) AS flags,
  NOT no_time AND NOT no_length AND NOT (start_station_id IS NULL AND end_station_id IS NULL) AS valid FROM norm),
silver AS (SELECT * FROM trips QUALIFY row_number() OVER (PARTITION BY ride_id ORDER BY _source_file, started_at, ended_at) = 1),
ends AS (SELECT start_station_id AS station_id, start_station_name AS station_name, CAST(ls AS DATE) AS local_date, CAST(isodow(ls) AS INTEGER) AS iso_weekday, CAST(hour(ls) AS INTEGER) AS local_hour, 1 AS p, 0 AS d FROM silver WHERE valid AND start_station_id IS NOT NULL
  UNION ALL SELECT end_station_id, end_station_name, CAST(le AS DATE), CAST(isodow(le) AS INTEGER), CAST(hour(le) AS INTEGER), 0, 1 FROM silver WHERE valid AND end_station_id IS NOT NULL),
hourly AS (SELECT station_id, local_date, iso_weekday, local_hour, min(station_name) AS station_name, CAST(sum(p) AS BIGINT) AS pickup_count, CAST(sum(d) AS BIGINT) AS dropoff_count FROM ends GROUP BY ALL),
days AS (SELECT CAST(unnest(generate_series(min(CAST(ls AS DATE)), max(CAST(ls AS DATE)), INTERVAL 1 DAY)) AS DATE) AS local_date FROM silver WHERE valid),
hours AS (SELECT local_date, CAST(isodow(local_date) AS INTEGER) AS iso_weekday, CAST(h AS INTEGER) AS local_hour FROM days, generate_series(0, 23) AS g(h)),
stations AS (SELECT station_id, min(station_name) AS station_name FROM hourly GROUP BY 1),
dense AS (SELECT s.station_id, s.station_name, c.iso_weekday, c.local_hour, coalesce(x.pickup_count, 0) AS p, coalesce(x.dropoff_count, 0) AS d FROM stations s CROSS JOIN hours c
  LEFT JOIN hourly x ON x.station_id = s.station_id AND x.local_date = c.local_date AND x.local_hour = c.local_hour),
baseline AS (SELECT station_id, iso_weekday, local_hour, min(station_name) AS station_name, CAST(count(*) AS INTEGER) AS calendar_days, round(avg(p), 3) AS avg_pickups, CAST(quantile_disc(p, 0.5) AS BIGINT) AS p50_pickups, CAST(quantile_disc(p, 0.95) AS BIGINT) AS p95_pickups,
  round(avg(d), 3) AS avg_dropoffs, CAST(quantile_disc(d, 0.5) AS BIGINT) AS p50_dropoffs, CAST(quantile_disc(d, 0.95) AS BIGINT) AS p95_dropoffs FROM dense GROUP BY 1, 2, 3)"""


EPISODES = (
    STATES
    + """, lagged AS (SELECT *, lag(risk) OVER w AS pr, lag(bikes) OVER w AS pb, lag(docks) OVER w AS pd FROM st WINDOW w AS (PARTITION BY station_id ORDER BY event_time, event_id)),
trended AS (SELECT *, CASE WHEN risk IN ('EMPTY', 'LOW_BIKES') AND pb IS NOT NULL THEN round(100.0 * greatest(0, pb - bikes) / greatest(pb, 1), 2)
  WHEN risk IN ('FULL', 'LOW_DOCKS') AND pd IS NOT NULL THEN round(100.0 * greatest(0, pd - docks) / greatest(pd, 1), 2) ELSE 0.0 END AS trend FROM lagged),
runs AS (SELECT *, sum(CASE WHEN pr IS NULL OR pr <> risk THEN 1 ELSE 0 END) OVER (PARTITION BY station_id ORDER BY event_time, event_id) AS run FROM trended),
began AS (SELECT *, min(event_time) OVER (PARTITION BY station_id, run) AS t0 FROM runs),
grouped AS (SELECT station_id, run, min(risk) AS risk, min(event_time) AS started_at, max(event_time) AS last_seen_at, count(*) AS observations,
  min(CASE WHEN floor(epoch(event_time)) - floor(epoch(t0)) >= 43200 THEN event_time END) AS opened_at, first(trend ORDER BY event_time, event_id) AS trend FROM began GROUP BY 1, 2),
followed AS (SELECT *, lead(started_at) OVER (PARTITION BY station_id ORDER BY run) AS nxt FROM grouped),
episodes AS (SELECT station_id, risk, started_at, last_seen_at, observations, opened_at, CASE WHEN opened_at IS NOT NULL THEN nxt END AS resolved_at, trend,
  sha256(concat_ws('|', 'station_feed', station_id, risk, strftime(started_at, '%Y-%m-%dT%H:%M:%SZ'))) AS alert_id FROM followed WHERE risk <> 'BALANCED'),
life0 AS (SELECT station_id, alert_id, risk, started_at, 'ALERT_OPENED' AS event_type, 'OPEN' AS lifecycle_status, opened_at AS event_time FROM episodes WHERE opened_at IS NOT NULL
  UNION ALL SELECT station_id, alert_id, risk, started_at, 'ALERT_RESOLVED', 'RESOLVED', resolved_at FROM episodes WHERE opened_at IS NOT NULL AND resolved_at IS NOT NULL),
life AS (SELECT *, sha256(concat_ws('|', alert_id, event_type, strftime(event_time, '%Y-%m-%dT%H:%M:%SZ'))) AS alert_event_id FROM life0)"""
)
