"""Registered queries over feeds, contracts, stored tables and service metrics, each with SQL for the same rows."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlens.functions.contracts import ALERT, alert_errors, parse_current_states, request_errors
from stationlens.functions.expr import utc_text
from stationlens.operators import episodes as ep
from stationlens.operators import materialize as mt
from stationlens.operators import observations as ob
from stationlens.operators import quality as qa
from stationlens.operators import serving as sv
from stationlens.operators import trips as tr
from stationlens.plans.catalog import _ARRIVALS_SQL, _LATEST_SQL, _LIFE, _REQUESTS_SQL, _SCORED_SQL, _STATE_SQL, _alert_state, _arrivals, _episodes, _priority_columns, _records, _requests, _scored, _state_documents, plain, query
from stationlens.plans.standin import CONFIG, EPISODES, OBSERVATIONS, RAW_TRIPS, SOURCE, load, observations, raw_trips
from stationlens.session import work_dir
from stationlens.sources.store import Store
from stationlens.sources.streams import file_records, topic_spans
from stationlens.sources.trips import TRIP_COLUMNS, read_trips, write_tables
from stationlens.streaming import jobs

# ---------------------------------------------------------------- feeds


def _n():
    return F.col("event_id")


def _status_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed's status rows: of each station and day the last event; a snapshot at the end of the day."""
    e = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    last = e.groupBy("user_id", "day").agg(F.max_by(F.struct("event_id", "value", "event_type"), "event_id").alias("e")).select("user_id", "day", "e.*")
    updated = F.unix_timestamp(F.col("day").cast("timestamp")) + 86400
    observed = updated + F.dayofmonth("day") % 7 * 60
    bikes = F.floor("value") % 13
    reported = F.when(_n() % 9 == 1, F.lit(86400)).when(_n() % 9 == 2, F.lit(1000)).when(_n() % 9 == 3, observed + 301).when(_n() % 9 != 0, observed - _n() * 7 % 200).cast("bigint")
    return last.select(
        updated.alias("last_updated"), observed.alias("observed"), F.col("user_id").cast("string").alias("station_id"), bikes.alias("num_bikes_available"), (_n() % 2).alias("num_bikes_disabled"), (12 - bikes).alias("num_docks_available"),
        F.lit(0).cast("bigint").alias("num_docks_disabled"), F.lit(1).alias("is_installed"), (F.col("event_type") != "error").cast("int").alias("is_renting"), F.lit(1).alias("is_returning"), reported.alias("last_reported"),
    )


def _information(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    return load(spark, sf_dir, "customer").filter(n % 7 != 0).select(n.cast("string").alias("station_id"), F.col("c_name").alias("short_name"), F.col("c_name").alias("name"), F.lit(40.7).alias("lat"), F.lit(-74.0).alias("lon"), F.when(n % 11 != 0, 12 + n % 3).alias("capacity"))


_STATUS_SQL = """last_events AS (SELECT user_id, CAST(ts AS DATE) AS day, max(event_id) AS event_id FROM events GROUP BY 1, 2),
status0 AS (SELECT e.user_id, l.day, e.event_id, CAST(epoch(CAST(l.day AS TIMESTAMP)) AS BIGINT) + 86400 AS last_updated, CAST(floor(e.value) AS BIGINT) % 13 AS bikes, e.event_type FROM last_events l JOIN events e USING (event_id)),
status1 AS (SELECT *, last_updated + day(day) % 7 * 60 AS observed FROM status0),
status AS (SELECT *, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 86400 WHEN 2 THEN 1000 WHEN 3 THEN observed + 301 ELSE observed - event_id * 7 % 200 END AS reported, 12 + event_id % 2 AS total FROM status1),
information AS (SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN 12 + c_custkey % 3 END AS capacity FROM customer WHERE c_custkey % 7 <> 0)"""


@query(
    f"""WITH {_STATUS_SQL}, judged AS (SELECT s.*, i.c_custkey IS NOT NULL AS met, i.capacity, strftime(make_timestamp(last_updated * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS said,
CASE WHEN reported IS NULL THEN 'MISSING' WHEN reported = 86400 THEN 'SENTINEL' WHEN reported < 1450155600 THEN 'OUT_OF_RANGE' WHEN reported > observed + 300 THEN 'FUTURE' ELSE 'VALID' END AS worth FROM status s LEFT JOIN information i ON i.c_custkey = s.user_id),
aged AS (SELECT *, CASE WHEN worth = 'VALID' THEN greatest(0, observed - reported) END AS age FROM judged)
SELECT CAST(user_id AS VARCHAR) AS station_id, said AS snapshot_updated_at_utc, sha256(concat_ws('|', 'station_feed', CAST(user_id AS VARCHAR), said, bikes, event_id % 2, 12 - bikes, 0, 'True', CASE WHEN event_type <> 'error' THEN 'True' ELSE 'False' END, 'True', coalesce(CAST(reported AS VARCHAR), 'null'))) AS event_id,
CASE WHEN met THEN 'MATCHED_BY_STATION_ID' ELSE 'UNMATCHED' END AS metadata_match_status, worth AS timestamp_status, age AS source_age_seconds, CASE WHEN capacity IS NULL THEN 'NOT_EVALUATED' WHEN capacity = total THEN 'EXACT' ELSE 'MISMATCH' END AS capacity_consistency,
concat_ws('|', CASE WHEN worth <> 'VALID' THEN 'SOURCE_TIMESTAMP_' || worth END, CASE WHEN observed - last_updated > 180 OR age > 180 THEN 'SOURCE_STALE' END, CASE WHEN NOT met THEN 'METADATA_UNMATCHED' END, CASE WHEN capacity <> total THEN 'CAPACITY_MISMATCH' END) AS issue_codes FROM aged"""
)
def feed_normalize(spark, sf_dir):
    """Feed documents (a JSON text a snapshot) -> observations."""
    rows = _status_rows(spark, sf_dir)
    station = [c for c in rows.columns if c not in ("last_updated", "observed")]
    documents = rows.groupBy("last_updated", "observed").agg(F.collect_list(F.struct(*station)).alias("stations"))
    text = F.to_json(F.struct("last_updated", F.lit("2.3").alias("version"), F.lit(60).alias("ttl"), F.struct("stations").alias("data")))
    status = documents.select(text.alias("value"), F.timestamp_seconds("observed").alias("observed_at"), F.sha2(text, 256).alias("snapshot_sha256"), F.lit("2.3").alias("feed_version"))
    known = _information(spark, sf_dir).groupBy().agg(F.collect_list(F.struct("*")).alias("stations"))
    information = known.select(F.to_json(F.struct(F.lit(1).alias("last_updated"), F.struct("stations").alias("data"))).alias("value"))
    o = ob.normalize_snapshot(status, information, SOURCE)
    return plain(o.select("station.station_id", "time.snapshot_updated_at_utc", "event_id", "station.metadata_match_status", "quality.timestamp_status", "time.source_age_seconds", "quality.capacity_consistency", "quality.issue_codes"))


@query(
    f"""WITH {_STATUS_SQL}, x AS (SELECT s.*, i.c_custkey IS NOT NULL AS met, total - i.capacity AS delta, last_updated - reported AS age FROM status s LEFT JOIN information i ON i.c_custkey = s.user_id)
SELECT last_updated, count(*) AS stations, count(DISTINCT user_id) AS unique_ids, count(DISTINCT user_id) FILTER (NOT met) AS ids_without_information, (SELECT count(*) FROM information) - count(DISTINCT user_id) FILTER (met) AS information_without_status, count(*) FILTER (bikes = 0) AS empty, count(*) FILTER (bikes = 12) AS full,
count(*) FILTER (event_type = 'error') AS offline, count(*) FILTER (reported = 86400) AS sentinel, min(age) AS age_min, median(age) AS age_median, max(age) AS age_max, count(*) FILTER (age > 300) AS age_over_300, count(*) FILTER (age > 3600) AS age_over_3600, count(*) FILTER (delta = 0) AS capacity_exact, count(*) FILTER (delta <> 0) AS capacity_mismatch FROM x GROUP BY 1"""
)
def snapshot_profile(spark, sf_dir):
    return qa.snapshot_profile(_status_rows(spark, sf_dir), _information(spark, sf_dir))


@query(
    """WITH s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN ' ' ELSE c_name END AS short_name, CASE WHEN c_custkey % 10 <> 0 THEN 40.7 END AS lat, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 40 END AS capacity FROM customer)
SELECT count(*) AS station_rows, count(DISTINCT k) AS unique_ids, count(*) FILTER (trim(short_name) = '') AS missing_short_name, 0 AS missing_name, count(*) FILTER (lat IS NULL) AS missing_coordinate, count(*) FILTER (capacity IS NULL) AS missing_capacity, count(*) FILTER (capacity <= 0) AS nonpositive_capacity,
min(capacity) AS capacity_min, max(capacity) AS capacity_max, round(median(capacity), 3) AS capacity_median FROM s"""
)
def information_profile(spark, sf_dir):
    n = F.col("c_custkey")
    s = load(spark, sf_dir, "customer").select(n.cast("string").alias("station_id"), F.when(n % 6 == 0, " ").otherwise(F.col("c_name")).alias("short_name"), F.col("c_name").alias("name"), F.when(n % 10 != 0, 40.7).alias("lat"), F.lit(-74.0).alias("lon"), F.when(n % 7 != 0, n % 40).alias("capacity"))
    return qa.information_profile(s)


@query(
    f"""WITH {RAW_TRIPS}, t AS (SELECT start_station_id AS i, start_station_name AS n FROM raw WHERE start_station_id IS NOT NULL), m AS (SELECT i, i IN (SELECT 's' || x FROM range(30) r(x)) AS by_id, n IN (SELECT 'Station ' || (x + 5) FROM range(30) r(x)) AS by_name FROM t)
SELECT count(*) FILTER (by_id) AS by_id, count(*) FILTER (NOT by_id AND by_name) AS by_name_only, count(*) FILTER (NOT by_id AND NOT by_name) AS unmatched, count(DISTINCT i) FILTER (by_id) AS ids_matched, count(DISTINCT i) FILTER (NOT by_id) AS ids_unmatched FROM m"""
)
def station_matches(spark, sf_dir):
    stations = spark.range(30).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("short_name"), F.concat(F.lit("Station "), (F.col("id") + 5).cast("string")).alias("name"))
    return qa.station_matches(raw_trips(spark, sf_dir), stations, "start")


@query(f"WITH {RAW_TRIPS} SELECT _source_file, started_at, ended_at, start_station_id FROM raw ORDER BY _source_file, started_at, ended_at, start_station_id NULLS FIRST LIMIT 500")
def first_trips(spark, sf_dir):
    """A report's first 500 rows in a fixed order."""
    columns = ["_source_file", "started_at", "ended_at", "start_station_id"]
    return qa.first_rows(raw_trips(spark, sf_dir).select(*columns), 500, *columns)


@query(f"WITH {RAW_TRIPS} SELECT count(*) FILTER (year(ls) = 2024 AND month(ls) = 1) AS inside, count(*) FILTER (NOT (year(ls) = 2024 AND month(ls) = 1)) AS outside, count(*) FILTER (ls IS NULL) AS unknown FROM trips")
def outside_month(spark, sf_dir):
    return qa.outside_month(tr.normalize(raw_trips(spark, sf_dir)), "started_local_date", 2024, 1)


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 50")
def partitioned_scan(spark, sf_dir):
    """Events written by type and read back: the type prunes folders, the value reaches the scan."""
    path = f"{work_dir(spark)}/tables/by-type-{uuid.uuid4().hex}"
    load(spark, sf_dir, "events").repartition("event_type").sortWithinPartitions("value").write.partitionBy("event_type").parquet(path)
    return spark.read.parquet(path).filter("event_type = 'purchase' AND value > 50").select("event_id", "user_id", "value")


@query("SELECT 'events' AS topic, 0 AS partition, min(event_id) AS low, max(event_id) + 1 AS high, max(event_id) + 1 - min(event_id) AS records FROM events")
def topic_offsets(spark, sf_dir):
    return topic_spans(_records(spark, sf_dir))


_LEGACY = {"started_at": "Start Time", "ended_at": "Stop Time", "start_station_id": "Start Station ID", "start_station_name": "Start Station Name", "end_station_id": "End Station ID", "end_station_name": "End Station Name", "start_lat": "Start Station Latitude"}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}/{uuid.uuid4().hex}"


@query(
    f"""WITH {RAW_TRIPS} SELECT CASE WHEN _source_file = 'f2.csv' THEN 'legacy_aliases' ELSE 'modern' END AS variant, CASE WHEN _source_file <> 'f2.csv' THEN ride0 END AS ride_id, started_at, ended_at, nullif(start_station_id, '') AS start_station_id, nullif(end_station_id, '') AS end_station_id, nullif(end_station_name, '') AS end_station_name FROM raw"""
)
def trip_files(spark, sf_dir):
    """Trips written as CSV files with two kinds of header and read back as one table."""
    raw, path = raw_trips(spark, sf_dir), _folder(spark, "trip-files")
    raw.filter("_source_file <> 'f2.csv'").select(*list(TRIP_COLUMNS), F.lit("x").alias("more")).write.option("header", True).csv(f"{path}/modern")
    raw.filter("_source_file = 'f2.csv'").select(*(F.col(c).alias(h) for c, h in _LEGACY.items())).write.option("header", True).csv(f"{path}/legacy")
    return read_trips(spark, path).select(F.col("_source_schema_variant").alias("variant"), F.trim("ride_id").alias("ride_id"), "started_at", "ended_at", "start_station_id", "end_station_id", "end_station_name")


@query(f"WITH {RAW_TRIPS} SELECT station_id, local_date, local_hour, pickup_count, dropoff_count FROM hourly WHERE iso_weekday = 3 AND pickup_count > 0")
def trip_tables(spark, sf_dir):
    """The tables of a batch written by partitions and the hourly one read back: the weekday prunes folders."""
    path = _folder(spark, "trip-tables")
    write_tables(tr.trip_pipeline(raw_trips(spark, sf_dir)), path)
    return spark.read.parquet(f"{path}/hourly").filter("iso_weekday = 3 AND pickup_count > 0").select("station_id", "local_date", "local_hour", "pickup_count", "dropoff_count")


@query(f"WITH {OBSERVATIONS} SELECT station_id, date_trunc('millisecond', event_time) AS event_time, bikes, docks FROM obs QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY event_time DESC, event_id DESC) = 1")
def job_snapshot(spark, sf_dir):
    """Observation documents in files, through the station job into files, and the snapshot that is made of its states (to the millisecond)."""
    o, path = observations(spark, sf_dir), _folder(spark, "station-job")
    digest = F.sha2(_n().cast("string"), 256)
    document = F.struct(
        F.lit("1.0").alias("schema_version"), digest.alias("event_id"), F.lit("STATION_STATUS_OBSERVED").alias("event_type"), F.lit(SOURCE).alias("source_system"), F.struct("station_id", F.col("station_id").alias("short_name"), F.lit("MATCHED_BY_STATION_ID").alias("metadata_match_status")).alias("station"),
        F.struct(F.col("bikes").alias("bikes_available"), F.lit(0).alias("bikes_disabled"), F.col("docks").alias("docks_available"), F.lit(0).alias("docks_disabled")).alias("availability"), F.struct(*(F.lit(True).alias(c) for c in ("is_installed", "is_renting", "is_returning"))).alias("service"),
        F.struct(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("snapshot_updated_at_utc"), "source_age_seconds").alias("time"), F.struct(F.lit("2.3").alias("feed_version"), digest.alias("snapshot_sha256")).alias("source"),
        F.struct(F.lit("VALID").alias("timestamp_status"), F.lit("EXACT").alias("capacity_consistency"), F.array().cast("array<string>").alias("issue_codes")).alias("quality"),
    )
    o.select(F.to_json(document).alias("value")).write.text(f"{path}/in")
    stats = ", ".join(f"{s}_{d} double" for d in ("pickups", "dropoffs") for s in ("avg", "p50", "p95"))
    baseline = spark.createDataFrame([], f"station_id string, iso_weekday int, local_hour int, calendar_days int, {stats}")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        jobs.finish(jobs.station_job(file_records(spark, f"{path}/in", files_per_trigger=100_000), baseline, jobs.file_sink(f"{path}/out", f"{path}/checkpoints")))
    finally:
        spark.conf.set(provider, before)
    n = lambda f: F.get_json_object("current_state_json", f"$.availability.{f}").cast("bigint")
    return plain(jobs.current_snapshot(spark, f"{path}/out").select("station_id", "event_time", n("bikes_available").alias("bikes"), n("docks_available").alias("docks")))


# ---------------------------------------------------------------- contracts


@query(
    """SELECT event_id AS input_offset, concat_ws('|', CASE WHEN event_id % 7 = 0 THEN 'SCHEMA_VERSION_INVALID' END, CASE WHEN event_id % 11 = 0 THEN 'STATION_ID_INVALID' END, CASE WHEN event_id % 3 <> 0 AND event_id % 11 = 0 THEN 'KAFKA_KEY_STATION_MISMATCH' END, CASE WHEN event_id % 13 = 0 THEN 'EVENT_ID_INVALID' END,
CASE WHEN event_id % 17 = 0 THEN 'EVENT_TIME_INVALID' END, CASE WHEN event_id % 19 = 0 THEN 'AVAILABILITY_INVALID' END, CASE WHEN event_id % 23 = 0 THEN 'SERVICE_INVALID' END, CASE WHEN event_id % 29 = 0 THEN 'QUALITY_INVALID' END, CASE WHEN event_id % 31 = 0 THEN 'BASELINE_CONTEXT_MISSING' END) AS error_codes FROM events"""
)
def validate_states(spark, sf_dir):
    """Current-state records, some of them wrong in one way or another."""
    o = observations(spark, sf_dir)
    wrong = lambda k: _n() % k == 0
    document = F.to_json(
        F.struct(
            F.when(wrong(7), "9").otherwise("1.0").alias("schema_version"), F.when(wrong(11), "elsewhere").otherwise(F.col("station_id")).alias("station_id"), F.when(wrong(13), "x").otherwise(F.sha2(_n().cast("string"), 256)).alias("event_id"),
            F.when(wrong(17), "soon").otherwise(utc_text(F.col("event_time"))).alias("event_time_utc"), F.struct("station_id").alias("station"), F.struct(F.when(~wrong(19), F.col("bikes")).alias("bikes_available"), F.col("docks").alias("docks_available")).alias("availability"),
            F.struct(F.lit(True).alias("is_installed"), F.when(~wrong(23), F.lit(True)).alias("is_renting"), F.lit(True).alias("is_returning")).alias("service"), F.struct(F.when(~wrong(29), "VALID").alias("timestamp_status"), F.array().cast("array<string>").alias("issue_codes")).alias("quality"),
            F.when(~wrong(31), F.struct(F.lit(False).alias("found"))).alias("historical_demand"),
        )
    )
    origin = F.struct(F.lit("states").alias("topic"), F.lit(0).cast("bigint").alias("partition"), _n().alias("offset")).alias("origin")
    records = o.select(F.when(_n() % 3 != 0, F.col("station_id")).alias("key"), document.alias("body"), origin)
    return plain(parse_current_states(records).select("input_offset", "error_codes"))


@query(
    """WITH a AS (SELECT event_id AS n, CASE event_id % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'RESOLVED' WHEN 2 THEN 'ACKNOWLEDGED' END AS expected FROM events), b AS (SELECT *, CASE WHEN n % 7 = 0 THEN 'OPEN' ELSE coalesce(expected, 'OPEN') END AS st FROM a),
c AS (SELECT *, st = 'RESOLVED' AND n % 11 <> 0 OR st <> 'RESOLVED' AND n % 13 = 0 AS ended FROM b)
SELECT n AS event_id, concat_ws('|', CASE WHEN expected IS NULL THEN 'EVENT_TYPE_INVALID' END, CASE WHEN st <> expected THEN 'LIFECYCLE_STATUS_INVALID' END, CASE WHEN st = 'RESOLVED' AND (n % 23 = 0 OR NOT ended) THEN 'RESOLUTION_INVALID' END, CASE WHEN st <> 'RESOLVED' AND ended THEN 'RESOLVED_AT_UNEXPECTED' END,
CASE WHEN n % 17 = 0 THEN 'IDENTITY_INVALID' END, CASE WHEN n % 19 = 0 THEN 'EVIDENCE_INVALID' END, CASE WHEN n % 120 > 100 THEN 'SCORE_INVALID' END) AS error_codes FROM c"""
)
def validate_alerts(spark, sf_dir):
    """Alert events as JSON, some of which break a rule of the contract."""
    expected = F.when(_n() % 4 == 0, "OPEN").when(_n() % 4 == 1, "RESOLVED").when(_n() % 4 == 2, "ACKNOWLEDGED")
    kind = F.when(_n() % 4 == 0, "ALERT_OPENED").when(_n() % 4 == 1, "ALERT_RESOLVED").when(_n() % 4 == 2, "ALERT_ACKNOWLEDGED").otherwise("ALERT_LOST")
    status = F.when(_n() % 7 == 0, "OPEN").otherwise(F.coalesce(expected, F.lit("OPEN")))
    done = status == "RESOLVED"
    ended = (done & (_n() % 11 != 0)) | (~done & (_n() % 13 == 0))
    identity = F.sha2(_n().cast("string"), 256)
    document = F.struct(
        identity.alias("alert_event_id"), F.when(_n() % 17 == 0, "x").otherwise(identity).alias("alert_id"), kind.alias("event_type"), status.alias("lifecycle_status"), F.when(done & (_n() % 23 != 0), "NONE").otherwise("INSPECT_STATION").alias("recommended_action"), F.when(done, "INFO").otherwise("WARNING").alias("severity"),
        F.struct(F.when(ended, "2024-01-01T00:00:00Z").alias("resolved_at_utc")).alias("time"), F.struct(F.lit(0).alias("risk_duration_seconds"), F.when(_n() % 19 != 0, F.lit(1)).alias("bikes_available"), F.lit(1).alias("docks_available")).alias("evidence"), F.struct((_n() % 120).cast("double").alias("score")).alias("priority"),
    )
    alerts = load(spark, sf_dir, "events").select("event_id", F.from_json(F.to_json(document), ALERT).alias("a"))
    return plain(alerts.select("event_id", alert_errors(F.col("a")).alias("error_codes")))


_AT_TEXTS = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00", "2024-01-01T00:00:00+02:00", "soon"]


@query(
    """SELECT c_custkey, concat_ws('|', CASE WHEN c_custkey % 140 NOT BETWEEN 8 AND 128 THEN 'IDEMPOTENCY_KEY_INVALID' END, CASE WHEN c_custkey % 9 = 0 THEN 'REQUESTED_BY_INVALID' END, CASE WHEN c_custkey % 5 IN (1, 3) THEN 'ACKNOWLEDGED_AT_INVALID' END) AS error_codes FROM customer"""
)
def validate_requests(spark, sf_dir):
    n = F.col("c_custkey")
    at = F.get(F.array(*map(F.lit, _AT_TEXTS)), (n % 5).cast("int"))
    asked = load(spark, sf_dir, "customer").select(n, F.struct(F.repeat(F.lit("k"), (n % 140).cast("int")).alias("idempotency_key"), F.when(n % 9 == 0, "").otherwise(F.col("c_name")).alias("requested_by"), at.alias("acknowledged_at_utc")).alias("r"))
    return plain(asked.select("c_custkey", request_errors(F.col("r")).alias("error_codes")))


# ---------------------------------------------------------------- stored tables


def _in_two_batches(store: Store, merge, rows: DataFrame, half: int) -> None:
    """Merges the earlier rows, the later ones, and the later ones once more (which changes nothing)."""
    for batch, part in ((0, rows.filter(F.col("arrival.row") <= half)), (1, rows.filter(F.col("arrival.row") > half)), (1, rows.filter(F.col("arrival.row") > half))):
        if not store.seen("query", batch):
            store.commit(merge(part), "query", batch)


def _place(c: str):
    return F.struct(F.lit("").alias("name"), F.lit(0).cast("bigint").alias("block"), F.col(c).cast("bigint").alias("row")).alias("arrival")


@query(
    f"""WITH {_ARRIVALS_SQL} SELECT alert_id, CAST(max_by(arrival, arrival) AS VARCHAR) AS last_event_id, CASE WHEN bool_or(s = 'RESOLVED') THEN 'RESOLVED' WHEN bool_or(s = 'ACKNOWLEDGED') THEN 'ACKNOWLEDGED' ELSE max_by(s, arrival) END AS lifecycle_status, max_by(score, arrival) AS priority_score, min_by(t, arrival) AS detected_at,
max_by(t, arrival) AS status_changed_at, max_by(t, arrival) FILTER (s = 'RESOLVED') AS resolved_at, max_by(t, arrival) FILTER (s = 'ACKNOWLEDGED') AS acknowledged_at FROM passed GROUP BY 1"""
)
def stored_alerts(spark, sf_dir):
    """Alert events merged into stored tables in two batches, the second of them twice: the state as it is read back."""
    a = _arrivals(spark, sf_dir)
    rows = a.select(
        "alert_event_id", "alert_id", "station_id", F.lit("x").alias("station_name"), F.lit("x").alias("short_name"), F.lit("ALERT").alias("event_type"), "lifecycle_status", "alert_type", F.lit("NONE").alias("recommended_action"), "severity", "priority_score", F.col("detected_at").alias("episode_started_at"), "detected_at", F.col("detected_at").alias("last_observed_at"), "status_changed_at", "resolved_at",
        F.when(F.col("lifecycle_status") == "ACKNOWLEDGED", F.col("status_changed_at")).alias("acknowledged_at"), F.lit(None).cast("string").alias("acknowledged_by"), F.lit("{}").alias("payload"), F.lit("t").alias("source_topic"), F.lit(0).cast("bigint").alias("source_partition"), F.col("arrival").alias("source_offset"), _place("arrival"),
    )
    store = Store(spark, f"{work_dir(spark)}/stores/{uuid.uuid4().hex}")

    def merge(part: DataFrame) -> dict:
        new, folded = mt.merge_alerts(store.read("alert_events"), store.read("alert_state"), part)
        return {"alert_events": ("append", new.select(*store.read("alert_events").columns)), "alert_state": ("replace", folded)}

    _in_two_batches(store, merge, rows, 4000)
    state = store.read("alert_state").withColumn("priority_score", F.col("priority_score").cast("double"))
    return plain(state.select("alert_id", "last_event_id", "lifecycle_status", "priority_score", "detected_at", "status_changed_at", "resolved_at", "acknowledged_at"))


@query(f"WITH {OBSERVATIONS} SELECT station_id, CAST(event_id AS VARCHAR) AS event_id, event_time, bikes AS bikes_available FROM obs QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY event_time DESC, event_id) = 1")
def stored_stations(spark, sf_dir):
    """Current states merged into a stored table in two batches, the second of them twice."""
    o = observations(spark, sf_dir)
    rows = o.select(
        "station_id", F.col("event_id").cast("string").alias("event_id"), "event_time", F.lit("x").alias("station_name"), F.lit("x").alias("short_name"), F.col("bikes").alias("bikes_available"), F.col("docks").alias("docks_available"), F.lit(12).cast("bigint").alias("capacity"), "source_age_seconds",
        *(F.lit(True).alias(c) for c in ("is_installed", "is_renting", "is_returning")), F.lit("{}").alias("payload"), _place("event_id"),
    )
    store = Store(spark, f"{work_dir(spark)}/stores/{uuid.uuid4().hex}")
    _in_two_batches(store, lambda part: {"station_current": ("replace", mt.merge_stations(store.read("station_current"), part)[1])}, rows, 4000)
    return plain(store.read("station_current").select("station_id", "event_id", "event_time", "bikes_available"))


@query(
    f"""WITH {_SCORED_SQL} SELECT alert_id, alert_id AS last_event_id, station_id, CASE WHEN resolved_at IS NOT NULL THEN 'RESOLVED' ELSE 'OPEN' END AS lifecycle_status, CAST(round(raw_score, 2) AS DOUBLE) AS score, observations AS bikes_available, strftime(opened_at, '%Y-%m-%dT%H:%M:%SZ') AS detected_at_utc, strftime(resolved_at, '%Y-%m-%dT%H:%M:%SZ') AS resolved_at_utc,
CASE WHEN resolved_at IS NOT NULL THEN 'someone' END AS acknowledged_by FROM scored"""
)
def alert_documents(spark, sf_dir):
    """Stored alerts in the shape that readers get."""
    s = _scored(spark, sf_dir)
    payload = F.to_json(F.struct(F.struct(F.col("p.score").alias("score"), F.lit("1").alias("rule_version")).alias("priority"), F.struct(F.col("observations").alias("bikes_available")).alias("evidence")))
    state = s.select(
        "alert_id", F.col("alert_id").alias("last_event_id"), "station_id", F.lit("x").alias("station_name"), F.lit("x").alias("short_name"), F.col("risk").alias("alert_type"), F.when(F.col("resolved_at").isNotNull(), "RESOLVED").otherwise("OPEN").alias("lifecycle_status"),
        F.col("p.action").alias("recommended_action"), F.col("p.level").alias("severity"), F.col("started_at").alias("episode_started_at"), F.col("opened_at").alias("detected_at"), F.col("last_seen_at").alias("last_observed_at"), F.col("opened_at").alias("status_changed_at"), "resolved_at",
        F.col("resolved_at").alias("acknowledged_at"), F.lit("someone").alias("acknowledged_by"), payload.alias("payload"),
    )
    d = sv.alert_documents(state).select("document.*")
    return d.select("alert_id", "last_event_id", "station.station_id", "lifecycle_status", "priority.score", "evidence.bikes_available", "time.detected_at_utc", "time.resolved_at_utc", "acknowledgement.acknowledged_by")


@query(f"WITH {_ARRIVALS_SQL} SELECT alert_id, CAST(arrival AS VARCHAR) AS alert_event_id, t AS status_changed_at, CAST(score AS VARCHAR) AS payload FROM arr0 WHERE s = 'ACKNOWLEDGED' QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY t DESC, CAST(arrival AS VARCHAR) DESC) = 1")
def latest_acknowledgements(spark, sf_dir):
    events = _arrivals(spark, sf_dir).withColumns({"event_type": F.concat(F.lit("ALERT_"), "lifecycle_status"), "payload": F.col("priority_score").cast("string")})
    return plain(sv.latest_acknowledgements(events))


@query("SELECT topic, CAST(sum(n) AS BIGINT) AS stored FROM (SELECT event_type AS topic, user_id % 3 AS p, max(event_id) + 1 AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def offsets_by_topic(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), (F.col("user_id") % 3).alias("partition"), F.col("event_id").alias("offset"))
    return sv.offsets_by_topic(sv.consumer_offsets(e))


@query(f"WITH {_SCORED_SQL} SELECT alert_id, risk = 'EMPTY' AS emptied, risk IN ('EMPTY', 'LOW_BIKES') AND c4 >= 60 AS rapid FROM scored")
def reason_checks(spark, sf_dir):
    s = _priority_columns(_scored(spark, sf_dir))
    return s.select("alert_id", sv.gives_all(F.col("reasons"), ["EMPTY_PERSISTED"]).alias("emptied"), sv.gives_all(F.col("reasons"), ["RAPID_OUTFLOW"]).alias("rapid"))


@query(f"WITH {EPISODES} SELECT {', '.join(_LIFE)} FROM life")
def replay_without_updates(spark, sf_dir):
    """The lifecycle machine in its older form, which opens and resolves alerts and sends nothing between."""
    return plain(ep.replay(_state_documents(observations(spark, sf_dir)), replace(CONFIG, send_updates=False), SOURCE).select(*_LIFE))


_FOUR_SQL = f"""{_STATE_SQL}, latest AS ({_LATEST_SQL}),
every AS (SELECT 'commands' AS t, 'key-' || c_custkey AS r FROM customer UNION ALL SELECT 'alert_events', alert_event_id FROM life UNION ALL SELECT 'alert_state', alert_id || '|' || lifecycle_status FROM alert_state UNION ALL SELECT 'station_current', station_id || '|' || event_id FROM latest),
level0 AS (SELECT sha256(t || '|' || r) AS h, row_number() OVER (ORDER BY t, r) AS n FROM every), level1 AS (SELECT (n - 1) // 1000 AS g, sha256(string_agg(h, chr(10) ORDER BY n)) AS h FROM level0 GROUP BY 1), level2 AS (SELECT sha256(string_agg(h, chr(10) ORDER BY g)) AS h FROM level1)"""


@query(
    f"""WITH {_FOUR_SQL} SELECT (SELECT count(*) FROM every WHERE t = 'alert_events') AS alert_events_rows, (SELECT count(*) FROM every WHERE t = 'alert_state') AS alert_state_rows, (SELECT count(*) FROM every WHERE t = 'commands') AS commands_rows, (SELECT count(*) FROM every WHERE t = 'station_current') AS station_current_rows, h AS fingerprint FROM level2"""
)
def business_fingerprint(spark, sf_dir):
    """One hash over four tables in the order of their keys."""
    tables = {
        "alert_events": (ep.lifecycle_events(_episodes(spark, sf_dir)), ["alert_event_id"]), "alert_state": (_alert_state(spark, sf_dir), ["alert_id", "lifecycle_status"]),
        "station_current": (ob.latest_state(observations(spark, sf_dir)), ["station_id", "event_id"]), "commands": (load(spark, sf_dir, "customer").select(F.concat(F.lit("key-"), F.col("c_custkey").cast("string")).alias("k")), ["k"]),
    }
    return qa.ordered_fingerprint(tables)


# ---------------------------------------------------------------- counters and metrics


@query(
    """WITH a AS (SELECT user_id, event_id, ts, event_id * 2 + CASE WHEN event_id % 8 = 0 THEN 1001.0 ELSE 0.0 END AS arrival FROM events), b AS (SELECT * FROM a UNION ALL SELECT user_id, event_id, ts, arrival + 7.5 FROM a WHERE event_id % 10 = 0),
c AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY arrival) > 1 AS again FROM b), d AS (SELECT *, max(CASE WHEN NOT again THEN ts END) OVER (PARTITION BY user_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c), e AS (SELECT *, NOT again AND coalesce(ts <= before, false) AS late FROM d)
SELECT count(*) AS received, count(*) FILTER (NOT again AND NOT late) AS processed, count(*) FILTER (again) AS duplicates, count(*) FILTER (late) AS out_of_order, count(*) FILTER (NOT again AND NOT late AND event_id % 9 = 0) AS quality_warnings FROM e"""
)
def engine_counters(spark, sf_dir):
    o = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", (_n() * 2 + F.when(_n() % 8 == 0, 1001.0).otherwise(0.0)).alias("arrival"))
    arrived = o.unionByName(o.filter(_n() % 10 == 0).withColumn("arrival", F.col("arrival") + 7.5))
    return qa.engine_counters(arrived, "user_id", "event_id", "ts", "arrival", _n() % 9 == 0)


_POLLS_SQL = """polls AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 = 0 THEN 'FAILED' WHEN event_id % 7 = 1 THEN 'DUPLICATE' ELSE 'PUBLISHED' END AS outcome, CASE WHEN event_id % 7 <> 0 THEN 'sha' || (event_id % 50) END AS sha FROM events)"""


@query(
    f"""WITH {_POLLS_SQL} SELECT count(*) AS poll_attempts_total, count(*) FILTER (outcome <> 'FAILED') AS poll_success_total, count(*) FILTER (outcome = 'FAILED') AS poll_failures_total, count(sha) AS snapshots_received_total, count(*) FILTER (outcome = 'PUBLISHED') AS snapshots_published_total, count(*) FILTER (outcome = 'DUPLICATE') AS duplicate_snapshots_total,
count(*) FILTER (event_id % 11 = 0) AS stale_snapshots_total, CAST(sum(event_id % 3) AS BIGINT) AS retry_attempts_total, count(*) FILTER (event_id % 5 = 0) AS metadata_refresh_total, 10 * count(*) FILTER (outcome = 'PUBLISHED') AS events_normalized_total, 9 * count(*) FILTER (outcome = 'PUBLISHED') AS events_published_total, count(*) FILTER (outcome = 'PUBLISHED') AS invalid_events_total,
(SELECT ts FROM polls WHERE outcome <> 'FAILED' ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_success_at, (SELECT ts FROM polls WHERE outcome <> 'FAILED' ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_snapshot_at, (SELECT sha FROM polls WHERE outcome <> 'FAILED' ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_snapshot_sha256,
(SELECT user_id FROM polls ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_poll_duration_ms, (SELECT CASE WHEN outcome = 'FAILED' THEN 'no answer' END FROM polls ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_error FROM polls"""
)
def collector_counters(spark, sf_dir):
    outcome = F.when(_n() % 7 == 0, "FAILED").when(_n() % 7 == 1, "DUPLICATE").otherwise("PUBLISHED")
    published = outcome == "PUBLISHED"
    at = F.col("ts").cast("timestamp")
    polls = load(spark, sf_dir, "events").select(
        _n().alias("poll_id"), at.alias("started_at"), outcome.alias("outcome"), F.when(_n() % 7 != 0, F.concat(F.lit("sha"), (_n() % 50).cast("string"))).alias("snapshot_sha256"), F.when(_n() % 7 != 0, at).alias("snapshot_at"), (_n() % 11 == 0).alias("stale"), (_n() % 3).alias("retries"), (_n() % 5 == 0).cast("bigint").alias("metadata_refreshed"),
        F.when(published, 10).otherwise(0).alias("events_normalized"), F.when(published, 9).otherwise(0).alias("events_published"), F.when(published, 1).otherwise(0).alias("invalid_events"), F.col("user_id").alias("duration_ms"), F.when(outcome == "FAILED", "no answer").alias("error"),
    )
    return plain(qa.poll_counters(polls))


_BOUNDS = qa.LATENCY_BUCKETS


def _quantile_sql() -> str:
    parts = []
    for i, b in enumerate(_BOUNDS):
        low, under = (f"CAST({_BOUNDS[i - 1]} AS DOUBLE)", f"c{i - 1}") if i else ("CAST(0 AS DOUBLE)", "0")
        parts.append(f"WHEN c{i} >= wanted THEN {low} + (CAST({b} AS DOUBLE) - {low}) * (wanted - {under}) / greatest(c{i} - {under}, 1)")
    return f"CASE {' '.join(parts)} ELSE {_BOUNDS[-1]} END"


@query(
    f"""WITH {_REQUESTS_SQL}, w AS (SELECT time_bucket(INTERVAL 5 MINUTE, at_time) AS window_start, count(*) AS n, count(*) FILTER (status >= 500) AS bad, count(*) * CAST(0.95 AS DOUBLE) AS wanted, {", ".join(f"count(*) FILTER (seconds <= {b}) AS c{i}" for i, b in enumerate(_BOUNDS))} FROM req GROUP BY 1)
SELECT window_start, round(n / 300.0, 6) AS request_rate, round((bad / 300.0) / greatest(n / 300.0, 0.001), 6) AS error_ratio, round({_quantile_sql()}, 6) AS latency_p95_seconds FROM w"""
)
def recording_rules(spark, sf_dir):
    return plain(qa.recording_rules(_requests(spark, sf_dir), "at", "seconds", F.col("status") >= 500))


_RULES = list(qa.ALERT_RULES.items())
_RULE_VALUES = ["bikes % 2", "bikes % 2", "bikes / 500.0", "bikes / 10.0", "bikes % 3", "source_age_seconds"]
_RULES_SQL = " UNION ALL ".join(f"SELECT station_id AS instance, '{name}' AS rule, '{severity}' AS severity, {seconds} AS wait, event_time AS t, coalesce(CAST({_RULE_VALUES[k]} AS DOUBLE) {'=' if op == '==' else op} {v}, false) AS holds FROM obs WHERE event_id % 6 = {k}" for k, (name, (_, op, v, seconds, severity)) in enumerate(_RULES))


@query(
    f"""WITH {OBSERVATIONS}, s AS ({_RULES_SQL}), x AS (SELECT *, sum(CASE WHEN holds THEN 0 ELSE 1 END) OVER (PARTITION BY instance, rule ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM s), y AS (SELECT *, min(t) OVER (PARTITION BY instance, rule, run) AS since FROM x WHERE holds)
SELECT instance, rule, severity, since AS held_since, min(t) AS fired_at FROM y WHERE floor(epoch(t)) - floor(epoch(since)) >= wait GROUP BY 1, 2, 3, 4"""
)
def alert_rules(spark, sf_dir):
    """The six alert rules over samples of their metrics."""
    metric = F.get(F.array(*(F.lit(r[0]) for _, r in _RULES)), (_n() % 6).cast("int"))
    value = F.get(F.array(*(F.expr(f"CAST({v} AS DOUBLE)") for v in _RULE_VALUES)), (_n() % 6).cast("int"))
    samples = observations(spark, sf_dir).select(F.col("station_id").alias("instance"), metric.alias("metric"), F.col("event_time").alias("at"), value.alias("value"))
    return plain(qa.evaluate_rules(samples))


@query(
    f"""WITH {_REQUESTS_SQL}, {OBSERVATIONS}, m AS (SELECT round(100.0 * count(*) FILTER (status < 500) / count(*), 4) AS success_percent, round(1000 * quantile_disc(seconds, 0.95), 3) AS p95_ms, round(count(*) / 600.0, 6) AS rate, (SELECT max(source_age_seconds) FROM obs) AS age FROM req),
c AS (SELECT 'success_percent' AS objective, CAST(success_percent AS DOUBLE) AS measured, 99.0 AS target, success_percent >= 99 AS met FROM m UNION ALL SELECT 'p95_ms', p95_ms, 500.0, p95_ms <= 500 FROM m UNION ALL SELECT 'requests_per_second', rate, 15.0, rate >= 15 FROM m UNION ALL SELECT 'source_age_seconds', age, 180.0, age <= 180 FROM m UNION ALL SELECT 'database_up', 1, 1.0, true)
SELECT objective, CAST(measured AS DOUBLE) AS measured, CAST(target AS DOUBLE) AS target, met, bool_and(met) OVER () AS all_met FROM c"""
)
def service_objectives(spark, sf_dir):
    """The service's five objectives and the gate that they make."""
    age = observations(spark, sf_dir).agg(F.max("source_age_seconds").alias("a"))
    summary = qa.latency_summary(_requests(spark, sf_dir), "seconds", F.col("status") < 500)
    measured = summary.select("success_percent", F.round(1000 * F.col("p95"), 3).alias("p95_ms"), F.round(F.col("requests") / 600.0, 6).alias("requests_per_second"), age.scalar().alias("source_age_seconds"), F.lit(1).alias("database_up"))
    return qa.objectives(measured, qa.SERVICE_OBJECTIVES)


@query(f"WITH {_REQUESTS_SQL} SELECT CAST(status AS VARCHAR) AS status, count(*) AS requests, round((SELECT count(*) FROM req) / 600.0, 2) AS requests_per_second FROM req GROUP BY 1")
def request_status(spark, sf_dir):
    return qa.status_counts(_requests(spark, sf_dir), "status", 600.0)


_GAUGES = {
    "serving_database_up": ("Whether the serving tables answered (1 or 0).", "database_up"),
    "active_alerts": ("Alerts that are not resolved.", "active_alerts"),
    "station_projection_rows": ("Stations with a current state.", "station_rows"),
    "critical_unacknowledged_alerts": ("Critical alerts that nobody has acknowledged.", "critical_unacknowledged_alerts"),
    "station_projection_age_seconds": ("Age of the newest current state.", "projection_age_seconds"),
    "station_source_age_seconds": ("Age that the feed reported and age of the state together.", "reported_source_age_seconds + projection_age_seconds"),
}
_PREFIX = "stationlens_api"
_TEXT = "regexp_replace(printf('%.6f', CAST({} AS DOUBLE)), '\\.?0+$', '')"
_TAGS = "'route=\"' || route || '\",status=\"' || status || '\"'"
_GAUGE_SQL = " UNION ALL ".join(
    f"SELECT {3 + k} AS section, unnest(['# HELP {_PREFIX}_{name} {text}', '# TYPE {_PREFIX}_{name} gauge', '{_PREFIX}_{name} ' || {_TEXT.format(value)}]) AS line FROM gauge" for k, (name, (text, value)) in enumerate(_GAUGES.items())
)


@query(
    f"""WITH {_REQUESTS_SQL}, {_STATE_SQL}, latest AS ({_LATEST_SQL}), gauge AS (SELECT 1 AS database_up, (SELECT count(*) FROM latest) AS station_rows, (SELECT count(*) FROM alert_state WHERE lifecycle_status <> 'RESOLVED') AS active_alerts, (SELECT count(*) FROM alert_state WHERE lifecycle_status = 'OPEN' AND severity = 'CRITICAL') AS critical_unacknowledged_alerts,
coalesce((SELECT max(source_age_seconds) FROM latest), 0) AS reported_source_age_seconds, (SELECT CAST(epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(event_time))) AS BIGINT) FROM latest) AS projection_age_seconds),
g AS (SELECT {_TAGS} AS tags, count(*) AS n, round(sum(seconds), 6) AS total FROM req GROUP BY 1), le(v, t) AS (VALUES {", ".join(f"({b}, '{f'{b:.6f}'.rstrip('0').rstrip('.')}')" for b in _BOUNDS)}, (1e308, '+Inf')),
b AS (SELECT {_TAGS} AS tags, t, count(*) FILTER (seconds <= v) AS n FROM req, le GROUP BY 1, 2)
SELECT 1 AS section, unnest(['# HELP {_PREFIX}_http_requests_total Completed HTTP requests.', '# TYPE {_PREFIX}_http_requests_total counter']) AS line UNION ALL SELECT 2, unnest(['# HELP {_PREFIX}_http_request_duration_seconds HTTP request latency.', '# TYPE {_PREFIX}_http_request_duration_seconds histogram'])
UNION ALL SELECT 1, '{_PREFIX}_http_requests_total{{' || tags || '}} ' || n FROM g UNION ALL SELECT 2, '{_PREFIX}_http_request_duration_seconds_sum{{' || tags || '}} ' || {_TEXT.format("total")} FROM g UNION ALL SELECT 2, '{_PREFIX}_http_request_duration_seconds_count{{' || tags || '}} ' || n FROM g
UNION ALL SELECT 2, '{_PREFIX}_http_request_duration_seconds_bucket{{' || tags || ',le="' || t || '"}} ' || n FROM b UNION ALL {_GAUGE_SQL}"""
)
def metrics_document(spark, sf_dir):
    """The whole text of the service's metrics, a line a row."""
    measured = sv.gauges(ob.latest_state(observations(spark, sf_dir)), _alert_state(spark, sf_dir), F.lit("2024-02-01").cast("timestamp")).withColumn("database_up", F.lit(1))
    return qa.metrics_document(_requests(spark, sf_dir), {name: (text, F.expr(value)) for name, (text, value) in _GAUGES.items()}, measured, _PREFIX, "seconds", ["route", "status"]).select("section", "line")
