"""The registered queries over the driver's tables, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlens.functions import rules
from stationlens.functions.contracts import dead_letters, parse_observations
from stationlens.functions.expr import codes, hash_parts, utc_text
from stationlens.operators import episodes as ep
from stationlens.operators import observations as ob
from stationlens.operators import quality as qa
from stationlens.operators import serving as sv
from stationlens.operators import trips as tr
from stationlens.plans.standin import CONFIG, EPISODES, OBSERVATIONS, RAW_TRIPS, SOURCE, STATES, as_observations, load, observations, raw_trips, states

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def plain(df: DataFrame) -> DataFrame:
    """Instants as zone-less UTC timestamps, arrays of codes joined: what the SQL side gives."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        out.append(c.cast("timestamp_ntz").alias(name) if kind == "timestamp" else F.array_join(c, "|").alias(name) if kind == "array<string>" else c)
    return df.select(*out)


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.deduplicate(tr.normalize(raw_trips(spark, sf_dir)))


def baseline_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = silver(spark, sf_dir)
    return tr.baseline(tr.hourly_demand(tr.demand_events(trips)), tr.calendar_hours(trips))


# ---------------------------------------------------------------- trips

_TRIP = ["ride_id", "ride_id_generated", "started_at_utc", "ended_at_utc", "duration_seconds", "started_local_date", "started_local_hour", "started_iso_weekday", "ended_local_date", "ended_local_hour", "ended_iso_weekday", "started_year", "started_month", "quality_flags", "valid_for_demand"]
_TRIP_SQL = """SELECT ride_id, ride0 IS NULL AS ride_id_generated, us AS started_at_utc, ue AS ended_at_utc, duration_seconds, CAST(ls AS DATE) AS started_local_date, CAST(hour(ls) AS INTEGER) AS started_local_hour, CAST(isodow(ls) AS INTEGER) AS started_iso_weekday,
CAST(le AS DATE) AS ended_local_date, CAST(hour(le) AS INTEGER) AS ended_local_hour, CAST(isodow(le) AS INTEGER) AS ended_iso_weekday, CAST(year(ls) AS INTEGER) AS started_year, CAST(month(ls) AS INTEGER) AS started_month, flags AS quality_flags, valid AS valid_for_demand FROM """


@query(f"WITH {RAW_TRIPS} {_TRIP_SQL} trips")
def trip_normalize(spark, sf_dir):
    return plain(tr.normalize(raw_trips(spark, sf_dir)).select(*_TRIP))


@query(f"WITH {RAW_TRIPS} {_TRIP_SQL} silver")
def trip_dedup(spark, sf_dir):
    return plain(silver(spark, sf_dir).select(*_TRIP))


@query(f"WITH {RAW_TRIPS} {_TRIP_SQL} silver WHERE NOT valid")
def trip_quarantine(spark, sf_dir):
    return plain(tr.quarantine(silver(spark, sf_dir)).select(*_TRIP))


@query(f"WITH {RAW_TRIPS} SELECT f AS quality_flag, count(*) AS trips FROM (SELECT unnest(string_split(flags, '|')) AS f FROM silver) WHERE f <> '' GROUP BY 1")
def trip_quality_histogram(spark, sf_dir):
    return tr.flag_counts(silver(spark, sf_dir))


@query(
    f"""WITH {RAW_TRIPS} SELECT count(*) AS raw_rows, count(DISTINCT ride_id) AS silver_rows, count(*) - count(DISTINCT ride_id) AS duplicate_rows, count(*) FILTER (NOT valid) AS quarantine_rows,
count(*) FILTER (valid AND start_station_id IS NOT NULL) + count(*) FILTER (valid AND end_station_id IS NOT NULL) AS demand_events, min(CAST(ls AS DATE)) AS first_start, max(CAST(ls AS DATE)) AS last_start, min(CAST(le AS DATE)) AS first_end, max(CAST(le AS DATE)) AS last_end FROM trips"""
)
def trip_run_summary(spark, sf_dir):
    return tr.run_summary(tr.normalize(raw_trips(spark, sf_dir)))


@query(f"WITH {RAW_TRIPS} SELECT _source_file, count(*) AS trips FROM raw GROUP BY 1")
def source_file_rows(spark, sf_dir):
    return raw_trips(spark, sf_dir).groupBy("_source_file").agg(F.count("*").alias("trips"))


@query(f"WITH {RAW_TRIPS} SELECT * FROM hourly")
def hourly_demand(spark, sf_dir):
    return tr.hourly_demand(tr.demand_events(silver(spark, sf_dir)))


@query(f"WITH {RAW_TRIPS} SELECT * FROM baseline")
def demand_baseline(spark, sf_dir):
    return baseline_of(spark, sf_dir)


@query(f"WITH {RAW_TRIPS} SELECT station_id, count(*) AS buckets, count(*) = 168 AS is_complete FROM baseline GROUP BY 1")
def baseline_completeness(spark, sf_dir):
    return baseline_of(spark, sf_dir).groupBy("station_id").agg(F.count("*").alias("buckets"), (F.count("*") == 168).alias("is_complete"))


@query("SELECT event_id, CAST(t AS DATE) AS local_date, CAST(hour(t) AS INTEGER) AS local_hour, CAST(isodow(t) AS INTEGER) AS iso_weekday FROM (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM events)")
def local_time_parts(spark, sf_dir):
    local = F.from_utc_timestamp("event_time", tr.TIME_ZONE)
    return observations(spark, sf_dir).select("event_id", F.to_date(local).alias("local_date"), F.hour(local).alias("local_hour"), tr.iso_weekday(local).alias("iso_weekday"))


@query("SELECT event_id, sha256(concat_ws('|', CAST(user_id AS VARCHAR), coalesce(CASE WHEN event_id % 5 <> 0 THEN event_type END, 'null'), strftime(ts, '%Y-%m-%dT%H:%M:%SZ'))) AS surrogate_key FROM events")
def surrogate_key(spark, sf_dir):
    return observations(spark, sf_dir).select("event_id", hash_parts(F.col("station_id"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")), utc_text(F.col("event_time"))).alias("surrogate_key"))


# ---------------------------------------------------------------- observations

_WINDOWS_SQL = """SELECT station_id, time_bucket(INTERVAL 5 MINUTE, event_time) AS window_start, time_bucket(INTERVAL 5 MINUTE, event_time) + INTERVAL 5 MINUTE AS window_end, count(*) AS observation_count, round(avg(bikes), 3) AS avg_bikes, round(avg(docks), 3) AS avg_docks,
max(source_age_seconds) AS max_source_age_seconds FROM obs GROUP BY 1, 2, 3"""


@query(f"WITH {OBSERVATIONS} {_WINDOWS_SQL}")
def window_metrics_5m(spark, sf_dir):
    return plain(ob.window_metrics(observations(spark, sf_dir)))


_LATEST = ["station_id", "event_id", "event_time", "bikes", "docks", "source_age_seconds"]
_LATEST_SQL = f"SELECT {', '.join(_LATEST)} FROM obs QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY event_time DESC, event_id DESC) = 1"


@query(f"WITH {OBSERVATIONS} {_LATEST_SQL}")
def latest_state(spark, sf_dir):
    return plain(ob.latest_state(observations(spark, sf_dir)).select(*_LATEST))


@query(
    f"""WITH {RAW_TRIPS}, {OBSERVATIONS}, timed AS (SELECT *, 's' || (event_id % 50) AS place, (event_time AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM obs)
SELECT o.event_id, o.place AS short_name, CAST(isodow(t) AS INTEGER) AS iso_weekday, CAST(hour(t) AS INTEGER) AS local_hour, b.station_id IS NOT NULL AS found, b.calendar_days, b.avg_pickups, b.p95_pickups, b.p95_dropoffs
FROM timed o LEFT JOIN baseline b ON b.station_id = o.place AND b.iso_weekday = isodow(t) AND b.local_hour = hour(t)""".replace("timed AS (SELECT *, 's'", "placed AS (SELECT *, 's'").replace("FROM timed o", "FROM placed o")
)
def baseline_enrich(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("short_name", F.concat(F.lit("s"), (F.col("event_id") % 50).cast("string")))
    return ob.with_baseline(o, baseline_of(spark, sf_dir)).select("event_id", "short_name", "iso_weekday", "local_hour", "found", "calendar_days", "avg_pickups", "p95_pickups", "p95_dropoffs")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation records as JSON text, some of them wrong in one way or another."""
    o = observations(spark, sf_dir)
    n = F.col("event_id")
    document = F.to_json(
        F.struct(
            F.when(n % 7 != 0, "1.0").otherwise("9").alias("schema_version"), F.sha2(n.cast("string"), 256).alias("event_id"), F.lit("STATION_STATUS_OBSERVED").alias("event_type"), F.lit(SOURCE).alias("source_system"),
            F.struct("station_id", F.lit("MATCHED_BY_STATION_ID").alias("metadata_match_status")).alias("station"),
            F.struct(F.when(n % 11 == 0, -1).otherwise(F.col("bikes")).alias("bikes_available"), F.lit(0).alias("bikes_disabled"), F.col("docks").alias("docks_available"), F.lit(0).alias("docks_disabled")).alias("availability"),
            F.struct(F.lit(True).alias("is_installed"), F.when(n % 13 != 0, F.lit(True)).alias("is_renting"), F.lit(True).alias("is_returning")).alias("service"),
            F.struct(F.when(n % 17 == 0, "soon").otherwise(utc_text(F.col("event_time"))).alias("snapshot_updated_at_utc"), F.col("source_age_seconds")).alias("time"),
            F.struct(F.lit("2.3").alias("feed_version"), F.sha2(n.cast("string"), 256).alias("snapshot_sha256")).alias("source"),
            F.struct(F.lit("VALID").alias("timestamp_status"), F.lit("EXACT").alias("capacity_consistency"), F.array().cast("array<string>").alias("issue_codes")).alias("quality"),
        )
    )
    raw = F.when(n % 19 == 0, "{not json").otherwise(document)
    key = F.when(n % 3 != 0, F.when(n % 23 == 0, "elsewhere").otherwise(F.col("station_id")))
    return o.select(key.alias("key"), raw.alias("body"), F.struct(F.lit("events").alias("topic"), F.lit(0).cast("bigint").alias("partition"), n.alias("offset")).alias("origin"))


_CODES_SQL = """checked AS (SELECT event_id, CASE WHEN event_id % 19 = 0 THEN 'MALFORMED_JSON' ELSE concat_ws('|', CASE WHEN event_id % 7 = 0 THEN 'SCHEMA_VERSION_INVALID' END, CASE WHEN event_id % 11 = 0 THEN 'AVAILABILITY_INVALID' END, CASE WHEN event_id % 13 = 0 THEN 'SERVICE_FLAGS_INVALID' END,
CASE WHEN event_id % 17 = 0 THEN 'EVENT_TIME_INVALID' END, CASE WHEN event_id % 3 <> 0 AND event_id % 23 = 0 THEN 'KAFKA_KEY_STATION_MISMATCH' END) END AS error_codes, CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_id % 23 = 0 THEN 'elsewhere' ELSE CAST(user_id AS VARCHAR) END END AS input_key FROM events)"""


@query(f"WITH {_CODES_SQL} SELECT event_id AS input_offset, error_codes, error_codes = '' AS is_valid FROM checked")
def validate_observations(spark, sf_dir):
    return plain(parse_observations(_records(spark, sf_dir)).select("input_offset", "error_codes", "is_valid"))


#: What the dead letter of a record with these faults is keyed by; SQL has no hash of the JSON text, so such keys are compared as ''.
@query(f"WITH {_CODES_SQL} SELECT event_id AS input_offset, error_codes, coalesce(input_key, CASE WHEN event_id % 19 = 0 THEN sha256('{{not json') ELSE '' END) AS record_key FROM checked WHERE error_codes <> ''")
def dead_letter(spark, sf_dir):
    """All dead letters; the hash that stands for a missing key is given where SQL can make it as well."""
    letters = dead_letters(parse_observations(_records(spark, sf_dir)))
    hashed = (F.col("record_key") == F.col("raw_sha256")) & (F.col("raw_fragment") != "{not json")
    return plain(letters.select("input_offset", "error_codes", F.when(hashed, "").otherwise(F.col("record_key")).alias("record_key")))


@query()
def dead_letter_all(spark, sf_dir):
    """All dead letters with their keys, the hashes of JSON texts included."""
    return plain(dead_letters(parse_observations(_records(spark, sf_dir))).select("input_offset", "error_codes", "record_key"))


def _raw_time() -> Column:
    n, now = F.col("event_id") % 9, F.unix_timestamp("event_time")
    return F.when(n == 1, F.lit(86400)).when(n == 2, F.lit(1000)).when(n == 3, now + 301).when(n != 0, now - F.col("source_age_seconds")).cast("bigint")


@query(
    f"""WITH {OBSERVATIONS}, r AS (SELECT event_id, CAST(floor(epoch(event_time)) AS BIGINT) AS now, CASE WHEN event_id % 9 = 1 THEN 86400 WHEN event_id % 9 = 2 THEN 1000 WHEN event_id % 9 = 3 THEN CAST(floor(epoch(event_time)) AS BIGINT) + 301 WHEN event_id % 9 <> 0 THEN CAST(floor(epoch(event_time)) AS BIGINT) - source_age_seconds END AS reported FROM obs),
s AS (SELECT *, CASE WHEN reported IS NULL THEN 'MISSING' WHEN reported = 86400 THEN 'SENTINEL' WHEN reported < 1450155600 THEN 'OUT_OF_RANGE' WHEN reported > now + 300 THEN 'FUTURE' ELSE 'VALID' END AS timestamp_status FROM r)
SELECT event_id, timestamp_status, CASE WHEN timestamp_status = 'VALID' THEN greatest(0, now - reported) END AS source_age_seconds FROM s"""
)
def timestamp_status(spark, sf_dir):
    raw, at = _raw_time(), F.col("event_time")
    return observations(spark, sf_dir).select("event_id", ob.reported_status(raw, at).alias("timestamp_status"), ob.source_age(raw, at).alias("source_age_seconds"))


@query(
    """SELECT o.o_orderkey, CASE WHEN c.c_custkey IS NULL THEN 'UNMATCHED' ELSE 'MATCHED_BY_STATION_ID' END AS metadata_match_status, CASE WHEN c.cap IS NULL THEN 'NOT_EVALUATED' WHEN o.o_orderkey % 40 = c.cap THEN 'EXACT' ELSE 'MISMATCH' END AS capacity_consistency,
concat_ws('|', CASE WHEN c.c_custkey IS NULL THEN 'METADATA_UNMATCHED' END, CASE WHEN c.cap IS NOT NULL AND o.o_orderkey % 40 <> c.cap THEN 'CAPACITY_MISMATCH' END) AS issue_codes
FROM orders o LEFT JOIN (SELECT c_custkey, c_custkey % 40 AS cap FROM customer WHERE c_custkey % 7 <> 0) c ON c.c_custkey = o.o_custkey"""
)
def metadata_join_status(spark, sf_dir):
    information = load(spark, sf_dir, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 40).alias("capacity"))
    joined = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(information, "o_custkey", "left")
    state = ob.capacity_status(F.col("capacity"), F.col("o_orderkey") % 40)
    lacking = F.col("capacity").isNull()
    return plain(joined.select("o_orderkey", F.when(lacking, "UNMATCHED").otherwise("MATCHED_BY_STATION_ID").alias("metadata_match_status"), state.alias("capacity_consistency"), codes((lacking, "METADATA_UNMATCHED"), (state == "MISMATCH", "CAPACITY_MISMATCH")).alias("issue_codes")))


# ---------------------------------------------------------------- risk and alerts


@query(f"WITH {STATES} SELECT event_id, station_id, risk FROM st")
def risk_classify(spark, sf_dir):
    return states(spark, sf_dir).select("event_id", "station_id", "risk")


@query(f"WITH {EPISODES} SELECT event_id, pr AS previous_risk, pb AS previous_bikes, trend FROM trended")
def onset_trend(spark, sf_dir):
    return ep.with_previous(states(spark, sf_dir)).select("event_id", "previous_risk", "previous_bikes", "trend")


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.episodes(states(spark, sf_dir), CONFIG, SOURCE)


@query(f"WITH {EPISODES} SELECT * FROM episodes")
def risk_episodes(spark, sf_dir):
    return plain(_episodes(spark, sf_dir))


@query(f"WITH {EPISODES} SELECT station_id, alert_id, risk, event_type, lifecycle_status, event_time, alert_event_id FROM life")
def alert_open_resolve(spark, sf_dir):
    return plain(ep.lifecycle_events(_episodes(spark, sf_dir)).select("station_id", "alert_id", "risk", "event_type", "lifecycle_status", "event_time", "alert_event_id"))


@query(f"WITH {EPISODES} SELECT event_type, count(*) AS events FROM life GROUP BY 1")
def lifecycle_counts(spark, sf_dir):
    return ep.lifecycle_events(_episodes(spark, sf_dir)).groupBy("event_type").agg(F.count("*").alias("events"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _episodes(spark, sf_dir).filter("opened_at IS NOT NULL")
    duration = (F.unix_timestamp("opened_at") - F.unix_timestamp("started_at")).cast("double")
    p95 = (F.col("observations") % 7).cast("bigint")
    return e.withColumn("p", rules.priority(F.col("risk"), duration, F.lit(True), p95, p95, F.col("trend"), CONFIG))


_SEVERITY = "CASE risk WHEN 'EMPTY' THEN 100.0 WHEN 'FULL' THEN 100.0 WHEN 'OFFLINE' THEN 90.0 WHEN 'STALE' THEN 80.0 WHEN 'DATA_QUALITY' THEN 50.0 ELSE 60.0 END"
_SCORED_SQL = f"""{EPISODES}, parts AS (SELECT *, CAST({_SEVERITY} AS DOUBLE) AS c1, CAST(round(CAST(least(100.0, 60.0 + 40.0 * greatest(0.0, floor(epoch(opened_at)) - floor(epoch(started_at)) - 43200.0) / 43200.0) AS DECIMAL(20, 10)), 2) AS DOUBLE) AS c2,
round(CASE WHEN risk IN ('EMPTY', 'LOW_BIKES', 'FULL', 'LOW_DOCKS') THEN least(100.0, 100.0 * (observations % 7) / 5.0) ELSE 0.0 END, 2) AS c3, round(least(100.0, greatest(0.0, trend)), 2) AS c4, CASE WHEN risk IN ('EMPTY', 'FULL', 'OFFLINE') THEN 100.0 ELSE 60.0 END AS c5 FROM episodes WHERE opened_at IS NOT NULL),
scored AS (SELECT *, CASE WHEN risk IN ('EMPTY', 'FULL', 'OFFLINE') THEN 'CRITICAL' ELSE 'WARNING' END AS severity, CASE WHEN risk IN ('EMPTY', 'LOW_BIKES') THEN 'DELIVER_BIKES' WHEN risk IN ('FULL', 'LOW_DOCKS') THEN 'REMOVE_BIKES' ELSE 'INSPECT_STATION' END AS recommended_action,
0.4 * CAST(c1 AS DECIMAL(7, 2)) + 0.2 * CAST(c2 AS DECIMAL(7, 2)) + 0.2 * CAST(c3 AS DECIMAL(7, 2)) + 0.1 * CAST(c4 AS DECIMAL(7, 2)) + 0.1 * CAST(c5 AS DECIMAL(7, 2)) AS raw_score FROM parts)"""


@query(
    f"""WITH {_SCORED_SQL} SELECT alert_id, severity, recommended_action, c1 AS severity_score, c2 AS persistence, c3 AS historical_demand, c4 AS recent_trend, CAST(round(raw_score, 2) AS DOUBLE) AS score,
concat_ws('|', CASE risk WHEN 'STALE' THEN 'SOURCE_STALE' WHEN 'OFFLINE' THEN 'STATION_OFFLINE' WHEN 'DATA_QUALITY' THEN 'DATA_QUALITY_RISK' ELSE risk || '_PERSISTED' END, CASE WHEN c3 >= 80 AND risk IN ('EMPTY', 'LOW_BIKES') THEN 'HIGH_HISTORICAL_PICKUP_DEMAND' WHEN c3 >= 80 THEN 'HIGH_HISTORICAL_DROPOFF_DEMAND' END,
CASE WHEN c4 >= 60 AND risk IN ('EMPTY', 'LOW_BIKES') THEN 'RAPID_OUTFLOW' WHEN c4 >= 60 AND risk IN ('FULL', 'LOW_DOCKS') THEN 'RAPID_INFLOW' END) AS reasons FROM scored"""
)
def priority_score(spark, sf_dir):
    return plain(_priority_columns(_scored(spark, sf_dir)))


def _priority_columns(s: DataFrame) -> DataFrame:
    return s.select("alert_id", F.col("p.level").alias("severity"), F.col("p.action").alias("recommended_action"), F.col("p.severity").alias("severity_score"), "p.persistence", "p.historical_demand", "p.recent_trend", F.col("p.score").alias("score"), "p.reasons")


def _alert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return s.select(
        "alert_id", "station_id", F.col("risk").alias("alert_type"), F.when(F.col("resolved_at").isNotNull(), "RESOLVED").otherwise("OPEN").alias("lifecycle_status"), F.col("p.level").alias("severity"),
        F.col("p.action").alias("recommended_action"), F.col("p.score").alias("priority_score"), F.col("opened_at").alias("detected_at"), F.coalesce("resolved_at", "opened_at").alias("event_time"), F.col("alert_id").alias("alert_event_id"),
    )


_STATE_SQL = f"{_SCORED_SQL}, alert_state AS (SELECT alert_id, station_id, risk AS alert_type, CASE WHEN resolved_at IS NOT NULL THEN 'RESOLVED' ELSE 'OPEN' END AS lifecycle_status, severity, recommended_action, CAST(round(raw_score, 2) AS DOUBLE) AS priority_score, opened_at AS detected_at, coalesce(resolved_at, opened_at) AS event_time FROM scored)"


@query(f"WITH {_STATE_SQL} SELECT alert_id, priority_score, event_time, CAST(row_number() OVER (ORDER BY priority_score DESC, event_time, alert_id) AS INTEGER) AS queue_rank FROM alert_state WHERE lifecycle_status <> 'RESOLVED'")
def priority_queue(spark, sf_dir):
    return plain(sv.priority_queue(_alert_state(spark, sf_dir)).select("alert_id", "priority_score", "event_time", "queue_rank"))


@query(f"WITH {_STATE_SQL} SELECT alert_id, station_id, priority_score, detected_at FROM alert_state WHERE recommended_action = 'INSPECT_STATION' ORDER BY priority_score DESC, detected_at, alert_id LIMIT 50 OFFSET 5")
def alert_list_page(spark, sf_dir):
    return plain(sv.alert_page(_alert_state(spark, sf_dir), active_only=False, action="INSPECT_STATION", limit=50, offset=5).select("alert_id", "station_id", "priority_score", "detected_at"))


@query(f"WITH {OBSERVATIONS}, latest AS ({_LATEST_SQL}) SELECT station_id, event_time FROM latest ORDER BY event_time DESC, station_id LIMIT 40 OFFSET 10")
def station_list_page(spark, sf_dir):
    return plain(sv.station_page(ob.latest_state(observations(spark, sf_dir)), 40, 10).select("station_id", "event_time"))


@query(f"WITH {EPISODES} SELECT alert_id, event_type, event_time, CAST(row_number() OVER (PARTITION BY alert_id ORDER BY event_time, alert_event_id) AS INTEGER) AS step FROM life")
def alert_history(spark, sf_dir):
    from pyspark.sql import Window

    events = ep.lifecycle_events(_episodes(spark, sf_dir))
    return plain(events.select("alert_id", "event_type", "event_time", F.row_number().over(Window.partitionBy("alert_id").orderBy("event_time", "alert_event_id")).alias("step")))


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert events as they might arrive: some acknowledged, some late."""
    o = observations(spark, sf_dir)
    status = F.when(F.col("event_id") % 5 == 0, "ACKNOWLEDGED").when(F.col("event_id") % 37 == 0, "RESOLVED").otherwise("OPEN")
    at = F.when(F.col("event_id") % 8 == 0, F.col("event_time") - F.expr("INTERVAL 5 DAYS")).otherwise(F.col("event_time"))
    return o.select(F.col("station_id").alias("alert_id"), F.col("event_id").cast("string").alias("alert_event_id"), "station_id", F.lit("EMPTY").alias("alert_type"), status.alias("lifecycle_status"), F.lit("CRITICAL").alias("severity"),
                    F.col("bikes").cast("double").alias("priority_score"), at.alias("detected_at"), at.alias("status_changed_at"), F.when(status == "RESOLVED", at).alias("resolved_at"), F.col("event_id").alias("arrival"))


_ARRIVALS_SQL = """arr0 AS (SELECT CAST(user_id AS VARCHAR) AS alert_id, event_id AS arrival, CASE WHEN event_id % 5 = 0 THEN 'ACKNOWLEDGED' WHEN event_id % 37 = 0 THEN 'RESOLVED' ELSE 'OPEN' END AS s, CASE WHEN event_id % 8 = 0 THEN ts - INTERVAL 5 DAY ELSE ts END AS t, CAST(CAST(floor(value) AS BIGINT) % 13 AS DOUBLE) AS score FROM events),
arr1 AS (SELECT *, max(t) OVER (PARTITION BY alert_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM arr0), passed AS (SELECT * FROM arr1 WHERE m IS NULL OR t >= m)"""


@query(
    f"""WITH {_ARRIVALS_SQL} SELECT alert_id, CAST(max_by(arrival, arrival) AS VARCHAR) AS last_event_id, CASE WHEN bool_or(s = 'RESOLVED') THEN 'RESOLVED' WHEN bool_or(s = 'ACKNOWLEDGED') THEN 'ACKNOWLEDGED' ELSE max_by(s, arrival) END AS lifecycle_status, max_by(score, arrival) AS priority_score,
max_by(t, arrival) AS status_changed_at, max_by(t, arrival) FILTER (s = 'RESOLVED') AS resolved_at, max_by(t, arrival) FILTER (s = 'ACKNOWLEDGED') AS acknowledged_at FROM passed GROUP BY 1"""
)
def lifecycle_merge(spark, sf_dir):
    return plain(sv.merge_alert_state(_arrivals(spark, sf_dir)).select("alert_id", "last_event_id", "lifecycle_status", "priority_score", "status_changed_at", "resolved_at", "acknowledged_at"))


@query(f"WITH {OBSERVATIONS} SELECT station_id, event_id, event_time FROM obs QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY event_time DESC, event_id) = 1")
def station_upsert(spark, sf_dir):
    return plain(sv.merge_station_state(observations(spark, sf_dir), "event_id").select("station_id", "event_id", "event_time"))


@query("SELECT DISTINCT event_id, user_id FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0")
def append_once_events(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "user_id")
    incoming = e.filter("event_id % 2 = 0")
    return sv.append_once(e.filter("event_id % 3 = 0"), incoming.unionByName(incoming.filter("event_id % 4 = 0")), "event_id")


@query(
    f"""WITH {EPISODES}, latest AS (SELECT * FROM life QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY event_time DESC, alert_event_id DESC) = 1), active AS (SELECT * FROM latest WHERE lifecycle_status <> 'RESOLVED')
SELECT alert_id, station_id, sha256(concat_ws('|', alert_id, 'ALERT_ACKNOWLEDGED', '2024-02-01T00:00:00Z')) AS alert_event_id, 'ALERT_ACKNOWLEDGED' AS event_type, 'ACKNOWLEDGED' AS lifecycle_status FROM active"""
)
def ack_overlay(spark, sf_dir):
    events = ep.lifecycle_events(_episodes(spark, sf_dir))
    commands = events.select("alert_id", F.lit("2024-02-01 00:00:00").cast("timestamp").alias("acknowledged_at"))
    return sv.acknowledge(events, commands)[0].select("alert_id", "station_id", "alert_event_id", "event_type", "lifecycle_status")


@query(
    """WITH c AS (SELECT 'key-' || c_custkey AS idempotency_key, CAST(c_custkey % 40 AS VARCHAR) AS alert_id, c_custkey AS n FROM customer), a AS (SELECT 'key-' || c_custkey AS k, CAST((c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END) % 40 AS VARCHAR) AS used FROM customer WHERE c_custkey % 5 = 0),
s AS (SELECT CAST(x AS VARCHAR) AS alert_id, CASE x % 3 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'ACKNOWLEDGED' ELSE 'OPEN' END AS st FROM range(30) t(x))
SELECT c.idempotency_key, c.alert_id, CASE WHEN a.used = c.alert_id THEN 'REPLAYED' WHEN a.used IS NOT NULL THEN 'CONFLICT' WHEN s.st IS NULL THEN 'NOT_FOUND' WHEN s.st = 'RESOLVED' THEN 'CONFLICT' WHEN s.st = 'ACKNOWLEDGED' THEN 'ALREADY_ACKNOWLEDGED' ELSE 'ACCEPTED' END AS outcome,
sha256(concat_ws('|', c.idempotency_key, c.alert_id, 'ACKNOWLEDGE')) AS command_id FROM c LEFT JOIN a ON a.k = c.idempotency_key LEFT JOIN s ON s.alert_id = c.alert_id"""
)
def acknowledge_commands(spark, sf_dir):
    n = F.col("c_custkey")
    customers = load(spark, sf_dir, "customer").select(n, F.concat(F.lit("key-"), n.cast("string")).alias("idempotency_key"))
    commands = customers.select("idempotency_key", (n % 40).cast("string").alias("alert_id"))
    applied = customers.filter(n % 5 == 0).select("idempotency_key", ((n + F.when(n % 2 == 0, 1).otherwise(0)) % 40).cast("string").alias("alert_id"))
    state = spark.range(30).select(F.col("id").cast("string").alias("alert_id"), F.when(F.col("id") % 3 == 0, "RESOLVED").when(F.col("id") % 3 == 1, "ACKNOWLEDGED").otherwise("OPEN").alias("lifecycle_status"))
    return sv.decide_commands(commands, applied, state)


@query("SELECT event_type AS topic, user_id % 3 AS partition, max(event_id) + 1 AS next_offset FROM events GROUP BY 1, 2")
def consumer_offsets(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), (F.col("user_id") % 3).alias("partition"), F.col("event_id").alias("offset"))
    return sv.consumer_offsets(e)


@query(
    f"""WITH {_STATE_SQL}, latest AS ({_LATEST_SQL}) SELECT (SELECT count(*) FROM latest) AS station_rows, (SELECT count(*) FROM alert_state WHERE lifecycle_status <> 'RESOLVED') AS active_alerts, (SELECT count(*) FROM alert_state WHERE lifecycle_status = 'OPEN' AND severity = 'CRITICAL') AS critical_unacknowledged_alerts,
coalesce((SELECT max(source_age_seconds) FROM latest), 0) AS reported_source_age_seconds, (SELECT CAST(epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(event_time))) AS BIGINT) FROM latest) AS projection_age_seconds"""
)
def serving_gauges(spark, sf_dir):
    return sv.gauges(ob.latest_state(observations(spark, sf_dir)), _alert_state(spark, sf_dir), F.lit("2024-02-01").cast("timestamp"))


@query(f"WITH {_STATE_SQL} SELECT count(*) FILTER (lifecycle_status <> 'RESOLVED') AS active, count(*) FILTER (lifecycle_status = 'OPEN' AND severity = 'CRITICAL') AS critical, count(*) FILTER (lifecycle_status = 'ACKNOWLEDGED') AS acknowledged, count(DISTINCT station_id) AS stations FROM alert_state")
def dashboard_kpis(spark, sf_dir):
    s = F.col("lifecycle_status")
    return _alert_state(spark, sf_dir).agg(F.count_if(s != "RESOLVED").alias("active"), F.count_if((s == "OPEN") & (F.col("severity") == "CRITICAL")).alias("critical"), F.count_if(s == "ACKNOWLEDGED").alias("acknowledged"), F.count_distinct("station_id").alias("stations"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), 'auto')")
def search_filter(spark, sf_dir):
    return sv.search(load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "AUTO", ["c_name", "c_mktsegment"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)")
def referential_check(spark, sf_dir):
    parents = load(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return sv.orphans(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), parents, "o_custkey").select("o_orderkey", "o_custkey")


# ---------------------------------------------------------------- profiles and service metrics


@query(
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup')
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS in_both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS left_only, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS right_only"""
)
def id_coverage(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return qa.key_coverage(e.filter("event_type = 'purchase'"), e.filter("event_type = 'signup'"), "user_id")


@query(
    f"""WITH {OBSERVATIONS}, l AS (SELECT lag(event_id) OVER w IS NOT NULL AS c, bikes IS DISTINCT FROM lag(bikes) OVER w AS b, docks IS DISTINCT FROM lag(docks) OVER w AS d, event_type IS DISTINCT FROM lag(event_type) OVER w AS t FROM obs WINDOW w AS (PARTITION BY station_id ORDER BY event_id))
SELECT count(*) FILTER (c) AS compared, count(*) FILTER (c AND b) AS bikes_changed, count(*) FILTER (c AND d) AS docks_changed, count(*) FILTER (c AND t) AS event_type_changed FROM l"""
)
def snapshot_diff(spark, sf_dir):
    return qa.snapshot_changes(observations(spark, sf_dir), "station_id", "event_id", ["bikes", "docks", "event_type"])


@query(
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS null_count, round(100.0 * count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') / greatest(count(*), 1), 4) AS null_percent, count(DISTINCT {c}) AS distinct_count FROM r" for c in ("start_station_id", "end_station_id", "started_at"))
    + ")"
)
def column_profile(spark, sf_dir):
    columns = ["start_station_id", "end_station_id", "started_at"]
    clean = [F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in columns]
    return qa.column_profile(raw_trips(spark, sf_dir).select(*clean), columns)


ORACLE_SQL["column_profile"] = f"WITH {RAW_TRIPS}, r AS (SELECT start_station_id, end_station_id, started_at FROM raw) {ORACLE_SQL['column_profile']}"


@query(
    f"""WITH {RAW_TRIPS}, x AS (SELECT duration_seconds AS d FROM trips) SELECT count(d) AS trips, min(d) AS shortest, max(d) AS longest, round(avg(d), 3) AS mean, round(median(d), 3) AS median, round(quantile_cont(d, 0.01), 3) AS p01, round(quantile_cont(d, 0.5), 3) AS p50, round(quantile_cont(d, 0.95), 3) AS p95,
round(quantile_cont(d, 0.99), 3) AS p99, count(*) FILTER (d < 0) AS negative, count(*) FILTER (d = 0) AS zero, count(*) FILTER (d >= 0 AND d < 60) AS under_minute, count(*) FILTER (d > 86400) AS over_day FROM x"""
)
def duration_profile(spark, sf_dir):
    return qa.duration_profile(tr.normalize(raw_trips(spark, sf_dir)), "duration_seconds")


@query(f"WITH {RAW_TRIPS} SELECT start_station_id, end_station_id, count(*) AS n FROM raw GROUP BY 1, 2 ORDER BY n DESC, start_station_id NULLS FIRST, end_station_id NULLS FIRST LIMIT 20")
def topk_pairs(spark, sf_dir):
    t = raw_trips(spark, sf_dir).select("start_station_id", F.nullif(F.trim("end_station_id"), F.lit("")).alias("end_station_id"))
    return qa.top_values(t, ["start_station_id", "end_station_id"], 20)


@query("SELECT event_id, user_id, n AS row_number FROM (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE n % 1000 = 0")
def systematic_sample(spark, sf_dir):
    return qa.systematic_sample(load(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 1000)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("route"), F.when(F.col("event_id") % 50 == 0, 503).otherwise(200).alias("status"), (F.floor(F.col("value") * 10) / 1000).alias("seconds"), F.col("ts").cast("timestamp").alias("at"))


_REQUESTS_SQL = "req AS (SELECT event_type AS route, CASE WHEN event_id % 50 = 0 THEN 503 ELSE 200 END AS status, floor(value * 10) / 1000 AS seconds, ts AS at_time FROM events)"
_BUCKETS = ", ".join(f"({b}, '{b}')" for b in qa.LATENCY_BUCKETS)


@query(
    f"""WITH {_REQUESTS_SQL}, b(v, le) AS (VALUES {_BUCKETS}, (1e308, '+Inf')) SELECT route, CAST(status AS INTEGER) AS status, le, count(*) FILTER (seconds <= v) AS bucket_count, count(*) AS request_count, round(sum(seconds), 6) AS duration_sum FROM req, b GROUP BY 1, 2, 3"""
)
def latency_histogram(spark, sf_dir):
    return qa.latency_histogram(_requests(spark, sf_dir), "seconds", "route", "status")


@query(
    f"""WITH {_REQUESTS_SQL}, b(v, le) AS (VALUES {_BUCKETS}, (1e308, '+Inf')) SELECT 'request_seconds_bucket{{route="' || route || '",le="' || le || '"}} ' || count(*) FILTER (seconds <= v) AS line FROM req, b GROUP BY route, le"""
)
def metrics_exposition(spark, sf_dir):
    return qa.exposition(qa.latency_histogram(_requests(spark, sf_dir), "seconds", "route"), "request_seconds", "route")


@query(f"WITH {_REQUESTS_SQL} SELECT count(*) AS requests, min(seconds) AS fastest, quantile_disc(seconds, 0.5) AS p50, quantile_disc(seconds, 0.95) AS p95, quantile_disc(seconds, 0.99) AS p99, max(seconds) AS slowest, round(100.0 * count(*) FILTER (status < 500) / count(*), 4) AS success_percent FROM req")
def latency_summary(spark, sf_dir):
    return qa.latency_summary(_requests(spark, sf_dir), "seconds", F.col("status") < 500)


@query(f"WITH {_REQUESTS_SQL} SELECT time_bucket(INTERVAL 5 MINUTE, at_time) AS window_start, round(count(*) / 300.0, 6) AS request_rate, round(count(*) FILTER (status >= 500) / CAST(count(*) AS DOUBLE), 6) AS error_ratio FROM req GROUP BY 1")
def request_rates(spark, sf_dir):
    return plain(qa.request_rates(_requests(spark, sf_dir), "at", F.col("status") >= 500))


@query(
    f"""WITH {OBSERVATIONS}, x AS (SELECT *, bikes <= 6 AS h, sum(CASE WHEN bikes <= 6 THEN 0 ELSE 1 END) OVER (PARTITION BY station_id ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS run FROM obs), y AS (SELECT *, min(event_time) OVER (PARTITION BY station_id, run) AS since FROM x WHERE h)
SELECT station_id, since AS held_since, min(event_time) AS fired_at FROM y WHERE floor(epoch(event_time)) - floor(epoch(since)) >= 86400 GROUP BY 1, 2"""
)
def threshold_alerts(spark, sf_dir):
    return plain(qa.sustained(observations(spark, sf_dir), "station_id", "event_time", F.col("bikes") <= 6, 86400))


@query(
    f"""WITH {_REQUESTS_SQL}, m AS (SELECT round(100.0 * count(*) FILTER (status < 500) / count(*), 4) AS success_percent, quantile_disc(seconds, 0.95) AS p95 FROM req), c AS (SELECT 'success_percent' AS objective, success_percent AS measured, 99.0 AS target, success_percent >= 99 AS met FROM m UNION ALL SELECT 'p95', p95, 5.0, p95 <= 5 FROM m)
SELECT objective, CAST(measured AS DOUBLE) AS measured, CAST(target AS DOUBLE) AS target, met, bool_and(met) OVER () AS all_met FROM c"""
)
def slo_gate(spark, sf_dir):
    return qa.objectives(qa.latency_summary(_requests(spark, sf_dir), "seconds", F.col("status") < 500), {"success_percent": (">=", 99.0), "p95": ("<=", 5.0)})


@query(
    """WITH h AS (SELECT sha256(concat_ws('|', CAST(event_id AS VARCHAR), event_type, CAST(user_id AS VARCHAR))) AS h FROM events), s AS (SELECT count(*) AS n, sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS a, sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS b FROM h)
SELECT n AS row_count, sha256(concat_ws('|', CAST(n AS VARCHAR), CAST(a AS VARCHAR), CAST(b AS VARCHAR))) AS fingerprint FROM s"""
)
def state_fingerprint(spark, sf_dir):
    return qa.state_fingerprint(load(spark, sf_dir, "events"), ["event_id", "event_type", "user_id"])


@query("WITH b AS (SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1), a AS (SELECT event_type AS k, count(*) AS n FROM events WHERE event_id % 100 <> 0 GROUP BY 1) SELECT CAST(sum(greatest(0, b.n - coalesce(a.n, 0))) AS BIGINT) AS lost FROM b LEFT JOIN a USING (k)")
def lost_records(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumnRenamed("event_type", "table_name")
    count = lambda df: df.groupBy("table_name").agg(F.count("*").alias("rows"))
    return qa.lost_rows(count(e), count(e.filter("event_id % 100 <> 0")))


@query("WITH p AS (SELECT user_id, count(DISTINCT CASE WHEN event_id % 97 = 0 THEN 9 ELSE user_id % 6 END) AS partitions, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS keys, count(*) FILTER (partitions > 1) AS split_keys, CAST(sum(n) AS BIGINT) AS records FROM p")
def key_partition_audit(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_id") % 97 == 0, 9).otherwise(F.col("user_id") % 6).alias("partition"))
    return qa.key_partitions(e)


# ---------------------------------------------------------------- streams over the driver's events


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = load(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return as_observations(events).withWatermark("event_time", "10 minutes")


def _drain(spark: SparkSession, df: DataFrame, mode: str, name: str) -> DataFrame:
    import uuid

    from stationlens.session import work_dir

    root = f"{work_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{root}/out")


@query(f"WITH {OBSERVATIONS}, w AS ({_WINDOWS_SQL}) SELECT * FROM w WHERE window_end <= (SELECT max(event_time) - INTERVAL 10 MINUTE FROM obs)")
def stream_windows(spark, sf_dir):
    from stationlens.streaming.jobs import closed_windows

    return plain(_drain(spark, closed_windows(_stream(spark, sf_dir)), "append", "windows"))


def _documents(o: DataFrame) -> DataFrame:
    """Observations as the stream operators take them: an observation document, no baseline."""
    quality = F.struct(F.when(F.col("timely"), "VALID").otherwise("FUTURE").alias("timestamp_status"), F.lit("EXACT").alias("capacity_consistency"), F.array().cast("array<string>").alias("issue_codes"))
    service = F.struct(*(F.col("in_service").alias(c) for c in ("is_installed", "is_renting", "is_returning")))
    body = [F.struct("station_id", F.lit("MATCHED_BY_STATION_ID").alias("metadata_match_status")).alias("station"), F.struct(F.col("bikes").alias("bikes_available"), F.col("docks").alias("docks_available")).alias("availability"), service.alias("service"), quality.alias("quality")]
    return o.select("station_id", F.col("event_id").cast("string").alias("event_id"), "event_time", utc_text(F.col("event_time")).alias("event_time_utc"), F.lit(0).cast("bigint").alias("input_partition"), "input_offset", *body, "source_age_seconds")


@query(f"WITH {OBSERVATIONS} {_LATEST_SQL.replace(', bikes, docks, source_age_seconds', ', bikes, docks')}")
def stream_latest_state(spark, sf_dir):
    from stationlens.streaming.processors import latest_states

    d = _documents(_stream(spark, sf_dir))
    document = F.to_json(F.struct("station", "availability", "service", "quality", F.struct("source_age_seconds").alias("time")))
    nothing = [F.lit(None).cast("int").alias(c) for c in ("calendar_days", "iso_weekday", "local_hour")] + [F.lit(None).cast("double").alias(f"{s}_{x}") for x in ("pickups", "dropoffs") for s in ("avg", "p50", "p95")]
    events = d.select("station_id", "event_id", "event_time", "event_time_utc", document.alias("observation_json"), "input_partition", "input_offset", *nothing)
    out = _drain(spark, latest_states(events), "update", "latest")
    n = lambda f: F.get_json_object("current_state_json", f"$.availability.{f}").cast("bigint")
    return plain(ob.latest_state(out).select("station_id", F.col("event_id").cast("bigint").alias("event_id"), "event_time", n("bikes_available").alias("bikes"), n("docks_available").alias("docks")))


def _state_documents(o: DataFrame) -> DataFrame:
    d = _documents(o).withColumn("historical_demand", F.struct(F.lit(False).alias("found")))
    return d.select("station_id", "event_id", F.to_json(F.struct("station_id", "event_id", "station", "availability", "service", "quality", "source_age_seconds", "historical_demand")).alias("current_state_json"), "event_time", "input_partition", "input_offset")


_LIFE = ["station_id", "alert_id", "alert_event_id", "event_type", "event_time"]


@query(f"WITH {EPISODES} SELECT {', '.join(_LIFE)} FROM life")
def stream_alerts(spark, sf_dir):
    """All alert events of the stream in the lifecycle's older form, which sends no updates."""
    from stationlens.streaming.processors import alert_events

    plain_form = replace(CONFIG, send_updates=False)
    return plain(_drain(spark, alert_events(_state_documents(_stream(spark, sf_dir)), plain_form, SOURCE), "update", "alerts").select(*_LIFE))


@query()
def stream_alerts_all(spark, sf_dir):
    """All alert events of the stream, updates included."""
    from stationlens.streaming.processors import alert_events

    return plain(_drain(spark, alert_events(_state_documents(_stream(spark, sf_dir)), CONFIG, SOURCE), "update", "alerts-all").select(*_LIFE))


@query()
def alert_replay(spark, sf_dir):
    """All lifecycle events, updates included, by the machine over sorted partitions."""
    return plain(ep.replay(_state_documents(observations(spark, sf_dir)), CONFIG, SOURCE).select(*_LIFE, "lifecycle_status", "priority_score"))
