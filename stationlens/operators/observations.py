"""Station observations: latest state, windows, baseline context, feed normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlens.functions.expr import codes, hash_parts, iso_weekday, utc_text
from stationlens.operators.trips import TIME_ZONE

#: Raw station times: what stands for "never", the earliest plausible, and how far ahead one may be. Fixed values.
SENTINEL_EPOCH, FIRST_EPOCH, AHEAD_SECONDS = 86_400, 1_450_155_600, 300


def latest_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row a key in the given order; Spark prunes the others before the shuffle's sort (WindowGroupLimit)."""
    return df.withColumn("_turn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_turn = 1").drop("_turn")


def latest_state(observations: DataFrame) -> DataFrame:
    return latest_by(observations, "station_id", F.desc("event_time"), F.desc("input_offset"))


def window_metrics(events: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Count, means and maximum by station and tumbling window; for batch and stream alike."""
    return (
        events.groupBy(F.window("event_time", width).alias("w"), "station_id")
        .agg(F.count("*").alias("observation_count"), F.round(F.avg("bikes"), 3).alias("avg_bikes"), F.round(F.avg("docks"), 3).alias("avg_docks"), F.max("source_age_seconds").alias("max_source_age_seconds"))
        .select("station_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "observation_count", "avg_bikes", "avg_docks", "max_source_age_seconds")
    )


def with_baseline(events: DataFrame, baseline: DataFrame, key: str = "short_name", time_zone: str = TIME_ZONE) -> DataFrame:
    """Events with the demand that is usual at their station, local weekday and hour; ``found`` says whether it is known.

    The baseline's lineage runs once: whether it is broadcast is left to its size as Spark knows it, from its files or, in
    a batch, from the stage that made it; a larger one is joined by a shuffle.
    """
    local = F.from_utc_timestamp("event_time", time_zone)
    stats = [f"{s}_{d}" for d in ("pickups", "dropoffs") for s in ("avg", "p50", "p95")]
    side = baseline.select(F.col("station_id").alias(key), "iso_weekday", "local_hour", "calendar_days", *stats)
    timed = events.withColumns({"iso_weekday": iso_weekday(local), "local_hour": F.hour(local)})
    return timed.join(side, [key, "iso_weekday", "local_hour"], "left").withColumn("found", F.col("calendar_days").isNotNull())


def reported_status(raw: Column, observed_at: Column) -> Column:
    """What a station's own timestamp (epoch seconds) is worth."""
    return (
        F.when(raw.isNull(), "MISSING")
        .when(raw == SENTINEL_EPOCH, "SENTINEL")
        .when(raw < FIRST_EPOCH, "OUT_OF_RANGE")
        .when(raw > F.unix_timestamp(observed_at) + AHEAD_SECONDS, "FUTURE")
        .otherwise("VALID")
    )


def source_age(raw: Column, observed_at: Column) -> Column:
    """Seconds since a valid station time, null otherwise."""
    return F.when(reported_status(raw, observed_at) == "VALID", F.greatest(F.lit(0).cast("long"), F.unix_timestamp(observed_at) - raw))


_INFORMATION = "struct<last_updated: bigint, data: struct<stations: array<struct<station_id: string, short_name: string, name: string, lat: double, lon: double, capacity: bigint>>>>"
_STATUS = "struct<last_updated: bigint, version: string, ttl: bigint, data: struct<stations: array<struct<station_id: string, num_bikes_available: bigint, num_bikes_disabled: bigint, num_docks_available: bigint, num_docks_disabled: bigint, num_ebikes_available: bigint, is_installed: int, is_renting: int, is_returning: int, last_reported: bigint>>>>"


def stations_of(documents: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Feed documents (one JSON a row) -> a row a station, with the document's own fields beside."""
    parsed = documents.withColumn("_d", F.from_json(value, schema))
    return parsed.select(*documents.columns, F.col("_d.last_updated").alias("last_updated"), F.explode("_d.data.stations").alias("station"))


def capacity_status(capacity: Column, observed: Column) -> Column:
    return F.when(capacity.isNull(), "NOT_EVALUATED").when(observed == capacity, "EXACT").otherwise("MISMATCH")


def normalize_snapshot(status: DataFrame, information: DataFrame, source_system: str, stale_after: int = 180) -> DataFrame:
    """Status documents (value, observed_at, snapshot_sha256, feed_version; feed_ttl_seconds, raw_archive_path if known) and information documents -> observations.

    One row a station with its metadata (or its being unmatched), identity, timestamp worth, source age, capacity check
    and issue codes in order, each once.
    """
    meta = latest_by(stations_of(information, _INFORMATION).select("last_updated", "station.*"), "station_id", F.desc("last_updated")).drop("last_updated")
    lineage = {"feed_ttl_seconds": "bigint", "raw_archive_path": "string"}
    status = status.withColumns({c: F.lit(None).cast(t) for c, t in lineage.items() if c not in status.columns})
    s = stations_of(status, _STATUS).select("observed_at", "snapshot_sha256", "feed_version", "feed_ttl_seconds", "raw_archive_path", "last_updated", "station.*")
    s = s.join(meta, "station_id", "left")
    snapshot = F.timestamp_seconds("last_updated")
    state = reported_status(F.col("last_reported"), F.col("observed_at"))
    age = source_age(F.col("last_reported"), F.col("observed_at"))
    total = F.col("num_bikes_available") + F.col("num_bikes_disabled") + F.col("num_docks_available") + F.col("num_docks_disabled")
    matched = F.col("capacity").isNotNull() | F.col("name").isNotNull()
    capacity = capacity_status(F.col("capacity"), total)
    late = F.unix_timestamp("observed_at") - F.col("last_updated") > stale_after
    issues = F.array_distinct(
        codes(
            (state != "VALID", "SOURCE_TIMESTAMP_"),
            (late | (age > stale_after), "SOURCE_STALE"),
            (~matched, "METADATA_UNMATCHED"),
            (capacity == "MISMATCH", "CAPACITY_MISMATCH"),
        )
    )
    issues = F.transform(issues, lambda c: F.when(c == "SOURCE_TIMESTAMP_", F.concat(c, state)).otherwise(c))
    flags = [F.col(f) != 0 for f in ("is_installed", "is_renting", "is_returning")]
    counts = [F.col(f) for f in ("num_bikes_available", "num_bikes_disabled", "num_docks_available", "num_docks_disabled")]
    # the identity is over the values as text: true and false capitalised, as the feed's first readers wrote them
    event_id = hash_parts(F.lit(source_system), F.col("station_id"), utc_text(snapshot), *counts, *(F.initcap(f.cast("string")) for f in flags), F.col("last_reported"))
    return s.select(
        F.lit("1.0").alias("schema_version"), event_id.alias("event_id"), F.lit("STATION_STATUS_OBSERVED").alias("event_type"), F.lit(source_system).alias("source_system"),
        F.struct("station_id", "short_name", "name", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "capacity", F.when(matched, "MATCHED_BY_STATION_ID").otherwise("UNMATCHED").alias("metadata_match_status")).alias("station"),
        F.struct(*(c.alias(n) for c, n in zip([*counts, F.col("num_ebikes_available")], ("bikes_available", "bikes_disabled", "docks_available", "docks_disabled", "ebikes_available"), strict=True))).alias("availability"),
        F.struct(*(f.alias(n) for f, n in zip(flags, ("is_installed", "is_renting", "is_returning"), strict=True))).alias("service"),
        F.struct(utc_text(snapshot).alias("snapshot_updated_at_utc"), F.col("last_reported").alias("station_reported_at_raw"), F.when(state == "VALID", utc_text(F.timestamp_seconds("last_reported"))).alias("station_reported_at_utc"), utc_text(F.col("observed_at")).alias("observed_at_utc"), utc_text(F.col("observed_at")).alias("normalized_at_utc"), age.alias("source_age_seconds")).alias("time"),
        F.struct(F.lit("station_status").alias("feed_name"), "feed_version", "feed_ttl_seconds", "snapshot_sha256", "raw_archive_path").alias("source"),
        F.struct(state.alias("timestamp_status"), capacity.alias("capacity_consistency"), issues.alias("issue_codes")).alias("quality"),
    )


def feed_endpoints(documents: DataFrame, language: str = "en", value: str = "value") -> DataFrame:
    """Discovery documents -> (name, url) of the language asked for, or of the first there is."""
    feeds = "struct<data: map<string, struct<feeds: array<struct<name: string, url: string>>>>>"
    data = documents.select(F.from_json(value, feeds)["data"].alias("d"))
    chosen = F.coalesce(F.try_element_at("d", F.lit(language)), F.get(F.map_values("d"), F.lit(0)))
    return data.select(F.explode(chosen["feeds"]).alias("f")).select("f.name", "f.url")
