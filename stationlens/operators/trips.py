"""Trips: cleaning, quality flags, identity, deduplication, demand facts, dense grid and baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlens.functions.expr import blank_to_null, codes, hash_parts, iso_weekday, parse_time, seconds_between
from stationlens.sources.trips import TRIP_COLUMNS

TIME_ZONE = "America/New_York"
LONG_TRIP_SECONDS = 24 * 3600
_IDENTITY = ("started_at", "ended_at", "start_station_id", "end_station_id", "start_station_name", "end_station_name")


def _off_earth(*pairs: tuple[Column, Column]) -> Column:
    bad = F.lit(False)
    for lat, lng in pairs:
        bad = bad | lat.isNull() | lng.isNull() | ~lat.between(-90, 90) | ~lng.between(-180, 180)
    return bad


def normalize(raw: DataFrame, time_zone: str = TIME_ZONE, long_seconds: int = LONG_TRIP_SECONDS) -> DataFrame:
    """Canonical raw trips (strings) -> typed trips with ``quality_flags`` and ``valid_for_demand``.

    Blank is null; junk coordinates and times become null and are flagged. Local wall-clock text is kept; elapsed time is
    taken in UTC, so it is right across clock changes. A missing ride id is replaced by a hash of the trip.
    """
    lineage = [c for c in raw.columns if c not in TRIP_COLUMNS]
    clean = raw.select(*lineage, *(blank_to_null(F.col(c)).alias(c) for c in TRIP_COLUMNS))
    timed = clean.select(
        *lineage, *(c for c in TRIP_COLUMNS if not c.endswith(("_lat", "_lng"))),
        *(F.expr(f"try_cast({c} AS double)").alias(c) for c in TRIP_COLUMNS if c.endswith(("_lat", "_lng"))),
        parse_time(F.col("started_at")).alias("_s"), parse_time(F.col("ended_at")).alias("_e"),
    )
    utc = timed.withColumns({"started_at_utc": F.to_utc_timestamp("_s", time_zone), "ended_at_utc": F.to_utc_timestamp("_e", time_zone)})
    lasted = utc.withColumn("duration_seconds", seconds_between(F.col("started_at_utc"), F.col("ended_at_utc")))
    no_time = F.col("started_at_utc").isNull() | F.col("ended_at_utc").isNull()
    no_length = F.coalesce(F.col("duration_seconds") <= 0, F.lit(True))
    no_start, no_end = F.col("start_station_id").isNull(), F.col("end_station_id").isNull()
    flags = codes(
        (no_time, "TIMESTAMP_INVALID"),
        (no_length, "DURATION_NONPOSITIVE"),
        (F.col("duration_seconds") > long_seconds, "DURATION_OVER_24H"),
        (no_start, "START_STATION_MISSING"),
        (no_end, "END_STATION_MISSING"),
        (_off_earth((F.col("start_lat"), F.col("start_lng")), (F.col("end_lat"), F.col("end_lng"))), "COORDINATE_MISSING_OR_INVALID"),
    )
    parts = [x for side, c in (("started", "_s"), ("ended", "_e")) for x in (F.to_date(c).alias(f"{side}_local_date"), F.hour(c).alias(f"{side}_local_hour"), iso_weekday(F.col(c)).alias(f"{side}_iso_weekday"))]
    return lasted.select(
        *lineage,
        F.coalesce("ride_id", hash_parts(*map(F.col, _IDENTITY), null="<null>")).alias("ride_id"), F.col("ride_id").isNull().alias("ride_id_generated"),
        *(c for c in TRIP_COLUMNS if c not in ("ride_id", "started_at", "ended_at")),
        F.col("started_at").alias("started_at_local"), F.col("ended_at").alias("ended_at_local"), "started_at_utc", "ended_at_utc", "duration_seconds",
        *parts, F.year("_s").alias("started_year"), F.month("_s").alias("started_month"),
        flags.alias("quality_flags"), (~no_time & ~no_length & ~(no_start & no_end)).alias("valid_for_demand"),
    )


def deduplicate(trips: DataFrame) -> DataFrame:
    """One row a ride id: the first by source file, then by times and stations, so that ties are settled alike each run."""
    order = ["_source_file", "started_at_local", "ended_at_local", "start_station_id", "end_station_id"]
    turn = F.row_number().over(Window.partitionBy("ride_id").orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    return trips.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def quarantine(trips: DataFrame) -> DataFrame:
    return trips.filter(~F.col("valid_for_demand"))


def flag_counts(trips: DataFrame) -> DataFrame:
    return trips.select(F.explode("quality_flags").alias("quality_flag")).groupBy("quality_flag").agg(F.count("*").alias("trips"))


def run_summary(trips: DataFrame) -> DataFrame:
    """The counts and dates of a batch in one pass, with its duplicates."""
    picked, dropped = F.col("valid_for_demand") & F.col("start_station_id").isNotNull(), F.col("valid_for_demand") & F.col("end_station_id").isNotNull()
    return trips.agg(
        F.count("*").alias("raw_rows"), F.count_distinct("ride_id").alias("silver_rows"), (F.count("*") - F.count_distinct("ride_id")).alias("duplicate_rows"),
        F.count_if(~F.col("valid_for_demand")).alias("quarantine_rows"), (F.count_if(picked) + F.count_if(dropped)).alias("demand_events"),
        F.min("started_local_date").alias("first_start"), F.max("started_local_date").alias("last_start"), F.min("ended_local_date").alias("first_end"), F.max("ended_local_date").alias("last_end"),
    )


def demand_events(trips: DataFrame) -> DataFrame:
    """An endpoint fact for each known end of a valid trip, from one scan."""
    ends = [
        F.struct(F.col(f"{p}_station_id").alias("station_id"), F.col(f"{p}_station_name").alias("station_name"), F.col(f"{t}_local_date").alias("local_date"), F.col(f"{t}_iso_weekday").alias("iso_weekday"), F.col(f"{t}_local_hour").alias("local_hour"), F.lit(a).alias("pickups"), F.lit(b).alias("dropoffs"))
        for p, t, a, b in (("start", "started", 1, 0), ("end", "ended", 0, 1))
    ]
    return trips.filter("valid_for_demand").select("ride_id", F.explode(F.array(*ends)).alias("end")).select("ride_id", "end.*").filter("station_id IS NOT NULL")


def hourly_demand(events: DataFrame) -> DataFrame:
    """Pick-ups and drop-offs by station, date and hour; of several names the smallest."""
    return events.groupBy("station_id", "local_date", "iso_weekday", "local_hour").agg(F.min("station_name").alias("station_name"), F.sum("pickups").cast("long").alias("pickup_count"), F.sum("dropoffs").cast("long").alias("dropoff_count"))


def calendar_hours(trips: DataFrame) -> DataFrame:
    """Every hour from the first to the last start date: a few rows for any number of trips."""
    bounds = trips.filter("valid_for_demand").agg(F.min("started_local_date").alias("a"), F.max("started_local_date").alias("b"))
    days = bounds.filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("local_date"))
    return days.select("local_date", iso_weekday(F.col("local_date")).alias("iso_weekday"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("local_hour"))


def baseline(hourly: DataFrame, calendar: DataFrame) -> DataFrame:
    """Demand by station, weekday and hour over a dense grid: hours without trips count as zero.

    The calendar (all days between two dates) is spread per station from its first and last date, so the grid is a narrow step
    and no cell holds more than its days; the facts join it on its key. Facts outside the calendar don't count.
    """
    stations = hourly.groupBy("station_id").agg(F.min("station_name").alias("station_name"))
    span = calendar.agg(F.struct(F.min("local_date").alias("first"), F.max("local_date").alias("last")).alias("span"))
    days = stations.withColumn("_span", span.scalar()).filter("_span.first IS NOT NULL").select("station_id", "station_name", F.explode(F.sequence("_span.first", "_span.last")).alias("local_date"))
    grid = days.select("station_id", "station_name", "local_date", iso_weekday(F.col("local_date")).alias("iso_weekday"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("local_hour"))
    facts = hourly.groupBy("station_id", "local_date", "local_hour").agg(F.sum("pickup_count").alias("p"), F.sum("dropoff_count").alias("d"))
    dense = grid.join(facts, ["station_id", "local_date", "local_hour"], "left").fillna(0, subset=["p", "d"])
    stats = [x for c, n in (("p", "pickups"), ("d", "dropoffs")) for x in (F.round(F.avg(c), 3).alias(f"avg_{n}"), F.percentile_approx(c, 0.5).cast("long").alias(f"p50_{n}"), F.percentile_approx(c, 0.95).cast("long").alias(f"p95_{n}"))]
    # (station, date, hour) is unique in the grid, so a group has a row a day
    return dense.groupBy("station_id", "iso_weekday", "local_hour").agg(F.min("station_name").alias("station_name"), F.count("*").cast("int").alias("calendar_days"), *stats)


def trip_pipeline(raw: DataFrame) -> dict[str, DataFrame]:
    """Raw trips -> silver, quarantine, hourly, baseline."""
    silver = deduplicate(normalize(raw))
    hourly = hourly_demand(demand_events(silver))
    return {"silver": silver, "quarantine": quarantine(silver), "hourly": hourly, "baseline": baseline(hourly, calendar_hours(silver))}
