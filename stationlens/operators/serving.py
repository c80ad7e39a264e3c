"""Serving views and merges: append-once events, guarded upserts, queue and pages, acknowledgements, gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlens.functions.expr import hash_parts, utc_text
from stationlens.operators.observations import latest_by
from stationlens.operators.ranking import ranked


def append_once(existing: DataFrame, incoming: DataFrame, key: str = "alert_event_id") -> DataFrame:
    """The incoming rows that are new, each key once."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti").select(*incoming.columns)


def accepted_in_order(events: DataFrame, key: str, time: str, arrival: str, strict: bool = False) -> DataFrame:
    """The events that a guard on ``time`` lets pass in order of arrival: not older (``strict``: newer) than any before."""
    before = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max(time).over(before)
    passes = newest.isNull() | ((F.col(time) > newest) if strict else (F.col(time) >= newest))
    return events.withColumn("_passes", passes).filter("_passes").drop("_passes")


def merge_alert_state(events: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Alert events in order of arrival -> a row an alert.

    Events older than the state are kept out. Resolved is final; acknowledged stays over open. When an episode started and was
    detected stays as first given; the rest is the last accepted event's; times of resolution and acknowledgement are the last
    that an accepted event gave. (An open event after an accepted resolution cannot bring the alert back, an acknowledgement
    after one cannot either.) A stored state counts as an event that arrived before all others.
    """
    status = F.col("lifecycle_status")
    if "acknowledged_at" not in events.columns:
        events = events.withColumn("acknowledged_at", F.when(status == "ACKNOWLEDGED", F.col("status_changed_at")))
    passed = accepted_in_order(events, "alert_id", "status_changed_at", arrival)
    kept, given = {"episode_started_at", "detected_at"}, {"resolved_at", "acknowledged_at", "acknowledged_by"}
    columns = []
    for c in events.columns:
        if c in ("alert_id", arrival):
            continue
        if c == "lifecycle_status":
            reached = lambda s: F.max(F.coalesce(status == s, F.lit(False)))
            columns.append(F.when(reached("RESOLVED"), "RESOLVED").when(reached("ACKNOWLEDGED"), "ACKNOWLEDGED").otherwise(F.max_by(c, arrival)).alias(c))
        elif c in given:
            columns.append(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(arrival))).alias(c))
        else:
            columns.append((F.min_by if c in kept else F.max_by)(c, arrival).alias("last_event_id" if c == "alert_event_id" else c))
    return passed.groupBy("alert_id").agg(*columns)


def merge_station_state(observations: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The current state a station under a strict guard: of equal times the first to arrive."""
    return latest_by(observations, "station_id", F.desc("event_time"), F.asc(arrival))


def priority_queue(events: DataFrame) -> DataFrame:
    """The latest event of each alert that is not resolved, ranked over all by ranges of the order."""
    active = latest_by(events, "alert_id", F.desc("event_time"), F.desc("alert_event_id")).filter("lifecycle_status <> 'RESOLVED'")
    return ranked(active, [F.desc("priority_score"), F.asc("event_time"), F.asc("alert_id")], "queue_rank").withColumn("queue_rank", F.col("queue_rank").cast("int"))


def alert_page(state: DataFrame, *, active_only: bool = True, status: str | None = None, action: str | None = None, alert_type: str | None = None, station_id: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset at least 0")
    rows = state.filter("lifecycle_status <> 'RESOLVED'") if active_only else state
    for name, value in (("lifecycle_status", status), ("recommended_action", action), ("alert_type", alert_type), ("station_id", station_id)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows.orderBy(F.desc("priority_score"), "detected_at", "alert_id").offset(offset).limit(limit)


def station_page(stations: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return stations.orderBy(F.desc("event_time"), "station_id").offset(offset).limit(limit)


def alert_history(events: DataFrame, alert_id: str) -> DataFrame:
    return events.filter(F.col("alert_id") == alert_id).orderBy("event_time", "alert_event_id")


def one_row(df: DataFrame, key: str, value: str) -> dict:
    """The row with this key as a dict; there being none is a ``LookupError``."""
    found = df.filter(F.col(key) == value).limit(1).collect()
    if not found:
        raise LookupError(f"{key} {value} was not found")
    return found[0].asDict(recursive=True)


def alert_documents(state: DataFrame) -> DataFrame:
    """Stored alert states in the shape that readers get: alert_id and ``document``; evidence and priority are the payload's."""
    utc = lambda c: utc_text(F.col(c)).alias(f"{c}_utc")
    part = lambda c, schema: F.from_json(F.get_json_object("payload", f"$.{c}"), schema).alias(c)
    acknowledged = F.when(F.col("acknowledged_at").isNotNull(), F.struct(utc("acknowledged_at"), "acknowledged_by"))
    return state.select(
        "alert_id",
        F.struct(
            "alert_id", "last_event_id", F.struct("station_id", F.col("station_name").alias("name"), "short_name").alias("station"), "alert_type", "lifecycle_status", "recommended_action", "severity",
            part("priority", "score double, rule_version string, components map<string, double>"), part("evidence", "risk_duration_seconds bigint, bikes_available bigint, docks_available bigint, is_renting boolean, is_returning boolean, source_age_seconds bigint, reason_codes array<string>"),
            F.struct(*(utc(c) for c in ("episode_started_at", "detected_at", "last_observed_at", "status_changed_at", "resolved_at"))).alias("time"), acknowledged.alias("acknowledgement"),
        ).alias("document"),
    )


def latest_acknowledgements(events: DataFrame, payload: str = "payload") -> DataFrame:
    """The last acknowledgement of each alert that has one: its event id, time and payload."""
    acks = events.filter("event_type = 'ALERT_ACKNOWLEDGED'")
    return latest_by(acks, "alert_id", F.desc("status_changed_at"), F.desc("alert_event_id")).select("alert_id", "alert_event_id", "status_changed_at", payload)


def gives_all(reasons: Column, required: list[str]) -> Column:
    """Whether an array holds all of the required values."""
    return F.size(F.array_except(F.array(*map(F.lit, required)), reasons)) == 0


def acknowledge(events: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(acknowledgement events to append, commands on alerts that are not active).

    ``commands``: (alert_id, acknowledged_at). One that was applied already is skipped, so replaying commands is safe.
    """
    wanted = commands.distinct().withColumn("alert_event_id", hash_parts(F.col("alert_id"), F.lit("ALERT_ACKNOWLEDGED"), F.date_format("acknowledged_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    pending = wanted.join(events.select("alert_event_id"), "alert_event_id", "left_anti")
    active = latest_by(events, "alert_id", F.desc("event_time"), F.desc("alert_event_id")).filter("lifecycle_status <> 'RESOLVED'").drop("alert_event_id")
    made = pending.join(active, "alert_id").withColumns({"event_type": F.lit("ALERT_ACKNOWLEDGED"), "lifecycle_status": F.lit("ACKNOWLEDGED"), "event_time": F.col("acknowledged_at")})
    return made.drop("acknowledged_at").select(*events.columns), pending.join(active.select("alert_id"), "alert_id", "left_anti")


def decide_commands(commands: DataFrame, applied: DataFrame, state: DataFrame) -> DataFrame:
    """What becomes of acknowledge commands (idempotency_key, alert_id): ``outcome`` and ``command_id``.

    ``applied``: (idempotency_key, alert_id) of commands done before. A key that was used for the same alert is REPLAYED,
    for another one a CONFLICT; then an unknown alert is NOT_FOUND, a resolved one a CONFLICT, an acknowledged one
    ALREADY_ACKNOWLEDGED (its event is the answer), an open one ACCEPTED. Of several commands of one key the first by alert counts.
    """
    first = latest_by(commands, "idempotency_key", F.asc("alert_id"))
    known = applied.select("idempotency_key", F.col("alert_id").alias("_used_for"))
    joined = first.join(known, "idempotency_key", "left").join(state.select("alert_id", F.col("lifecycle_status").alias("_status")), "alert_id", "left")
    outcome = (
        F.when(F.col("_used_for") == F.col("alert_id"), "REPLAYED")
        .when(F.col("_used_for").isNotNull(), "CONFLICT")
        .when(F.col("_status").isNull(), "NOT_FOUND")
        .when(F.col("_status") == "RESOLVED", "CONFLICT")
        .when(F.col("_status") == "ACKNOWLEDGED", "ALREADY_ACKNOWLEDGED")
        .otherwise("ACCEPTED")
    )
    return joined.select("idempotency_key", "alert_id", outcome.alias("outcome"), hash_parts(F.col("idempotency_key"), F.col("alert_id"), F.lit("ACKNOWLEDGE")).alias("command_id"))


def consumer_offsets(records: DataFrame) -> DataFrame:
    return records.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))


def offsets_by_topic(offsets: DataFrame) -> DataFrame:
    """How many records of each topic have been stored: the sum of its partitions' next offsets."""
    return offsets.groupBy("topic").agg(F.sum("next_offset").cast("long").alias("stored"))


def health(stations: DataFrame, alerts: DataFrame) -> dict[str, object]:
    """Whether the serving tables answer: ready with their counts, or not ready with the reason."""
    try:
        return {"status": "ready", "stations": stations.count(), "active_alerts": alerts.filter("lifecycle_status <> 'RESOLVED'").count()}
    except Exception as e:  # noqa: BLE001  what the caller is told
        return {"status": "not_ready", "error": f"{type(e).__name__}: {str(e)[:200]}"}


def gauges(stations: DataFrame, alerts: DataFrame, now: Column) -> DataFrame:
    """One row of service gauges from two scans."""
    s = stations.agg(F.count("*").alias("station_rows"), F.coalesce(F.max("source_age_seconds"), F.lit(0)).alias("reported_source_age_seconds"), F.coalesce(F.greatest(F.lit(0).cast("long"), F.unix_timestamp(now) - F.unix_timestamp(F.max("event_time"))), F.lit(0)).alias("projection_age_seconds"))
    active = alerts.agg(F.count_if(F.col("lifecycle_status") != "RESOLVED").alias("n"))
    critical = alerts.agg(F.count_if((F.col("lifecycle_status") == "OPEN") & (F.col("severity") == "CRITICAL")).alias("n"))
    return s.withColumns({"active_alerts": active.scalar(), "critical_unacknowledged_alerts": critical.scalar()})


def search(state: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text, in any case, in one of the columns."""
    return state.filter(F.lower(F.concat_ws(" ", *columns)).contains(text.lower()))


def orphans(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Rows whose key has no parent: what a foreign key would refuse."""
    return child.join(parent.select(on).distinct(), on, "left_anti")
