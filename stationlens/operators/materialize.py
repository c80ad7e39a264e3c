"""Records of alerts and current states, validated and merged into stored serving tables, a commit a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stationlens.functions.contracts import ALERT, CURRENT_STATE, alert_errors, required_state_errors
from stationlens.functions.expr import hash_parts
from stationlens.operators.observations import latest_by
from stationlens.operators.serving import accepted_in_order, append_once, consumer_offsets, decide_commands, merge_alert_state
from stationlens.sources.store import Store
from stationlens.sources.streams import bad_lines, json_lines

KINDS = {"alert": (ALERT, "alert_json", alert_errors), "current": (CURRENT_STATE, "current_state_json", required_state_errors)}
#: The order of arrival: a place in files or topics, from 0 on; stored rows come before all.
_ARRIVAL = "struct<name: string, block: bigint, row: bigint>"


def _instant(c: Column) -> Column:
    return F.try_to_timestamp(c)


def from_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The records of NDJSON files, in the order of files and lines; a line that is no JSON raises with its place."""
    schema, wrapper, errors = KINDS[kind]
    lines = json_lines(spark, path, schema, wrapper)
    wrong = bad_lines(spark, lines).orderBy("file", "line").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['file']}:{wrong[0]['line']} is not JSON")
    none = F.lit(None)
    return lines.select("record", F.col("body").alias("payload"), F.col("place").cast(_ARRIVAL).alias("arrival"), none.cast("string").alias("topic"), none.cast("bigint").alias("partition"), none.cast("bigint").alias("offset"), errors(F.col("record")).alias("error_codes"))


def from_records(records: DataFrame, kind: str) -> DataFrame:
    """The same from a topic's records; a body that is no JSON has the code MALFORMED_JSON."""
    schema, wrapper, errors = KINDS[kind]
    body = F.coalesce(F.get_json_object("body", f"$.{wrapper}"), F.col("body"))
    arrival = F.struct(F.lit("").alias("name"), F.col("origin.partition").alias("block"), F.col("origin.offset").alias("row"))
    parsed = records.select(F.from_json(body, schema).alias("record"), body.alias("payload"), arrival.alias("arrival"), "origin.topic", "origin.partition", "origin.offset")
    found = F.when(F.get_json_object("payload", "$").isNull(), F.array(F.lit("MALFORMED_JSON"))).otherwise(errors(F.col("record")))
    return parsed.withColumn("error_codes", found)


def alert_rows(parsed: DataFrame) -> DataFrame:
    """Valid alert records as rows of events with what their state needs."""
    a, t = F.col("record"), F.col("record.time")
    changed = _instant(t["status_changed_at_utc"])
    return parsed.select(
        a["alert_event_id"].alias("alert_event_id"), a["alert_id"].alias("alert_id"), a["station"]["station_id"].alias("station_id"), a["station"]["name"].alias("station_name"), a["station"]["short_name"].alias("short_name"),
        *(a[c].alias(c) for c in ("event_type", "lifecycle_status", "alert_type", "recommended_action", "severity")), a["priority"]["score"].cast("decimal(6,2)").alias("priority_score"),
        _instant(t["episode_started_at_utc"]).alias("episode_started_at"), _instant(t["detected_at_utc"]).alias("detected_at"), _instant(t["last_observed_at_utc"]).alias("last_observed_at"), changed.alias("status_changed_at"),
        _instant(t["resolved_at_utc"]).alias("resolved_at"), F.when(a["lifecycle_status"] == "ACKNOWLEDGED", changed).alias("acknowledged_at"), F.lit(None).cast("string").alias("acknowledged_by"),
        "payload", F.col("topic").alias("source_topic"), F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"), "arrival",
    )


def station_rows(parsed: DataFrame) -> DataFrame:
    s = F.col("record")
    return parsed.select(
        s["station_id"].alias("station_id"), s["event_id"].alias("event_id"), _instant(s["event_time_utc"]).alias("event_time"), s["station"]["name"].alias("station_name"), s["station"]["short_name"].alias("short_name"),
        s["availability"]["bikes_available"].alias("bikes_available"), s["availability"]["docks_available"].alias("docks_available"), s["station"]["capacity"].alias("capacity"), s["source_age_seconds"].alias("source_age_seconds"),
        *(s["service"][c].alias(c) for c in ("is_installed", "is_renting", "is_returning")), "payload", "arrival",
    )


def _stored_first(stored: DataFrame, columns: list[str]) -> DataFrame:
    place = F.struct(F.lit("").alias("name"), F.lit(-1).cast("bigint").alias("block"), F.lit(-1).cast("bigint").alias("row"))
    return stored.withColumn("arrival", place).select(*columns)


def merge_alerts(stored_events: DataFrame, stored_state: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events that are new, the alert states with them): only states of alerts that new events touch are folded anew."""
    new = append_once(stored_events, incoming)
    touched = new.select("alert_id").distinct()
    known = stored_state.withColumnsRenamed({"last_event_id": "alert_event_id"})
    fields = [c for c in known.columns if c != "alert_event_id"]
    before = _stored_first(known.join(touched, "alert_id", "left_semi"), ["alert_event_id", *fields, "arrival"])
    folded = merge_alert_state(before.unionByName(new.select("alert_event_id", *fields, "arrival")))
    return new, stored_state.join(touched, "alert_id", "left_anti").unionByName(folded.select(*stored_state.columns))


def merge_stations(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the states that were accepted on their way, the current state of each station): a state must be newer than the one before."""
    both = incoming.unionByName(_stored_first(stored, incoming.columns))
    accepted = accepted_in_order(both, "station_id", "event_time", "arrival", strict=True)
    return accepted.filter("arrival.block >= 0"), latest_by(accepted, "station_id", F.desc("arrival")).select(*stored.columns)


def apply(store: Store, source: str, batch: int, alerts: DataFrame | None = None, states: DataFrame | None = None, strict: bool = True) -> dict[str, int]:
    """Merges parsed records (``from_files``, ``from_records``) into the stored tables as one commit, and says what changed.

    With ``strict`` an invalid record raises and nothing is stored; without, invalid ones are left out. A batch that went in
    before changes nothing. The consumer's offsets go into the same commit.
    """
    counts = {"alert_read": 0, "alert_inserted": 0, "current_read": 0, "current_updated": 0, "invalid": 0}
    if store.seen(source, batch):
        return counts
    state, changes, offsets = store.state(), {}, store.read("consumer_offsets")
    before = offsets
    for kind, parsed in (("current", states), ("alert", alerts)):
        if parsed is None:
            continue
        sums = parsed.agg(F.count("*").alias("n"), F.count_if(F.size("error_codes") > 0).alias("bad"), F.min(F.when(F.size("error_codes") > 0, F.array_join("error_codes", ", "))).alias("first")).first()
        if strict and sums["bad"]:
            raise ValueError(f"{sums['bad']} {kind} records are invalid, for instance {sums['first']}")
        counts[f"{kind}_read"], counts["invalid"] = sums["n"] - sums["bad"], counts["invalid"] + sums["bad"]
        valid = parsed.filter(F.size("error_codes") == 0)
        if kind == "alert":
            new, folded = merge_alerts(store.read("alert_events", state), store.read("alert_state", state), alert_rows(valid))
            counts["alert_inserted"] = new.count()
            changes |= {"alert_events": ("append", new.select(*store.read("alert_events", state).columns)), "alert_state": ("replace", folded)}
        else:
            accepted, current = merge_stations(store.read("station_current", state), station_rows(valid))
            counts["current_updated"] = accepted.count()
            changes["station_current"] = ("replace", current)
        met = consumer_offsets(parsed.filter("topic IS NOT NULL").select("topic", "partition", "offset"))
        offsets = offsets.unionByName(met).groupBy("topic", "partition").agg(F.max("next_offset").alias("next_offset"))
    if offsets is not before:
        changes["consumer_offsets"] = ("replace", offsets)
    store.commit(changes, source, batch)
    return counts


def materialize_files(spark: SparkSession, store: Store, batch: int, alerts: str | None = None, current: str | None = None, source: str = "files") -> dict[str, int]:
    """Files of records into the stored tables; what was read and what changed."""
    return apply(store, source, batch, from_files(spark, alerts, "alert") if alerts else None, from_files(spark, current, "current") if current else None)


def materialize_stream(records: DataFrame, store: Store, kind: str, checkpoint: str, available_now: bool = True, on_batch: Callable[[int, dict], None] | None = None) -> StreamingQuery:
    """A topic into the stored tables: each micro-batch is one commit, with its offsets; a repeated one changes nothing."""

    def put(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            done = apply(store, f"stream-{kind}", batch_id, **{"alerts" if kind == "alert" else "states": from_records(held, kind)}, strict=False)
            if on_batch is not None:
                on_batch(batch_id, done)
        finally:
            held.unpersist()

    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def acknowledge_alerts(store: Store, source: str, batch: int, requests: DataFrame) -> DataFrame:
    """Acknowledge requests (idempotency_key, alert_id, requested_by, acknowledged_at) -> their outcomes; accepted ones are stored.

    An accepted request adds an event to its alert, moves the alert's state and is kept as a command; all in one commit.
    """
    state = store.state()
    events, alerts, commands = (store.read(t, state) for t in ("alert_events", "alert_state", "alert_commands"))
    decided = decide_commands(requests.select("idempotency_key", "alert_id"), commands, alerts)
    # of several accepted requests for one alert the first by key makes the event, the others meet it
    accepted = latest_by(decided.filter("outcome = 'ACCEPTED'"), "alert_id", F.asc("idempotency_key"))
    asked = latest_by(requests, "idempotency_key", F.asc("alert_id")).select("idempotency_key", "requested_by", F.col("acknowledged_at").alias("at"))
    latest = alerts.withColumnsRenamed({"last_event_id": "_last"})
    made = accepted.join(asked, "idempotency_key").join(latest.drop("acknowledged_by", "acknowledged_at"), "alert_id")
    at = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    made = made.withColumn("alert_event_id", hash_parts(F.col("alert_id"), F.lit("ALERT_ACKNOWLEDGED"), at)).persist()
    rows = made.withColumns({
        "event_type": F.lit("ALERT_ACKNOWLEDGED"), "lifecycle_status": F.lit("ACKNOWLEDGED"), "status_changed_at": F.greatest("at", "status_changed_at"), "last_observed_at": F.col("at"), "acknowledged_at": F.col("at"), "acknowledged_by": F.col("requested_by"),
        "source_topic": F.lit(None).cast("string"), "source_partition": F.lit(None).cast("bigint"), "source_offset": F.lit(None).cast("bigint"),
        "arrival": F.struct(F.lit("").alias("name"), F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("row")),
    })
    new, folded = merge_alerts(events, alerts, rows)
    kept = made.select("command_id", "idempotency_key", "alert_id", F.lit("ACKNOWLEDGE").alias("command"), "requested_by", F.col("at").alias("acknowledged_at"), F.col("alert_event_id").alias("result_event_id"))
    outcomes = decided.persist()
    outcomes.count()  # decided by the state before
    store.commit({"alert_events": ("append", new.select(*events.columns)), "alert_state": ("replace", folded), "alert_commands": ("append", kept)}, source, batch)
    return outcomes
