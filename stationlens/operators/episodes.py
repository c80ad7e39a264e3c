"""Risk episodes in batch form: runs of one risk, when they open and when they resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationlens.functions import rules
from stationlens.functions.expr import hash_parts, utc_text
from stationlens.functions.rules import RuleConfig


def with_previous(states: DataFrame) -> DataFrame:
    """Each state with the one before it at its station: risk, bikes, docks, and the onset trend."""
    w = Window.partitionBy("station_id").orderBy("event_time", "event_id")
    lagged = states.withColumns({f"previous_{c}": F.lag(c).over(w) for c in ("risk", "bikes", "docks")})
    return lagged.withColumn("trend", rules.onset_trend(F.col("risk"), F.col("previous_bikes"), F.col("previous_docks"), F.col("bikes"), F.col("docks")))


def risk_runs(states: DataFrame) -> DataFrame:
    """Rows (station_id, event_id, event_time, bikes, docks, risk) with ``run``: the number of their run of equal risk."""
    w = Window.partitionBy("station_id").orderBy("event_time", "event_id")
    starts = F.coalesce(F.col("risk") != F.col("previous_risk"), F.lit(True))
    return with_previous(states).withColumn("run", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def episodes(states: DataFrame, cfg: RuleConfig, source_system: str) -> DataFrame:
    """A row a run that is not balanced: start, end of observation, when it opened (null: never) and resolved (null: not yet).

    An alert opens at the first observation that is ``persistence_seconds`` after its run's start and resolves at the
    first observation of the next run. (station, risk, start) is the alert's identity.
    """
    marked = risk_runs(states)
    run = Window.partitionBy("station_id", "run")
    began = F.min("event_time").over(run)
    waited = F.unix_timestamp("event_time") - F.unix_timestamp(began)
    timed = marked.withColumn("opens", F.when(waited >= cfg.persistence_seconds, F.col("event_time")))
    runs = timed.groupBy("station_id", "run").agg(
        F.min("risk").alias("risk"), F.min("event_time").alias("started_at"), F.max("event_time").alias("last_seen_at"), F.count("*").alias("observations"),
        F.min("opens").alias("opened_at"), F.min_by("trend", F.struct("event_time", "event_id")).alias("trend"),
    )
    following = F.lead("started_at").over(Window.partitionBy("station_id").orderBy("run"))
    out = runs.withColumn("next_started_at", following).filter("risk <> 'BALANCED'")
    alert_id = hash_parts(F.lit(source_system), F.col("station_id"), F.col("risk"), utc_text(F.col("started_at")))
    return out.select("station_id", "risk", "started_at", "last_seen_at", "observations", "opened_at", F.when(F.col("opened_at").isNotNull(), F.col("next_started_at")).alias("resolved_at"), "trend", alert_id.alias("alert_id"))


def lifecycle_events(found: DataFrame) -> DataFrame:
    """Opened and resolved events of the episodes that opened."""
    pair = F.array(
        F.struct(F.lit("ALERT_OPENED").alias("event_type"), F.lit("OPEN").alias("lifecycle_status"), F.col("opened_at").alias("event_time")),
        F.struct(F.lit("ALERT_RESOLVED").alias("event_type"), F.lit("RESOLVED").alias("lifecycle_status"), F.col("resolved_at").alias("event_time")),
    )
    events = found.filter("opened_at IS NOT NULL").select("station_id", "alert_id", "risk", "started_at", F.explode(pair).alias("e")).select("station_id", "alert_id", "risk", "started_at", "e.*").filter("event_time IS NOT NULL")
    return events.withColumn("alert_event_id", hash_parts(F.col("alert_id"), F.col("event_type"), utc_text(F.col("event_time"))))


def replay(states: DataFrame, cfg: RuleConfig, source_system: str) -> DataFrame:
    """All lifecycle events, updates included, by the stream's own machine over each station's states in order.

    An update depends on the last one sent, so no window expresses it; the station's rows go through the machine as a
    sorted iterator of Arrow batches, not as one table.
    """
    from stationlens.session import ship
    from stationlens.streaming.machines import replay_batches

    ship(states.sparkSession)
    rows = states.select("station_id", "event_time", "input_offset", "event_id", "current_state_json")
    schema = "station_id string, alert_id string, alert_event_id string, event_time timestamp, event_type string, lifecycle_status string, priority_score double, alert_json string"
    # one partition holds whole stations, each in order
    return rows.repartition("station_id").sortWithinPartitions("station_id", "event_time", "input_offset").mapInPandas(replay_batches(cfg, source_system), schema)
