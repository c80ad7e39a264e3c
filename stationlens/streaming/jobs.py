"""The streaming jobs: sources, branches, sinks with a checkpoint each, and what is made of their output afterwards."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stationlens.functions.contracts import ALERT, dead_letters, parse_current_states, parse_observations
from stationlens.functions.expr import utc_text
from stationlens.functions.rules import RuleConfig
from stationlens.operators.observations import latest_state, window_metrics, with_baseline
from stationlens.operators.serving import acknowledge, priority_queue
from stationlens.session import exists, written
from stationlens.streaming.processors import ALERTS, LATEST, alert_events, latest_states


def valid_observations(parsed: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    r = F.col("record")
    return (
        parsed.filter("is_valid")
        .select(
            r["station"]["station_id"].alias("station_id"), r["station"]["short_name"].alias("short_name"), r["event_id"].alias("event_id"), "event_time",
            r["time"]["snapshot_updated_at_utc"].alias("event_time_utc"), F.col("raw_value").alias("observation_json"),
            r["availability"]["bikes_available"].alias("bikes"), r["availability"]["docks_available"].alias("docks"), r["time"]["source_age_seconds"].alias("source_age_seconds"), "input_partition", "input_offset",
        )
        .withWatermark("event_time", watermark)
    )


def closed_windows(events: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Window metrics of a stream, each event id counted once within the watermark."""
    return window_metrics(events.dropDuplicatesWithinWatermark(["event_id"]), width)


def valid_states(parsed: DataFrame, watermark: str) -> DataFrame:
    r = F.col("record")
    return parsed.filter("is_valid").select(r["station_id"].alias("station_id"), r["event_id"].alias("event_id"), F.col("raw_value").alias("current_state_json"), "event_time", "input_partition", "input_offset").withWatermark("event_time", watermark)


def write_batches(df: DataFrame, path: str, checkpoint: str, mode: str, available_now: bool = True) -> StreamingQuery:
    """A JSON sink that a repeated batch cannot double: each batch owns a folder, which it overwrites."""

    def put(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # asked whether it is empty and then written, from one run of its plan
        try:
            if not held.isEmpty():
                held.write.mode("overwrite").json(f"{path}/batch_id={batch_id}")
        finally:
            held.unpersist()

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_ordered(df: DataFrame, path: str, checkpoint: str, value: str, *order: str) -> StreamingQuery:
    """Lines of text in order within each batch; a batch owns a folder whose files follow each other by name."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.orderBy(*order).select(F.col(value).alias("value")).write.mode("overwrite").text(f"{path}/batch_id={batch_id}")

    return df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


#: What each output of the jobs is keyed by in a topic.
KEYS = {
    "dead_letters": lambda: F.col("record_key"),
    "current_state": lambda: F.col("station_id"),
    "windows": lambda: F.concat_ws("|", "station_id", utc_text(F.col("window_end"))),
    "alerts": lambda: F.col("station_id"),
}
#: Outputs that are documents already; of the others all columns make one.
DOCUMENTS = {"current_state": "current_state_json", "alerts": "alert_json"}

#: How an output (data, its name, its mode) is written.
Sink = Callable[[DataFrame, str, str], StreamingQuery]


def as_messages(df: DataFrame, name: str) -> DataFrame:
    """An output as keys and values of a topic."""
    value = F.col(DOCUMENTS[name]) if name in DOCUMENTS else F.to_json(F.struct("*"))
    return df.select(KEYS[name]().cast("string").alias("key"), value.alias("value"))


def file_sink(out: str, checkpoints: str, available_now: bool = True) -> Sink:
    return lambda df, name, mode: write_batches(df, f"{out}/{name}", f"{checkpoints}/{name}", mode, available_now)


def kafka_sink(servers: str, topics: dict[str, str], checkpoints: str, available_now: bool = True) -> Sink:
    """A topic an output, each with its own checkpoint and mode; needs the connector on the classpath."""

    def put(df: DataFrame, name: str, mode: str) -> StreamingQuery:
        writer = as_messages(df, name).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topics[name])
        writer = writer.option("checkpointLocation", f"{checkpoints}/{name}").outputMode(mode).queryName(f"kafka-{name}")
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    return put


def memory_sink(prefix: str) -> Sink:
    """Keys and values in tables of the driver's memory: for tests and demonstrations."""
    return lambda df, name, mode: as_messages(df, name).writeStream.format("memory").queryName(f"{prefix}_{name}").outputMode(mode).trigger(availableNow=True).start()


def station_job(records: DataFrame, baseline: DataFrame, sink: Sink, cfg: RuleConfig | None = None, source_system: str | None = None) -> dict[str, StreamingQuery]:
    """Dead letters, current states and closed windows of an observation stream: three queries, a checkpoint each."""
    cfg = cfg or RuleConfig()
    parsed = parse_observations(records, source_system) if source_system else parse_observations(records)
    events = valid_observations(parsed, cfg.watermark_delay)
    outputs = {
        "dead_letters": (dead_letters(parsed), "append"),
        "current_state": (latest_states(with_baseline(events, baseline), cfg.dedup_ttl_seconds), "update"),
        "windows": (closed_windows(events), "append"),
    }
    return {name: sink(df, name, mode) for name, (df, mode) in outputs.items()}


def alert_job(records: DataFrame, sink: Sink, cfg: RuleConfig, source_system: str) -> dict[str, StreamingQuery]:
    parsed = parse_current_states(records)
    outputs = {"dead_letters": (dead_letters(parsed), "append"), "alerts": (alert_events(valid_states(parsed, cfg.watermark_delay), cfg, source_system), "update")}
    return {name: sink(df, name, mode) for name, (df, mode) in outputs.items()}


def finish(queries: dict[str, StreamingQuery]) -> None:
    for q in queries.values():
        q.awaitTermination()


def read_output(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(path)


def current_snapshot(spark: SparkSession, out: str) -> DataFrame:
    return latest_state(read_output(spark, f"{out}/current_state", LATEST))


def queue_snapshot(spark: SparkSession, out: str) -> DataFrame:
    return priority_queue(read_output(spark, f"{out}/alerts", ALERTS))


def acknowledge_commands(spark: SparkSession, path: str) -> DataFrame:
    """Acknowledge commands from JSON lines: (alert_id, acknowledged_at); blank lines don't count."""
    raw = spark.read.schema("alert_id string, acknowledged_at_utc string").json(path).filter("alert_id IS NOT NULL")
    return raw.select("alert_id", F.try_to_timestamp("acknowledged_at_utc").alias("acknowledged_at"))


def apply_acknowledgements(spark: SparkSession, out: str, commands: DataFrame) -> int:
    """Adds the acknowledgements that commands ask for to an alert job's events, in a folder of their own; how many.

    A command that was applied before adds nothing; one on an alert that is not active raises, and nothing is written.
    """
    events = read_output(spark, f"{out}/alerts", ALERTS)
    made, refused = acknowledge(events, commands)
    lost = refused.limit(1).collect()
    if lost:
        raise ValueError(f"alert {lost[0]['alert_id']} is not active and can't be acknowledged")
    a, at = F.from_json("alert_json", ALERT), utc_text(F.col("event_time"))
    document = a.withField("event_type", F.col("event_type")).withField("lifecycle_status", F.col("lifecycle_status")).withField("alert_event_id", F.col("alert_event_id"))
    for field in ("time.status_changed_at_utc", "time.last_observed_at_utc", "lineage.generated_at_utc"):
        document = document.withField(field, at)
    made = written(made.withColumn("alert_json", F.to_json(document, {"ignoreNullFields": "false"})), "acknowledged")
    many = made.count()
    if many:
        made.write.json(f"{out}/alerts/batch_id=acknowledged-{uuid.uuid4().hex}")
    return many


def materialize_outputs(spark: SparkSession, out: str, commands: DataFrame | None = None) -> dict[str, int]:
    """After a run: acknowledgements, then the current snapshot and the priority queue, each overwritten as a whole."""
    counts = {}
    if commands is not None:
        counts["acknowledged"] = apply_acknowledgements(spark, out, commands)
    for name, source, make in (("current_snapshot", "current_state", current_snapshot), ("priority_queue", "alerts", queue_snapshot)):
        if exists(spark, f"{out}/{source}"):
            done = written(make(spark, out), name)
            done.write.mode("overwrite").json(f"{out}/{name}")
            counts[name] = done.count()
    return counts
