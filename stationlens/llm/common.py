"""Shared plumbing: scratch tables in the folder that all executors see."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import pickle
import traceback
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from stationlens.session import delete, ship, work_dir


#: Rows and bytes of an Arrow batch: texts are long rows, and a batch is held by the executor and its worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ships the package and keeps Arrow batches small; sizes that the session sets smaller stay."""
    ship(spark)
    for key, most in ((_ROWS, BATCH_ROWS), (_BYTES, BATCH_BYTES)):
        now = spark.conf.get(key, None)
        size = int(now) if now and now.lstrip("-").isdigit() else 0
        if not 0 < size <= most:
            spark.conf.set(key, str(most))


class Scratch:
    """Tables written to the shared folder so that a lost executor costs one stage, not the lineage.

    ``keep`` writes a table and reads it back; ``drop`` deletes tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession) -> None:
        prepare(spark)
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{work_dir(self.spark)}/llm/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        atexit.register(delete, self.spark, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names or list(self.paths):
            for path in self.paths.pop(name, []):
                delete(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as it takes to be none of ``columns`` (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a written table has at most so many rows; asked before it is broadcast."""
    return df.limit(rows + 1).count() <= rows


def semi_by_id(df: DataFrame, ids: DataFrame, key: str, rows: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids``: broadcast up to ``rows`` ids (8 bytes each), else a shuffled join."""
    side = F.broadcast(ids) if small_enough(ids, rows) else ids
    return df.join(side, key, "left_semi")


def in_one_task(rows: DataFrame, make: Callable[[pa.Table], object]) -> object:
    """What ``make`` returns for all of ``rows`` (a bounded sample or table of statistics), worked out by one task.

    So neither the rows nor what training leaves behind are held by the driver, and a lost executor costs the task. The
    work is done by a child of the task's worker, as a worker lives on and may keep memory that it has freed.
    """
    schema = to_arrow_schema(rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_caches("one task", int)
        made = _by_a_child(make, pa.Table.from_batches([b.cast(schema) for b in batches], schema))
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["made"])

    return pickle.loads(rows.repartition(1).mapInArrow(run, "made binary").first()["made"])


def _by_a_child(make: Callable[[pa.Table], object], table: pa.Table) -> bytes:
    """``make(table)``, pickled, from a process of its own."""
    read, write = os.pipe()
    child = os.fork()
    if not child:
        status = 1
        try:
            os.close(read)
            with os.fdopen(write, "wb") as out:
                try:
                    out.write(pickle.dumps(make(table)))
                    status = 0
                except BaseException:  # noqa: BLE001  told to the parent
                    out.write(traceback.format_exc().encode())
        finally:
            os._exit(status)
    os.close(write)
    with os.fdopen(read, "rb") as said:
        made = said.read()
    if os.waitpid(child, 0)[1]:
        raise RuntimeError(f"the work of one task failed: {made.decode(errors='replace')}")
    return made


def in_slices(batch: pa.RecordBatch, column: int, most_bytes: int = 400_000) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have so many bytes together (or are one row), so that work on them stays small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end


_OWNER: dict[str, Callable[[], object]] = {}
#: Returns free heap pages; only the GNU C library has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def own_caches(name: str, clear: Callable[[], object]) -> None:
    """Called by an operator's tasks in a worker: what another operator kept there before is given up, and freed memory
    goes back to the system, as workers share a machine with their executor."""
    if name not in _OWNER:
        for other in _OWNER.values():
            other()
        _OWNER.clear()
        _OWNER[name] = clear
        gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
