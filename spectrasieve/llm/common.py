"""What the training-data operators share: tables in the shared folder and the memory of workers."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrasieve import shared

_SCOPES: list[list[str]] = []
_HELD: dict[str, dict] = {}


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder (by Parquet's ``codec``, if given) and read it again.

    This cuts the lineage: what follows survives lost executors without recomputing,
    and a frame that is used more than once is computed once.
    """
    spark = df.sparkSession
    at = f"{shared.folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at, compression=codec)
    if _SCOPES:
        _SCOPES[-1].append(at)
    made = spark.read.schema(df.schema).parquet(at)
    made.cut_at = at
    return made


def keep(df: DataFrame) -> DataFrame:
    """A table that :func:`cut` wrote outlives the innermost :func:`scratch`."""
    if _SCOPES and df.cut_at in _SCOPES[-1]:
        _SCOPES[-1].remove(df.cut_at)
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(df.cut_at)
    return df


def drop_cut(*frames: DataFrame) -> None:
    """Delete tables that :func:`cut` wrote and nothing will read again."""
    for df in frames:
        _delete(df.sparkSession, df.cut_at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables cut inside are deleted at the end, but for those that :func:`keep` names."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for at in _SCOPES.pop():
            _delete(spark, at)


def few(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counting stops there."""
    return df.limit(rows + 1).count() <= rows


def sized(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` hinted for a join: broadcast if it has at most ``rows`` (narrow) rows, else a merge join."""
    return F.broadcast(df) if few(df, rows) else df.hint("merge")


def held(owner: str) -> dict:
    """What tasks of one operator keep in a worker from task to task; a task of another lets it go."""
    if owner not in _HELD:
        _HELD.clear()
        _HELD[owner] = {}
        trim()
    return _HELD[owner]


def trim() -> None:
    """Give free memory of this process back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def by_batch(df: DataFrame, task, schema: str, owner: str = "") -> DataFrame:
    """``df.mapInArrow(task, schema)`` with bounded memory.

    Batches hold at most 4 MB (and a row) unless the session sets its own ``maxBytesPerBatch``. A task
    lets go what other operators hold in its worker and gives free memory back when it ends.
    """
    conf, default = df.sparkSession.conf, "67108864b"
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == default:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))

    def run(batches):
        held(owner)
        try:
            yield from task(batches)
        finally:
            trim()

    return df.mapInArrow(run, schema)
