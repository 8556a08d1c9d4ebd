"""Shared plumbing of the training-data operators: scratch tables and input normalisation.

Scratch tables live in the folder that the cluster names in ``spark.checkpoint.dir``, which the
driver and all executors share. They cut lineage: a lost executor costs at most the stage that
was running, never an earlier pass over the corpus.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark hands to a Python worker at once; small enough for documents of 100 kB.
ARROW_ROWS = 512

_scratch: dict[str, SparkSession] = {}
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local temporary one only where the session names none (tests)."""
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="strandwise-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, removed by ``discard``, at the end of the ``scratch_scope`` that it was made in, or when
    the interpreter ends."""
    path = f"{shared_dir(spark)}/strandwise-{uuid.uuid4().hex}"
    _scratch[path] = spark
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and its size is known to the planner."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(path: str) -> None:
    spark = _scratch.pop(path, None)
    if spark is None:
        return
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; the folder is then the cluster's to clean
        pass


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing lazy reads any more."""
    for t in tables:
        _delete(t._scratch_path)


@contextlib.contextmanager
def scratch_scope(keep: list[DataFrame] | None = None) -> Iterator[None]:
    """Deletes at its end what was made within it, but for tables put into ``keep``; other scratch tables aren't touched."""
    mine: list[str] = []
    token = _scope.set(mine)
    try:
        yield
    finally:
        _scope.reset(token)
        kept = {t._scratch_path for t in keep or []}
        for path in mine:
            if path not in kept:
                _delete(path)
            elif (outer := _scope.get()) is not None:
                outer.append(path)


@atexit.register
def _delete_all() -> None:
    for path in list(_scratch):
        _delete(path)


def set_apart(df: DataFrame, used: tuple[str, ...], inner: tuple[str, ...], made: tuple[str, ...], *more: Column) -> tuple[DataFrame, list[Column]]:
    """df with ``more`` columns, safe to add columns ``inner`` and ``made`` to, and how to select its own columns again.

    If an unused column has one of these names (in any case), all unused columns travel in one struct. A column named like
    one in ``made`` gives way to it; all others come back.
    """
    clash = {c.lower() for c in (*inner, *made)}
    if not any(c.lower() in clash for c in df.columns if c not in used):
        return df.select("*", *more) if more else df, [F.col(f"`{c}`") for c in df.columns]
    rest = [c for c in df.columns if c not in used]
    gone = {c.lower() for c in made}
    back = [F.col(f"`{c}`") if c in used else F.col("_rest").getField(f"c{rest.index(c)}").alias(c) for c in df.columns if c.lower() not in gone]
    packed = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest))).alias("_rest")
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c in used), packed, *more), back


def small_batches(spark: SparkSession) -> None:
    """Python functions get at most ARROW_ROWS rows at once. All operators set the same, so none changes what another has planned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``rows`` rows; for short rows only."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
