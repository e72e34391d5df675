"""Checkpoints and written tables in the folder the cluster shares."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from typing import NamedTuple
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Paths written inside ``passing_tables``; None outside.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``; fall back to a scratch folder in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="gradebook-checkpoint-")
    context.setCheckpointDir(configured)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder and read from there by every later use."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new place in the checkpoint folder, read back from there.

    Unlike a checkpoint the copy is columnar: later scans prune columns, push
    filters down and know the size of the table. It is removed when the application ends.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are removed at the end, but for those of ``kept_table``.

    Nothing that still reads them may be used afterwards. Checkpoints stay.
    """
    before = _passing.set([])
    try:
        yield
    finally:
        folders = _passing.get()
        _passing.reset(before)
        for path in folders:
            _folder_of(spark, path).delete()


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """``written_once``, inside ``passing_tables`` for a table that outlives it."""
    mine = _passing.set(None)
    try:
        return written_once(df, name)
    finally:
        _passing.reset(mine)


def remove_table(df: DataFrame) -> None:
    """Remove what ``written_once`` or ``kept_table`` wrote for ``df``, which must not be read afterwards."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        _folder_of(df.sparkSession, path).delete()


def at_once(spark: SparkSession, *steps: Callable[[], object]) -> list:
    """The results of steps that do not need each other. Their jobs share the cluster, so the ends of one's stages leave no core idle.

    All steps end before an error of one is raised.
    """
    ensure_checkpoint_dir(spark)
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(copy_context().run, inheritable_thread_target(spark)(step)) for step in steps]
    return [r.result() for r in running]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the checkpoint folder that is not used yet; what is written there is removed when the application ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid4().hex}/{name}"
    folder = _folder_of(spark, path)
    folder.files.mkdirs(folder.path)
    folder.files.deleteOnExit(folder.path)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    return path


class _Folder(NamedTuple):
    files: object
    path: object

    def delete(self) -> None:
        self.files.delete(self.path, True)


def _folder_of(spark: SparkSession, path: str) -> _Folder:
    """The folder that ``new_folder`` made for a path, in its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    return _Folder(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder)
