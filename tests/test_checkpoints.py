"""Where checkpoints and written tables go."""

from pathlib import Path

import pytest

from gradebook.sources.checkpoints import ensure_checkpoint_dir, kept_table, passing_tables, remove_table, written_once


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master, **conf):
        self.sparkContext, self.conf = Context(master), conf


def test_the_folder_named_by_the_cluster_is_used():
    session = Session("yarn", **{"spark.checkpoint.dir": "hdfs:///shared"})
    ensure_checkpoint_dir(session)
    assert session.sparkContext.folder == "hdfs:///shared"


def test_a_folder_already_set_is_kept():
    session = Session("yarn", **{"spark.checkpoint.dir": "hdfs:///other"})
    session.sparkContext.folder = "hdfs:///set"
    ensure_checkpoint_dir(session)
    assert session.sparkContext.folder == "hdfs:///set"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session("yarn"))
    local = Session("local[2]")
    ensure_checkpoint_dir(local)
    assert "gradebook-checkpoint-" in local.sparkContext.folder


def test_a_written_table_is_read_back_whole(spark):
    frame = spark.range(1000).withColumnRenamed("id", "n")
    copy = written_once(frame, "numbers")
    assert copy.exceptAll(frame).count() == 0 and copy.count() == 1000
    assert "FileScan parquet" in copy._jdf.queryExecution().executedPlan().toString()


def folder_of(df):
    return Path(df.inputFiles()[0].removeprefix("file://")).parent


def test_passing_tables_are_removed(spark):
    with passing_tables(spark):
        step = folder_of(written_once(spark.range(9), "step"))
        kept = kept_table(spark.range(8), "kept")
        last = folder_of(written_once(kept, "last"))
        assert step.exists() and last.exists()
    assert not step.exists() and not last.exists() and kept.count() == 8
    place = folder_of(kept)
    remove_table(kept)
    assert not place.exists()
    with pytest.raises(ZeroDivisionError), passing_tables(spark):
        step = folder_of(written_once(spark.range(9), "step"))
        1 / 0
    assert not step.exists() and folder_of(written_once(spark.range(1), "outside")).exists()
