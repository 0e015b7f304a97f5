import os
import time

from eventlens.llm.common import CLEANUP, clear_scratch, discard, numbered, only, stored


def folder(df):
    return df.scratch.removeprefix("file://").removeprefix("file:")


def test_stored_tables_are_deleted_when_asked(spark):
    clear_scratch(spark)
    a, b = stored(spark.range(3), "test"), stored(spark.range(4), "test")
    assert os.path.isdir(folder(a)) and b.count() == 4
    discard(a)
    assert not os.path.isdir(folder(a))
    assert clear_scratch(spark) == 1 and not os.path.isdir(folder(b)) and clear_scratch(spark) == 0


def test_numbered_takes_a_free_name(spark):
    rows, name = numbered(spark.createDataFrame([(1, 2)] * 3, "row int, ROW_ int"), "test")
    assert name not in ("row", "ROW_") and rows.count() == 3
    kept = rows.limit(2).select(name)
    left = only(rows, name, kept)
    assert left.columns == ["row", "ROW_"] and left.count() == 2


def test_shuffle_files_of_a_stored_frame_are_deleted(spark):
    """At once, not when the driver next collects garbage."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum("shuffle_" in name for name in (f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles())))
    before = files()
    kept = stored(spark.range(1000).repartition(5, "id"), "shuffled")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and kept.count() == 1000
    assert spark.conf.get(CLEANUP, "false") == "false"
