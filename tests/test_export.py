import pytest

from eventlens.dataset import EventSet
from eventlens.functions.text import camel_words_text, column_label, title_label
from eventlens.operators.projection import export_frame, table_columns, table_view
from eventlens.sources import sinks
from tests.conftest import make_events, ns

RANGE = ("2025-11-10", "2025-11-10")


def test_export_projection_drops_hidden_and_relabels(spark):
    df = make_events(spark, [{"timestamp": ns("2025-11-10T12:57:14.062068"), "username": "u"}])
    df = df.withColumn("workspaceId", df.uuid).withColumn("zExtra", df.uuid)
    out = export_frame(df)
    assert out.columns == [
        "Date & Time (UTC)", "User Name", "Event", "File Path", "Project Name", "Project ID",
        "Workspace Name", "Workspace ID", "Environment Name", "Hardware Tier ID", "zExtra",
    ]
    assert out.collect()[0]["Date & Time (UTC)"] == "2025-11-10T12:57:14.062068"


def test_table_view_titles(spark):
    df = make_events(spark, [{"timestamp": ns("2025-11-10T01:02:03.5")}])
    out = table_view(df)
    assert out.columns[:3] == ["DATE & TIME (UTC)", "USER NAME", "EVENT"]
    assert "UUID" not in out.columns and "USER ID" not in out.columns
    assert out.collect()[0][0] == "11/10/2025, 01:02:03"
    assert table_columns(["x", "uuid", "timestamp"]) == ["timestamp", "x"]


def test_labels():
    assert column_label("hardwareTierId") == "Hardware Tier ID"
    assert column_label("someNewColumn") == "some New Column"
    assert title_label("action") == "EVENT"
    assert camel_words_text("InProgress") == "In Progress"


def test_csv_roundtrip_quotes_commas_newlines_nulls(spark, tmp_dir):
    values = ['say "hi"', "a,b", "line1\nline2", None, ""]
    ev = EventSet.from_frame(make_events(spark, [{"filename": v} for v in values]), *RANGE)
    path = ev.export_csv(path=f"{tmp_dir}/out.csv")
    frame = ev.export_frame()
    back = sinks.read_csv_export(spark, path, frame.schema).collect()
    got = sorted((r["File Path"] or "<null>") for r in back)
    assert got == sorted(['say "hi"', "a,b", "line1\nline2", "<null>", "<null>"])
    text = "".join(open(p).read() for p in __import__("glob").glob(f"{path}/part-*.csv"))
    assert '"say ""hi"""' in text and '"a,b"' in text


def test_parquet_export_keeps_label_names(spark, tmp_dir):
    ev = EventSet.from_frame(make_events(spark, [{"filename": "x"}]), *RANGE)
    path = ev.export_parquet(path=f"{tmp_dir}/out.parquet")
    back = spark.read.parquet(path)
    assert "Date & Time (UTC)" in back.columns and back.count() == 1


def test_export_name():
    from datetime import datetime

    assert sinks.export_name("csv", datetime(2025, 11, 10, 1, 2, 3)) == "workspace_audit_events_20251110_010203.csv"



def test_single_file_is_joined_from_parallel_parts(spark, tmp_dir):
    import csv
    import os

    from pyspark.sql import functions as F

    from eventlens.sources import sinks

    df = spark.range(0, 1000, 1, 7).select(
        F.col("id").alias("Row, id"), F.when(F.col("id") % 5 == 0, 'a "quoted",\nline').otherwise(F.lit(None)).alias("text")
    )
    path = sinks.write_csv(df, f"{tmp_dir}/one.csv", single_file=True)
    files = [f for f in os.listdir(path) if not f.startswith((".", "_"))]
    assert files == ["part-00000.csv"]
    with open(f"{path}/part-00000.csv", newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0] == ["Row, id", "text"] and [int(r[0]) for r in rows[1:]] == list(range(1000))
    assert all(r[1] == ('a "quoted",\nline' if int(r[0]) % 5 == 0 else "") for r in rows[1:])
    back = sinks.read_csv_export(spark, path, df.schema)
    assert back.count() == 1000
    with pytest.raises(Exception):
        sinks.write_csv(df, path, single_file=True)
    empty = sinks.write_csv(df.limit(0), f"{tmp_dir}/none.csv", single_file=True)
    assert sinks.read_csv_export(spark, empty, df.schema).count() == 0
