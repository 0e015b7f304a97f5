import io
import json
from contextlib import redirect_stdout

from eventlens.__main__ import main
from eventlens.sources.testdata import audit_frame
from tests.conftest import SF001


def run(argv):
    buf = io.StringIO()
    with redirect_stdout(buf):
        code = main(argv)
    return code, json.loads(buf.getvalue())


def test_cli_requests(spark, tmp_dir):
    path = f"{tmp_dir}/events"
    audit_frame(spark, SF001).write.parquet(path)
    rng = ["--paths", path, "--start", "2024-01-01", "--end", "2024-01-31"]

    code, out = run(["data", *rng, "--page-size", "3"])
    assert code == 0 and out["total"] == 1000 and len(out["data"]) == 3
    assert "T" in out["data"][0]["timestamp"]

    body = json.dumps({"filters": {"action": ["click"]}, "page": 2, "pageSize": 10})
    code, out = run(["query", *rng, "--body", body, "--chart-field", "username"])
    assert code == 0 and out["page"] == 2 and len(out["data"]) == 10
    assert sum(p["event_count"] for p in out["chart"]) == out["total"]

    code, out = run(["columns", *rng, "--columns", "action", "projectName"])
    assert out["columns"]["action"]["values"] == ["click", "error", "purchase", "signup", "view"]
    assert out["columnLabels"]["action"] == "Event"

    code, out = run(["filtered-columns", *rng, "--body", json.dumps({"filters": {"action": ["click"]}})])
    assert set(out["columns"]) == {"action", "username", "projectName", "filename"}
    assert out["columns"]["action"]["countLabel"] == "(5)"
    code, approx = run(["filtered-columns", *rng, "--approx", "--body", json.dumps({"filters": {"action": ["click"]}})])
    assert {c: v["values"] for c, v in approx["columns"].items()} == {c: v["values"] for c, v in out["columns"].items()}
    code, cut = run(["columns", *rng, "--columns", "uuid", "--prelimit"])
    assert len(cut["columns"]["uuid"]["values"]) == 1000

    code, out = run(["download", *rng, "--body", body, "--format", "parquet", "--out", f"{tmp_dir}/dl"])
    assert spark.read.parquet(out["path"]).count() > 0

    code, out = run(["query", *rng, "--body", json.dumps({"filters": {"nope": ["x"]}})])
    assert code == 2 and "unknown filter column" in out["error"]


def test_cli_sync_appends_once(spark, tmp_dir):
    from tests.conftest import make_events

    landing, table, ckpt = f"{tmp_dir}/landing", f"{tmp_dir}/table", f"{tmp_dir}/ckpt"
    make_events(spark, [{"uuid": f"a{i}"} for i in range(12)]).write.parquet(landing)
    args = ["sync", "--landing", landing, "--table", table, "--checkpoint", ckpt]
    code, first = run(args)
    assert code == 0 and first["rows"] == 12 and first["status"] == "Completed"
    code, second = run(args)
    assert second["rows"] == 0 and spark.read.parquet(table).count() == 12


def test_cli_single_file_csv_download(spark, tmp_dir):
    import glob

    path = f"{tmp_dir}/events"
    audit_frame(spark, SF001).repartition(4).write.parquet(path)
    rng = ["--paths", path, "--start", "2024-01-01", "--end", "2024-01-31"]
    code, out = run(["download", *rng, "--format", "csv", "--single-file", "--out", f"{tmp_dir}/dl"])
    assert code == 0 and out["path"].endswith(".csv")
    assert len(glob.glob(f"{out['path']}/part-*.csv")) == 1


def test_cli_default_range_is_last_week(spark, tmp_dir):
    path = f"{tmp_dir}/events"
    audit_frame(spark, SF001).write.parquet(path)
    code, out = run(["data", "--paths", path, "--end", "2024-01-10", "--page-size", "2"])
    assert code == 0 and len(out["data"]) == 2
    from eventlens.dataset import EventSet
    ev = EventSet.load(spark, path, "2024-01-03", "2024-01-10")
    assert out["total"] == ev.total()
    assert repr(ev).startswith("EventSet(2024-01-03 .. 2024-01-10")
