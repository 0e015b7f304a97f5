import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from eventlens.schema import KNOWN_COLUMNS  # noqa: E402
from eventlens.session import REQUIRED_CONF  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[4]")
        .appName("eventlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    # Use the shared folder the environment names; only a bare session gets its own.
    if not s.conf.get("spark.checkpoint.dir", None) and not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="eventlens-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="eventlens-test-")


def ns(text: str) -> int:
    from eventlens.functions.time import epoch_ns, parse_instant

    return epoch_ns(parse_instant(text))


def make_events(spark, rows):
    """Canonical-schema DataFrame; missing fields default per column."""
    from eventlens.schema import EVENT_SCHEMA

    out = []
    for i, r in enumerate(rows):
        rec = {c: None for c in KNOWN_COLUMNS}
        rec["uuid"] = r.get("uuid", f"u{i:05d}")
        rec["timestamp"] = r.get("timestamp", ns("2025-11-10T12:00:00") + i)
        for k, v in r.items():
            rec[k] = v
        out.append(tuple(rec[c] for c in KNOWN_COLUMNS))
    return spark.createDataFrame(out, EVENT_SCHEMA)
