import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from peerpanel.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=8)
    if not s.sparkContext.getCheckpointDir():
        # tests only: the cluster names its shared folder in spark.checkpoint.dir
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pp-ckpt-"))
    yield s


def make_panel(spark, rows, group="g"):
    """rows: (ts_id, 'YYYY-MM-DD', count) -> canonical panel."""
    import datetime as dt

    from peerpanel.sources.panel import panel

    data = [(group, str(t), dt.date.fromisoformat(d), float(c)) for t, d, c in rows]
    df = spark.createDataFrame(data, "group_id string, ts_id string, date date, count double")
    return panel(df, group_id="group_id")
