"""The shared folder: taken from the session, refused where it would be local."""

import os

import pytest

from quarry import session


class FakeContext:
    def __init__(self, master):
        self.master, self.dir = master, None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class FakeSession:
    def __init__(self, master, conf=None):
        self.sparkContext, self.values = FakeContext(master), dict(conf or {})
        self.conf = self

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        session.shared_dir(FakeSession(master))
    assert session.shared_dir(FakeSession(master, {"spark.checkpoint.dir": "hdfs://x/y"})) == "hdfs://x/y"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_local_session_gets_a_folder(master):
    s = FakeSession(master)
    d = session.shared_dir(s)
    assert os.path.isdir(d) and session.shared_dir(s) == d


def test_stage_tables_are_removed(spark):
    kept = session.materialize(spark.range(5), "kept")
    root = session.stage_root(spark)
    assert kept.count() == 5 and os.listdir(root)
    session.clear_stages(spark)
    assert not os.path.exists(root)
