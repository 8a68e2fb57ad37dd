"""Session helpers: the shared folder and scratch tables."""

import os
import re
from types import SimpleNamespace

import pytest

from ledgerlens.session import ensure_checkpoint_dir, materialized


def _session(master, configured=None):
    state = {"dir": None}
    conf = SimpleNamespace(get=lambda k, d=None: configured or d)
    sc = SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: state["dir"], setCheckpointDir=lambda d: state.update(dir=d))
    return SimpleNamespace(sparkContext=sc)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_session(master))
    assert ensure_checkpoint_dir(_session(master, "s3://b/c")) == "s3://b/c"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_a_local_session_gets_a_scratch_folder(master):
    assert os.path.isdir(ensure_checkpoint_dir(_session(master)))


def test_scratch_tables_go_when_done(spark):
    # scratch tables only: beside them the cleaner removes checkpoints of other tests at any time
    folder = re.sub("^file:/*", "/", ensure_checkpoint_dir(spark)) + "/ledgerlens"
    files = lambda: sorted(f for _, _, names in os.walk(folder) for f in names)
    before = files()
    with materialized(spark.range(10)) as df:
        assert df.count() == 10 and files() != before
    with pytest.raises(RuntimeError), materialized(spark.range(10)):
        raise RuntimeError
    assert files() == before
