"""Where intermediate results go."""

from types import SimpleNamespace

import pytest

from forecourt import workspace


def session(setting, master, checkpoint=None):
    state = {"dir": checkpoint}
    context = SimpleNamespace(
        master=master,
        applicationId="app",
        getCheckpointDir=lambda: state["dir"],
        setCheckpointDir=lambda d: state.update(dir=d),
    )
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=context)


def test_the_session_setting_wins():
    spark = session("hdfs://shared/cp/", "yarn")
    assert workspace.shared_root(spark) == "hdfs://shared/cp"
    assert workspace.fresh_dir(spark, "x").startswith("hdfs://shared/cp/forecourt/app/x-")


def test_a_cluster_never_gets_a_local_folder():
    with pytest.raises(ValueError):
        workspace.shared_root(session(None, "yarn"))


def test_a_local_master_gets_one_folder():
    spark = session(None, "local[2]")
    first = workspace.shared_root(spark)
    assert workspace.shared_root(spark) == first


def test_landed_once_writes_once(monkeypatch):
    spark, written = session("s3a://b/cp", "yarn"), []
    monkeypatch.setattr(workspace, "_landed", {})
    paths = {workspace.landed_once(spark, "s3a://b/in/events.csv", written.append) for _ in range(3)}
    assert len(paths) == 1 and written == list(paths)
    assert ":" not in written[0].split("://", 1)[1]


def test_stored_rows_are_read_back(spark):
    df = spark.range(10).withColumnRenamed("id", "Length(mm)")
    assert workspace.stored(df, "t").agg({"Length(mm)": "sum"}).first()[0] == 45
