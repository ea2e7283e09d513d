from types import SimpleNamespace

import pytest

from latchflow.plans.session import fresh_dir, shared_dir


def session(master, setting=None):
    given = []
    context = SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: given[-1] if given else None,
        setCheckpointDir=given.append,
    )
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: setting)), given


def test_the_cluster_names_the_shared_folder():
    spark, given = session("yarn", "hdfs:///shared")
    assert shared_dir(spark) == "hdfs:///shared" and given == ["hdfs:///shared"]
    assert fresh_dir(spark, "events").startswith("hdfs:///shared/events-")


def test_no_local_folder_on_a_cluster():
    spark, _ = session("yarn")
    with pytest.raises(ValueError):
        shared_dir(spark)


def test_local_sessions_take_one_temporary_folder():
    spark, given = session("local[2]")
    assert shared_dir(spark) == shared_dir(spark) == given[0] and len(given) == 1
