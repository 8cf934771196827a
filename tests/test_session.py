from types import SimpleNamespace

import pytest

from vesselflow.session import fresh_dir, shared_dir


def session(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder or default),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app of {master}"),
    )


def test_the_named_folder_is_used(spark):
    assert shared_dir(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert fresh_dir(spark, "x") != fresh_dir(spark, "x")
    assert fresh_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_only_a_local_session_makes_its_own():
    local = session("local[2]")
    assert shared_dir(local) == shared_dir(local)
    with pytest.raises(ValueError):
        shared_dir(session("yarn"))


def test_days_are_utc(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
