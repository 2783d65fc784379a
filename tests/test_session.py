from types import SimpleNamespace

import pytest

from surveyloom import session as S


def test_spread_leaves_other_tables_alone(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(100).coalesce(1).write.parquet(path)
    one = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    assert S.spread(one).rdd.getNumPartitions() == cores
    assert S.spread(one).count() == 100
    memory = spark.range(10)
    assert S.spread(memory) is memory
    assert S.spread(one, 0) is one and S.spread(one, 1) is one


def session_like(configured, current, master):
    """What shared_dir asks of a session; the setting is fixed once a context runs."""
    dirs = [current]
    context = SimpleNamespace(
        getCheckpointDir=lambda: dirs[-1], setCheckpointDir=dirs.append, master=master
    )
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: configured), sparkContext=context), dirs


def test_the_configured_folder_wins():
    like, dirs = session_like("hdfs://shared/cp", None, "yarn")
    assert S.shared_dir(like) == "hdfs://shared/cp" and dirs[-1] == "hdfs://shared/cp"
    assert S.fresh_path(like, "x").startswith("hdfs://shared/cp/x-")


def test_no_machine_local_folder_on_a_cluster():
    like, _ = session_like(None, None, "yarn")
    with pytest.raises(RuntimeError):
        S.shared_dir(like)
    like, dirs = session_like(None, None, "local[2]")
    assert S.shared_dir(like) == dirs[-1]


def test_materialised_tables_lie_in_the_folder(spark):
    df = S.materialise(spark.range(5), "x")
    assert df.count() == 5 and S.shared_dir(spark).removeprefix("file:") in df.inputFiles()[0]
