from types import SimpleNamespace

import pytest

from leakloom import session


def fake(master, conf=None, checkpoint=None):
    chosen = []
    context = SimpleNamespace(
        master=master, getConf=lambda: SimpleNamespace(get=lambda k: conf),
        getCheckpointDir=lambda: chosen[-1] if chosen else checkpoint, setCheckpointDir=chosen.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf), sparkContext=context), chosen


def test_the_configured_folder_wins():
    spark, chosen = fake("spark://host:7077", conf="s3a://shared/cp")
    assert session.work_dir(spark, "x").startswith("s3a://shared/cp/x-") and chosen == ["s3a://shared/cp"]


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError):
        session.work_dir(fake("yarn")[0], "x")


def test_an_existing_checkpoint_folder_is_used():
    spark, chosen = fake("yarn", checkpoint="hdfs://nn/cp")
    assert session.work_dir(spark, "x").startswith("hdfs://nn/cp/x-") and not chosen


def test_work_dirs_are_fresh(spark):
    assert session.work_dir(spark, "x") != session.work_dir(spark, "x")


def test_complete_folders(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "done"))
    (tmp_path / "broken").mkdir()
    (tmp_path / "file").write_text("x")
    assert session.complete_folders(spark, str(tmp_path)) == ["done"]
    assert session.complete_folders(spark, str(tmp_path / "none")) == []
