"""The checkpoint folder on a cluster: a mount that all machines share is used, a machine's own disk is refused."""

import pytest

from quarry import session


def test_shared_mount_is_used_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    folder = session.ensure_checkpoint_dir(spark)
    assert folder.startswith("file:")
    kept = session.materialize(spark.range(5), "mount")
    assert kept.count() == 5 and kept.inputFiles()[0].replace("file:///", "file:/").startswith(folder)
    session.release(kept)


def test_folder_that_loses_rows_is_refused(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_comes_back", lambda *_: False)
    with pytest.raises(RuntimeError, match="machine-local"):
        session.ensure_checkpoint_dir(spark)
