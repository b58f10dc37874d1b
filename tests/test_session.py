"""Session helpers: the shared checkpoint folder is read from the session."""

from tablelens.session import DEFAULT_CONF, ensure_checkpoint_dir, shared_dir


def test_checkpoint_dir_comes_from_the_session(spark):
    root = ensure_checkpoint_dir(spark)
    assert root and root == (spark.sparkContext.getCheckpointDir() or root)


def test_shared_dirs_are_fresh_subfolders(spark):
    root = ensure_checkpoint_dir(spark)
    a, b = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert a != b and a.startswith(root) and b.startswith(root)


def test_defaults_keep_the_ui_off_and_aqe_on():
    assert DEFAULT_CONF["spark.ui.enabled"] == "false"
    assert DEFAULT_CONF["spark.sql.adaptive.enabled"] == "true"
    assert DEFAULT_CONF["spark.sql.adaptive.skewJoin.enabled"] == "true"
