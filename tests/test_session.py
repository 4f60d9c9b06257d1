"""Session contract: the shared checkpoint folder is read from the session
and only set when missing; the package is shipped once per application."""

from sendero import session as S


def test_checkpoint_dir_is_read_not_replaced(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert S.checkpoint_dir(spark) == configured
    assert spark.sparkContext.getCheckpointDir() is not None
    assert S.scratch_path(spark, "x").startswith(configured)


def test_package_shipped_once(spark):
    S.ship_package(spark)
    assert spark.sparkContext.applicationId in S._SHIPPED
    before = len(S._SHIPPED)
    S.ship_package(spark)
    assert len(S._SHIPPED) == before
