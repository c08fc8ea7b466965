"""Session helpers: the documented cluster settings are valid Spark settings; checkpoints go to the
configured shared folder."""

from driftwise.session import SCALE_CONF, ensure_checkpoint_dir, scratch_path


def test_scale_conf_is_accepted_by_spark(spark):
    old = {k: spark.conf.get(k, None) for k in SCALE_CONF}
    try:
        for k, v in SCALE_CONF.items():
            spark.conf.set(k, v)
            assert spark.conf.get(k) == v
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_scratch_paths_live_under_the_checkpoint_folder(spark):
    base = ensure_checkpoint_dir(spark)
    conf = spark.conf.get("spark.checkpoint.dir")
    p1, p2 = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert p1 != p2 and p1.startswith(conf.rstrip("/")) and base
