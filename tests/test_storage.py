"""The folder of intermediate tables: shared by all executors, with its scheme."""

from types import SimpleNamespace

import pytest

from tidemark.functions import storage


def as_if(spark, master, **settings):
    """The session with another master and other settings."""
    context = spark.sparkContext
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default=None: settings.get(name.replace(".", "_"), default)),
        sparkContext=SimpleNamespace(master=master, _jvm=context._jvm, _jsc=context._jsc, getCheckpointDir=lambda: None),
    )


def test_paths_have_a_scheme(spark):
    assert storage.new_path(spark).startswith("file:/")


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"])
def test_own_disks_are_refused_as_shared_folder(spark, master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(as_if(spark, master, spark_sql_warehouse_dir="/tmp/warehouse"))
    named = as_if(spark, master, spark_sql_warehouse_dir="/tmp/warehouse", spark_checkpoint_dir="/tmp/shared/")
    assert storage.shared_dir(named) == "file:/tmp/shared"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_one_machine_may_use_its_warehouse(spark, master):
    assert storage.shared_dir(as_if(spark, master, spark_sql_warehouse_dir="/tmp/warehouse")) == "file:/tmp/warehouse/_tidemark"


def test_release_deletes_the_table(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    written = storage.settle(spark.range(5).toDF("x"))
    path = Path(urlparse(written._settled_at).path)
    assert written.count() == 5 and path.exists()
    storage.release(written)
    assert not path.exists()
