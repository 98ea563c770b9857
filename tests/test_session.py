import pytest

from hemicycle import session


class Conf(dict):
    def set(self, key, value):
        self[key] = value


class Fake:
    """As much of a session as the choice of the shared folder reads."""

    def __init__(self, master, folder=None, jvm_folder=None):
        self.conf = Conf({"spark.checkpoint.dir": folder} if folder else {})
        option = type("Option", (), {"isDefined": lambda _: jvm_folder is not None, "get": lambda _: jvm_folder})()
        context = type("Context", (), {"getCheckpointDir": lambda _: option})()
        java = type("Java", (), {"sc": lambda _: context})()
        self.sparkContext = type("PyContext", (), {"_jsc": java, "master": master})()


def test_the_shared_folder_comes_from_the_setting():
    assert session.scratch_dir(Fake("spark://host:7077", "hdfs://shared/x/")) == "hdfs://shared/x"
    assert session.scratch_dir(Fake("yarn", None, "hdfs://jvm/y")) == "hdfs://jvm/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(Fake("yarn"))
    with pytest.raises(ValueError):
        session.scratch_dir(Fake("local-cluster[2,1,1024]"))
    alone = Fake("local[4]")
    assert session.scratch_dir(alone) == session.scratch_dir(alone)


def test_few_tasks_are_spread_and_many_stay(spark):
    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(100, numPartitions=1), spark.range(100, numPartitions=cores + 3)
    assert session.spread(few, "id").rdd.getNumPartitions() == cores and session.spread(many, "id") is many
    assert sorted(r.id for r in session.spread(few, "id").collect()) == list(range(100))
    assert session.numbered(spark, "/tmp/no/such/folder") == []
