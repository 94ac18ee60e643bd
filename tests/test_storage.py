"""Where intermediate tables may go."""

from types import SimpleNamespace

import pytest

from civictopics.storage import CLEANUP, cut, new_path, scratch, settled, shared_folder


def session(master, configured=None, checkpoint=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: configured if key == "spark.checkpoint.dir" else default),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint),
    )


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session(master))
    assert shared_folder(session(master, "hdfs:///shared")) == "hdfs:///shared"
    assert shared_folder(session(master, None, "hdfs:///set/on/context")) == "hdfs:///set/on/context"


def test_one_machine_gets_a_folder_of_its_own():
    assert "civictopics-" in shared_folder(session("local[4]"))
    assert new_path(session("local[*]", "/given/"), "t").startswith("/given/civictopics/t-")


def test_scratch_tables_are_deleted(spark):
    before = cut(spark.range(3).toDF("a"), "kept")
    with scratch(spark):
        inside = cut(spark.range(5).toDF("a"), "gone")
        assert inside.count() == 5
        place = inside.inputFiles()[0]
    assert before.count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_settled_keeps_only_its_result(spark):
    places = []

    def make():
        inside = cut(spark.range(5).toDF("a"), "gone")
        places.append(inside.inputFiles()[0])
        return inside.filter("a > 1")

    assert sorted(r.a for r in settled(spark, "stays", make).collect()) == [2, 3, 4]
    path = spark._jvm.org.apache.hadoop.fs.Path(places[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_what_a_written_table_has_shuffled_is_deleted(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        names = (f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files.getAllFiles()))
        return {n for n in names if n.startswith("shuffle_")}

    before, kept = shuffled(), spark.conf.get(CLEANUP)
    table = cut(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count().repartition(3, "k"), "grouped")
    assert sorted(r["count"] for r in table.collect()) == [142, 143, 143, 143, 143, 143, 143]
    assert shuffled() <= before and spark.conf.get(CLEANUP) == kept
