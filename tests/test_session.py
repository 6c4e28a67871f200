from types import SimpleNamespace

import pytest

from nearfield.session import scratch_path, staged, widen


def stub(master, folder):
    conf = SimpleNamespace(get=lambda key, default=None: folder)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_scratch_is_where_the_session_says():
    a, b = (scratch_path(stub("spark://host:7077", "hdfs://shared/tmp/"), "x") for _ in range(2))
    assert a.startswith("hdfs://shared/tmp/nearfield/x-") and a != b


def test_only_local_sessions_fall_back_to_this_machine():
    assert scratch_path(stub("local[2]", None), "x") != scratch_path(stub("local[2]", None), "x")
    with pytest.raises(ValueError, match="checkpoint"):
        scratch_path(stub("yarn", None), "x")


def test_staged_rows_no_longer_depend_on_their_source(spark):
    df = staged(spark.range(10).selectExpr("id * 2 AS x"), "test")
    assert sorted(r["x"] for r in df.collect()) == list(range(0, 20, 2))
    assert "Range" not in df._jdf.queryExecution().analyzed().toString()


def test_widen_only_narrow_inputs(spark):
    slots = spark.sparkContext.defaultParallelism
    assert widen(spark.range(100, numPartitions=1), "id").rdd.getNumPartitions() == slots
    wide = spark.range(100, numPartitions=slots + 3)
    assert widen(wide, "id") is wide
