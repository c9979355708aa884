import pytest

from runout.llm import common, whitening


@pytest.mark.parametrize(("size", "want"), [("64m", 64 << 20), ("16777216b", 16 << 20), ("1G", 1 << 30), (" 2500 ", 2500), ("8kb", 8192), ("-1", -1)])
def test_sizes_with_units(size, want):
    assert common.bytes_of(size) == want


@pytest.mark.parametrize("bound", ["64m", "1g", "1048576b", "512k"])
def test_sessions_with_bounds_of_any_unit(spark, bound):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, bound)
    try:
        df = spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(5)], "vec_id long, embedding array<float>")
        assert whitening.whiten_table(df).count() == 10
        assert 0 < common.bytes_of(spark.conf.get(name)) <= common.ARROW_BATCH[name]
    finally:
        spark.conf.set(name, before)
