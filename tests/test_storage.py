import pytest
from pyspark.sql import functions as F

from threadstats.storage import scope, shared_folder, written


def _tables(spark):
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return {str(f.getPath()) for f in system.listStatus(folder)} if system.exists(folder) else set()


def test_a_scope_deletes_its_tables_and_hands_on_what_it_keeps(spark):
    before = _tables(spark)
    with scope(spark):
        with scope(spark) as keep:
            kept = keep(written(spark.range(5), "inner").filter("id > 1"), "kept")
        assert kept.count() == 3
        assert len(_tables(spark) - before) == 1
    assert _tables(spark) == before


def test_a_scope_deletes_its_tables_on_failure(spark):
    before = _tables(spark)
    with pytest.raises(ZeroDivisionError):
        with scope(spark):
            written(spark.range(5).select(F.col("id")), "lost")
            1 / 0
    assert _tables(spark) == before
