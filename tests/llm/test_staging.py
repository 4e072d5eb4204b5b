"""Tables in the shared folder."""

from factweave.llm import staging


def test_stage_drop_and_clear(spark):
    table = staging.stage(spark.range(10).withColumnRenamed("id", "a b"), "t")
    assert table.columns == ["a b"] and table.count() == 10 and staging.shared_dir(spark) in table.inputFiles()[0]
    staging.drop(table)
    other = staging.stage(spark.range(3), "t")
    files = other.inputFiles()
    staging.clear(spark)
    import os

    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_folder_beside_the_warehouse_if_none_is_set():
    import pytest

    def session(warehouse, master):
        class Session:
            class conf:
                @staticmethod
                def get(name, default=None):
                    return {"spark.sql.warehouse.dir": warehouse}.get(name, default)

            class sparkContext:
                pass

        Session.sparkContext.master = master
        return Session()

    assert staging.shared_dir(session("hdfs://x/warehouse/", "yarn")) == "hdfs://x/warehouse/_checkpoints"
    assert staging.shared_dir(session("file:/w", "local[4]")) == "file:/w/_checkpoints"
    for warehouse in ("file:/w", "/w"):
        with pytest.raises(RuntimeError):
            staging.shared_dir(session(warehouse, "spark://host:7077"))
