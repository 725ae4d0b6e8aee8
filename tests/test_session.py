import pytest

from cleanloom import session


def test_scratch_lies_in_the_configured_folder_and_can_be_released(spark, monkeypatch):
    monkeypatch.setattr(session, "_written", [])
    path = session.scratch_path(spark, "probe")
    assert path.startswith(spark.sparkContext.getConf().get(session.CHECKPOINT_CONF))
    spark.range(2).write.parquet(path)
    assert session.release_scratch(spark) == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_lineage_is_cut_by_a_reliable_checkpoint(spark):
    df = session.cut_lineage(spark.range(5).selectExpr("id * 2 as x"))
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().executedPlan().toString()
