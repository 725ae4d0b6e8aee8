import pytest

from cleanloom.operators.fixes import apply_fix
from cleanloom.session import scratch_path
from cleanloom.streaming.cleaning import clean_stream, write_stream


def test_stream_equals_batch(spark):
    source, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    rows = [(i, f" U{i}@gnail.com ", i * 10 - 20, "01/02/2023", "2022-01-01") for i in range(20)]
    batch = spark.createDataFrame(rows, "k int, email string, discount_pct int, order_date string, ship_date string")
    batch.write.parquet(source)
    steps = [("FIX_STRIP_WHITESPACE", "email", {}), ("FIX_EMAIL_TYPOS", "email", {}), ("FIX_CLIP_PERCENTAGE", "discount_pct", {}),
             ("FIX_STANDARDIZE_DATE_FORMAT", "order_date", {}), ("FIX_SWAP_LOGICAL_DATES", "order_date -> ship_date", {})]
    stream = clean_stream(spark.readStream.schema(batch.schema).parquet(source), steps)
    write_stream(stream, out, scratch_path(spark, "progress")).awaitTermination()
    expected = batch
    for fix_id, column, params in steps:
        expected = apply_fix(expected, fix_id, column, params)
    got = spark.read.parquet(out)
    assert got.count() == 20 and got.exceptAll(expected).isEmpty()


def test_refused_on_streams(spark):
    folder = scratch_path(spark, "refused")
    batch = spark.createDataFrame([(1, 2.0)], "k int, v double")
    batch.write.parquet(folder)
    stream = spark.readStream.schema(batch.schema).parquet(folder)
    with pytest.raises(ValueError, match="other rows"):
        clean_stream(stream, [("FIX_FORWARD_FILL", "v", {})])
    with pytest.raises(ValueError, match="parameters"):
        clean_stream(stream, [("FIX_MEDIAN_IMPUTE", "v", {})])
    assert clean_stream(stream, [("FIX_MEDIAN_IMPUTE", "v", {"median_value": 1.0}), ("FIX_DROP_COLUMN", "k", {})]).columns == ["v"]
