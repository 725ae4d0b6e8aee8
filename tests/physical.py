"""What tests ask of physical plans."""


def single_partition_exchanges(df) -> int:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).count("SinglePartition")
