"""Reader of the driver's Parquet tables."""

from pyspark.sql import DataFrame, SparkSession

from quern.shared import ship


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
