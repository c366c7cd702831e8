"""Tables written once to the folder that driver and executors share."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; where the session names none (a single machine, as in tests), one
    beside the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/ledgerloom-staging"


def settle(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The table written to the shared folder (or to `folder`, which must be shared) and read back.

    Later stages then start from files that outlive lost executors. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
