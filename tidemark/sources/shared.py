"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh(spark: SparkSession, kind: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset (a local test), below the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{at.rstrip('/')}/tidemark-{kind}-{uuid.uuid4().hex}"


def kept(df: DataFrame, kind: str, by: str | None = None) -> DataFrame:
    """Rows written into the shared folder, by the values of a column if given, and read from there."""
    path = fresh(df.sparkSession, kind)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def there(rows: DataFrame) -> bool:
    """Whether rows that were kept still are."""
    files = rows.inputFiles()
    if not files:
        return False
    context = rows.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(files[0])
    return path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)
