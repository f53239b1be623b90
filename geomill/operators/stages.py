"""Tables written between steps of iterative operators, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def base(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder is set only where that is unset and the master is local,
    as on a cluster each machine would write to its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="geomill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def folder(spark: SparkSession) -> str:
    """A new folder's name in the shared place."""
    return f"{base(spark)}/files-{uuid.uuid4().hex[:12]}"


def keeper(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table under the shared folder and reads it back, which cuts its lineage."""
    root, n = f"{base(spark)}/steps-{uuid.uuid4().hex[:12]}", iter(range(1 << 30))

    def keep(df: DataFrame) -> DataFrame:
        path = f"{root}/{next(n):04d}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as a shuffle has, for work that costs more than moving them: well packed files have few splits."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
